"""Contaminated documents against an alignment of every document with every item, by a plain table."""

import random
import re

from auditlake.llm.common import staged
from auditlake.llm.op02_decontamination import contaminated

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(item, text):
    """Score and longest exact run of the best local alignment, cell by cell."""
    before, runs, best, longest = [0] * (len(text) + 1), [0] * (len(text) + 1), 0, 0
    for w in item:
        row, run = [0] * (len(text) + 1), [0] * (len(text) + 1)
        for j, x in enumerate(text, 1):
            row[j] = max(0, before[j - 1] + (2 if x == w else -1), before[j] - 1, row[j - 1] - 1)
            run[j] = runs[j - 1] + 1 if x == w else 0
        best, longest = max(best, *row), max(longest, *run)
        before, runs = row, run
    return best / (2 * len(item)), longest


def edited(rng, item, vocabulary, share):
    out = []
    for w in item:
        r = rng.random()
        if r < share / 2:
            out.append(rng.choice(vocabulary))
        elif r < share * 3 / 4:
            out += [w, rng.choice(vocabulary)]
        elif r >= share:
            out.append(w)
    return out


def test_recall_on_edited_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [[rng.choice(vocabulary[: 3000 if n < 6 else None]) for _ in range(n)] for n in (1, 2, 3, 4, 6, 9, 12, 12, 20, 35, 59)]
    items[0], items[1] = ["photosynthesis"], ["quantum", "entanglement"]
    docs = []
    for k in range(240):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if k % 4:
            at = rng.randint(0, len(body))
            body[at:at] = edited(rng, rng.choice(items), vocabulary, rng.choice([0, 0, 0.1, 0.2, 0.35]))
        docs.append((k, " ".join(body)))
    docs += [(900, "Photosynthesis!"), (901, "quantum entanglement"), (902, " ".join(items[-1][10:38])), (903, None), (904, "")]
    # Every third word of an item of twelve replaced, and a word put after each.
    docs += [(905, " ".join("x" if i % 3 == 2 else w for i, w in enumerate(items[6]))), (906, " ".join(f"{w} x" if i % 3 == 0 else w for i, w in enumerate(items[7])))]
    want = {}
    for d, text in docs:
        for i, item in enumerate(items):
            t = words(text)
            score, run = plain(item, t) if t else (0, 0)
            if score >= 0.5 or run >= 25:
                want[d, i] = score
    table = staged(spark.createDataFrame(docs, "doc_id long, text string"), "docs")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(table, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {(900, 0), (901, 1), (902, 10), (905, 6), (906, 7)} <= set(got)
    assert len(got) >= 0.9 * len(want) > 100


def test_against_all_pairs_of_the_smallest_tables(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: words(r.text) for r in benchmark.collect()}
    want = set()
    for d in docs.select("doc_id", "text").collect():
        t = words(d.text)
        known = set(t)
        for i, item in items.items():
            # No alignment can count with fewer words in common.
            if sum(w in known for w in item) >= min(0.5 * len(item), 25):
                score, run = plain(item, t)
                if score >= 0.5 or run >= 25:
                    want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 0
