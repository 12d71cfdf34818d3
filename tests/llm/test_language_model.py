"""Seating, totals and frequent words of op10."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from auditlake.llm import op10_pitman_yor as P
from auditlake.llm.common import small_batches, staged


def test_chance_of_sitting_alone():
    # Of three customers at two tables one sits alone; of two at two both do.
    got = P.alone(np.array([3, 2, 2, 5]), np.array([2, 2, 1, 5]))
    assert np.allclose(got, [1 / 3, 1, 0, 1])
    # The saddle point goes on where the exact numbers end.
    c, t = np.array([P.EXACT, P.EXACT + 1]), np.array([40, 40])
    exact, beyond = P.alone(c, t)
    assert abs(exact / beyond - 1) < 0.05


def test_a_sweep_moves_every_customer():
    # A pair of a million customers, and 20,000 pairs of the same word that have one each.
    c, others = 1_000_000, 20_000
    part = SimpleNamespace(customers=np.array([c] + [1] * others), of_word=np.zeros(others + 1, np.int64), context=np.array([3] + [4] * others), n_words=1, seed=1)
    tables = np.zeros(P.CONTEXTS)
    tables[3] = tables[4] = 50_000
    start = int(P.first_tables(part.customers)[0])
    got = [int(t[0]) for t in P.sweeps(part, [tables] * 12, 1000)]
    # Far more tables than one for each step are opened or closed in a sweep, and seating settles where both are as likely.
    assert abs(got[0] - start) > 1000

    def surplus(t):
        fresh = (P.STRENGTH + P.DISCOUNT * tables[3]) * P.parent_probability(np.array([t + others]), tables.sum(), 1000)[0]
        return fresh / (fresh + c - 1 - P.DISCOUNT * t) - P.alone(np.array([c]), np.array([t]))[0]

    assert abs(surplus(got[-1])) < 0.1 * P.alone(np.array([c]), np.array([got[-1]]))[0]


def stirling(c, discount):
    """Generalised Stirling numbers: the weight of c customers at t tables, t from 0 to c."""
    s = [1.0]
    for n in range(c):
        s = [(s[t - 1] if t else 0) + ((n - discount * t) * s[t] if t < len(s) else 0) for t in range(n + 2)]
    return np.array(s)


def test_the_parent_is_seated_as_enumeration_says():
    # Each of n words has a pair of three customers and four pairs of one: all seatings, by tables of the pair and in the parent.
    n = 4000
    part = SimpleNamespace(customers=np.tile([3, 1, 1, 1, 1], n), of_word=np.repeat(np.arange(n), 5), context=np.tile(np.arange(5), n), n_words=n, seed=1)
    tables, parent, vocabulary = np.zeros(P.CONTEXTS), 900.0, 500
    tables[0], tables[9] = 8, 3
    base = (P.PARENT_STRENGTH + P.PARENT_DISCOUNT * parent) / (vocabulary + 1)
    weight = (P.STRENGTH + P.DISCOUNT * 8) / (P.PARENT_STRENGTH + 11)
    true = np.zeros((4, 8))
    for t in (1, 2, 3):
        for top in range(1, t + 5):
            true[t, top] = stirling(3, P.DISCOUNT)[t] * weight**t * stirling(t + 4, P.PARENT_DISCOUNT)[top] * base**top
    got = np.zeros((4, 8))
    for k, both in enumerate(P.sweeps(part, [tables] * 30, vocabulary, [parent] * 30)):
        assert len(both) == 6 * n and both[: 5 * n].reshape(n, 5)[:, 1:].max() == 1
        if k >= 10:
            np.add.at(got, (both[: 5 * n : 5], both[5 * n :]), 1 / (20 * n))
    assert abs(got - true / true.sum()).max() < 0.01
    assert got[:, 2:].sum() > 0.5


def test_the_parents_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(0, 300, 2000) ** 2 // 300)
    of_word = np.unique(words, return_inverse=True)[1]
    part = SimpleNamespace(customers=rng.geometric(0.2, 2000) * rng.integers(1, 40, 2000), of_word=of_word, context=rng.integers(0, 50, 2000), n_words=int(of_word.max()) + 1, seed=2)
    totals = np.bincount(part.context, P.first_tables(part.customers), P.CONTEXTS)
    for both in P.sweeps(part, [totals] * 4, part.n_words, [float(part.n_words)] * 4):
        customers, tables = np.bincount(of_word, both[:2000]), both[2000:]
        assert (tables >= 1).all() and (tables <= customers).all()
    assert tables.sum() > part.n_words
    args = float(customers.sum()), part.n_words
    p = P.parent_probability(np.append(customers, 0), *args, np.append(tables, 0), float(tables.sum()))
    assert math.isclose(p.sum(), 1)


def test_frequent_words_are_added_up_first(spark):
    # One word has nearly all tokens; a task sends one row for each of its contexts, and its contexts are scored apart.
    texts = pa.array(["hot " * 50 + f"w{k % 40} hot" for k in range(2000)])
    batch = pa.RecordBatch.from_arrays([pa.array([True] * 2000), texts], names=["train", "text"])
    (rows,) = P._counter(8)(iter([batch, batch]))
    assert len(rows) < 200 and sum(rows.column("n").to_pylist()) == 2 * 2000 * 53
    assert len(set(P._shard(np.full(50, 7, np.uint64), np.arange(50), 8))) > 4


def test_batches_of_packs_are_small(spark):
    # 40 packs of a megabyte in one partition come in several batches, and all of them come.
    packs = small_batches(staged(spark.range(40).coalesce(1).selectExpr("id", "cast(repeat('x', 1 << 20) as binary) as words"), "packs"))
    sizes = packs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 40
    assert max(r["size"] for r in sizes) <= 12 << 20


def test_scores_add_up(spark):
    rows = [(k, f"a b {'c' * (k % 3 + 1)} a b") for k in range(60)] + [(None, "a b"), (61, "never seen"), (1, "a b cc a b")]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    got = P.pitman_yor_scores(docs).collect()
    assert len(got) == 63 and Counter(r.doc_id for r in got)[1] == 2 and Counter(r.doc_id for r in got)[None] == 1
    held = {r.doc_id: r.h for r in docs.select("doc_id", (P.remainder("doc_id", 7) == 2).alias("h")).collect()}
    words = Counter(w for d, t in rows if not held[d] for w in [*t.split(), "</s>"])
    n, v = sum(words.values()), len(words)
    by_id = {}
    for r in got:
        assert r.held_out == held[r.doc_id] and r.train_tokens == n
        by_id[r.doc_id] = r
    for d, t in rows:
        tokens = [*t.split(), "</s>"]
        assert by_id[d].n_tokens == len(tokens) and by_id[d].n_known == sum(w in words for w in tokens)
        assert math.isclose(by_id[d].base_score, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
