"""What showed on larger tables: order of rows, copies of texts, sizes that must not grow with a product."""

import random

import pytest
from test_ingest import BASE, DELTA, entry, packed
from test_operators import brute_renames, found_renames

from auditlake.operators import chains, likeness
from auditlake.operators import history as H
from auditlake.operators.chains import Reach, chain_places
from auditlake.sources import ingest as I


def test_chains_do_not_depend_on_the_order_of_edges(spark):
    # Edges without indexes, as objects.reachable is given them: all parents are equal.
    rows = [(k, k - d, 0) for k in range(2, 60) for d in (1, 2) if k - d > 0]
    seen = []
    for edges in (rows, rows[::-1]):
        df = spark.createDataFrame(edges, "child long, parent long, parent_index int").coalesce(1)
        seen.append({(r.node, r.chain, r.pos) for r in chain_places(df.select(df.child.alias("node")), df).collect()})
    assert seen[0] == seen[1]


@pytest.mark.parametrize("pairs", [100, 1_000_000])
def test_common_lines_do_not_change_which_texts_are_paired(spark, monkeypatch, pairs):
    # Texts of few common lines, some of them with a rare one, which must not be paired before likelier ones that share none.
    monkeypatch.setattr(likeness, "PAIRS", pairs, raising=False)
    rng = random.Random(5)
    text = lambda k: "\n".join([*[rng.choice(["a long line that many texts have", "}", "x = 1"]) for _ in range(rng.randint(1, 4))], *[f"rare {k % 30}"] * (k % 3 == 0)])
    old, new = ([(f"{s}{k}", text(k)) for k in range(60)] for s in "da")
    assert found_renames(spark, old, new) == brute_renames(old, new)


def test_prerequisites_are_counted_without_pairs(spark):
    # 1 <- 2 <- 3 <- 4, 3 <- 5; 6 alone. One prerequisite is named twice, one has no edges.
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 3, 0)], "child long, parent long, parent_index int")
    reach = Reach(edges)
    starts = spark.createDataFrame([("b", 4), ("b", 5), ("b", 2), ("b", 6), ("c", 4)], "bundle_id string, start long")
    asked = spark.createDataFrame([("b", 3), ("b", 3), ("b", 1), ("b", 6), ("c", 2)], "bundle_id string, node long")
    labels = reach.labels(starts.select("start", starts.start.alias("node")).distinct())
    got: dict = {}
    for r in reach.counted(labels.join(starts, "start"), asked).collect():
        n, least = got.get((r.bundle_id, r.start), (0, 99))
        got[r.bundle_id, r.start] = (n + r.n, min(least, r.least))
    assert got == {("b", 4): (3, 1), ("b", 5): (3, 1), ("b", 2): (1, 1), ("b", 6): (1, 6), ("c", 4): (1, 2)}


def test_packages_of_one_receiver_share_what_it_has(spark):
    far = lambda k: entry(7, DELTA, bytes([k]) * 20)
    packs = spark.createDataFrame([("p", packed([far(1)])), ("q", packed([far(1), far(2)])), ("r", packed([far(1)]))], "bundle_id string, pack binary")
    base = spark.createDataFrame([("x", "01" * 20, "blob", BASE), ("x", "03" * 20, "blob", BASE), ("y", "02" * 20, "blob", BASE)], "receiver string, oid string, kind string, content binary")
    whose = spark.createDataFrame([("p", "x"), ("q", "x"), ("r", "y")], "bundle_id string, receiver string")
    got = {(r.bundle_id, r.idx): r.resolved_via for r in I.ingest_packs(packs, base, whose).collect()}
    assert got == {("p", 0): "baseline", ("q", 0): "baseline", ("q", 1): None, ("r", 0): None}


def drawn(n, seed, parents=2):
    rng = random.Random(seed)
    return [(c, p, k) for c in range(2, n) for k, p in enumerate(dict.fromkeys(rng.randint(max(1, c - 9), c - 1) for _ in range(rng.randint(0, parents))))]


def above(edges, start, here=None):
    seen, left = set(), [start]
    while left:
        x = left.pop()
        if x not in seen and (here is None or x in here):
            seen.add(x)
            left += [p for c, p, _ in edges if c == x]
    return seen


def test_shortcuts_grow_with_the_crossings(spark):
    edges = spark.createDataFrame(drawn(400, 2, 4), "child long, parent long, parent_index int")
    reach = Reach(edges)
    landed = reach.cross.select("to_chain", "to_pos").distinct().count()
    assert 0 < reach.short.count() <= (chains.DOUBLINGS + 1) * landed


def test_first_head_and_lacking_parents_by_brute_force(spark):
    rows, rng = drawn(120, 4), random.Random(6)
    edges = spark.createDataFrame(rows, "child long, parent long, parent_index int")
    heads = [("b", k, f"h{k}", rng.randint(60, 119)) for k in range(9)]
    df = spark.createDataFrame(heads, "bundle_id string, head_index int, reference string, oid long")
    found = spark.createDataFrame([("b", k) for k in range(1, 120)], "bundle_id string, oid long")
    want = {x: next((r for _, _, r, o in heads if x in above(rows, o)), None) for x in range(1, 120)}
    assert {r.oid: r.reference for r in H.needed_by(found, df, edges).collect()} == want
    here = {repo: {x for x in range(1, 120) if x % d} for repo, d in ((1, 7), (2, 5))}
    commits = spark.createDataFrame([(r, x) for r, xs in here.items() for x in xs], "repo int, id long")
    pre = [30, 41]
    tips = df.crossJoin(commits.select("repo").distinct()).select("bundle_id", "repo", "oid")
    got = {(r.repo, r.kind, r.oid) for r in H.dangling(tips, spark.createDataFrame([("b", x) for x in pre], "bundle_id string, oid long"), commits, edges).collect()}
    lost = set()
    for repo, xs in here.items():
        walked = set().union(*[above(rows, o, xs) for *_, o in heads]) - set().union(*[above(rows, o, xs) for o in pre])
        lost |= {(repo, "head", o) for *_, o in heads if o not in xs}
        lost |= {(repo, "parent", p) for c, p, _ in rows if c in walked and p not in xs and p not in pre}
    assert got == lost


def test_ends_on_one_chain_are_not_walked(spark, monkeypatch):
    walked, labels = [], Reach.labels
    monkeypatch.setattr(Reach, "labels", lambda self, starts: (walked.append(starts.count()), labels(self, starts))[1])
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 2, 0), (4, 5, 1)], "child long, parent long, parent_index int")
    commits = spark.createDataFrame([(k, k) for k in range(1, 7)], "id long, time long")
    pairs = spark.createDataFrame([(5, 2), (1, 5), (3, 3), (6, 6), (3, None)], "a long, b long")
    assert {(r.a, r.b): r.merge_base for r in H.merge_base(pairs, commits, edges).collect()} == {(5, 2): 2, (1, 5): 1, (3, 3): 3, (6, 6): 6, (3, None): None}
    assert walked == [0]
    far = spark.createDataFrame([(4, 5), (5, 3), (6, 2)], "a long, b long")
    assert {(r.a, r.b): r.merge_base for r in H.merge_base(far, commits, edges).collect()} == {(4, 5): 5, (5, 3): 2, (6, 2): None}
