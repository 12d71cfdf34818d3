"""Edge rules on tiny tables."""

import pytest
from pyspark.sql import Row

from auditlake.operators import history as H
from auditlake.operators import ledger as LE
from auditlake.operators import lines as L
from auditlake.operators import objects as O
from auditlake.operators import receive as R
from auditlake.operators import snapshot as S


def test_line_counts(spark):
    # A last line without newline differs from the same line with one.
    pairs = [("a\nb\nc", "a\nx\nc"), ("", "a\n"), ("a\n", "a"), ("a\nb\nc\nd\n", "b\nd\ne\n"), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, old_text string, new_text string")
    got = {r.i: (r.additions, r.deletions) for r in L.line_counts(df).collect()}
    assert got == {0: (1, 1), 1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (0, 0)}


def test_merge_base_and_range(spark):
    commits = spark.createDataFrame([(i, i) for i in range(1, 7)], "id long, time long")
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 2, 0), (5, 3, 0), (5, 4, 1)], "child long, parent long, parent_index int")
    pairs = spark.createDataFrame([(3, 4), (5, 6), (5, 3)], "a long, b long")
    assert {(r.a, r.b): r.merge_base for r in H.merge_base(pairs, commits, edges).collect()} == {(3, 4): 2, (5, 6): None, (5, 3): 3}
    ranges = spark.createDataFrame([("r", 5, 2)], "range_id string, tip long, hidden long")
    assert {r.node for r in H.commit_range(ranges, edges).collect()} == {3, 4, 5}


def test_apply_then_roll_back_is_identity(spark):
    refs = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo string, ref_name string, oid string")
    updates = spark.createDataFrame([("x", "r", "a", "1", "9"), ("x", "r", "c", None, "8"), ("y", "r", "b", "stale", "7")], "bundle_id string, repo string, ref_name string, expected_old string, new_oid string")
    after, failed = R.apply_updates(refs, updates)
    assert {(r.ref_name, r.oid) for r in after.collect()} == {("a", "9"), ("b", "2"), ("c", "8")}
    assert [r.ref_name for r in failed.collect()] == ["b"]
    back, report = R.roll_back(after, updates.where("bundle_id = 'x'"))
    assert {(r.ref_name, r.oid) for r in back.collect()} == {("a", "1"), ("b", "2")}
    assert {(r.ref_name, r.outcome) for r in report.collect()} == {("a", "restored"), ("c", "deleted")}


def test_swapped_sides_mirror(spark):
    old = spark.createDataFrame([Row(path="a", mode="100644", oid="1"), Row(path="b", mode="100644", oid="2")])
    new = spark.createDataFrame([Row(path="a", mode="120000", oid="1"), Row(path="c", mode="100644", oid="3")])
    one = {(r.path, r.status) for r in S.snapshot_diff(old, new).collect()}
    two = {(r.path, r.status) for r in S.snapshot_diff(new, old).collect()}
    assert one == {("a", "T"), ("b", "D"), ("c", "A")} and two == {("a", "T"), ("b", "A"), ("c", "D")}


def test_all_copies_of_one_content_are_renamed(spark):
    columns = "status string, path string, old_path string, old_oid string, new_oid string, old_mode string, new_mode string"
    rows = [("D", f"d{k:05}", f"d{k:05}", "x", None, "100644", None) for k in range(1203)] + [("A", f"a{k:05}", None, None, "x", None, "100644") for k in range(1201)]
    rows += [("D", "e", "e", "y", None, "100644", None), ("A", "f", None, None, "z", None, "100644")]
    got = S.detect_renames(spark.createDataFrame(rows, columns)).collect()
    assert {(r.old_path, r.path) for r in got if r.status == "R"} == {(f"d{k:05}", f"a{k:05}") for k in range(1201)}
    assert {(r.status, r.path) for r in got if r.status != "R"} == {("D", "d01201"), ("D", "d01202"), ("D", "e"), ("A", "f")}


def brute_renames(old, new, threshold=0.5):
    """Pairs of (path, text) lists by falling score, equal scores by the hash of the pair."""
    import hashlib
    from collections import Counter

    left, want = [], set()
    for d, x in old:
        for a, y in new:
            p, q = Counter(x.split("\n")), Counter(y.split("\n"))
            score = sum(min(n, q[w]) * (len(w) + 1) for w, n in p.items()) / (max(len(x), len(y)) + 1)
            left += [(score, hashlib.sha1(f"{d}\n{a}".encode()).hexdigest(), d, a)] if x and y and score >= threshold else []
    while left:
        score, _, d, a = max(left)
        want.add((d, a, round(score, 9)))
        left = [r for r in left if r[2] != d and r[3] != a]
    return want


def found_renames(spark, old, new, **more):
    pair = lambda rows: spark.createDataFrame(rows, "path string, text string")
    return {(r.d, r.a, round(r.score, 9)) for r in S.similar_renames(pair(old), pair(new), **more).collect()}


def test_similar_renames_by_brute_force(spark):
    import random

    rng = random.Random(3)
    text = lambda: "\n".join(rng.choice(["", "}", "return", "x = 1", "some longer line", "another one"]) for _ in range(rng.randint(1, 7)))
    old, new = ([(f"{s}{k}", text()) for k in range(18)] for s in "da")
    assert found_renames(spark, old, new) == brute_renames(old, new)


def test_moved_files_that_share_one_common_line(spark):
    from auditlake.operators import likeness

    # Every file holds the same long line; most have more lines of their own, some nothing else.
    common = "the same licence in every file, longer than what is otherwise in it"
    old = [(f"d{k:03}", f"{common}\nown {k} {k * k}\n" + "more\n" * (k % 3)) for k in range(40)] + [("d-alone", f"{common}\n")]
    new = [(f"a{k:03}", f"{common}\nown {k} {k * k}\nnew {k}\n") for k in range(0, 40, 2)] + [(f"b{k:03}", f"{common}\nelse {k}\n") for k in range(10)]
    assert 41 * 30 > likeness.FEW
    got = found_renames(spark, old, new)
    assert {(d, a) for d, a, _ in got if a[0] == "a"} == {(f"d{k:03}", f"a{k:03}") for k in range(0, 40, 2)}
    rest = [(d, a) for d, a, _ in got if a[0] == "b"]
    assert len(rest) == len({d for d, _ in rest}) == len({a for _, a in rest}) == 10
    scores = {(d, a): s for d, a, s in got}
    sizes = dict(old) | dict(new)
    assert all(abs(scores[d, a] - (len(common) + 2) / (max(len(sizes[d]), len(sizes[a])) + 1)) < 1e-6 for d, a in rest)


def test_one_line_in_very_many_files(spark):
    n, common = 3000, "shared by all"
    old = spark.range(n).selectExpr("concat('d', id) as path", f"concat('{common}\n', repeat(concat('line of ', id, ' alone\n'), 3)) as text")
    new = spark.range(n).selectExpr("concat('a', id) as path", f"concat('{common}\n', repeat(concat('line of ', id, ' alone\n'), 3), 'more') as text")
    got = S.similar_renames(old, new).collect()
    assert {(r.d[1:], r.a[1:]) for r in got} == {(str(k), str(k)) for k in range(n)}


def test_many_equal_texts_of_common_lines_settle_at_once(spark):
    n = 1500
    side = lambda c: spark.range(n).selectExpr(f"concat('{c}', id) as path", "concat('all of them hold this line\n', id % 7) as text")
    got = S.similar_renames(side("d"), side("a")).collect()
    assert len(got) == len({r.d for r in got}) == len({r.a for r in got}) == n


def test_edited_moves_are_renames_of_their_own_snapshot(spark):
    files = "by_ int, path string, mode string, oid string, text string"
    body = "one\ntwo\nthree\nfour\n"
    old = [(k, "x/f", "100644", "1", body) for k in (1, 2)] + [(1, "link", "120000", "2", body), (1, "bin", "100644", "3", "\0" + body), (2, "none", "100644", "4", ""), (1, "gone", "100644", "5", None)]
    new = [(1, "y/g", "100755", "9", body + "five\n"), (1, "other", "120000", "8", body), (2, "bin2", "100644", "7", "\0" + body + "x"), (2, "none2", "100644", "6", "\n")]
    got = S.changed_files(spark.createDataFrame(old, files), spark.createDataFrame(new, files), ("by_",)).collect()
    assert {(r.by_, r.status, r.path, r.old_path) for r in got if r.status == "R"} == {(1, "R", "y/g", "x/f")}
    assert {(r.by_, r.status, r.path) for r in got if r.status != "R"} == {(1, "D", "link"), (1, "D", "bin"), (1, "D", "gone"), (1, "A", "other"), (2, "D", "x/f"), (2, "D", "none"), (2, "A", "bin2"), (2, "A", "none2")}
    one = next(r for r in got if r.status == "R")
    assert (one.old_oid, one.new_oid, one.old_mode, one.new_mode, one.old_text, one.new_text, one.non_text) == ("1", "9", "100644", "100755", body, body + "five\n", False)
    empty = spark.createDataFrame([], files)
    assert S.changed_files(empty, empty, ("by_",)).count() == 0


def test_trees_are_built_from_their_files_up(spark):
    import hashlib

    oid = lambda kind, data: hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()
    blob = oid("blob", b"x")
    tree = lambda *entries: b"".join(f"{m} {n}".encode() + b"\0" + bytes.fromhex(o) for m, n, o in entries)
    deep = tree(("100644", "f", blob))
    sub = tree(("40000", "c", oid("tree", deep)), ("100755", "z", blob))
    root = tree(("100644", "a.b", blob), ("40000", "a", oid("tree", sub)), ("120000", "a0", blob), ("100644", "\u00e9", blob))
    files = [(1, "a/c/f", "100644", blob), (1, "a/z", "100755", blob), (1, "a.b", "100644", blob), (1, "a0", "120000", blob), (1, "\u00e9", "100644", blob), (2, "f", "100644", blob)]
    got = {(r.s, r.dir): (r.oid, bytes(r.content)) for r in O.build_trees(spark.createDataFrame(files, "s int, path string, mode string, oid string"), ("s",)).collect()}
    assert got == {(1, "a/c"): (oid("tree", deep), deep), (1, "a"): (oid("tree", sub), sub), (1, ""): (oid("tree", root), root), (2, ""): (oid("tree", deep), deep)}
    assert O.build_trees(spark.createDataFrame([], "s int, path string, mode string, oid string"), ("s",)).count() == 0
    again = {(r.tree_oid, r.name, r.child_oid, r.mode) for r in O.explode_trees(spark.createDataFrame([(o, c) for o, c in got.values()], "oid string, content binary")).collect()}
    assert (oid("tree", root), "a", oid("tree", sub), "40000") in again and (oid("tree", sub), "z", blob, "100755") in again


def test_framing_tells_gaps_and_trailing_bytes(spark):
    rows = [("whole", 12, 30), ("whole", 30, 45), ("gap", 12, 30), ("gap", 33, 45), ("late", 14, 45), ("tail", 12, 40), ("short", 12, 45), ("short", 45, None)]
    bundles = [(b, n, 45) for b, n in (("whole", 2), ("gap", 2), ("late", 1), ("tail", 1), ("short", 2), ("none", 0), ("empty", 1))]
    got = {r.bundle_id: (r.parsed, r.bytes_left, r.gaps, r.status) for r in LE.framing_check(spark.createDataFrame(rows, "bundle_id string, offs long, end_offs long"), spark.createDataFrame(bundles, "bundle_id string, declared long, trailer_offset long")).collect()}
    assert got == {"whole": (2, 0, 0, "ok"), "gap": (2, 0, 1, "gap between entries"), "late": (1, 0, 1, "gap between entries"), "tail": (1, 5, 0, "trailing bytes"), "short": (1, 0, 0, "entries missing"), "none": (0, 33, 0, "trailing bytes"), "empty": (0, 33, 0, "entries missing")}


def test_contracts_know_json_types(spark):
    import json

    from auditlake.operators.contracts import contract_faults

    oid = "a" * 40
    person = {"name": "", "email": "e", "time_seconds": 10**25, "offset_minutes": -60}
    good = {
        "schema_version": "1", "tool_version": "t", "generated_at_unix_secs": 0, "generated_by_username": "u", "generated_by_hostname": "h", "bundle_path": "p", "bundle_size_bytes": 5, "bundle_sha256": "b" * 64, "bundle_header_version": "v2",
        "prerequisites": [], "heads": [{"oid": oid, "reference": "r"}], "range_from_oid": oid, "range_to_oid": oid, "tip_ref": "r",
        "commit_chain": [{"oid": oid, "tree_oid": oid, "parent_oids": [oid], "subject": "", "author": person, "committer": person}],
        "changed_files": [{"status": "M", "path": "p", "old_path": None, "old_oid": None, "new_oid": oid, "old_mode": None, "new_mode": "100644", "is_binary": False}], "patch_sidecar": None,
    }
    docs = [(good, []), (good | {"bundle_size_bytes": "5"}, ["bundle_size_bytes is no count"]), (good | {"schema_version": 1}, ["schema_version is no schema"]), (good | {"tip_ref": {"a": 1}}, ["tip_ref is no text"]), (good | {"heads": {}}, ["heads is no list"])]
    docs += [(good | {"heads": [7, {"oid": oid, "reference": ""}]}, ["heads[] is no object", "heads[].reference is no text"]), ([], ["document is no object"]), (good | {"patch_sidecar": []}, ["patch_sidecar is no object"]), (good | {"range_to_oid": None, "more": 1}, ["document has other fields", "range_to_oid is no oid"])]
    docs += [(good | {"changed_files": [good["changed_files"][0] | {"is_binary": "true"}]}, ["changed_files[].is_binary is no flag"]), ({k: v for k, v in good.items() if k != "heads"}, ["heads is missing"])]
    rows = [(k, json.dumps(d)) for k, (d, _) in enumerate(docs)] + [(90, "no json"), (91, None), (92, json.dumps(good)[:-1] + ',"tip_ref":"r"}')]
    got = {r.doc_id: r.faults for r in contract_faults(spark.createDataFrame(rows, "doc_id int, json string"), "creation").collect()}
    assert {k: got[k] for k in range(len(docs))} == {k: f for k, (_, f) in enumerate(docs)}
    assert got[90] == got[91] == got[92] == ["document is no object"]


def test_a_long_line_of_commits(spark):
    n = 50_000
    commits = spark.range(n).selectExpr("id", "id as time", "'r' as repo")
    edges = spark.range(1, n).selectExpr("id as child", "id - 1 as parent", "0 as parent_index")
    heads = spark.createDataFrame([("b", 0, n - 1), ("b", 1, n // 2)], "bundle_id string, head_index int, oid long")
    got = H.visit_order(heads, commits, edges)
    assert got.where(f"head_index <> 0 or commit_order <> {n} - id").count() == 0 and got.count() == n
    pairs = spark.createDataFrame([(n - 1, 0), (0, n - 1), (7, 7)], "a long, b long")
    assert {(r.a, r.b): r.descends for r in H.is_descendant(pairs, edges).collect()} == {(n - 1, 0): True, (0, n - 1): False, (7, 7): False}
    ranges = spark.createDataFrame([("r", n - 1, n - 4)], "range_id string, tip long, hidden long")
    assert {r.node for r in H.commit_range(ranges, edges).collect()} == {n - 3, n - 2, n - 1}


def test_visits_are_those_of_a_stack_on_random_graphs(spark):
    import random

    rng, commits, edges, heads, want = random.Random(5), [], [], [], {}
    for g in range(12):
        n = rng.randint(2, 25)
        parents = {k: rng.sample(range(k), min(k, rng.choice([0, 1, 1, 2, 3]))) for k in range(n)}
        tips = rng.sample(range(n), min(n, 3))
        commits += [(f"{g}:{k}", k) for k in range(n)]
        edges += [(f"{g}:{k}", f"{g}:{p}", i) for k, ps in parents.items() for i, p in enumerate(ps)]
        heads += [(g, i, f"{g}:{t}") for i, t in enumerate(tips)]
        seen = set()
        for i, tip in enumerate(tips):
            stack, order = [tip], 0
            while stack:
                k = stack.pop()
                if k not in seen:
                    seen.add(k)
                    order += 1
                    want[g, f"{g}:{k}"] = (i, order)
                    stack += parents[k][::-1]
        assert seen
    frames = (spark.createDataFrame(heads, "bundle_id int, head_index int, oid string"), spark.createDataFrame(commits, "id string, time long"), spark.createDataFrame(edges, "child string, parent string, parent_index int"))
    assert {(r.bundle_id, r.id): (r.head_index, r.commit_order) for r in H.visit_order(*frames).collect()} == want


def test_what_is_reached_on_random_graphs(spark):
    import random

    rng, edges = random.Random(6), []
    for g in range(8):
        for k in range(1, 40):
            edges += [(g * 100 + k, g * 100 + p, i) for i, p in enumerate(rng.sample(range(k), min(k, rng.choice([1, 1, 1, 2]))))]
    above = {}
    for child, parent, _ in sorted(edges):
        above.setdefault(child, {child}).update(above.get(parent, {parent}))
    df = spark.createDataFrame(edges, "child long, parent long, parent_index int")
    starts = sorted(above)[::3] + [100_000]
    got = {}
    for r in H.ancestors(spark.createDataFrame([(s,) for s in starts], "start long"), df).collect():
        assert r.node not in got.setdefault(r.start, set())
        got[r.start].add(r.node)
    assert got == {s: above.get(s, {s}) for s in starts}
