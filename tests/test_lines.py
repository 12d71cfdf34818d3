"""Edit scripts against the quadratic table, patches applied by hand, merges, renames of many equal files, long ref chains."""

import random
import re

import pytest

from auditlake.operators import history as H
from auditlake.operators import lines as L
from auditlake.operators import receive as R
from auditlake.operators import snapshot as S


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def applied(old, patch):
    """The text that a unified patch makes of old."""
    lines, out, at, text = L.lines_of(old), [], 0, patch.split("\n")
    k = next((i for i, x in enumerate(text) if x.startswith("@@")), len(text))
    while k < len(text) - 1:
        start, n = re.match(r"@@ -(\d+)(?:,(\d+))?", text[k]).groups()
        start = int(start) - (n != "0")
        out += lines[at:start]
        at, k = start, k + 1
        while k < len(text) - 1 and not text[k].startswith("@@"):
            sign, line = text[k][:1], text[k][1:] + "\n"
            if k + 1 < len(text) and text[k + 1].startswith("\\"):
                line, k = line[:-1], k + 1
            if sign in " -":
                assert lines[at] == line
                at += 1
            if sign in " +":
                out.append(line)
            k += 1
    return "".join(out + lines[at:])


def texts(n, letters="abcd", most=14):
    random.seed(n)
    one = lambda: "\n".join(random.choice(letters) for _ in range(random.randint(0, most))) + random.choice(["", "\n"])
    return [(one(), one()) for _ in range(n)]


def test_scripts_are_shortest_and_patches_apply():
    for a, b in texts(800) + texts(50, "abcdefgh", 60):
        x, y = L.lines_of(a), L.lines_of(b)
        n = longest(x, y)
        assert L.counted(a, b) == (len(y) - n, len(x) - n)
        e = L.edits(x, y)
        assert sum(q[1] - q[0] for q in e) == len(x) - n and sum(q[3] - q[2] for q in e) == len(y) - n
        assert applied(a, L.patch("f", "f", "100644", "100644", "a" * 40, "b" * 40, a, b)) == b


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "want"),
    [
        ("a\nb\nc\n", "a\nb\nc\nd\n", "x\na\nb\nc\n", "x\na\nb\nc\nd\n"),
        ("a\n", "b\n", "c\n", None),
        ("a\n", "b\n", "b\n", "b\n"),
        ("a\nb\n", "a\nx\nb\n", "a\ny\nb\n", None),
        ("a\nb\nc\nd\n", "A\nb\nc\nd\n", "a\nb\nc\nD\n", "A\nb\nc\nD\n"),
        ("a", "a\nb", "a\0", None),
        ("", "", "", ""),
    ],
)
def test_merge(base, ours, theirs, want):
    assert L.merged(base, ours, theirs) == want


def test_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "a\nb"), (2, "a\n", None), (3, "", "")], "i int, old_text string, new_text string")
    assert {r.i: (r.additions, r.deletions) for r in L.line_counts(df).collect()} == {1: (2, 0), 2: (0, 1), 3: (0, 0)}
    assert L.line_counts(df.where("false")).count() == 0


def test_many_equal_files_are_all_paired(spark):
    n = 1500
    old = spark.createDataFrame([(f"old/{i:05}", "100644", "same") for i in range(n)], "path string, mode string, oid string")
    new = spark.createDataFrame([(f"new/{i:05}", "100644", "same") for i in range(n)], "path string, mode string, oid string")
    got = S.detect_renames(S.snapshot_diff(old, new)).collect()
    assert {(r.old_path, r.path) for r in got if r.status == "R"} == {(f"old/{i:05}", f"new/{i:05}") for i in range(n)} and len(got) == n


def test_long_and_circular_ref_chains(spark):
    refs = [("r", f"s{i}", None, f"s{i + 1}") for i in range(40)] + [("r", "s40", "t0", None), ("r", "x", None, "y"), ("r", "y", None, "x"), ("r", "lost", None, "nowhere"), ("r", "odd", "blob", None)]
    tags = [(f"t{i}", f"t{i + 1}") for i in range(30)]
    got = {r.ref_name: (r.target_oid, r.commit_oid, r.error) for r in H.resolve_refs(spark.createDataFrame(refs, "repo string, ref_name string, target_oid string, symbolic_target string"), spark.createDataFrame(tags, "oid string, target_oid string"), spark.createDataFrame([("t30",)], "id string")).collect()}
    assert got["s0"] == ("t0", "t30", None) and got["x"][2] == "symbolic refs form a circle"
    assert got["lost"] == (None, None, None) and got["odd"] == ("blob", None, "target is not a commit")


def test_bundles_that_name_one_ref_are_taken_in_turn(spark):
    refs = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], "repo string, ref_name string, oid string")
    updates = [("b1", "r", "a", "1", "9"), ("b2", "r", "a", "1", "8"), ("b2", "r", "b", "1", "8"), ("b3", "r", "b", "1", "7"), ("b4", "r", "c", "5", "6")]
    after, failed = R.apply_updates(refs, spark.createDataFrame(updates, "bundle_id string, repo string, ref_name string, expected_old string, new_oid string"))
    assert {(r.ref_name, r.oid) for r in after.collect()} == {("a", "9"), ("b", "7")} and after.count() == 2
    assert {(r.bundle_id, r.ref_name, r.actual) for r in failed.collect()} == {("b2", "a", "9"), ("b2", "b", "7"), ("b4", "c", None)}


def test_sidecar_is_the_digest_of_the_joined_text(spark):
    import hashlib

    rows = [(b, f"p{i:04}", f"{b} {i}\n" * 50) for b in ("x", "y") for i in range(300)]
    random.shuffle(rows)
    got = {r.bundle_id: (r.size_bytes, r.sha256) for r in S.patch_sidecar(spark.createDataFrame(rows, "bundle_id string, path string, patch string")).collect()}
    for b in ("x", "y"):
        t = "".join(p for c, _, p in sorted(rows) if c == b).encode()
        assert got[b] == (len(t), hashlib.sha256(t).hexdigest())
