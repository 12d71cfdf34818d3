"""Snapshots and their differences, renames, line counts and patches.

Tables: snapshots(path, mode, oid, text), tree_entries(tree_oid, pos, mode, name, child_oid, child_kind),
diff(status, path, old_path, old_oid, new_oid, old_mode, new_mode).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.operators.iterate import checkpointed, levels, numbered
from auditlake.operators.likeness import regular, similar_renames
from auditlake.operators.lines import line_counts

#: Bytes of a file in which a NUL makes it binary.
BINARY_WITHIN = 8000

HEADERS = ["diff --git ", "index ", "--- ", "+++ ", "new file mode ", "deleted file mode ", "similarity index ", "rename from ", "rename to "]


def flatten(roots: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """(root, path, mode, oid, kind) of every entry below roots(root), level by level."""
    level = roots.select("root", F.col("root").alias("tree_oid"), F.lit("").alias("prefix"))
    found = None
    for _ in levels(tree_entries):
        rows = checkpointed(level.join(tree_entries, "tree_oid").select("root", F.concat("prefix", "name").alias("path"), "mode", F.col("child_oid").alias("oid"), F.col("child_kind").alias("kind")))
        if rows.isEmpty():
            return found if found is not None else rows
        found = rows if found is None else found.unionByName(rows)
        level = rows.where("kind = 'tree'").select("root", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("prefix"))


def file_type(mode: str) -> Column:
    """Regular file, link or submodule by mode."""
    return F.when(F.col(mode) == "120000", "link").when(F.col(mode) == "160000", "commit").otherwise("file")


def snapshot_diff(old: DataFrame, new: DataFrame, keep_unchanged: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """A, D, M and T rows between two snapshots by path; an empty old snapshot makes all rows A. With `by`, many pairs of snapshots at once."""
    a = old.select(*by, "path", F.col("mode").alias("old_mode"), F.col("oid").alias("old_oid"))
    b = new.select(*by, "path", F.col("mode").alias("new_mode"), F.col("oid").alias("new_oid"))
    rows = a.join(b, [*by, "path"], "full")
    gone, come = F.col("new_oid").isNull(), F.col("old_oid").isNull()
    status = F.when(come, "A").when(gone, "D").when(file_type("old_mode") != file_type("new_mode"), "T").when((F.col("old_oid") != F.col("new_oid")) | (F.col("old_mode") != F.col("new_mode")), "M").otherwise("=")
    rows = rows.withColumn("status", status).withColumn("old_path", F.when(~come, F.col("path"))).select(*by, "status", "path", "old_path", "old_oid", "new_oid", "old_mode", "new_mode")
    return rows if keep_unchanged else rows.where("status <> '='")


def detect_renames(diff: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """diff with D and A rows of equal content paired as R rows, one to one, within each `by`."""
    d = diff.where("status = 'D' AND old_oid IS NOT NULL").select(*by, F.col("old_oid").alias("oid"), F.col("path").alias("d"), "old_mode")
    a = diff.where("status = 'A' AND new_oid IS NOT NULL").select(*by, F.col("new_oid").alias("oid"), F.col("path").alias("a"), "new_mode")
    # Within one content all scores are equal, so first choices pair the paths in their order.
    pairs = checkpointed(numbered(d, [*by, "oid"], "d").join(numbered(a, [*by, "oid"], "a"), [*by, "oid", "number"]).drop("number"))
    moved = pairs.select(*by, F.lit("R").alias("status"), F.col("a").alias("path"), F.col("d").alias("old_path"), F.col("oid").alias("old_oid"), F.col("oid").alias("new_oid"), "old_mode", "new_mode")
    taken = pairs.select(*by, F.col("d").alias("path"), F.lit("D").alias("status")).unionByName(pairs.select(*by, F.col("a").alias("path"), F.lit("A").alias("status")))
    rest = diff.join(taken, [*by, "path", "status"], "left_anti")
    return rest.select(*moved.columns).unionByName(moved)


def changed_files(old: DataFrame, new: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Changes between two snapshots(by, path, mode, oid, text) with both texts and non_text; moved files are R rows.

    Equal contents are paired first, then, of what is left, text files whose lines are alike; so a file that was moved and
    edited is one row with its edits, not a deleted and an added file.
    """
    by = tuple(by)
    rows = checkpointed(detect_renames(snapshot_diff(old, new, by=by), by))
    before = old.select(*by, F.col("path").alias("old_path"), F.col("text").alias("old_text"))
    after = new.select(*by, "path", F.col("text").alias("new_text"))

    def alone(status: str, side: DataFrame, mode: str) -> DataFrame:
        asked = rows.where((F.col("status") == status) & regular(mode)).select(*by, "path")
        return side.join(asked, [*by, "path"], "left_semi").select(*by, "path", "text").where(~binary("text"))

    pairs = checkpointed(similar_renames(alone("D", old, "old_mode"), alone("A", new, "new_mode"), threshold, by).select(*by, "d", "a"))
    gone = rows.where("status = 'D'").select(*by, F.col("path").alias("d"), "old_oid", "old_mode")
    come = rows.where("status = 'A'").select(*by, F.col("path").alias("a"), "new_oid", "new_mode")
    moved = pairs.join(gone, [*by, "d"]).join(come, [*by, "a"]).select(*by, F.lit("R").alias("status"), F.col("a").alias("path"), F.col("d").alias("old_path"), "old_oid", "new_oid", "old_mode", "new_mode")
    taken = pairs.select(*by, F.col("d").alias("path"), F.lit("D").alias("status")).unionByName(pairs.select(*by, F.col("a").alias("path"), F.lit("A").alias("status")))
    told = rows.join(taken, [*by, "path", "status"], "left_anti").select(*moved.columns).unionByName(moved)
    texts = told.join(before, [*by, "old_path"], "left").join(after, [*by, "path"], "left")
    return texts.withColumn("non_text", non_text("old_mode", "new_mode", "old_text", "new_text"))


def changed_texts(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """changed_files of two commits' files(commit, path, mode, oid, text) for each of pairs(pair, old_commit, new_commit).

    A null old_commit is the empty snapshot.
    """
    side = lambda c: pairs.select("pair", F.col(c).alias("commit")).join(files, "commit").drop("commit")
    return changed_files(side("old_commit"), side("new_commit"), ("pair",))


def line_stats(changes: DataFrame) -> DataFrame:
    """(pair, path, additions, deletions) of changed_texts' rows; files that are no text have 0 and 0."""
    plain = lambda c: F.when(~F.col("non_text"), F.col(c)).alias(c)
    return line_counts(changes.select("pair", "path", plain("old_text"), plain("new_text"))).drop("old_text", "new_text")


def commit_line_stats(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(commit, path, additions, deletions) of commits(id, first_parent) against their first parent, or the empty tree."""
    pairs = commits.select(F.col("id").alias("pair"), F.col("first_parent").alias("old_commit"), F.col("id").alias("new_commit"))
    return line_stats(changed_texts(pairs, files)).withColumnRenamed("pair", "commit")


def head_line_stats(heads: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle_id, head_index, path, additions, deletions) of heads(bundle_id, head_index, oid, base_oid) against their base."""
    pairs = heads.select(F.struct("bundle_id", "head_index").alias("pair"), F.col("base_oid").alias("old_commit"), F.col("oid").alias("new_commit"))
    return line_stats(changed_texts(pairs, files)).select("pair.*", "path", "additions", "deletions")


def find_copies(diff_all: DataFrame) -> DataFrame:
    """C rows: added paths whose content an unchanged path has, the smallest such path; diff_all keeps unchanged rows."""
    kept = diff_all.where("status = '='").groupBy(F.col("new_oid").alias("oid")).agg(F.min("path").alias("old_path"))
    return diff_all.where("status = 'A'").drop("old_path", "status").join(kept, F.col("new_oid") == F.col("oid")).select(F.lit("C").alias("status"), "path", "old_path", F.col("new_oid").alias("old_oid"), "new_oid", "new_mode")


def binary(text: str) -> Column:
    """Whether a text has a NUL near its beginning; a null text has none."""
    return F.coalesce(F.contains(F.substring(F.col(text).cast("binary"), 1, BINARY_WITHIN), F.lit(b"\0")), F.lit(False))


def non_text(old_mode: str, new_mode: str, old_text: str, new_text: str) -> Column:
    """Whether either side is binary or not a regular file; null modes and texts mean an absent side."""
    odd = lambda m: F.coalesce(~regular(m), F.lit(False))
    return odd(old_mode) | odd(new_mode) | binary(old_text) | binary(new_text)


def bundle_line_stats(stats: DataFrame) -> DataFrame:
    """stats(bundle_id, path, additions, deletions) summed by path."""
    return stats.groupBy("bundle_id", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def find_change(requests: DataFrame, diffs: DataFrame) -> DataFrame:
    """requests(commit, want) with the change of that path, by new or old name, and an outcome. diffs(commit, status, path, old_path, is_non_text)."""
    named = diffs.select("commit", F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("want"), "status", "path", "is_non_text")
    best = named.groupBy("commit", "want").agg(F.min_by(F.struct("status", "path", "is_non_text"), F.struct((F.col("path") != F.col("want")).cast("int"), "path")).alias("c"))
    rows = requests.join(best, ["commit", "want"], "left")
    return rows.select("commit", "want", "c.status", "c.path", F.when(F.col("c").isNull(), "not-changed").when(F.col("c.is_non_text"), "non-text").otherwise("text").alias("outcome"))


def line_kind(line: str = "line") -> Column:
    """header, hunk, added, deleted, context or other."""
    c = F.col(line)
    header = F.lit(False)
    for h in HEADERS:
        header = header | c.startswith(h)
    return F.when(header, "header").when(c.startswith("@@"), "hunk").when(c.startswith("+") & ~c.startswith("+++"), "added").when(c.startswith("-") & ~c.startswith("---"), "deleted").when(c.startswith(" "), "context").otherwise("other")


def hunk_starts(line: str = "line") -> Column:
    """Old and new start of a hunk header; null if the line is none."""
    p = r"^@@ -(\d+)(?:,[^ ]*)? \+(\d+)(?:,.*)? @@"
    one = lambda k: F.regexp_extract(line, p, k).try_cast("long")
    return F.when(F.col(line).rlike(p), F.struct(one(1).alias("old_start"), one(2).alias("new_start")))


def number_patch(lines: DataFrame) -> DataFrame:
    """lines(patch_id, pos, line) with kind and old and new line numbers; blank before the first hunk."""
    rows = lines.withColumns({"kind": line_kind(), "starts": hunk_starts()})
    by = W.Window.partitionBy("patch_id").orderBy("pos")
    rows = rows.withColumn("hunk", F.count("starts").over(by.rowsBetween(W.Window.unboundedPreceding, 0)))
    within = W.Window.partitionBy("patch_id", "hunk").orderBy("pos")
    before = within.rowsBetween(W.Window.unboundedPreceding, -1)
    step = lambda kinds: F.coalesce(F.count_if(F.col("kind").isin(*kinds)).over(before), F.lit(0))
    start = lambda k: F.first(F.col("starts")[k], True).over(within)
    old, new = start("old_start") + step(("deleted", "context")), start("new_start") + step(("added", "context"))
    return rows.withColumns({"old_line": F.when(F.col("kind").isin("deleted", "context"), old), "new_line": F.when(F.col("kind").isin("added", "context"), new)}).drop("starts", "hunk")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and digests of the bundles' patches, which come in order of bundle, then path."""
    done, now, sha, size = [], None, None, 0

    def put(rows):
        return pa.RecordBatch.from_pylist(rows, pa.schema([("bundle", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string())]))

    for batch in batches:
        for bundle, patch in zip(batch.column("bundle"), batch.column("patch"), strict=True):
            if sha is None or bundle.as_py() != now:
                if sha is not None:
                    done.append({"bundle": now, "size_bytes": size, "sha256": sha.hexdigest()})
                now, sha, size = bundle.as_py(), hashlib.sha256(), 0
            data = (patch.as_py() or "").encode()
            sha.update(data)
            size += len(data)
        yield put(done)
        done = []
    if sha is not None:
        yield put([{"bundle": now, "size_bytes": size, "sha256": sha.hexdigest()}])


def patch_sidecar(patches: DataFrame) -> DataFrame:
    """(bundle_id, format, size_bytes, sha256) of patches(bundle_id, path, patch) joined in order of path, digested as a stream."""
    rows = patches.select(F.col("bundle_id").cast("string").alias("bundle"), "path", "patch").repartition("bundle").sortWithinPartitions("bundle", "path")
    return rows.select("bundle", "patch").mapInArrow(_digested, "bundle string, size_bytes long, sha256 string").select(F.col("bundle").alias("bundle_id"), F.lit("unified-diff").alias("format"), "size_bytes", "sha256")
