"""Objects of packages: previews, reachability, inventory, text statistics and detail lines.

Tables: objects(bundle_id, oid, kind, size_bytes, content), tree_entries(tree_oid, pos, mode, name, child_oid, child_kind),
index(bundle_id, oid, kind, size_bytes, first_entry_idx), context(bundle_id, oid, head_index, commit_order, path).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.functions.columns import kind_rank, object_id
from auditlake.operators.chains import Reach, in_order
from auditlake.operators.iterate import checkpointed, closure, levels

#: Blobs above this size keep a preview alone, of this many bytes.
WHOLE, PREVIEW = 4 * 1024 * 1024, 8192
#: Paths kept of a blob, in order of visit.
PATHS = 12
#: Bytes of a binary blob that detail lines show, and bytes in a row of them.
HEX, ROW = 256, 16


def object_store(objects: DataFrame, whole: int = WHOLE, preview: int = PREVIEW) -> DataFrame:
    """objects with large blobs cut to a preview and content_truncated."""
    large = (F.col("kind") == "blob") & (F.octet_length("content") > whole)
    return objects.withColumns({"content": F.when(large, F.substring("content", 1, preview)).otherwise(F.col("content")), "content_truncated": large})


def commit_fields(commits: DataFrame, content: str = "content") -> DataFrame:
    """Tree and parents of commit objects' text: header lines before the first empty one; what is no id is left out."""
    lines = F.split(F.make_valid_utf8(F.decode(content, "utf-8")) if dict(commits.dtypes)[content] == "binary" else F.col(content), "\r?\n")
    blank = F.array_position(lines, "")
    head = F.when(blank > 0, F.slice(lines, F.lit(1), (blank - 1).cast("int"))).otherwise(lines)
    pick = lambda k: F.transform(F.filter(head, lambda x: x.rlike(f"^{k} [0-9a-f]{{40}}$")), lambda x: F.substring(x, len(k) + 2, 40))
    return commits.withColumns({"tree_oid": F.get(pick("tree"), F.lit(0)), "parent_oids": pick("parent")})


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tree_oid", "pos", "mode", "name", "child_oid", "child_kind", "error"]
    for batch in batches:
        out = []
        for oid, raw in zip(batch.column("oid").to_pylist(), batch.column("content").to_pylist(), strict=True):
            found, at, bad = [], 0, None
            while at < len(raw or b""):
                space, nul = raw.find(b" ", at), raw.find(b"\0", at)
                if space < 0 or nul < space or nul + 21 > len(raw):
                    bad = f"tree entry {len(found)} is malformed"
                    break
                mode = raw[at:space].decode("ascii", "replace")
                kind = "tree" if mode in ("40000", "040000") else "commit" if mode == "160000" else "blob"
                found.append((oid, len(found), mode, raw[space + 1 : nul].decode("utf-8", "replace"), raw[nul + 1 : nul + 21].hex(), kind, None))
                at = nul + 21
            # A malformed tree has no entries, only its error.
            out += found if bad is None else [(oid, None, None, None, None, None, bad)]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def explode_trees(trees: DataFrame) -> DataFrame:
    """tree_entries of tree objects(oid, content), and a row with an error for each malformed tree."""
    return trees.select("oid", "content").mapInArrow(_tree_rows, "tree_oid string, pos long, mode string, name string, child_oid string, child_kind string, error string")


def build_trees(files: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, dir, oid, content): the tree objects of files(by, path, mode, oid), oid in hex, from the deepest directories up.

    A directory's entries are its files and the trees of the directories in it, in byte order of their names, those of directories
    as if they ended in a slash; the root is the directory ''. A tree is digested in one task, for its id is that of its
    bytes in order; directories go level by level, all snapshots at once.
    """
    split = F.length("path") - F.length(F.substring_index("path", "/", -1))
    parts = checkpointed(files.select(*by, F.substring(F.col("path"), F.lit(1), split - 1).alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.regexp_replace("mode", "^0+", "").alias("mode"), "oid", F.length(F.regexp_replace("path", "[^/]", "")).alias("depth")))
    name = F.col("name").cast("binary")
    entry = F.struct(F.when(F.col("mode") == "40000", F.concat(name, F.lit(b"/"))).otherwise(name).alias("order"), F.hex(F.concat(F.encode(F.concat("mode", F.lit(" ")), "utf-8"), name, F.lit(b"\0"), F.unhex("oid"))).alias("bytes"))
    deepest = parts.agg(F.max("depth")).first()[0]
    found = below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        entries = parts.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            up = F.length("dir") - F.length(F.substring_index("dir", "/", -1))
            entries = entries.unionByName(below.select(*by, F.substring(F.col("dir"), F.lit(1), up - 1).alias("dir"), F.substring_index("dir", "/", -1).alias("name"), F.lit("40000").alias("mode"), "oid"))
        content = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["bytes"]), ""))
        below = checkpointed(entries.groupBy(*by, "dir").agg(content.alias("content")).select(*by, "dir", object_id(F.lit("tree"), "content").alias("oid"), "content"))
        found = below if found is None else found.unionByName(below)
    return found if found is not None else parts.select(*by, "dir", "oid", F.lit(b"").alias("content"))


def reachable(heads: DataFrame, commits: DataFrame, edges: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """(bundle_id, oid, kind) of what heads(bundle_id, oid) reach: commits(id, tree_oid) that are present, their trees and
    every entry of those trees, present or not. All are strings. Each bundle is walked once, from all its heads."""
    present = commits.select(F.col("id").alias("oid"))
    starts = heads.join(present, "oid", "left_semi")
    own = edges.join(present.withColumnRenamed("oid", "child"), "child", "left_semi").join(present.withColumnRenamed("oid", "parent"), "parent", "left_semi")
    reach = Reach(own)
    labels = reach.labels(starts.select(F.col("bundle_id").alias("start"), F.col("oid").alias("node")))
    seen = checkpointed(reach.nodes(labels).select(F.col("start").alias("bundle_id"), F.col("node").alias("oid")))
    return seen.withColumn("kind", F.lit("commit")).unionByName(tree_objects(seen, commits, tree_entries))


def tree_objects(seen: DataFrame, commits: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """(bundle_id, oid, kind) of the trees of seen(bundle_id, oid) commits and all entries below them."""
    roots = seen.join(commits.select(F.col("id").alias("oid"), "tree_oid"), "oid").select(F.col("bundle_id").alias("start"), F.col("tree_oid").alias("node")).distinct()
    links = tree_entries.where("child_kind = 'tree'").select(F.col("tree_oid").alias("child"), F.col("child_oid").alias("parent"))
    trees = checkpointed(closure(roots, links).select(F.col("start").alias("bundle_id"), F.col("node").alias("oid")))
    entries = trees.join(tree_entries.select(F.col("tree_oid").alias("oid"), "child_oid", "child_kind"), "oid").where("child_kind <> 'tree'").select("bundle_id", F.col("child_oid").alias("oid"), F.col("child_kind").alias("kind")).distinct()
    return trees.withColumn("kind", F.lit("tree")).unionByName(entries)


def objects_to_ship(ranges: DataFrame, commits: DataFrame, edges: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """(range_id, oid, kind) of a package: commits, trees and entries of each range less all that its hidden commits reach.

    ranges(range_id, tip), hidden ones in further rows ranges(range_id, hidden).
    """
    side = lambda c: ranges.where(F.col(c).isNotNull()).select(F.col("range_id").alias("bundle_id"), F.col(c).alias("oid")).distinct()
    shown, known = reachable(side("tip"), commits, edges, tree_entries), reachable(side("hidden"), commits, edges, tree_entries)
    return shown.join(known.select("bundle_id", "oid"), ["bundle_id", "oid"], "left_anti").withColumnRenamed("bundle_id", "range_id")


def blob_paths(visits: DataFrame, n: int = PATHS) -> DataFrame:
    """visits(oid, visit, path) -> (oid, paths): the first n paths in order of visit, then sorted and distinct."""
    first = visits.withColumn("r", F.row_number().over(W.Window.partitionBy("oid").orderBy("visit"))).where(F.col("r") <= n)
    return first.groupBy("oid").agg(F.array_sort(F.array_distinct(F.collect_list("path"))).alias("paths"))


def object_inventory(index: DataFrame, reached: DataFrame, context: DataFrame) -> DataFrame:
    """index with reachable, head_index, commit_order, path, and position by kind rank and oid within the bundle."""
    mark = reached.select("bundle_id", "oid").distinct().withColumn("reachable", F.lit(True))
    rows = index.join(mark, ["bundle_id", "oid"], "left").join(context, ["bundle_id", "oid"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))
    return in_order(rows, ["bundle_id"], kind_rank("kind"), F.col("oid")).withColumn("position", F.col("number") - 1).drop("number")


def inventory_summary(inventory: DataFrame) -> DataFrame:
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s")
    return inventory.groupBy("bundle_id").agg(F.count("*").alias("total"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"), *[of(k) for k in ("commit", "tree", "blob", "tag")])


def order_inventory(inventory: DataFrame, mode: str = "context") -> DataFrame:
    """inventory with `row`: by head and commit, absent ones last, then path (absent first), kind and id; or as in the inventory."""
    if mode == "canonical":
        return inventory.withColumn("row", F.col("position"))
    last = lambda c: (F.col(c).isNull(), F.col(c))
    return in_order(inventory, ["bundle_id"], *last("head_index"), *last("commit_order"), F.col("path"), kind_rank("kind"), F.col("oid")).withColumn("row", F.col("number") - 1).drop("number")


def reachability_verdict(inventory: DataFrame) -> DataFrame:
    """(bundle_id, verdict): yes, or no with the numbers."""
    lost, total = F.count_if(~F.col("reachable")), F.count("*")
    return inventory.groupBy("bundle_id").agg(F.when(lost == 0, "yes").otherwise(F.concat(F.lit("no ("), lost.cast("string"), F.lit("/"), total.cast("string"), F.lit(" unreachable)"))).alias("verdict"))


def ledger_targets(resolved: DataFrame, inventory: DataFrame) -> DataFrame:
    """(bundle_id, idx, oid, kind, reachable) of each ledger row's object; unresolved rows have none."""
    known = inventory.select("bundle_id", "oid", F.col("kind").alias("object_kind"), "reachable")
    rows = resolved.select("bundle_id", "idx", F.when(F.col("resolved"), F.col("oid")).alias("oid"))
    return rows.join(known, ["bundle_id", "oid"], "left").select("bundle_id", "idx", "oid", F.col("object_kind").alias("kind"), "reachable")


def content_lines(text):
    """Lines as they are shown: no closing empty line, no carriage returns at ends."""
    lines = F.split(text, "\r?\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def text_stats(objects: DataFrame) -> DataFrame:
    """objects(content binary, content_truncated) with is_text and line_count; null when truncated or binary."""
    text = F.is_valid_utf8(F.col("content"))
    decoded = F.when(text, F.decode("content", "utf-8"))
    return objects.withColumns({"is_text": text, "line_count": F.when(text & ~F.col("content_truncated"), F.size(content_lines(decoded)).cast("long"))})


def object_detail(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """text_stats' rows with paths of blobs and the path that tells a highlighter the syntax."""
    rows = text_stats(objects).join(paths, "oid", "left")
    own = F.when(F.col("kind") == "blob", F.coalesce("paths", F.expr("cast(array() as array<string>)"))).otherwise(F.expr("cast(array() as array<string>)"))
    hint = F.when(F.col("kind") == "blob", F.coalesce(F.get("paths", F.lit(0)), F.when(F.col("is_text"), "blob.txt")))
    return rows.withColumns({"paths": own, "syntax_path": hint})


def blob_lines(objects: DataFrame) -> DataFrame:
    """(bundle_id, oid, pos, line): header block and content of blobs, as text or in hexadecimal rows."""
    rows = text_stats(objects.where("kind = 'blob'"))
    n, size = F.octet_length("content"), F.col("size_bytes").cast("string")
    cut = F.col("content_truncated")
    part = F.concat(F.lit("preview only: "), n.cast("string"), F.lit(" / "), size, F.lit(" bytes"))
    head = lambda kind, third: F.array(F.concat(F.lit(f"{kind} blob "), "oid"), F.concat(F.lit("size: "), size, F.lit(" bytes")), F.when(cut, part).otherwise(third), F.lit(""))
    tail = F.when(cut, F.array(F.lit(""), F.lit("full content not retained in-memory (large blob preview mode)"))).otherwise(F.expr("cast(array() as array<string>)"))
    text = F.concat(head("text", F.concat(F.lit("text lines: "), F.coalesce("line_count", F.lit(0)).cast("string"))), content_lines(F.decode("content", "utf-8")), tail)
    shown = F.least(n, F.lit(HEX))
    at = F.when(shown > 0, F.sequence(F.lit(0), F.ceil(shown / ROW).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    hexes = F.transform(at, lambda k: F.trim(F.regexp_replace(F.lower(F.hex(F.substr("content", k * ROW + 1, F.least(F.lit(ROW), shown - k * ROW)))), "(..)", "$1 ")))
    binary = F.concat(head("binary", F.concat(F.lit("hex preview (first "), shown.cast("string"), F.lit(" bytes):"))), hexes)
    return rows.select("bundle_id", "oid", F.posexplode(F.when(F.col("is_text"), text).otherwise(binary)).alias("pos", "line"))


def blob_preview(lines: DataFrame, max_rows: int) -> DataFrame:
    """The first rows of each object's lines(oid, pos, line), with how many more there are when clipped."""
    n = F.max("pos").over(W.Window.partitionBy("oid")) + 1
    rows = lines.withColumn("n", n)
    more = F.concat(F.lit("... ("), (F.col("n") - (max_rows - 1)).cast("string"), F.lit(" more lines)"))
    clipped = F.col("n") > max_rows
    kept = rows.where(~clipped | (F.col("pos") < max_rows))
    return kept.select("oid", "pos", F.when(clipped & (F.col("pos") == max_rows - 1), more).otherwise(F.col("line")).alias("line"))


def _text_of(content: str = "content"):
    return F.make_valid_utf8(F.decode(content, "utf-8"))


def object_lines(objects: DataFrame) -> DataFrame:
    """(bundle_id, oid, pos, line) of objects of any kind: what a detail view shows of each.

    A commit shows its id, its tree, parent, author and committer lines, and its message; a tree its entries, aligned; a
    tag its text; a blob what blob_lines gives; an object of unknown kind a notice.
    """
    lines = content_lines(_text_of())
    blank = F.array_position(lines, "").cast("int")
    ends = F.when(blank > 0, blank - 1).otherwise(F.size(lines))
    shown = F.filter(F.slice(lines, F.lit(1), ends), lambda x: x.rlike("^(tree|parent|author|committer) "))
    rest = F.when(blank > 0, F.slice(lines, blank, F.size(lines))).otherwise(F.expr("cast(array() as array<string>)"))
    head = lambda k, *more: F.array(F.concat(F.lit(f"{k} "), "oid"), *[F.lit(m) for m in more])
    told = (
        F.when(F.col("kind") == "commit", F.concat(head("commit"), shown, rest))
        .when(F.col("kind") == "tag", F.concat(head("tag", ""), lines))
        .when(~F.col("kind").isin("tree", "blob"), head("object", "unsupported object type for detail rendering"))
    )
    plain = objects.where("kind not in ('tree', 'blob')").select("bundle_id", "oid", F.posexplode(told).alias("pos", "line"))
    trees = objects.where("kind = 'tree'")
    entries = explode_trees(trees.select("oid", "content").dropDuplicates(["oid"])).where("error is null")
    entry = F.concat(F.lpad("mode", 6, " "), F.lit(" "), F.rpad("child_kind", 7, " "), F.lit(" "), F.col("child_oid"), F.lit(" "), F.col("name"))
    within = entries.select(F.col("tree_oid").alias("oid"), (F.col("pos") + 2).cast("int").alias("pos"), entry.alias("line"))
    tree_head = trees.select("bundle_id", "oid", F.posexplode(head("tree", "")).alias("pos", "line"))
    tree_body = trees.select("bundle_id", "oid").join(within, "oid").select("bundle_id", "oid", "pos", "line")
    return plain.unionByName(tree_head).unionByName(tree_body).unionByName(blob_lines(objects))


def preview_lines(objects: DataFrame, lines: DataFrame, paths: DataFrame, reached: DataFrame, shown: int = 8) -> DataFrame:
    """(bundle_id, oid, pos, line) of a preview: blobs begin with their kind of content, line count and paths; others as in lines.

    lines: object_lines' rows; paths(oid, paths); reached(bundle_id, oid).
    """
    rows = text_stats(objects.where("kind = 'blob'")).join(paths, "oid", "left").join(reached.select("bundle_id", "oid").distinct().withColumn("seen", F.lit(True)), ["bundle_id", "oid"], "left")
    n = F.coalesce(F.size("paths"), F.lit(0))
    none = F.when(F.col("seen"), "blob paths: (none found in advertised-head trees)").otherwise("blob paths: (none; object is unreachable from advertised heads)")
    listed = F.concat(F.array(F.concat(F.lit("blob paths: "), n.cast("string"))), F.transform(F.slice("paths", 1, shown), lambda x: F.concat(F.lit("  - "), x)), F.when(n > shown, F.array(F.concat(F.lit("  ... and "), (n - shown).cast("string"), F.lit(" more")))).otherwise(F.expr("cast(array() as array<string>)")))
    counted = F.col("line_count").isNotNull()
    head = F.concat(
        F.array(F.concat(F.lit("blob "), "oid"), F.concat(F.lit("size: "), F.col("size_bytes").cast("string"), F.lit(" bytes")), F.concat(F.lit("content: "), F.when(counted, "text").otherwise("binary")), F.concat(F.lit("text lines: "), F.coalesce(F.col("line_count").cast("string"), F.lit("-")))),
        F.when(n > 0, listed).otherwise(F.array(none)),
    )
    heads = rows.select("bundle_id", "oid", head.alias("head"))
    blobs = objects.where("kind = 'blob'").select("bundle_id", "oid")
    # A blob's own header takes four lines; what follows is its content.
    body = lines.join(blobs, ["bundle_id", "oid"], "left_semi").where("pos >= 4").join(heads.select("bundle_id", "oid", F.size("head").alias("n")), ["bundle_id", "oid"]).select("bundle_id", "oid", (F.col("pos") - 2 + F.col("n")).cast("int").alias("pos"), "line")
    some = body.select("bundle_id", "oid").distinct().withColumn("some", F.lit(True))
    told = F.when(F.col("some"), F.concat("head", F.array(F.lit(""), F.lit("content preview:")))).otherwise(F.col("head"))
    top = heads.join(some, ["bundle_id", "oid"], "left").select("bundle_id", "oid", F.posexplode(told).alias("pos", "line"))
    others = lines.join(blobs, ["bundle_id", "oid"], "left_anti")
    return others.select("bundle_id", "oid", "pos", "line").unionByName(top).unionByName(body)


def tree_context(visits: DataFrame, commits: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """(bundle_id, oid, head_index, commit_order, path): where trees and their entries are first met.

    visits(bundle_id, id, head_index, commit_order) is the order of commits, commits(id, tree_oid) their trees. An object
    keeps the first commit that has it, in order of heads and commits, and there its first path by place in the trees; a
    commit's own tree has no path.
    """
    first = F.min(F.struct("head_index", "commit_order", "key", "path"))
    roots = visits.join(commits.select("id", "tree_oid"), "id").select("bundle_id", "head_index", "commit_order", F.col("tree_oid").alias("oid"), F.expr("cast(array() as array<bigint>)").alias("key"), F.lit(None).cast("string").alias("path"))
    level = checkpointed(roots.groupBy("bundle_id", "oid").agg(first.alias("f")).select("bundle_id", "oid", "f.*"))
    found, links = level, tree_entries.select(F.col("tree_oid").alias("oid"), "pos", "name", "child_oid", "child_kind")
    for _ in levels(tree_entries):
        below = level.join(links, "oid").select("bundle_id", F.col("child_oid").alias("oid"), "head_index", "commit_order", F.concat("key", F.array("pos")).alias("key"), F.concat_ws("/", "path", "name").alias("path"), (F.col("child_kind") == "tree").alias("deeper"))
        level = checkpointed(below.groupBy("bundle_id", "oid").agg(first.alias("f"), F.max("deeper").alias("deeper")).select("bundle_id", "oid", "f.*", "deeper"))
        if level.isEmpty():
            return found.groupBy("bundle_id", "oid").agg(first.alias("f")).select("bundle_id", "oid", "f.head_index", "f.commit_order", "f.path")
        found = found.unionByName(level.drop("deeper"))
        level = level.where("deeper").drop("deeper")
