"""Queries on objects, column expressions, claims and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import columns as X
from auditlake.operators import claims as C
from auditlake.operators import history as H
from auditlake.operators import ledger as L
from auditlake.operators import objects as O
from auditlake.operators.iterate import checkpointed
from auditlake.plans.ledger_queries import _VIEWS, RESOLVED
from auditlake.plans.registry import query
from auditlake.plans.views import duck, view
from auditlake.sources import ingest as I


def _column(name: str, table: str, key: str, make, sql: str):
    """Registers one column expression over a view."""

    @query(name, duck([table], f"SELECT {key}, {sql} AS value FROM {table}"))
    def run(spark, sf):
        return view(spark, sf, table).select(key, make().alias("value"))


_k = lambda c, n: F.col(c) % n
_NAMES = "CASE doc_id % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' WHEN 4 THEN 'copied' WHEN 5 THEN 'typechange' ELSE 'odd' END"
_KINDS = "CASE doc_id % 6 WHEN 0 THEN 'commit' WHEN 1 THEN 'tree' WHEN 2 THEN 'blob' WHEN 3 THEN 'tag' WHEN 4 THEN 'other' END"
_MODES = "CASE doc_id % 4 WHEN 0 THEN '40000' WHEN 1 THEN '160000' WHEN 2 THEN '040000' ELSE '100644' END"
_column("x01_change_code", "docs", "doc_id", lambda: X.change_code(F.expr(_NAMES)), "CASE doc_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'R' WHEN 4 THEN 'C' WHEN 5 THEN 'T' END")
_column("x02_header_version", "docs", "doc_id", lambda: X.header_version(_k("doc_id", 5)), "CASE doc_id % 5 WHEN 2 THEN 'v2' WHEN 3 THEN 'v3' END")
_column("x03_octal_mode", "docs", "doc_id", lambda: X.octal_mode(F.when(_k("doc_id", 2) == 0, 33188).otherwise(F.when(_k("doc_id", 3) == 0, 0).otherwise(16384))), "CASE WHEN doc_id % 2 = 0 THEN '100644' WHEN doc_id % 3 = 0 THEN '000000' ELSE '040000' END")
_column("x04_present_oid", "objects", "doc_id", lambda: X.present_oid(F.when(_k("doc_id", 3) == 0, "0" * 40).otherwise(F.col("oid"))), "CASE WHEN doc_id % 3 <> 0 THEN oid END")
_column("x05_kind_label", "docs", "doc_id", lambda: X.kind_label(F.expr(_KINDS)), "CASE doc_id % 6 WHEN 0 THEN 'commit' WHEN 1 THEN 'tree' WHEN 2 THEN 'blob' WHEN 3 THEN 'tag' ELSE 'unknown' END")
_column("x06_decoration", "decor_refs", "ref_name", lambda: F.concat_ws("|", X.decoration_rank("ref_name").cast("string"), X.decoration_label("ref_name")), "CASE WHEN ref_name LIKE 'refs/heads/%' THEN '1|' || substr(ref_name, 12) WHEN ref_name LIKE 'refs/tags/%' THEN '2|tag: ' || substr(ref_name, 11) ELSE '' END")
_column("x07_signed_time", "docs", "doc_id", lambda: X.signed_time(F.col("doc_id") + 1700000000, _k("doc_id", 3) * 105 - 90), "concat(doc_id + 1700000000, CASE doc_id % 3 WHEN 0 THEN ' (UTC-01:30)' WHEN 1 THEN ' (UTC+00:15)' ELSE ' (UTC+02:00)' END)")
_column("x08_identity_label", "docs", "doc_id", lambda: X.identity_label("source", "lang"), "concat(source, ' <', lang, '>')")
_column("x09_repository_name", "urls", "page_id", lambda: X.repository_name("url"), r"nullif(regexp_extract(regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', ''), '([^/:]*)$', 1), '')")
_column("x10_tip_reference", "objects", "doc_id", lambda: X.tip_reference(F.when(_k("doc_id", 2) == 0, F.col("bundle_id")), "oid"), "CASE WHEN doc_id % 2 = 0 THEN bundle_id ELSE concat('refs/heads/bundle-tip-', substr(oid, 1, 12)) END")
_column("x11_one_line", "docs", "doc_id", lambda: F.md5(X.one_line("text").cast("binary")), r"md5(regexp_replace(text, '\r?\n', ' ', 'g'))")
_column("x12_kind_rank", "docs", "doc_id", lambda: X.kind_rank(F.expr(_KINDS)), "CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END")
_column("x13_tree_mode_kind", "docs", "doc_id", lambda: X.tree_mode_kind(F.expr(_MODES)), "CASE doc_id % 4 WHEN 1 THEN 'commit' WHEN 3 THEN 'blob' ELSE 'tree' END")
_column("x14_parent_label", "commits", "id", lambda: X.parent_label(F.array_compact(F.array(F.col("p1").cast("string"), F.col("p2").cast("string")))), "coalesce(nullif(concat_ws(', ', p1, p2), ''), '-')")
_column("x15_short_oid", "objects", "doc_id", lambda: F.concat_ws(" ", X.short_oid(F.when(_k("doc_id", 3) != 0, F.col("oid"))), X.short_oid("oid", 7)), "concat(CASE WHEN doc_id % 3 <> 0 THEN substr(oid, 1, 12) ELSE '-' END, ' ', substr(oid, 1, 7))")
_column("x15_short_subject", "objects", "doc_id", lambda: X.short_subject(F.when(_k("doc_id", 3) != 0, F.col("oid")), F.when(_k("doc_id", 2) == 0, F.col("bundle_id")).when(_k("doc_id", 5) == 0, "  ")), "CASE WHEN doc_id % 3 = 0 THEN '-' ELSE concat(substr(oid, 1, 12), CASE WHEN doc_id % 2 = 0 THEN concat(' ', bundle_id) ELSE '' END) END")
_column("h1_object_id", "docs", "doc_id", lambda: X.object_id(F.when(_k("doc_id", 5) == 0, "other").otherwise("blob"), "text"), "CASE WHEN doc_id % 5 <> 0 THEN sha1(concat('blob ', strlen(text), chr(0), text)) END")
_column("h2_content_digest", "transport", "page_id", lambda: F.concat_ws(" ", X.content_digest("html"), X.bundle_id("html")), "concat(sha256(html), ' ', substr(sha256(html), 1, 12))")


def _objects(spark, sf, whole=2000, preview=500):
    rows = view(spark, sf, "objects").withColumn("content", F.col("text").cast("binary"))
    return O.object_store(rows.dropDuplicates(["oid"]).drop("text", "doc_id", "bundle_id").withColumn("bundle_id", F.lit("b")), whole, preview)


ONE = "+ one AS (SELECT oid, any_value(text) AS text, any_value(size_bytes) AS size_bytes FROM objects GROUP BY oid)"


@query("object_store", duck(["objects"], ONE + " SELECT oid, size_bytes, least(size_bytes, CASE WHEN size_bytes > 2000 THEN 500 ELSE size_bytes END) AS kept, size_bytes > 2000 AS content_truncated FROM one"))
def object_store(spark, sf):
    return _objects(spark, sf).select("oid", "size_bytes", F.octet_length("content").alias("kept"), "content_truncated")



@query("text_stats", duck(["objects"], ONE + """ SELECT oid, true AS is_text, CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) END AS line_count FROM one"""))
def text_stats(spark, sf):
    return O.text_stats(_objects(spark, sf, 1 << 40)).select("oid", "is_text", "line_count")


@query("blob_lines", duck(["objects"], ONE + """, l AS (SELECT oid, list_concat([concat('text blob ', oid), concat('size: ', size_bytes, ' bytes'), concat('text lines: ', CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) END), ''],
  CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END) AS l FROM one)
  SELECT oid, count(*) AS n_lines, md5(string_agg(x, '|' ORDER BY i)) AS digest FROM (SELECT oid, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM l) GROUP BY oid"""))
def blob_lines(spark, sf):
    rows = O.blob_lines(_objects(spark, sf, 1 << 40))
    text = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]))
    return rows.groupBy("oid").agg(F.count("*").alias("n_lines"), F.md5(text.cast("binary")).alias("digest"))


@query("object_detail", duck(["objects"], ONE + ", p AS (SELECT oid, min(concat(bundle_id, '/', doc_id)) AS path FROM objects WHERE doc_id % 2 = 0 GROUP BY oid) SELECT oid, coalesce(path, 'blob.txt') AS syntax_path FROM one LEFT JOIN p USING (oid)"))
def object_detail(spark, sf):
    visits = view(spark, sf, "objects").where("doc_id % 2 = 0").select("oid", F.col("doc_id").alias("visit"), F.concat("bundle_id", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return O.object_detail(_objects(spark, sf, 1 << 40), O.blob_paths(visits, 1000)).select("oid", "syntax_path")


@query("blob_paths", duck(["docs"], "+ v AS (SELECT lang AS oid, doc_id AS visit, concat(source, '/', doc_id % 50) AS path FROM docs), f AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY visit) AS r FROM v) SELECT oid, array_to_string(list_sort(list_distinct(list(path))), ',') AS paths FROM f WHERE r <= 12 GROUP BY oid"))
def blob_paths(spark, sf):
    visits = view(spark, sf, "docs").select(F.col("lang").alias("oid"), F.col("doc_id").alias("visit"), F.concat("source", F.lit("/"), _k("doc_id", 50).cast("string")).alias("path"))
    return O.blob_paths(visits).select("oid", F.concat_ws(",", "paths").alias("paths"))


@query("blob_preview", duck(["docs"], """+ l AS (SELECT doc_id AS oid, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM docs), n AS (SELECT *, max(pos) OVER (PARTITION BY oid) + 1 AS n FROM l)
  SELECT oid, pos, CASE WHEN n > 5 AND pos = 4 THEN concat('... (', n - 4, ' more lines)') ELSE md5(line) END AS line FROM n WHERE pos < 5"""))
def blob_preview(spark, sf):
    lines = view(spark, sf, "docs").select(F.col("doc_id").alias("oid"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.md5(F.col("line").cast("binary")))
    return O.blob_preview(lines, 5)


@query("commit_fields", duck(["commits"], "SELECT id, md5(concat('t', id)) || '00000000' AS tree_oid, CASE WHEN p1 IS NULL THEN 0 ELSE 1 END + CASE WHEN p2 IS NULL THEN 0 ELSE 1 END AS n_parents FROM commits"))
def commit_fields(spark, sf):
    oid = lambda p, c: F.concat(F.md5(F.concat(F.lit(p), F.col(c).cast("string")).cast("binary")), F.lit("0" * 8))
    text = F.concat_ws("\n", F.concat(F.lit("tree "), oid("t", "id")), F.when(F.col("p1").isNotNull(), F.concat(F.lit("parent "), oid("c", "p1"))), F.when(F.col("p2").isNotNull(), F.concat(F.lit("parent "), oid("c", "p2"))), F.lit("parent nonsense"), F.lit("author a"), F.lit(""), F.concat(F.lit("parent "), oid("c", "id")))
    found = O.commit_fields(view(spark, sf, "commits").select("id", text.cast("binary").alias("content")))
    return found.select("id", "tree_oid", F.size("parent_oids").alias("n_parents"))


@query("reachable", duck(["heads", "edges", "commits", "tree_entries"], """+ c(bundle_id, oid) AS (SELECT bundle_id, oid FROM heads UNION SELECT c.bundle_id, e.parent FROM c JOIN edges e ON e.child = c.oid),
  t(bundle_id, oid) AS (SELECT bundle_id, CASE WHEN oid % 2 = 0 THEN concat('r', oid % 5) ELSE concat('n', oid % 25) END FROM c UNION SELECT t.bundle_id, child_oid FROM t JOIN tree_entries ON tree_oid = t.oid WHERE child_kind = 'tree')
  SELECT bundle_id, oid::varchar AS oid, 'commit' AS kind FROM c UNION ALL SELECT bundle_id, oid, 'tree' FROM t UNION ALL SELECT DISTINCT bundle_id, child_oid, child_kind FROM t JOIN tree_entries ON tree_oid = t.oid WHERE child_kind <> 'tree'""", True))
def reachable(spark, sf):
    text = lambda c: F.col(c).cast("string")
    tree = F.when(_k("id", 2) == 0, F.concat(F.lit("r"), _k("id", 5).cast("string"))).otherwise(F.concat(F.lit("n"), _k("id", 25).cast("string")))
    commits = view(spark, sf, "commits").select(text("id").alias("id"), tree.alias("tree_oid"))
    edges = view(spark, sf, "edges").select(text("child").alias("child"), text("parent").alias("parent"))
    return O.reachable(view(spark, sf, "heads").select("bundle_id", text("oid").alias("oid")), commits, edges, view(spark, sf, "tree_entries"))


INVENTORY = RESOLVED.rstrip().rstrip(",") + """, ix AS (SELECT bundle_id, oid, arg_min(kind, idx) AS kind, arg_min(out_size, idx) AS size_bytes, min(idx) AS first_entry_idx FROM resolved WHERE resolved GROUP BY ALL),
m AS (SELECT source AS bundle_id, bloboid(text) AS oid, min(doc_id) FILTER (doc_id % 3 = 1) AS d1, min(doc_id) AS d2 FROM docs WHERE doc_id % 3 <> 0 GROUP BY ALL),
inv AS (SELECT ix.*, d2 IS NOT NULL AS reachable, CASE WHEN d2 IS NOT NULL THEN 0 END AS head_index, CASE WHEN d1 IS NOT NULL THEN 1 WHEN d2 IS NOT NULL THEN 2 END AS commit_order, CASE WHEN d2 IS NOT NULL THEN concat(coalesce(d1, d2), '.txt') END AS path,
  row_number() OVER (PARTITION BY bundle_id ORDER BY CASE kind WHEN 'commit' THEN 0 WHEN 'tree' THEN 1 WHEN 'blob' THEN 2 WHEN 'tag' THEN 3 ELSE 4 END, oid) - 1 AS position FROM ix LEFT JOIN m USING (bundle_id, oid))""".replace("bloboid(text)", "sha1(concat('blob ', strlen(text), chr(0), text))")


def _inventory(spark, sf):
    """Each bundle's head has every third document in its tree, and its parent two of three."""
    resolved = checkpointed(L.resolve_bases(view(spark, sf, "ledger"), view(spark, sf, "baseline")))
    index = L.object_index(resolved).drop("copies")
    rows = view(spark, sf, "objects").select("doc_id", "bundle_id", "oid")
    name = lambda p: F.concat(F.lit(p), "bundle_id")
    in_tree = lambda t, some: rows.where(some).select(name(t).alias("tree_oid"), F.col("doc_id").alias("pos"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("oid").alias("child_oid"), F.lit("blob").alias("child_kind"))
    entries = in_tree("ta/", "doc_id % 3 = 1").unionByName(in_tree("tb/", "doc_id % 3 <> 0"))
    bundles = rows.select("bundle_id").distinct()
    commits = bundles.select(name("ca/").alias("id"), name("ta/").alias("tree_oid")).unionByName(bundles.select(name("cb/"), name("tb/")).toDF("id", "tree_oid"))
    edges = bundles.select(name("ca/").alias("child"), name("cb/").alias("parent"), F.lit(0).alias("parent_index"))
    heads = bundles.select("bundle_id", F.lit(0).alias("head_index"), name("ca/").alias("oid"))
    context = O.tree_context(H.visit_order(heads, commits, edges), commits, entries)
    return O.object_inventory(index, O.reachable(heads, commits, edges, entries), context), resolved


@query("object_inventory", duck(_VIEWS, INVENTORY + " SELECT bundle_id, oid, kind, size_bytes, first_entry_idx, reachable, head_index, commit_order, path, position FROM inv"))
def object_inventory(spark, sf):
    return _inventory(spark, sf)[0]


@query("inventory_summary", duck(_VIEWS, INVENTORY + " SELECT bundle_id, count(*) AS total, count(*) FILTER (reachable) AS reachable, count(*) FILTER (NOT reachable) AS unreachable, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}s" for k in ("commit", "tree", "blob", "tag")) + " FROM inv GROUP BY bundle_id"))
def inventory_summary(spark, sf):
    return O.inventory_summary(_inventory(spark, sf)[0])


@query("order_inventory", duck(_VIEWS, INVENTORY + """ SELECT bundle_id, oid, row_number() OVER (PARTITION BY bundle_id ORDER BY head_index NULLS LAST, commit_order NULLS LAST, path NULLS FIRST, CASE kind WHEN 'commit' THEN 0 WHEN 'tree' THEN 1 WHEN 'blob' THEN 2 WHEN 'tag' THEN 3 ELSE 4 END, oid) - 1 AS row FROM inv"""))
def order_inventory(spark, sf):
    return O.order_inventory(_inventory(spark, sf)[0]).select("bundle_id", "oid", "row")


@query("reachability_verdict", duck(_VIEWS, INVENTORY + " SELECT bundle_id, CASE WHEN count(*) FILTER (NOT reachable) = 0 THEN 'yes' ELSE concat('no (', count(*) FILTER (NOT reachable), '/', count(*), ' unreachable)') END AS verdict FROM inv GROUP BY bundle_id"))
def reachability_verdict(spark, sf):
    return O.reachability_verdict(_inventory(spark, sf)[0])


@query("ledger_targets", duck(_VIEWS, INVENTORY + " SELECT r.bundle_id, r.idx, CASE WHEN resolved THEN r.oid END AS oid, inv.kind, reachable FROM resolved r LEFT JOIN inv ON r.resolved AND inv.bundle_id = r.bundle_id AND inv.oid = r.oid"))
def ledger_targets(spark, sf):
    inventory, resolved = _inventory(spark, sf)
    return O.ledger_targets(resolved, inventory)


@query("transport_inventory", "SELECT concat('page_', page_id, '.html') AS name, strlen(coalesce(html, '')) AS size_bytes, sha256(coalesce(html, '')) AS sha256 FROM pages")
def transport_inventory(spark, sf):
    files = view(spark, sf, "transport").select(F.col("name").alias("path"), F.col("html").cast("binary").alias("content"))
    return I.transport_inventory(files).select("name", "size_bytes", "sha256")


PROOF = RESOLVED.rstrip().rstrip(",")


@query("report_proof", duck(_VIEWS, PROOF + " SELECT bundle_id, verification_status AS status, entries_declared, entries_parsed, entries_materialized, 'yes' AS checksum_verified, CASE WHEN thin_pack_detected THEN 'yes' ELSE 'no' END AS thin_pack, CASE WHEN transfer_allowed THEN 'yes' ELSE 'no' END AS transfer_allowed, coalesce(blocked_reason, '-') AS blocked_reason FROM proof"))
def report_proof(spark, sf):
    inventory, resolved = _inventory(spark, sf)
    return C.report_tables(L.proof(resolved, view(spark, sf, "declared")), transport_inventory(spark, sf), inventory)["proof"]


@query("report_objects", duck(_VIEWS, INVENTORY + " SELECT bundle_id, oid, kind, size_bytes, CASE WHEN reachable THEN 'yes' ELSE 'no' END AS reachable, coalesce(path, '-') AS path FROM inv"))
def report_objects(spark, sf):
    inventory, resolved = _inventory(spark, sf)
    return C.report_tables(L.proof(resolved, view(spark, sf, "declared")), transport_inventory(spark, sf), inventory)["objects"]


# Claims: per nation a bundle whose heads are its customers' last orders.
BUNDLES = """+ b AS (SELECT bundle_id, sum(oid) AS size_bytes, sha256(bundle_id::varchar) AS sha256, 'v2' AS version, max(oid) AS top FROM heads GROUP BY bundle_id)"""


def _claims(spark, sf):
    heads = view(spark, sf, "heads")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("head_index", "oid", "reference"))), lambda x: F.concat_ws(" ", x["oid"].cast("string"), x["reference"]))
    rows = heads.groupBy("bundle_id").agg(F.sum("oid").alias("size_bytes"), listed.alias("heads"), F.max_by("reference", "oid").alias("tip_ref"), F.max("oid").alias("range_to"))
    own = rows.withColumns({"sha256": F.sha2(F.col("bundle_id").cast("string").cast("binary"), 256), "version": F.lit("v2"), "prereqs": F.array(F.col("range_to").cast("string"))})
    k = F.col("bundle_id") % 8
    claims = own.withColumns(
        {
            "schema_version": F.when(k == 1, "2").otherwise("1"),
            "size_bytes": F.col("size_bytes") + F.when(k == 2, 1).otherwise(0),
            "sha256": F.when(k == 3, "x").otherwise(F.col("sha256")),
            "version": F.when(k == 4, "v3").otherwise(F.col("version")),
            "prereqs": F.when(k == 5, F.array(F.lit("p"))).otherwise(F.col("prereqs")),
            "heads": F.when(k == 6, F.reverse("heads")).otherwise(F.col("heads")),
            "tip_ref": F.when(k == 7, "refs/heads/none").otherwise(F.col("tip_ref")),
        }
    )
    return claims, own


@query("verify_integrity", duck(["heads"], BUNDLES + """, r AS (SELECT *, CASE bundle_id % 8 WHEN 1 THEN 'unsupported schema version: ''2''' WHEN 2 THEN concat('bundle size mismatch: metadata=', size_bytes + 1, ', actual=', size_bytes) WHEN 3 THEN concat('bundle sha256 mismatch: metadata=x, actual=', sha256)
  WHEN 4 THEN 'bundle header version mismatch: metadata=v3, actual=v2' WHEN 5 THEN 'bundle prerequisites mismatch between metadata and bundle header' WHEN 6 THEN CASE WHEN (SELECT count(*) FROM heads h WHERE h.bundle_id = b.bundle_id) > 1 THEN 'bundle heads mismatch between metadata and bundle header' END
  WHEN 7 THEN 'metadata tip_ref/range_to_oid must match one bundle head entry' END AS failure FROM b) SELECT bundle_id, failure, failure IS NULL AS ok FROM r"""))
def verify_integrity(spark, sf):
    return C.verify_integrity(*_claims(spark, sf))


@query("verify_patch", duck(["heads"], BUNDLES + """ SELECT bundle_id, CASE bundle_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unsupported patch sidecar format: ''other''' WHEN 2 THEN concat('patch sidecar size mismatch: metadata=', size_bytes + 1, ', actual=', size_bytes) WHEN 3 THEN concat('patch sidecar sha256 mismatch: metadata=y, actual=', sha256) END AS failure FROM b"""))
def verify_patch(spark, sf):
    own = _claims(spark, sf)[1].select("bundle_id", F.col("size_bytes").alias("patch_size"), F.col("sha256").alias("patch_sha256"))
    k = F.col("bundle_id") % 5
    claims = own.select("bundle_id", F.when(k == 1, "other").when(k > 0, "unified-diff").alias("patch_format"), (F.col("patch_size") + F.when(k == 2, 1).otherwise(0)).alias("patch_size"), F.when(k == 3, "y").otherwise(F.col("patch_sha256")).alias("patch_sha256"))
    return C.verify_patch(claims, own)


@query("mismatched_rows", duck(["commits"], "SELECT repo, id, CASE WHEN cust % 97 = 0 THEN 'different' WHEN cust % 89 = 0 THEN 'not claimed' ELSE 'not so' END AS mismatch FROM commits WHERE cust % 97 = 0 OR cust % 89 = 0 OR cust % 83 = 0"))
def mismatched_rows(spark, sf):
    rows = view(spark, sf, "commits")
    claimed = rows.where("cust % 97 = 0 or cust % 89 <> 0").withColumn("p1", F.when(F.col("cust") % 97 == 0, -1).otherwise(F.col("p1")))
    return C.mismatched_rows(claimed, rows.where("cust % 97 = 0 or cust % 89 = 0 or cust % 83 <> 0"), ["repo", "id"], ["p1", "p2", "message"])


@query("build_claims", duck(["heads", "commits"], "SELECT bundle_id, i AS pos, c.id AS oid, c.message AS subject FROM (SELECT repo AS bundle_id, row_number() OVER (PARTITION BY repo ORDER BY time, id) - 1 AS i, id, message FROM commits) c"))
def build_claims(spark, sf):
    """Documents are built, read again and taken apart."""
    from pyspark.sql import window as W

    chain = view(spark, sf, "commits").select(F.col("repo").alias("bundle_id"), (F.row_number().over(W.Window.partitionBy("repo").orderBy("time", "id")) - 1).alias("pos"), F.col("id").alias("oid"), F.col("message").alias("subject"))
    docs = C.build_claims(chain.select("bundle_id").distinct(), chain, chain.withColumnRenamed("subject", "path"))
    read = docs.withColumn("d", F.from_json("json", "schema_version string, commit_chain array<struct<oid: long, subject: string>>"))
    return read.select("bundle_id", F.posexplode("d.commit_chain").alias("pos", "c")).select("bundle_id", "pos", "c.oid", "c.subject")
