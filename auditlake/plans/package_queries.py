"""Queries on package files, which Spark writes from the supplied tables and reads again, and on their trees and documents."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from auditlake.functions import columns as X
from auditlake.operators import claims as C
from auditlake.operators import history as H
from auditlake.operators import ledger as L
from auditlake.operators import objects as O
from auditlake.operators.iterate import checkpointed, shared_dir
from auditlake.plans.object_queries import _VIEWS, INVENTORY, _inventory, transport_inventory
from auditlake.plans.registry import query
from auditlake.plans.views import duck, view
from auditlake.sources import ingest as I

# Packages: the documents of a source in groups of up to 25. Each entry is a blob; every fourth is a delta on the one before.
PACKED = """+ g AS (SELECT *, (doc_id DIV 20) DIV 25 AS part, row_number() OVER (PARTITION BY source, (doc_id DIV 20) DIV 25 ORDER BY doc_id) - 1 AS idx, lag(text) OVER (PARTITION BY source, (doc_id DIV 20) DIV 25 ORDER BY doc_id) AS before FROM docs),
e AS (SELECT *, concat(source, '/', part) AS bundle, idx % 4 = 1 AS by_offset, idx % 4 = 3 AS by_id, CASE WHEN idx % 2 = 1 THEN concat(before, '#', doc_id) ELSE text END AS content FROM g),
p AS (SELECT bundle, part, min(doc_id) AS first_id, count(*) AS n FROM e GROUP BY ALL)""".replace(" DIV ", " // ")
_ENTRY_BLOB, _ENTRY_OFS, _ENTRY_REF = 3, 6, 7


def _entry(code: int, data: bytes, extra: bytes = b"") -> bytes:
    size, first, head = len(data) >> 4, code << 4 | len(data) & 15, bytearray()
    while size:
        head.append(first | 128)
        first, size = size & 127, size >> 7
    head.append(first)
    return bytes(head) + extra + zlib.compress(data)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _distance(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def _grown(base: bytes, more: bytes) -> bytes:
    """A delta that copies the base, in pieces of 65,535 bytes at most, and adds some bytes."""
    out = bytearray(_varint(len(base)) + _varint(len(base) + len(more)))
    for at in range(0, len(base), 65535):
        n = min(65535, len(base) - at)
        out += bytes([0b10111111, at & 255, at >> 8 & 255, at >> 16 & 255, at >> 24, n & 255, n >> 8])
    return bytes(out) + bytes([len(more)]) + more


def _body(rows: Iterator[tuple[int, str]]) -> tuple[bytes, bytes]:
    """Entries of a pack, and the last of them by itself."""
    body, offsets, before, at, e = bytearray(), [], b"", 12, b""
    for idx, (doc_id, text) in enumerate(rows):
        data = text.encode()
        offsets.append(at)
        if idx % 4 == 1:
            e = _entry(_ENTRY_OFS, _grown(before, f"#{doc_id}".encode()), _distance(at - offsets[-2]))
        elif idx % 4 == 3:
            e = _entry(_ENTRY_REF, _grown(before, f"#{doc_id}".encode()), hashlib.sha1(f"blob {len(before)}\0".encode() + before).digest())
        else:
            e = _entry(_ENTRY_BLOB, data)
        body += e
        at, before = at + len(e), data
    return bytes(body), e


def _pack(n: int, body: bytes) -> bytes:
    pack = b"PACK" + struct.pack(">II", 2, n) + body
    return pack + hashlib.sha1(pack).digest()


def _written(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's bundle file, by turns sound or spoilt in one of four ways."""
    pdf = pdf.sort_values("doc_id")
    pack = _pack(len(pdf), _body(zip(pdf["doc_id"], pdf["text"], strict=True))[0])
    part, source = int(pdf["part"].iloc[0]), pdf["source"].iloc[0]
    oid = lambda t: hashlib.sha1(f"blob {len(t)}\0".encode() + t).hexdigest()
    kind = int(pdf["doc_id"].iloc[0]) // 20 // 25 % 5
    pack = {1: pack[:-1] + bytes([pack[-1] ^ 1]), 2: pack[:4] + b"\0\0\0\x09" + pack[8:], 3: pack[:20]}.get(kind, pack)
    mark = "# v2 git bundle" if kind != 4 else "# v1 git bundle"
    header = f"{mark}\n-{oid(source.encode())} base of {source}\n{oid(pdf['text'].iloc[0].encode())} refs/heads/{source}/{part}\n\n"
    return pd.DataFrame({"path": [f"{source}/{part}"], "content": [header.encode() + pack]})


def _framed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's pack, its checksum right, by turns whole, with five bytes before its trailer, or with one entry less than it says."""
    pdf = pdf.sort_values("doc_id")
    body, last = _body(zip(pdf["doc_id"], pdf["text"], strict=True))
    kind = int(pdf["doc_id"].iloc[0]) % 3
    body = {1: body + b"\0" * 5, 2: body[: len(body) - len(last)]}.get(kind, body)
    return pd.DataFrame({"bundle_id": [f"{pdf['source'].iloc[0]}/{int(pdf['part'].iloc[0])}"], "pack": [_pack(len(pdf), body)]})


def _thin(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's pack of every second document, as deltas on those between, which the pack does not hold."""
    pdf, out = pdf.sort_values("doc_id"), []
    rows = list(zip(pdf["doc_id"], pdf["text"], strict=True))
    for (_, base), (doc_id, _) in zip(rows[::2], rows[1::2], strict=False):
        data = base.encode()
        out.append(_entry(_ENTRY_REF, _grown(data, f"#{doc_id}".encode()), hashlib.sha1(f"blob {len(data)}\0".encode() + data).digest()))
    return pd.DataFrame({"bundle_id": [f"{pdf['source'].iloc[0]}/{int(pdf['part'].iloc[0])}"], "pack": [_pack(len(out), b"".join(out))]})


def _groups(spark, sf):
    return view(spark, sf, "docs").select("doc_id", "source", "text", F.expr("(doc_id div 20) div 25").alias("part")).groupBy("source", "part")


def _files(spark, sf):
    return _groups(spark, sf).applyInPandas(_written, "path string, content binary")


_KIND = "(first_id // 20 // 25) % 5"


@query("bundle_headers", duck(["docs"], PACKED + f""" SELECT p.bundle AS path, CASE WHEN {_KIND} <> 4 THEN 'v2' END AS version, CASE WHEN {_KIND} = 4 THEN 'header line is missing' END AS error,
  CASE WHEN {_KIND} <> 4 THEN sha1(concat('blob ', strlen(split_part(p.bundle, '/', 1)), chr(0), split_part(p.bundle, '/', 1))) END AS prereq,
  CASE WHEN {_KIND} <> 4 THEN sha1(concat('blob ', strlen(d.text), chr(0), d.text)) END AS head, CASE WHEN {_KIND} <> 4 THEN concat('refs/heads/', p.bundle) END AS reference FROM p JOIN docs d ON d.doc_id = first_id"""))
def bundle_headers(spark, sf):
    bundles, prereqs, heads = I.bundle_headers(_files(spark, sf))
    rows = bundles.join(prereqs.select("path", F.col("oid").alias("prereq")), "path", "left").join(heads.select("path", F.col("oid").alias("head"), "reference"), "path", "left")
    return rows.select("path", "version", "error", "prereq", "head", "reference")


@query("pack_preflight", duck(["docs"], PACKED + f""" SELECT bundle AS path, CASE {_KIND} WHEN 1 THEN 'pack trailer checksum mismatch' WHEN 2 THEN 'unsupported pack version: 9' WHEN 3 THEN 'pack payload is too small' END AS failure,
  CASE WHEN {_KIND} <> 3 THEN n WHEN n > 0 THEN n END AS declared, {_KIND} = 0 AS checksum_verified FROM p WHERE {_KIND} <> 4"""))
def pack_preflight(spark, sf):
    bundles = I.bundle_headers(_files(spark, sf))[0].where("error is null")
    found = L.pack_preflight(bundles)
    return found.select("path", F.regexp_replace("failure", ": computed=.*", "").alias("failure"), "declared", "checksum_verified")


@query("ingest_packs", duck(["docs"], PACKED + f""" SELECT e.bundle AS bundle_id, idx, CASE WHEN by_offset THEN 'ofs-delta' WHEN by_id THEN 'ref-delta' ELSE 'blob' END AS kind, 'blob' AS result_kind, CASE WHEN by_id AND idx >= 1 THEN 'baseline' ELSE 'in-pack' END AS resolved_via,
  CASE WHEN idx % 2 = 1 THEN strlen(content) END AS reconstructed_size, sha1(concat('blob ', strlen(content), chr(0), content)) AS result_oid, strlen(content) AS n_bytes, NULL AS error FROM e JOIN p USING (bundle) WHERE {_KIND} = 0""").replace("CASE WHEN by_id AND idx >= 1 THEN 'baseline' ELSE 'in-pack' END", "'in-pack'"))
def ingest_packs(spark, sf):
    bundles = I.bundle_headers(_files(spark, sf))[0]
    sound = L.pack_preflight(bundles.where("error is null")).where("failure is null")
    rows = I.ingest_packs(sound.select(F.col("path").alias("bundle_id"), "pack"))
    return rows.select("bundle_id", "idx", "kind", "result_kind", "resolved_via", "reconstructed_size", "result_oid", F.octet_length("content").cast("long").alias("n_bytes"), "error")


@query("framing_check", duck(["docs"], PACKED + """ SELECT bundle AS bundle_id, n AS declared, n - (first_id % 3 = 2)::int AS parsed, CASE first_id % 3 WHEN 1 THEN 5 ELSE 0 END AS bytes_left, 0 AS gaps, CASE first_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'trailing bytes' ELSE 'entries missing' END AS status FROM p"""))
def framing_check(spark, sf):
    """Real packs as read: whole ones, some with bytes before the trailer, some with an entry too few."""
    packs = checkpointed(_groups(spark, sf).applyInPandas(_framed, "bundle_id string, pack binary"))
    told = L.pack_preflight(packs.withColumnRenamed("bundle_id", "path")).select(F.col("path").alias("bundle_id"), "declared", F.col("checksum_verified").alias("sound"))
    bundles = packs.select("bundle_id", (F.octet_length("pack") - I.TRAILER).alias("trailer_offset")).join(told.where("sound").drop("sound"), "bundle_id")
    return L.framing_check(I.ingest_packs(packs), bundles)


@query("ingest_thin_packs", duck(["docs"], PACKED + """, bases AS (SELECT DISTINCT source, sha1(concat('blob ', strlen(text), chr(0), text)) AS oid FROM docs WHERE doc_id % 97 <> 0),
  t AS (SELECT bundle, (idx - 1) // 2 AS idx, sha1(concat('blob ', strlen(before), chr(0), before)) AS base_oid, sha1(concat('blob ', strlen(content), chr(0), content)) AS oid, source FROM e WHERE idx % 2 = 1),
  m AS (SELECT t.*, b.oid IS NOT NULL AS known, EXISTS (SELECT 1 FROM t x WHERE x.bundle = t.bundle AND x.idx < t.idx AND x.oid = t.base_oid) AS own FROM t LEFT JOIN bases b ON b.source = t.source AND b.oid = t.base_oid),
  f AS (SELECT bundle, min(idx) AS failed FROM m WHERE NOT known AND NOT own GROUP BY bundle)
  SELECT m.bundle AS bundle_id, idx, base_oid, CASE WHEN idx = failed THEN NULL WHEN own THEN 'in-pack' ELSE 'baseline' END AS resolved_via, CASE WHEN idx IS DISTINCT FROM failed THEN m.oid END AS result_oid, CASE WHEN idx = failed THEN concat('ref-delta references unresolved base object ', base_oid, ' (external dependency/thin pack)') END AS error
  FROM m LEFT JOIN f ON f.bundle = m.bundle WHERE failed IS NULL OR idx <= failed"""))
def ingest_thin_packs(spark, sf):
    """Packs that build upon what the receiver has, which lacks some of it."""
    packs = checkpointed(_groups(spark, sf).applyInPandas(_thin, "bundle_id string, pack binary"))
    held = view(spark, sf, "docs").where("doc_id % 97 <> 0").select(F.col("source").alias("receiver"), X.object_id(F.lit("blob"), "text").alias("oid"), F.lit("blob").alias("kind"), F.col("text").cast("binary").alias("content"))
    own = packs.select("bundle_id", F.split_part("bundle_id", F.lit("/"), F.lit(1)).alias("receiver"))
    return I.ingest_packs(packs, held, own).select("bundle_id", "idx", "base_oid", "resolved_via", "result_oid", "error")


# Archives: ten pages each, with or without the one bundle that an archive must have.


def _zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    out, part = io.BytesIO(), int(pdf["part"].iloc[0])
    with zipfile.ZipFile(out, "w") as z:
        for k in range(part % 3):
            z.writestr(f"z{k}.bundle", f"bundle {part}")
        for name, html in zip(pdf["name"], pdf["html"], strict=True):
            z.writestr(name, html)
        z.writestr("sub/", "")
    return pd.DataFrame({"path": [f"a{part}.zip"], "content": [out.getvalue()]})


@query("transport_archives", duck(["transport"], """+ m AS (SELECT page_id // 10 AS part, name, html AS data FROM transport UNION ALL SELECT DISTINCT page_id // 10, concat('z', k, '.bundle'), concat('bundle ', page_id // 10) FROM transport, unnest([0, 1]) t(k) WHERE k < (page_id // 10) % 3)
  SELECT concat('a', part, '.zip') AS path, name, strlen(data) AS size_bytes, sha256(data) AS sha256, CASE WHEN part % 3 <> 1 THEN concat('archive must hold exactly one .bundle member, not ', part % 3) END AS error FROM m"""))
def transport_archives(spark, sf):
    pages = view(spark, sf, "transport").withColumn("part", F.expr("page_id div 10"))
    files = pages.groupBy("part").applyInPandas(_zipped, "path string, content binary")
    return I.transport_inventory(files).select("path", "name", "size_bytes", "sha256", "error")


# Creation metadata, written as files and loaded.


_REFUSED = "source IN ('src3', 'src7', 'src11')"


@query("load_claims", duck(["docs"], f"""SELECT source AS bundle_id, CASE WHEN NOT {_REFUSED} THEN count(*) END AS commits, CASE WHEN NOT {_REFUSED} THEN min(doc_id) END AS first_oid, CASE WHEN NOT {_REFUSED} THEN max(doc_id) END AS last_oid,
  CASE WHEN source IN ('src3', 'src11') THEN 'document is not as its schema says' WHEN source = 'src7' THEN 'unsupported schema version: ''2''' END AS error FROM docs GROUP BY source"""))
def load_claims(spark, sf):
    """Documents written and read again; one is cut off, one of another version, one has a text for a number."""
    from pyspark.sql import window as W

    chain = view(spark, sf, "docs").select(F.col("source").alias("bundle_id"), (F.row_number().over(W.Window.partitionBy("source").orderBy("doc_id")) - 1).alias("pos"), F.col("doc_id").alias("oid"), "lang")
    folder = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    docs = C.build_claims(chain.select("bundle_id").distinct(), chain, chain)
    b = F.col("bundle_id")
    spoilt = F.when(b == "src3", F.substring("json", 1, 100)).when(b == "src7", F.replace("json", F.lit('"schema_version":"1"'), F.lit('"schema_version":"2"'))).when(b == "src11", F.regexp_replace("json", r'"oid":(\d+)', '"oid":"$1x"')).otherwise(F.col("json"))
    C.write_documents(docs.withColumn("json", spoilt), folder)
    read = C.read_documents(spark, folder, "schema_version string, commit_chain array<struct<oid: long, lang: string>>")
    listed = F.col("doc.commit_chain")
    return read.select(F.col("name").alias("bundle_id"), F.when(F.col("error").isNull(), F.size(listed)).cast("long").alias("commits"), F.get(listed, F.lit(0))["oid"].alias("first_oid"), F.element_at(listed, -1)["oid"].alias("last_oid"), "error")


# Trees as stored: mode, name and id of each entry, one after the other.
TREES = """+ t AS (SELECT tree_oid, row_number() OVER (PARTITION BY tree_oid ORDER BY pos) - 1 AS pos, mode, name, sha1(child_oid) AS child_oid, child_kind FROM tree_entries)"""


def _trees(spark, sf):
    e = view(spark, sf, "tree_entries")
    one = F.concat(F.concat("mode", F.lit(" "), "name").cast("binary"), F.lit(b"\0"), F.unhex(F.sha1("child_oid")))
    listed = F.array_sort(F.collect_list(F.struct("pos", one.alias("raw"))))
    return e.groupBy(F.col("tree_oid").alias("oid")).agg(F.concat_ws("", F.transform(listed, lambda x: F.hex(x["raw"]))).alias("h")).select("oid", F.unhex("h").alias("content"))


@query("explode_trees", duck(["tree_entries"], TREES + " SELECT tree_oid, pos, mode, name, child_oid, child_kind, NULL AS error FROM t UNION ALL SELECT concat(tree_oid, '-cut'), NULL, NULL, NULL, NULL, NULL, concat('tree entry ', count(*) - 1, ' is malformed') FROM t GROUP BY tree_oid"))
def explode_trees(spark, sf):
    """Every tree as it is and without its last byte."""
    whole = _trees(spark, sf)
    cut = whole.select(F.concat("oid", F.lit("-cut")).alias("oid"), F.substr("content", F.lit(1), F.octet_length("content") - 1).alias("content"))
    return O.explode_trees(whole.unionByName(cut))


# Detail lines of commits, trees and tags; blobs have a query of their own.
COMMIT = "concat('tree t', id, chr(10), CASE WHEN p1 IS NOT NULL THEN concat('parent c', p1, chr(10)) ELSE '' END, 'author a', cust, chr(10), 'gpgsig x', chr(10), 'committer b', cust, chr(10), chr(10), message, chr(10), chr(10), 'end', id)"


@query("object_lines", duck(["commits", "tree_entries"], TREES + f""", l AS (SELECT concat('c', id) AS oid, list_concat([concat('commit c', id), concat('tree t', id)], CASE WHEN p1 IS NOT NULL THEN [concat('parent c', p1)] ELSE [] END, [concat('author a', cust), concat('committer b', cust), '', message, '', concat('end', id)]) AS l FROM commits
  UNION ALL SELECT concat('g', id), [concat('tag g', id), '', 'object', concat('tag ', message)] FROM commits UNION ALL SELECT concat('u', id), [concat('object u', id), 'unsupported object type for detail rendering'] FROM commits
  UNION ALL SELECT tree_oid, list_concat([concat('tree ', tree_oid), ''], list(concat(lpad(mode, 6, ' '), ' ', rpad(child_kind, 7, ' '), ' ', child_oid, ' ', name) ORDER BY pos)) FROM t GROUP BY tree_oid)
  SELECT oid, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l"""))
def object_lines(spark, sf):
    c = view(spark, sf, "commits")
    text = lambda x: x.cast("binary").alias("content")
    one = lambda p, kind, content: c.select(F.lit("b").alias("bundle_id"), F.concat(F.lit(p), F.col("id").cast("string")).alias("oid"), F.lit(kind).alias("kind"), text(content))
    objects = one("c", "commit", F.expr(COMMIT)).unionByName(one("g", "tag", F.concat(F.lit("object\ntag "), "message", F.lit("\n")))).unionByName(one("u", "other", F.col("message")))
    objects = objects.unionByName(_trees(spark, sf).select(F.lit("b").alias("bundle_id"), "oid", F.lit("tree").alias("kind"), "content"))
    return O.object_lines(objects.withColumns({"size_bytes": F.octet_length("content"), "content_truncated": F.lit(False)})).select("oid", "line", "pos")


@query("preview_lines", duck(["objects"], """+ one AS (SELECT oid, any_value(text) AS text, any_value(size_bytes) AS size_bytes FROM objects GROUP BY oid), paths AS (SELECT oid, list_sort(list(concat('p', lpad(doc_id::varchar, 9, '0')))) AS p FROM objects WHERE doc_id % 3 = 0 GROUP BY oid),
  b AS (SELECT *, CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END AS body FROM one),
  l AS (SELECT oid, list_concat([concat('blob ', oid), concat('size: ', size_bytes, ' bytes'), 'content: text', concat('text lines: ', len(body))],
    CASE WHEN p IS NULL THEN [CASE WHEN ascii(oid) % 2 = 0 THEN 'blob paths: (none found in advertised-head trees)' ELSE 'blob paths: (none; object is unreachable from advertised heads)' END] ELSE list_concat([concat('blob paths: ', least(len(p), 12))], list_transform(p[1:8], lambda x: concat('  - ', x)), CASE WHEN len(p) > 8 THEN [concat('  ... and ', least(len(p), 12) - 8, ' more')] ELSE [] END) END,
    CASE WHEN len(body) > 0 THEN list_concat(['', 'content preview:'], body) ELSE [] END) AS l FROM b LEFT JOIN paths USING (oid))
  SELECT oid, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l"""))
def preview_lines(spark, sf):
    rows = view(spark, sf, "objects")
    visits = rows.where("doc_id % 3 = 0").select("oid", F.col("doc_id").alias("visit"), F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    objects = rows.dropDuplicates(["oid"]).select(F.lit("b").alias("bundle_id"), "oid", "kind", "size_bytes", F.col("text").cast("binary").alias("content"), F.lit(False).alias("content_truncated"))
    found = O.preview_lines(objects, O.object_lines(objects), O.blob_paths(visits), objects.where(F.ascii("oid") % 2 == 0))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]))
    return found.groupBy("oid").agg(F.count("*").alias("n_lines"), F.md5(text.cast("binary")).alias("digest"))


@query("tree_context", duck(["heads", "edges", "commits", "tree_entries"], """+ t AS (SELECT repo AS bundle_id, id, row_number() OVER (PARTITION BY repo ORDER BY id) AS commit_order, CASE WHEN id % 2 = 0 THEN concat('r', id % 5) ELSE concat('n', id % 25) END AS oid FROM commits),
  w(bundle_id, oid, commit_order, k, path, kind) AS (SELECT bundle_id, oid, min(commit_order), []::bigint[], NULL::varchar, 'tree' FROM t GROUP BY ALL UNION ALL SELECT w.bundle_id, e.child_oid, w.commit_order, list_append(w.k, e.pos), concat_ws('/', w.path, e.name), e.child_kind FROM w JOIN tree_entries e ON e.tree_oid = w.oid WHERE w.kind = 'tree')
  SELECT bundle_id, oid, 0 AS head_index, (arg_min(struct_pack(commit_order, path), (commit_order, k))).commit_order AS commit_order, (arg_min(struct_pack(commit_order, path), (commit_order, k))).path AS path FROM w GROUP BY bundle_id, oid""", True))
def tree_context(spark, sf):
    from pyspark.sql import window as W

    c = view(spark, sf, "commits")
    tree = F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), (F.col("id") % 5).cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("id") % 25).cast("string")))
    visits = c.select(F.col("repo").alias("bundle_id"), "id", F.lit(0).alias("head_index"), F.row_number().over(W.Window.partitionBy("repo").orderBy("id")).alias("commit_order"))
    return O.tree_context(visits, c.select("id", tree.alias("tree_oid")), view(spark, sf, "tree_entries"))


# What to ship, and what a package lacks.
SHIP = """+ ends AS (SELECT a.bundle_id, a.oid AS tip, CASE WHEN a.cust % 3 = 0 THEN r.id END AS hidden FROM all_heads a LEFT JOIN ranked r ON r.cust = a.cust AND r.r = 3),
  c(bundle_id, side, oid) AS (SELECT bundle_id, 'tip', tip FROM ends UNION SELECT bundle_id, 'hidden', hidden FROM ends WHERE hidden IS NOT NULL UNION SELECT c.bundle_id, c.side, e.parent FROM c JOIN edges e ON e.child = c.oid),
  t(bundle_id, side, oid) AS (SELECT bundle_id, side, CASE WHEN oid % 2 = 0 THEN concat('r', oid % 5) ELSE concat('n', oid % 25) END FROM c UNION SELECT t.bundle_id, side, child_oid FROM t JOIN tree_entries ON tree_oid = t.oid WHERE child_kind = 'tree'),
  met AS (SELECT bundle_id, side, oid::varchar AS oid, 'commit' AS kind FROM c UNION SELECT bundle_id, side, oid, 'tree' FROM t UNION SELECT bundle_id, side, child_oid, child_kind FROM t JOIN tree_entries ON tree_oid = t.oid WHERE child_kind <> 'tree')"""


def _graph(spark, sf):
    text = lambda c: F.col(c).cast("string")
    tree = F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), (F.col("id") % 5).cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("id") % 25).cast("string")))
    commits = view(spark, sf, "commits").select(text("id").alias("id"), tree.alias("tree_oid"))
    return commits, view(spark, sf, "edges").select(text("child").alias("child"), text("parent").alias("parent")), view(spark, sf, "tree_entries")


@query("objects_to_ship", duck(["all_heads", "ranked", "edges", "tree_entries"], SHIP + " SELECT bundle_id AS range_id, oid, kind FROM met WHERE side = 'tip' AND (bundle_id, oid) NOT IN (SELECT (bundle_id, oid) FROM met WHERE side = 'hidden')", True))
def objects_to_ship(spark, sf):
    heads = view(spark, sf, "all_heads").select(F.col("bundle_id").alias("range_id"), "cust", F.col("oid").cast("string").alias("tip"))
    third = view(spark, sf, "ranked").where("r = 3 and cust % 3 = 0").select("cust", F.col("id").cast("string").alias("hidden"))
    return O.objects_to_ship(heads.join(third, "cust", "left").select("range_id", "tip", "hidden"), *_graph(spark, sf))


@query("connectivity", duck(["all_heads", "edges", "commits", "tree_entries"], """+ here AS (SELECT id FROM commits WHERE id % 50 <> 0), pre AS (SELECT repo AS bundle_id, id AS oid FROM commits WHERE id % 40 = 0),
  entries AS (SELECT tree_oid, child_oid, CASE WHEN child_oid LIKE 's%7' THEN NULL ELSE child_kind END AS child_kind FROM tree_entries),
  c(bundle_id, side, oid) AS (SELECT bundle_id, 'tip', oid FROM all_heads WHERE oid % 50 <> 0 UNION SELECT bundle_id, 'pre', oid FROM pre WHERE oid % 50 <> 0 UNION SELECT c.bundle_id, c.side, e.parent FROM c JOIN edges e ON e.child = c.oid JOIN here h ON h.id = e.parent),
  walked AS (SELECT bundle_id, oid FROM c WHERE side = 'tip' EXCEPT SELECT bundle_id, oid FROM c WHERE side = 'pre'),
  t(bundle_id, oid) AS (SELECT bundle_id, CASE WHEN oid % 2 = 0 THEN concat('r', oid % 5) ELSE concat('n', oid % 25) END FROM walked UNION SELECT t.bundle_id, child_oid FROM t JOIN entries ON tree_oid = t.oid WHERE child_kind = 'tree')
  SELECT bundle_id, bundle_id AS repo, 'head' AS kind, oid::varchar AS oid FROM all_heads WHERE oid % 50 = 0
  UNION ALL SELECT DISTINCT w.bundle_id, w.bundle_id, 'parent', e.parent::varchar FROM walked w JOIN edges e ON e.child = w.oid WHERE e.parent % 50 = 0 AND (w.bundle_id, e.parent) NOT IN (SELECT (bundle_id, oid) FROM pre)
  UNION ALL SELECT bundle_id, bundle_id, 'tree', oid FROM t WHERE oid LIKE '%4' OR bundle_id % 2 = 1 AND oid LIKE '%5' UNION ALL SELECT DISTINCT bundle_id, bundle_id, 'entry', child_oid FROM t JOIN entries ON tree_oid = t.oid WHERE child_kind <> 'tree' AND (child_oid LIKE '%4' OR bundle_id % 2 = 1 AND child_oid LIKE '%5')
  UNION ALL SELECT DISTINCT bundle_id, bundle_id, 'unknown', child_oid FROM t JOIN entries ON tree_oid = t.oid WHERE child_kind IS NULL""", True))
def connectivity(spark, sf):
    """Commits whose id is a multiple of 50 and objects whose id ends in 4 are absent, and, from half of the repositories, those in 5; links that end in 7 are of unknown kind."""
    commits, edges, entries = _graph(spark, sf)
    heads = view(spark, sf, "all_heads").select("bundle_id", F.col("bundle_id").alias("repo"), F.col("oid").cast("string").alias("oid"))
    prereqs = view(spark, sf, "commits").where("id % 40 = 0").select(F.col("repo").alias("bundle_id"), F.col("id").cast("string").alias("oid"))
    odd = entries.select("tree_oid", "child_oid", F.when(~F.col("child_oid").rlike("^s.*7$"), F.col("child_kind")).alias("child_kind"))
    objects = entries.select(F.explode(F.array("tree_oid", "child_oid")).alias("oid")).distinct().where("oid not like '%4'").withColumn("repo", F.explode(F.sequence(F.lit(0), F.lit(24)))).where("repo % 2 = 0 or oid not like '%5'")
    here = commits.where("cast(id as bigint) % 50 <> 0").join(view(spark, sf, "commits").select(F.col("id").cast("string").alias("id"), "repo"), "id")
    return H.dangling(heads, prereqs, here, edges, odd, objects)


# Documents and whole checks.


@query("audit_document", duck(_VIEWS, INVENTORY + """, s AS (SELECT bundle_id, count(*) AS total, count(*) FILTER (reachable) AS reachable FROM inv GROUP BY bundle_id)
  SELECT p.bundle_id, '1' AS schema_version, p.entries_declared AS declared, p.entries_parsed AS parsed, (SELECT count(*) FROM resolved r WHERE r.bundle_id = p.bundle_id AND NOT resolved) AS unresolved, total, total - reachable AS unreachable, total AS objects, 0 AS details,
    (SELECT min(oid) FROM inv WHERE inv.bundle_id = p.bundle_id AND position = 0) AS first_object FROM proof p JOIN s USING (bundle_id)"""))
def audit_document(spark, sf):
    """The documents' own JSON, read back."""
    inventory, resolved = _inventory(spark, sf)
    proofs = L.proof(resolved, view(spark, sf, "declared"))
    sections = L.ledger_sections(resolved, "summary").select("section", *[F.col(c) for c in ("bundle_id", "idx")])
    ledger = sections.join(L.encode_ledger(resolved), ["bundle_id", "idx"])
    bundles = proofs.select("bundle_id", F.concat("bundle_id", F.lit(".bundle")).alias("bundle_path"))
    heads = inventory.where("position = 0").select("bundle_id", F.lit(0).alias("head_index"), "oid", F.lit("refs/heads/main").alias("reference"))
    prereqs = heads.select("bundle_id", F.lit(0).alias("pos"), "oid")
    transport = heads.select("bundle_id", F.concat("bundle_id", F.lit(".bundle")).alias("name"), F.lit(0).alias("size_bytes"), F.sha2("oid", 256).alias("sha256"))
    docs = C.audit_document(bundles, heads, prereqs, transport, proofs, ledger, inventory, inventory.select("bundle_id", "oid", "kind"))
    shape = "schema_version string, entry_ledger struct<declared_entries long, parsed_entries long, unresolved_entry_rows array<struct<idx long>>>, pack_summary struct<total_objects long, unreachable_objects long>, pack_objects array<struct<oid string>>, object_details array<struct<oid string>>"
    d = docs.select("bundle_id", F.from_json("document", shape).alias("d"))
    size = lambda c: F.size(f"d.{c}").cast("long")
    return d.select("bundle_id", "d.schema_version", F.col("d.entry_ledger.declared_entries").alias("declared"), F.col("d.entry_ledger.parsed_entries").alias("parsed"), size("entry_ledger.unresolved_entry_rows").alias("unresolved"), F.col("d.pack_summary.total_objects").alias("total"), F.col("d.pack_summary.unreachable_objects").alias("unreachable"), size("pack_objects").alias("objects"), size("object_details").alias("details"), F.get("d.pack_objects", F.lit(0))["oid"].alias("first_object"))


@query("report_transport", duck(["transport"], "SELECT name, strlen(html) AS size_bytes, sha256(html) AS sha256 FROM transport"))
def report_transport(spark, sf):
    inventory, resolved = _inventory(spark, sf)
    return C.report_tables(L.proof(resolved, view(spark, sf, "declared")), transport_inventory(spark, sf), inventory)["transport"]


@query("verify_truth", duck(["rev_commits", "rev_files"], """+ b AS (SELECT DISTINCT bundle_id, substr(bundle_id, 4)::int % 6 AS k FROM rev_commits)
  SELECT bundle_id, CASE k WHEN 1 THEN 'range_from_oid does not exist' WHEN 2 THEN 'range_to_oid does not exist' WHEN 3 THEN 'range_to_oid does not descend from range_from_oid' WHEN 4 THEN 'commit_chain differs from the repository at position 0' WHEN 5 THEN 'changed_files differs from the repository at position 0' END AS failure FROM b"""))
def verify_truth(spark, sf):
    """Claims of each bundle's revisions, spoilt by turns; chain and files are recomputed from commits and files."""
    from auditlake.operators import snapshot as S
    from auditlake.plans.change_queries import _rev_edges, _rev_graph
    from pyspark.sql import window as W

    names = view(spark, sf, "rev_commits").select("bundle_id").distinct().withColumn("k", F.substring("bundle_id", 4, 9).cast("int") % 6)
    rev = lambda n: F.concat("bundle_id", F.lit(f"/r{n}"))
    k = F.col("k")
    claims = names.select("bundle_id", F.when(k == 1, "none").when(k == 3, rev(3)).otherwise(rev(1)).alias("range_from"), F.when(k == 2, "none").when(k == 3, rev(1)).otherwise(rev(3)).alias("range_to"))
    edges, graph = _rev_edges(spark, sf), _rev_graph(spark, sf).withColumn("committer", F.col("author"))
    guard = H.range_guard(claims.select(F.col("bundle_id").alias("range_id"), F.col("range_to").alias("tip"), F.col("range_from").alias("base")), edges).select(F.col("range_id").alias("bundle_id"), "linear")
    ranges = names.select(F.col("bundle_id").alias("range_id"), rev(3).alias("tip"), rev(1).alias("hidden"))
    chain = H.commit_chain(ranges, graph, edges).select(F.col("range_id").alias("bundle_id"), F.col("position").alias("pos"), "oid", "subject")
    changed = S.changed_texts(names.select(F.col("bundle_id").alias("pair"), rev(1).alias("old_commit"), rev(3).alias("new_commit")), view(spark, sf, "rev_files"))
    files = changed.select(F.col("pair").alias("bundle_id"), (F.row_number().over(W.Window.partitionBy("pair").orderBy("path", "old_path")) - 1).alias("pos"), "status", "path", "old_path", "old_oid", "new_oid")
    # Two chains' first and second places changed over, and a file's status altered.
    turned = chain.join(names, "bundle_id").withColumn("pos", F.when((k == 4) & (F.col("pos") < 2), 1 - F.col("pos")).otherwise(F.col("pos"))).drop("k")
    altered = files.join(names, "bundle_id").withColumn("status", F.when((k == 5) & (F.col("pos") == 0), "C").otherwise(F.col("status"))).drop("k")
    return C.verify_truth(claims, view(spark, sf, "rev_commits").select(F.col("id").alias("oid")), guard, (turned, chain), (altered, files))


def _stamps():
    return {"tool_version": F.lit("1"), "generated_at_unix_secs": F.lit(0), "generated_by_username": F.lit("u"), "generated_by_hostname": F.lit("h")}


@query("claims_meet_contract", duck(["rev_commits"], "SELECT DISTINCT bundle_id, '' AS faults FROM rev_commits"))
def claims_meet_contract(spark, sf):
    """Creation documents as built from commits, changed files and patches, held against their contract."""
    from auditlake.operators import snapshot as S
    from auditlake.operators.contracts import contract_faults
    from auditlake.operators.lines import patches

    revisions, oid = view(spark, sf, "rev_commits"), lambda c: F.sha1(F.col(c).cast("binary"))
    person = F.struct(F.col("author").alias("name"), F.lit("").alias("email"), F.col("n").cast("long").alias("time_seconds"), F.lit(-60).alias("offset_minutes"))
    parents = F.array_compact(F.array(oid("first_parent")))
    chain = revisions.where("n > 1").select("bundle_id", "n", (F.col("n") - 2).alias("pos"), oid("id").alias("oid"), F.sha1(F.col("tree_oid").cast("binary")).alias("tree_oid"), parents.alias("parent_oids"), "subject", person.alias("author"), person.alias("committer")).drop("n")
    names = revisions.select("bundle_id").distinct()
    rev = lambda n: F.concat("bundle_id", F.lit(f"/r{n}"))
    changed = checkpointed(S.changed_texts(names.select(F.col("bundle_id").alias("pair"), rev(1).alias("old_commit"), rev(3).alias("new_commit")), view(spark, sf, "rev_files")))
    odd = S.binary("old_text") | S.binary("new_text")
    files = changed.select(F.col("pair").alias("bundle_id"), F.struct("path", "old_path").alias("pos"), "status", "path", "old_path", "old_oid", "new_oid", "old_mode", "new_mode", odd.alias("is_binary"))
    sidecar = S.patch_sidecar(patches(changed.where("not non_text")).select(F.col("pair").alias("bundle_id"), "path", "patch"))
    record = sidecar.select("bundle_id", F.struct(F.concat("bundle_id", F.lit(".patch")).alias("path"), "format", "size_bytes", "sha256").alias("patch_sidecar")).where("bundle_id <> 'src4'")
    head = F.sha1(rev(3).cast("binary"))
    bundles = names.join(record, "bundle_id", "left").select("bundle_id", "patch_sidecar", *[v.alias(k) for k, v in _stamps().items()], F.concat("bundle_id", F.lit(".bundle")).alias("bundle_path"), F.lit(1).alias("bundle_size_bytes"), F.sha2("bundle_id", 256).alias("bundle_sha256"), F.lit("v2").alias("bundle_header_version"), F.array(F.sha1(rev(1).cast("binary"))).alias("prerequisites"), F.array(F.struct(head.alias("oid"), F.lit("refs/heads/main").alias("reference"))).alias("heads"), F.sha1(rev(1).cast("binary")).alias("range_from_oid"), head.alias("range_to_oid"), F.lit("refs/heads/main").alias("tip_ref"))
    found = contract_faults(C.build_claims(bundles, chain, files), "creation", "bundle_id")
    return found.select("bundle_id", F.concat_ws("|", "faults").alias("faults"))


@query("audit_meets_contract", duck(["docs"], PACKED + f" SELECT bundle AS bundle_id, n AS entries, '' AS faults FROM p WHERE {_KIND} = 0"))
def audit_meets_contract(spark, sf):
    """Audit documents of packs as read from their files, with every section, held against their contract."""
    from auditlake.operators.contracts import contract_faults

    bundles, prereqs, heads = I.bundle_headers(_files(spark, sf))
    packs = checkpointed(L.pack_preflight(bundles.where("error is null")).where("failure is null").withColumnRenamed("path", "bundle_id"))
    rows = checkpointed(I.ingest_packs(packs.select("bundle_id", "pack")))
    ledger = rows.select("*", F.col("result_oid").alias("oid"), F.col("error").isNull().alias("resolved"), F.col("error").alias("note"))
    proofs = L.proof(ledger, packs.select("bundle_id", "declared"), packs.select("bundle_id", "checksum_verified"))
    entries = L.ledger_sections(C.entry_fields(ledger), "summary")
    index = ledger.groupBy("bundle_id", "oid").agg(F.min_by("result_kind", "idx").alias("kind"), F.min_by(F.octet_length("content"), "idx").alias("size_bytes"), F.min("idx").alias("position"))
    none = lambda t: F.lit(None).cast(t)
    inventory = index.withColumns({"reachable": F.lit(False), "head_index": none("int"), "commit_order": none("int"), "path": none("string")})
    details = index.select("bundle_id", "oid", "kind", "size_bytes", none("string").alias("syntax_path_hint"), F.array().cast("array<string>").alias("blob_paths"), none("int").alias("text_line_count"), F.array(F.lit("blob")).alias("lines"))
    named = lambda df: df.withColumnRenamed("path", "bundle_id")
    files = packs.select("bundle_id", *[v.alias(k) for k, v in _stamps().items()], F.concat("bundle_id", F.lit(".bundle")).alias("bundle_path"), F.octet_length("pack").alias("bundle_size_bytes"), F.sha2("pack", 256).alias("bundle_sha256"), F.col("version").alias("bundle_header_version"))
    transport = files.select("bundle_id", F.col("bundle_path").alias("name"), F.col("bundle_size_bytes").alias("size_bytes"), F.col("bundle_sha256").alias("sha256"))
    documents = checkpointed(C.audit_document(files, named(heads), named(prereqs), transport, C.proof_fields(proofs, packs), entries, inventory, details, "summary", "full"))
    found = contract_faults(documents, "audit", "bundle_id", "document")
    counted = documents.select("bundle_id", F.get_json_object("document", "$.pack_proof.entries_parsed").cast("long").alias("entries"))
    return counted.join(found, "bundle_id").select("bundle_id", "entries", F.concat_ws("|", "faults").alias("faults"))


# Documents against their contracts: whole ones from every document, by turns spoilt in one field.
CREATION_FAULTS = ["", "schema_version is no schema", "heads[].oid is no oid", "commit_chain[].author.offset_minutes is missing", "changed_files[].status is no status", "patch_sidecar.sha256 is no digest", "document has other fields", "prerequisites is no list", "bundle_size_bytes is no count", "schema_version is no schema", "commit_chain[].subject is no any", "changed_files[].is_binary is no flag", "heads is no list", "commit_chain[].parent_oids[] is no oid", "commit_chain[].committer.offset_minutes is no integer", "tip_ref is no text"]
# By turns from the ninth: what is found in the sound document, and the same value with another JSON type.
CREATION_TYPES = [(r'"bundle_size_bytes":(\d+)', '"bundle_size_bytes":"$1"'), ('"schema_version":"1"', '"schema_version":1'), ('"subject":""', '"subject":{}'), ('"is_binary":false', '"is_binary":"false"'), (r'"heads":\[(\{[^}]*\})\]', '"heads":$1'), (r'"parent_oids":\["[^"]*"\]', '"parent_oids":[7]'), ('"offset_minutes":0', '"offset_minutes":0.5'), ('"tip_ref":"[^"]*"', '"tip_ref":null')]
AUDIT_FAULTS = ["", "pack_proof.hash_algorithm is no hash", "entry_ledger.first_entries[].resolved_via is no via", "pack_objects[] has other fields", "object_detail_mode is no detail mode", "bundle_size_bytes is no count", "pack_summary.tree_objects is missing", "transport_entries[].name is no text", "pack_proof.checksum_verified is no flag", "pack_proof.pack_version is no pack version", "pack_summary is no object", "entry_ledger.last_entries is no list", "object_details[].lines[] is no any", "pack_proof.blocked_reason is no any", "pack_objects[].context_head_index is no count", "entry_ledger.first_entries[].resolved is no flag"]
AUDIT_TYPES = [('"checksum_verified":true', '"checksum_verified":"true"'), ('"pack_version":2', '"pack_version":"2"'), (r'"pack_summary":\{[^}]*\}', '"pack_summary":[]'), (r'"last_entries":\[\]', '"last_entries":{}'), (r'"lines":\[""\]', '"lines":["",null]'), ('"blocked_reason":null', '"blocked_reason":false'), ('"context_head_index":null', '"context_head_index":-1'), ('"resolved":true', '"resolved":1')]


def _retyped(json, types):
    """By turns of sixteen, from the ninth, a document with one value of another JSON type."""
    for n, (pattern, other) in enumerate(types, 8):
        json = F.when(F.col("doc_id") % 16 == n, F.regexp_replace(json, pattern, other)).otherwise(json)
    return json


def _faults_sql(names):
    return "SELECT doc_id, CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END AS faults FROM objects"


def _common(k):
    text = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return [F.lit("t").alias("tool_version"), F.col("doc_id").alias("generated_at_unix_secs"), F.lit("u").alias("generated_by_username"), F.lit("h").alias("generated_by_hostname"), text.alias("bundle_path"), F.sha2("oid", 256).alias("bundle_sha256"), F.lit("v2").alias("bundle_header_version")]


def _creation_faults(spark, sf):
    from auditlake.operators.contracts import contract_faults

    k = F.col("doc_id") % 16
    spoilt = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    person = lambda some: F.struct(F.lit("n").alias("name"), F.lit("").alias("email"), F.col("doc_id").alias("time_seconds"), (F.when(k != 3, F.lit(-60)) if some else F.lit(0)).alias("offset_minutes"))
    doc = F.struct(
        spoilt(1, "2", "1").alias("schema_version"),
        *_common(k),
        F.col("size_bytes").alias("bundle_size_bytes"),
        F.when(k != 7, F.array("oid")).alias("prerequisites"),
        F.array(F.struct(spoilt(2, "HEAD", F.col("oid")).alias("oid"), F.lit("refs/heads/main").alias("reference"))).alias("heads"),
        F.col("oid").alias("range_from_oid"),
        F.col("oid").alias("range_to_oid"),
        F.lit("refs/heads/main").alias("tip_ref"),
        F.array(F.struct("oid", F.col("oid").alias("tree_oid"), F.array("oid").alias("parent_oids"), F.lit("").alias("subject"), person(True).alias("author"), person(False).alias("committer"))).alias("commit_chain"),
        F.array(F.struct(spoilt(4, "X", "M").alias("status"), F.lit("p").alias("path"), F.lit("q").alias("old_path"), F.col("oid").alias("old_oid"), F.col("oid").alias("new_oid"), F.lit("100644").alias("old_mode"), F.lit("100755").alias("new_mode"), F.lit(False).alias("is_binary"))).alias("changed_files"),
        F.struct(F.lit("p").alias("path"), F.lit("unified-diff").alias("format"), F.lit(1).alias("size_bytes"), spoilt(5, "x", F.sha2("oid", 256)).alias("sha256")).alias("patch_sidecar"),
        F.when(k == 6, 1).alias("surprise"),
    )
    # Absent fields are left out; a null prerequisites field stands for one that is no list.
    json = F.regexp_replace(F.to_json(doc), r"^\{", F.when(k == 7, F.lit('{"prerequisites":5,')).otherwise(F.lit("{")))
    return contract_faults(view(spark, sf, "objects").select("doc_id", _retyped(json, CREATION_TYPES).alias("json")), "creation")


@query("creation_contract", duck(["objects"], _faults_sql(CREATION_FAULTS)))
def creation_contract(spark, sf):
    return _creation_faults(spark, sf).select("doc_id", F.concat_ws("|", "faults").alias("faults"))


@query("check_contract", duck(["objects"], "SELECT doc_id, doc_id % 16 = 0 AS sound, (doc_id % 16 <> 0)::int AS n_faults FROM objects"))
def check_contract(spark, sf):
    """Which documents may be taken, and how many rules the others break."""
    return _creation_faults(spark, sf).select("doc_id", (F.size("faults") == 0).alias("sound"), F.size("faults").alias("n_faults"))


@query("audit_contract", duck(["objects"], _faults_sql(AUDIT_FAULTS)))
def audit_contract(spark, sf):
    from auditlake.operators.contracts import CONTRACTS, contract_faults

    k = F.col("doc_id") % 16
    spoilt = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    one = F.lit(1)
    entry = F.struct(one.alias("idx"), one.alias("offset"), F.lit("blob").alias("kind"), one.alias("out_size"), F.lit(None).cast("int").alias("reconstructed_size"), F.lit(None).cast("string").alias("base"), F.col("oid").alias("result_oid"), F.lit("blob").alias("result_kind"), F.lit(True).alias("resolved"), spoilt(2, "elsewhere", "in-pack").alias("resolved_via"), F.lit(None).cast("string").alias("note"))
    special = {"verification_status": F.lit("ok"), "pack_version": F.lit(2), "checksum_verified": F.lit(True), "thin_pack_detected": F.lit(False), "transfer_allowed": F.lit(True), "blocked_reason": F.lit(None).cast("string"), "hash_algorithm": spoilt(1, "md5", "sha1"), "computed_pack_checksum": F.col("oid"), "trailer_pack_checksum": F.col("oid")}
    proof = F.struct(*[special.get(c, one).alias(c) for c in CONTRACTS["audit"]["pack_proof"]])
    book = F.struct(F.lit("summary").alias("mode"), *[one.alias(c) for c in ("declared_entries", "parsed_entries", "unresolved_entries")], F.array(entry).alias("first_entries"), *[F.array().cast("array<string>").alias(c) for c in ("last_entries", "unresolved_entry_rows", "entries")])
    whole = list(CONTRACTS["audit"]["pack_summary"])
    summary = F.to_json(F.struct(*[one.alias(c) for c in whole]))
    less = F.to_json(F.struct(*[one.alias(c) for c in whole if c != "tree_objects"]))
    thing = [F.col("oid").alias("oid"), F.lit("blob").alias("kind"), one.alias("size_bytes")]
    shown = F.to_json(F.array(F.struct(*thing, F.lit(True).alias("reachable_from_heads"), *[F.lit(None).cast("int").alias(c) for c in ("context_head_index", "context_commit_order")], F.lit("p").alias("context_path"))), {"ignoreNullFields": "false"})
    doc = F.struct(
        F.lit("1").alias("schema_version"),
        *_common(k),
        spoilt(5, F.lit(-1), F.col("size_bytes")).alias("bundle_size_bytes"),
        F.array("oid").alias("prerequisites"),
        F.array(F.struct("oid", F.lit("refs/heads/main").alias("reference"))).alias("heads"),
        F.array(F.struct(spoilt(7, "", "n").alias("name"), one.alias("size_bytes"), F.sha2("oid", 256).alias("sha256"))).alias("transport_entries"),
        proof.alias("pack_proof"),
        book.alias("entry_ledger"),
        F.lit("@summary").alias("pack_summary"),
        F.lit("@objects").alias("pack_objects"),
        spoilt(4, "some", "light").alias("object_detail_mode"),
        F.array(F.struct(*thing, F.lit(None).cast("string").alias("syntax_path_hint"), F.array(F.lit("p")).alias("blob_paths"), one.alias("text_line_count"), F.array(F.lit("")).alias("lines"))).alias("object_details"),
    )
    json = F.replace(F.to_json(doc, {"ignoreNullFields": "false"}), F.lit('"@summary"'), F.when(k == 6, less).otherwise(summary))
    json = F.replace(json, F.lit('"@objects"'), F.when(k == 3, F.replace(shown, F.lit('"kind"'), F.lit('"odd":1,"kind"'))).otherwise(shown))
    found = contract_faults(view(spark, sf, "objects").select("doc_id", _retyped(json, AUDIT_TYPES).alias("json")), "audit")
    return found.select("doc_id", F.concat_ws("|", "faults").alias("faults"))
