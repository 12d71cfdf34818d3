"""WARC archives as a table of record chunks.

Payloads are cut into numbered chunks in Spark, written chunk by chunk into WARC/1.1 archives (one gzip member per
record), and read back as rows (record_id, chunk_no, offset, data, digest so far): neither side ever holds the whole of
an oversized record in Python, and each row carries the SHA-1 of the payload up to and with its chunk, so that a reader
can stop, resume or verify at any row and the last row's digest is the record's.

Of records with equal payloads of at least `least` bytes the one with the largest id is a response and the others are
revisits that refer to it. Archives lie in a folder of the shared store and carry a random name; a manifest table,
written with Spark's own commit, lists those whose task succeeded, so a lost or repeated task leaves no trace in it.

Defined results: a null payload is empty; a null id sorts lowest, and a group with null ids only is all responses; rows
with the same id and payload as the response are responses too; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import keyed, lookup, new_folder, staged

#: Bytes of payload in a chunk row.
CHUNK = 16 * 1024
#: Payloads of fewer bytes are never revisited.
LEAST = 1000
#: Bytes of archive read at a time.
READ = 256 * 1024

MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("digest", T.StringType()),
        T.StructField("is_last", T.BooleanType()),
    ]
)
_SCHEMA = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("stated_digest", pa.string()), ("chunk_no", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("is_last", pa.bool_())])


def record_types(pages: DataFrame, id_col: str, payload: str, least: int = LEAST) -> DataFrame:
    """pages with n_bytes, sha1, record_type and refers_to; the payload itself is not shuffled."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    light = staged(pages.select("rid", F.col(id_col).cast("long").alias("id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha1(raw).alias("sha1")), "digests")
    group = F.struct("sha1", "n_bytes")
    rows = light.withColumn("group", group)
    kept = rows.where(F.col("n_bytes") >= least).groupBy("group").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").drop("n")
    found = lookup(rows, kept, "group")
    again = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    return found.select("rid", "n_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def _writer(folder: str, chunk: int):
    """A function for mapInArrow that writes sorted chunk rows to one archive and returns its manifest row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        path, out, gz, n, size = None, None, None, 0, 0

        def close():
            nonlocal gz, size
            if gz is not None:
                end = gz.compress(b"\r\n\r\n") + gz.flush()
                out.write(end)
                size += len(end)
                gz = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                if row["chunk_no"] == 0:
                    close()
                    gz, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    head = _header(row)
                    done = gz.compress(head)
                    size += len(done)
                    out.write(done)
                if row["data"]:
                    done = gz.compress(row["data"])
                    size += len(done)
                    out.write(done)
        if out is not None:
            close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]}, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def _header(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{row['id'] or ''}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['sha1']}",
        f"WARC-Payload-Length: {row['n_bytes']}",
    ]
    if row["uri"]:
        lines.append("WARC-Target-URI: " + " ".join(row["uri"].split()))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else row['n_bytes']}", "", ""]
    return "\r\n".join(lines).encode()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload: str = "html", uri: str = "url", least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes a record per row of pages into gzip WARC archives, one per task; returns the manifest."""
    rows = keyed(pages, id_col, payload, uri)
    types = record_types(rows, id_col, payload, least)
    # Payloads meet their types by row key, which is spread evenly whatever the payloads repeat.
    typed = rows.join(types, "rid")
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(raw)
    n_chunks = F.greatest(F.ceil(F.octet_length(body) / F.lit(chunk)), F.lit(1)).cast("long")
    cut = typed.withColumn("body", body).select(
        F.col(id_col).cast("string").alias("id"),
        F.col(uri).cast("string").alias("uri"),
        "record_type",
        F.col("refers_to").cast("string").alias("refers_to"),
        "sha1",
        "n_bytes",
        "body",
        F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("chunk_no"),
    )
    parts = cut.select("id", "uri", "record_type", "refers_to", "sha1", "n_bytes", "chunk_no", F.substring("body", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))
    return staged(parts.mapInArrow(_writer(folder, chunk), MANIFEST), "manifest")


class _Inflated:
    """Lines and bytes of a file of gzip members, inflated a bounded piece at a time."""

    def __init__(self, f):
        self.f, self.z, self.held, self.raw, self.ended = f, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while not self.ended:
            if not self.raw:
                self.raw = self.f.read(READ)
                if not self.raw:
                    self.ended = True
                    if not self.z.eof and self.z.unconsumed_tail:
                        raise ValueError("the archive ends within a record")
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, READ)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        line, self.held = self.held[:at], self.held[at + 2 :]
        return line

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        got, self.held = self.held[:n], self.held[n:]
        if len(got) < n:
            raise ValueError("the archive ends within a record")
        return got


def _name(urn: str | None) -> str | None:
    return urn[len("<urn:page:") : -1] if urn else None


def _reader(chunk: int, rows: int = 64):
    """A function for mapInArrow that reads the archives of manifest rows as chunk rows."""

    def records(path: str, f) -> Iterator[tuple]:
        data = _Inflated(f)
        while (line := data.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record begins where one should")
            head = {}
            while line := data.line():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            if line is None or not {"content-length", "warc-payload-digest", "warc-record-id", "warc-type", "warc-payload-length"} <= head.keys():
                raise ValueError(f"{path}: the archive ends within a record's header")
            left, no, at, sha = int(head["content-length"]), 0, 0, hashlib.sha1()
            stated = head["warc-payload-digest"].removeprefix("sha1:")
            known = (path, _name(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), _name(head.get("warc-refers-to")), int(head["warc-payload-length"]), stated)
            while True:
                part = data.take(min(chunk, left))
                left -= len(part)
                sha.update(part)
                last = not left
                digest = sha.copy().hexdigest()
                if last and head["warc-type"] == "response" and digest != stated:
                    raise ValueError(f"{path}: {known[1]} has digest {digest}, its header says {stated}")
                yield (*known, no, at, part, digest if head["warc-type"] == "response" else stated, last)
                no, at = no + 1, at + len(part)
                if last:
                    break
            if data.take(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: {known[1]} is longer than its header says")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri, want in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                n_read = 0
                held: list[tuple] = []
                size = 0
                with store.open_input_stream(path, compression=None) as f:
                    for row in records(path, f):
                        held.append(row)
                        size += len(row[9])
                        n_read += row[11]
                        if len(held) >= rows * 16 or size >= rows * chunk:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                if n_read != want:
                    raise ValueError(f"{path}: {n_read} records were read, {want} were written")

    return read


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives in the manifest, one archive per task at a time."""
    scheme = folder.partition("://")[0] + "://" if "://" in folder else "file://"
    n = max(1, manifest.count())
    files = manifest.select(F.concat(F.lit(scheme), "path").alias("path"), "n_records").repartition(n, "path")
    return files.mapInArrow(_reader(chunk), CHUNKS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    manifest = write_archives(pages, folder)
    last = read_archives(spark, manifest, folder).where("is_last")
    return last.select(
        F.col("record_id").try_cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
