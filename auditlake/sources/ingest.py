"""Reading package files: headers, members of archives, pack entries. A package is read by one task; its deltas are rebuilt by joins."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.columns import object_id
from auditlake.operators.iterate import checkpointed

#: Entry types of a pack, and the bytes that end it.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs-delta", 7: "ref-delta"}
TRAILER = 20
#: Bytes of a file in which its header is expected to end.
HEADER = 64 * 1024
#: Bytes of a pack that are inflated at a time.
STEP = 64 * 1024


def package_files(spark, paths) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def bundle_headers(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """bundles(path, version, pack, error), prereqs(path, pos, oid) and heads(path, head_index, oid, reference).

    The header is the lines up to the first empty one; PACK must follow at once. A line that is neither a prerequisite nor
    an id and a ref makes the package an error row.
    """
    # The header is looked for at the beginning; only if it does not end there, the whole file is looked at.
    start = F.decode(F.substring("content", 1, HEADER), "ISO-8859-1")
    ended = (F.instr(start, "\n\n") > 0) | (F.instr(start, "\n\r\n") > 0)
    text = F.when(ended | (F.octet_length("content") <= HEADER), start).otherwise(F.decode("content", "ISO-8859-1"))
    end = F.instr(F.regexp_replace(text, "\r\n", " \n"), "\n\n")
    raw_end = F.greatest(end, F.instr(text, "\n\r\n"))
    stop = F.when(F.instr(text, "\n\r\n") > 0, F.when((F.instr(text, "\n\n") > 0) & (F.instr(text, "\n\n") < F.instr(text, "\n\r\n")), F.instr(text, "\n\n") + 2).otherwise(F.instr(text, "\n\r\n") + 3)).otherwise(F.instr(text, "\n\n") + 2)
    cut = files.withColumns({"_stop": F.when(raw_end > 0, stop), "_text": text})
    lines = F.filter(F.split(F.substr("_text", F.lit(1), F.col("_stop") - 1), "\r?\n"), lambda x: x != "")
    rows = cut.withColumn("_lines", F.when(F.col("_stop").isNotNull(), lines)).withColumn("pack", F.substr("content", F.col("_stop"), F.octet_length("content")))
    version = F.regexp_extract(F.get("_lines", F.lit(0)), "^# (v[23]) git bundle$", 1)
    body = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))
    bad = F.exists(body, lambda x: ~x.rlike("^-[0-9a-f]{40}( .*)?$") & ~x.rlike("^[0-9a-f]{40} .+$"))
    error = F.when(F.col("_stop").isNull(), "header does not end").when(F.coalesce(version, F.lit("")) == "", "header line is missing").when(bad, "header line is malformed").when(F.coalesce(F.substring("pack", 1, 4), F.lit(b"")) != F.lit(b"PACK"), "pack does not follow the header")
    rows = rows.withColumns({"version": F.nullif(version, F.lit("")), "error": error, "_body": body})
    good = rows.where("error is null")
    kept = lambda p: F.filter("_body", lambda x: x.rlike(p))
    prereqs = good.select("path", F.posexplode(kept("^-")).alias("pos", "l")).select("path", "pos", F.substring("l", 2, 40).alias("oid"))
    heads = good.select("path", F.posexplode(kept("^[0-9a-f]")).alias("head_index", "l")).select("path", "head_index", F.left("l", F.lit(40)).alias("oid"), F.substr("l", F.lit(42), F.length("l")).alias("reference"))
    return rows.select("path", "version", "pack", "error"), prereqs, heads


def transport_inventory(files: DataFrame) -> DataFrame:
    """(path, name, size_bytes, sha256) of each member of archives and each plain file, how many .bundle members there are, and an error unless an archive has one."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if not path.endswith(".zip"):
                    out.append((path, path.rsplit("/", 1)[-1], len(content), hashlib.sha256(content).hexdigest()))
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
                        digest = hashlib.sha256()
                        with z.open(info) as f:
                            while part := f.read(1 << 20):
                                digest.update(part)
                        out.append((path, info.filename, info.file_size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "name", "size_bytes", "sha256"])

    rows = files.mapInPandas(members, "path string, name string, size_bytes long, sha256 string")
    n = rows.groupBy("path").agg(F.count_if(F.col("name").endswith(".bundle")).alias("n_bundles"))
    odd = F.col("path").endswith(".zip") & (F.col("n_bundles") != 1)
    return rows.join(n, "path").withColumn("error", F.when(odd, F.concat(F.lit("archive must hold exactly one .bundle member, not "), F.col("n_bundles").cast("string"))))


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian number of seven bits a byte."""
    out = shift = 0
    while True:
        byte = data[at]
        out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return out, at


def _rebuilt(base: bytes, delta: bytes) -> bytes:
    """A delta's copies and insertions applied to its base."""
    size, at = _number(delta, 0)
    want, at = _number(delta, at)
    if size != len(base):
        raise ValueError(f"delta is for a base of {size} bytes, not {len(base)}")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op >= 128:
            offset = length = 0
            for k in range(7):
                if op >> k & 1:
                    if k < 4:
                        offset |= delta[at] << 8 * k
                    else:
                        length |= delta[at] << 8 * (k - 4)
                    at += 1
            length = length or 1 << 16
            if offset + length > len(base):
                raise ValueError("delta copies from beyond its base")
            out += base[offset : offset + length]
        elif op:
            if at + op > len(delta):
                raise ValueError("delta inserts beyond its end")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("delta has an empty instruction")
    if len(out) != want:
        raise ValueError(f"delta makes {len(out)} bytes, not {want}")
    return bytes(out)


RAW = "bundle_id string, idx long, offs long, end_offs long, kind string, out_size long, base_distance long, base_offset long, base_oid string, error string, data binary"
LEDGER = "bundle_id string, idx long, offs long, end_offs long, kind string, out_size long, reconstructed_size long, base_distance long, base_offset long, base_oid string, result_oid string, result_kind string, resolved_via string, error string, content binary"
#: Bytes of inflated entries that a task sends on at once.
SENT = 4 * 1024 * 1024


def _scanned(bundle: str, pack: bytes) -> Iterator[dict]:
    """Entries in order as they are stored, each with where it ends; the last has an error if the pack cannot be read on."""
    declared, at, view = int.from_bytes(pack[8:12], "big"), 12, memoryview(pack)
    for idx in range(declared):
        row = dict.fromkeys(c.split()[0] for c in RAW.split(", ")) | {"bundle_id": bundle, "idx": idx, "offs": at}
        try:
            if at >= len(pack) - TRAILER:
                raise ValueError("pack ends before its declared entries")
            byte = pack[at]
            code, size, shift, pos = byte >> 4 & 7, byte & 15, 4, at + 1
            while byte >= 128:
                byte = pack[pos]
                size, shift, pos = size | (byte & 127) << shift, shift + 7, pos + 1
            if code not in KINDS:
                raise ValueError(f"entry type {code} is unknown")
            row |= {"kind": KINDS[code], "out_size": size}
            if code == 6:
                byte, pos = pack[pos], pos + 1
                distance = byte & 127
                while byte >= 128:
                    byte, pos = pack[pos], pos + 1
                    distance = (distance + 1) << 7 | byte & 127
                row |= {"base_distance": distance, "base_offset": at - distance if distance <= at else None}
            elif code == 7:
                row["base_oid"], pos = pack[pos : pos + 20].hex(), pos + 20
            z, data, end = zlib.decompressobj(), bytearray(), len(pack) - TRAILER
            while not z.eof and len(data) <= size:
                part = view[pos : min(pos + STEP, end)]
                if not len(part):
                    raise ValueError("pack ends within an entry")
                data += z.decompress(part)
                pos += len(part)
            if len(data) != size:
                raise ValueError(f"entry inflates to {len(data)} bytes, its header says {size}")
            at = pos - len(z.unused_data)
            row |= {"end_offs": at, "data": bytes(data)}
        except (ValueError, IndexError, zlib.error) as e:
            row["error"] = str(e)
            yield row
            return
        yield row


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle, pack in zip(batch.column("bundle_id"), batch.column("pack"), strict=True):
            rows, held = [], 0
            for row in _scanned(bundle.as_py(), pack.as_py()):
                rows.append(row)
                held += len(row["data"] or b"")
                if held > SENT:
                    yield pa.RecordBatch.from_pylist(rows, _RAW)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RAW)


_RAW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RAW.split(", "))])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of each delta, or why it cannot be applied."""
    for batch in batches:
        for part in (batch.slice(k, 100) for k in range(0, len(batch), 100)):
            content, error = [], []
            for base, delta in zip(part.column("base"), part.column("data"), strict=True):
                try:
                    content.append(_rebuilt(base.as_py(), delta.as_py()))
                    error.append(None)
                except (ValueError, IndexError) as e:
                    content.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("bundle_id", "idx", "offs", "kind")), pa.array(content, pa.binary()), pa.array(error, pa.string())], names=["bundle_id", "idx", "offs", "kind", "content", "error"])


def ingest_packs(bundles: DataFrame, baseline: DataFrame | None = None, receivers: DataFrame | None = None) -> DataFrame:
    """Ledger rows with content of bundles(bundle_id, pack), many packages in parallel; a package's first failure ends it with an error row.

    A scan tells a package's entries apart, one after the other, as an entry's end is known only after inflating it. Deltas
    are then rebuilt a level of their chains at a time, by joins with their bases, so that what is costly is spread by entry and no
    task holds a package's objects. An offset names an entry, an id an earlier entry of that id or else an object of
    the receiver, baseline(bundle_id, oid, kind, content). With receivers(bundle_id, receiver), many packages share what a receiver
    has, baseline(receiver, oid, kind, content); it is looked up by the ids that they ask for.
    """
    raw = checkpointed(bundles.select(F.col("bundle_id").cast("string").alias("bundle_id"), "pack").mapInArrow(_scan, RAW))
    delta = F.col("kind").isin("ofs-delta", "ref-delta")
    with_id = lambda rows: rows.withColumn("oid", F.when(F.col("error").isNull(), object_id("kind", "content")))
    fresh = checkpointed(with_id(raw.where("error is null").where(~delta).select("bundle_id", "idx", "offs", "kind", F.col("data").alias("content"), "error")))
    deltas = raw.where("error is null").where(delta).select("bundle_id", "idx", "offs", "base_offset", "base_oid", "data")
    done, left, asked = fresh, deltas, False
    while True:
        ready = fresh.where("error is null")
        at = ready.select("bundle_id", F.col("offs").alias("base_offset"), "kind", F.col("content").alias("base"))
        first = ready.groupBy("bundle_id", "oid").agg(F.min("idx").alias("base_idx"))
        named = first.join(ready.select("bundle_id", F.col("idx").alias("base_idx"), "kind", F.col("content").alias("base")), ["bundle_id", "base_idx"]).withColumnRenamed("oid", "base_oid")
        columns = ["bundle_id", "idx", "offs", "kind", "base", "data"]
        met = left.join(at, ["bundle_id", "base_offset"]).select(*columns).unionByName(left.join(named, ["bundle_id", "base_oid"]).where("base_idx < idx").select(*columns))
        fresh = checkpointed(with_id(met.mapInArrow(_applied, "bundle_id string, idx long, offs long, kind string, content binary, error string")))
        if fresh.isEmpty():
            if asked or baseline is None:
                break
            # What no earlier entry gives is taken from the receiver, once all is known that the package gives by itself.
            asked = True
            whose = "bundle_id" if receivers is None else "receiver"
            wants = left.where("base_oid is not null")
            wants = wants if receivers is None else wants.join(receivers.select(F.col("bundle_id").cast("string").alias("bundle_id"), "receiver"), "bundle_id")
            outer = baseline.select(whose, F.col("oid").alias("base_oid"), "kind", F.col("content").alias("base"))
            outer = outer.join(wants.select(whose, "base_oid").distinct(), [whose, "base_oid"], "left_semi").dropDuplicates([whose, "base_oid"])
            fresh = checkpointed(with_id(wants.join(outer, [whose, "base_oid"]).select(*columns).mapInArrow(_applied, "bundle_id string, idx long, offs long, kind string, content binary, error string")))
            if fresh.isEmpty():
                break
        done = done.unionByName(fresh)
        left = checkpointed(left.join(fresh.select("bundle_id", "idx"), ["bundle_id", "idx"], "left_anti"))
    made = done.select("bundle_id", "idx", F.col("kind").alias("result_kind"), "content", F.col("oid").alias("result_oid"), F.col("error").alias("bad_delta"))
    earliest = done.where("oid is not null").groupBy("bundle_id", F.col("oid").alias("base_oid")).agg(F.min("idx").alias("base_idx"))
    rows = raw.drop("data").join(made, ["bundle_id", "idx"], "left").join(earliest, ["bundle_id", "base_oid"], "left")
    said = F.lit(" (external dependency/thin pack)")
    lost = F.when(F.col("result_kind").isNull() & F.col("error").isNull(), F.when(F.col("kind") == "ref-delta", F.concat(F.lit("ref-delta references unresolved base object "), "base_oid", said)).when(F.col("base_offset").isNull(), "ofs-delta base offset underflow").otherwise(F.concat(F.lit("ofs-delta references unresolved base at distance "), F.col("base_distance").cast("string"), said)))
    rows = rows.withColumn("error", F.coalesce("error", "bad_delta", lost))
    good = F.col("error").isNull()
    via = F.when(good & (F.col("kind") == "ref-delta") & F.coalesce(F.col("base_idx") >= F.col("idx"), F.lit(True)), "baseline").when(good, "in-pack")
    size = F.when(good & delta, F.octet_length("content").cast("long"))
    told = rows.withColumns({"resolved_via": via, "reconstructed_size": size, "content": F.when(good, F.col("content")), "result_kind": F.when(good, F.col("result_kind"))})
    # A package's first failure ends its ledger.
    failed = rows.where(~good).groupBy("bundle_id").agg(F.min("idx").alias("failed_idx"))
    return told.join(failed, "bundle_id", "left").where("failed_idx is null or idx <= failed_idx").select(*[c.split()[0] for c in LEDGER.split(", ")])
