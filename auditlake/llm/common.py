"""What the operators of this subpackage share: the shared folder, staged tables, joins that stand hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8 to 24 bytes that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes in a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
#: Bits of a row key for the place within a file.
FILE_BITS = 40
#: Parts into which one hot key of a lookup is split.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only in local mode, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage and survives lost executors."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def released() -> None:
    """Gives memory that a task no longer uses back to the system, for a Python worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go(spark: SparkSession) -> None:
    """Has the driver find which broadcasts and shuffles nothing needs any more, so that executors drop them before the next step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small, so that long texts and packs don't fill the memory of a worker, or of the JVM beside it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def located(docs: DataFrame, name: str) -> DataFrame:
    """docs with a row key under the given name: the number of a row's file, by path, and its place in the file.

    The key belongs to the stored row, so it is the same in every scan, however the files are cut and whatever executors
    come and go. What is not a plain scan of files is written to the shared folder first.
    """
    docs = small_batches(docs)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = staged(docs, "rows")
    place = docs.metadataColumn("_metadata")
    file, row = _new_name(docs, "_file"), _new_name(docs, "_place")
    seed, codes = _file_codes(docs, place["file_path"])
    # Joined by a long: each broadcast by a string would keep a page of tens of megabytes in every executor.
    numbers = docs.sparkSession.createDataFrame(list(zip(codes, range(len(codes)), strict=True)), f"{file} long, {name} long")
    rows = docs.withColumns({file: _code(place["file_path"], seed), row: place["row_index"]}).join(F.broadcast(numbers), file)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(name, FILE_BITS) + F.col(row)).alias(name))


def _code(path, seed: int):
    return F.xxhash64(path, F.lit(seed))


def _file_codes(docs: DataFrame, path) -> tuple[int, list[int]]:
    """A seed with which no two files have the same code, and the codes in order of the paths."""
    seed = 0
    while True:
        # One row for each file, of which the driver holds the list anyway.
        files = sorted(docs.select(path.alias("path")).distinct().select("path", _code(F.col("path"), seed)).collect())
        codes = [r[1] for r in files]
        if len(set(codes)) == len(codes):
            return seed, codes
        seed += 1


def _new_name(docs: DataFrame, name: str) -> str:
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with a row key `rid`, which keeps repeated rows and null ids apart."""
    key = _new_name(docs, "rid")
    return located(docs, key).select(F.col(key).alias("rid"), *columns)


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row key, under a name that clashes with no column, and that name."""
    name = _new_name(docs, "_row")
    return located(docs, name), name


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Joins rows to a table of one row per key. Each key is split into `salts` parts, so that no task gets all rows of a hot key."""
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    few = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]), F.lit(salts)).cast("int"))
    return few.join(many, [key, "_salt"], how).drop("_salt")


def having_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join with a staged table of ids: broadcast when counted to be small, otherwise shuffled."""
    if ids.count() <= bound:
        return rows.join(F.broadcast(ids), key, how)
    return rows.join(ids, key, how)
