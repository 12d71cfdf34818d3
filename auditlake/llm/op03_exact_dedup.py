"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions alone.

A text's bytes are cut where the bytes themselves say so, in any script, each distinct chunk is put into a dictionary, and
texts are compared by their ordered lists of chunk identifiers. A long text is read once, where it lies; what moves is a
row per distinct chunk of a task, and eight bytes per chunk of a text.

An identifier is verified before it counts: the dictionary of distinct (identifier, length, SHA-256) shows whether two
different chunks ever share one. Chunks under such an ambiguous identifier are told apart by their rank among the
digests that share it, so equal lists mean equal texts.

Defined results: null text counts as empty and has an empty recipe; repeated rows with one doc_id are each returned;
of ties for the largest doc_id one row (with the largest row key) stays; rows with null doc_id lose to any other.
Columns of the input other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import having_ids, keyed, lookup, row_keyed, staged

#: A chunk has at least this many bytes, ends at the first cut after them, and at the latest here.
LEAST, MOST = 256, 8192
#: Where to cut: after bytes, STRIDE apart, whose numbers leave these remainders by 4. With characters of one, two or three
#: bytes those are like parts of characters, so in any script one in a few hundred places is such, and chunks fall into
#: step again soon after an edit.
CUT, STRIDE = (2, 0, 2, 3), 6


def _bytes(remainder: int) -> str:
    return "[" + "".join(rf"\x{b:02x}" for b in range(256) if b % 4 == remainder) + "]"


def chunks(text):
    """The chunks of a text column, in order, with a character for each byte; their concatenation is the text."""
    raw = F.decode(text.cast("binary"), "ISO-8859-1")
    cut = f".{{{STRIDE - 1}}}".join(map(_bytes, CUT))
    return F.regexp_extract_all(raw, F.lit(rf"(?s).{{{LEAST},{MOST}}}?(?:(?<={cut})|\z)|.{{{MOST}}}|.+"), F.lit(0))


def chunk_recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `recipe`: per chunk its 64-bit identifier, length in bytes and SHA-256."""
    return docs.withColumn("recipe", F.transform(chunks(F.coalesce(F.col(text), F.lit(""))), lambda c: F.struct(F.xxhash64(c).alias("chunk_id"), F.length(c).alias("n_bytes"), F.unhex(F.sha2(F.encode(c, "ISO-8859-1"), 256)).alias("sha256"))))


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """Distinct chunks: chunk_id, n_bytes, sha256, `uses`, and `rank` among the chunks that share the chunk_id (null where it is alone)."""
    distinct = staged(recipes.select(F.explode("recipe").alias("c")).groupBy("c.chunk_id", "c.n_bytes", "c.sha256").agg(F.count("*").alias("uses")), "chunks")
    shared = distinct.groupBy("chunk_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("sha256", "n_bytes"))).alias("all")).where("n > 1")
    return distinct.join(shared, "chunk_id", "left").withColumn("rank", F.array_position("all", F.struct("sha256", "n_bytes"))).drop("n", "all")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, and the row key rid."""
    cut = chunk_recipes(keyed(docs, "doc_id", "text")).select(
        "rid", "doc_id", "recipe", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )
    rows = staged(cut, "recipes")
    unsure = staged(chunk_dictionary(rows).where(F.col("rank").isNotNull()).drop("uses"), "unsure")
    known = F.transform("recipe", lambda c: c["chunk_id"])
    listed = rows.select("rid", "doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), known.alias("ids"))
    if not unsure.isEmpty():
        listed = _told_apart(rows, unsure)
    best = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), "rid")
    groups = listed.groupBy("ids").agg(F.max(F.struct(best.alias("o"), "doc_id")).alias("top"), F.count("*").alias("group_size")).where("group_size > 1")
    found = lookup(listed, groups, "ids")
    alone = F.col("group_size").isNull()
    return found.select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.o.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
        F.col("n_chunks").cast("long").alias("n_chunks"),
    )


def _told_apart(rows: DataFrame, unsure: DataFrame) -> DataFrame:
    """Recipes whose chunks under an ambiguous identifier carry their rank as well."""
    each = rows.select("rid", "doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), F.posexplode_outer("recipe").alias("pos", "c")).select("*", "c.*")
    marked = each.join(unsure, ["chunk_id", "n_bytes", "sha256"], "left")
    name = F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("rank").cast("string"))
    lists = marked.groupBy("rid", "doc_id", "text_sha256", "n_chunks").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", name.alias("id"))))).alias("l"))
    return lists.select("rid", "doc_id", "text_sha256", "n_chunks", F.transform("l", lambda x: x["id"]).alias("ids"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    marked, key = row_keyed(docs)
    gone = staged(exact_groups(docs).where(~F.col("kept")).select(F.col("rid").alias(key)), "copies")
    return having_ids(marked, gone, key, "left_anti").drop(key)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "n_chunks")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
