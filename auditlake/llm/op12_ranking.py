"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by weight: the first owner has the rarest terms, and each next one half of the weight that is left.
A bundle of items goes from owner to owner, one stage each: its sparse accumulators, (document, score so far) for each
item, meet the owner's posting lists in a cogroup, take on its terms' contributions and go on. Documents are cut into
slices of bounded size, and a bundle goes through all slices at once, so no accumulator grows with the corpus.

An accumulator is left behind only when it cannot count: the owners still ahead can add less than WHOLE for each unit of
weight, so a document whose score and that bound together stay below the tenth score of its slice is not among the
item's ten. For the same reason later owners stop taking in documents that no earlier owner met. Results are exact.

Terms are known by 64-bit hashes. The benchmark's terms go to the tasks that index documents as one array if counted to
be at most WANTED; beyond that, all terms are indexed and joined with the items'.

Defined results: null and empty texts have no terms; items without terms or without a matching document have no rows;
repeated rows are documents or items of their own; a null doc_id ranks behind its equals, an item with null item_id keeps it;
a long text is a block of its own; other columns are not looked at; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.llm.common import keyed, released, staged
from auditlake.llm.words import blocks

#: Results of an item.
TOP = 10
#: A term's share of a score is less than this times its weight.
WHOLE = 1_000_000
#: Owners of terms, and so stages.
OWNERS = 4
#: Bits of a row's place within a file that are its place within a slice.
SLICE_BITS = 14
#: Items of a bundle.
BUNDLE = 256
#: Terms of the benchmark that go to the tasks as one array.
WANTED = 1_000_000
#: Postings that a task holds before it sends them on.
HELD = 2_000_000

_TERMS = np.arange(256, dtype=np.uint8)
_TERMS[65:91] += 32
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERMS[_first : _last + 1] = 32


def _terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: the hashes of all terms, the text of each, and of each text of the block its number and its terms."""
    for block in blocks(texts, table=_TERMS):
        n = np.diff(block.words)
        yield block.hashes().view(np.int64), np.repeat(np.arange(len(n)), n) + block.first, np.stack([np.arange(len(n)) + block.first, n])


def _itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, term, q): an item's distinct terms and how often it has each."""
    for batch in batches:
        for h, d, _ in _terms(batch.column("text")):
            pairs, q = np.unique(np.stack([d, h]), axis=1, return_counts=True)
            own = pa.array(pairs[0])
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(own), batch.column("item_id").take(own), pa.array(pairs[1]), pa.array(q.astype(np.int64))], names=["item", "item_id", "term", "q"])


INDEX = "slice long, term long, at array<int>, n array<int>, ids array<long>"


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def _indexed(wanted: np.ndarray | None):
    """Posting lists of a task's documents: per slice and term the places of documents and the occurrences, and per slice, under no term, the places, terms and ids of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, held = (1 << SLICE_BITS) - 1, []

        def lists() -> pa.RecordBatch:
            term, rid, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((rid, term, rid >> SLICE_BITS))
            term, rid, n = term[order], rid[order], n[order]
            part = rid >> SLICE_BITS
            starts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(part) != 0))) if len(term) else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(term[starts]), _lists(rid & mask, starts, pa.int32()), _lists(n, starts, pa.int32()), pa.nulls(len(starts), pa.list_(pa.int64()))], names=["slice", "term", "at", "n", "ids"])

        for batch in batches:
            rid, lengths = np.asarray(batch.column("rid")), np.zeros(len(batch), np.int64)
            for h, d, (texts, n) in _terms(batch.column("text")):
                lengths[texts] = n
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                    good = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
                    h, d = h[good], d[good]
                # By number of the distinct terms, so that a pair is one integer.
                own, number = np.unique(h, return_inverse=True)
                pairs, n = np.unique(number * len(batch) + d, return_counts=True)
                held.append((own[pairs // len(batch)], rid[pairs % len(batch)], n))
            order = np.argsort(rid, kind="stable")
            starts = np.flatnonzero(np.diff(rid[order] >> SLICE_BITS, prepend=-1))
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rid)).astype(np.int32)), batch.column("doc_id").take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.array(rid[order][starts] >> SLICE_BITS), pa.nulls(len(starts), pa.int64()), _lists(rid[order] & mask, starts, pa.int32()), _lists(lengths[order], starts, pa.int32()), ids], names=["slice", "term", "at", "n", "ids"])
            if sum(len(x[0]) for x in held) > HELD:
                yield lists()
        if held:
            yield lists()
        released()

    return run


def _stage(owner: int, documents: int, terms: int):
    """One owner's stage: adds its terms' contributions to the accumulators of a bundle in a slice; after the last, ranks what is left."""
    last = owner == OWNERS - 1

    def run(key: tuple, bundle: pa.Table, postings: pa.Table) -> pa.Table:
        size = 1 << SLICE_BITS
        n, ids, known = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        lists = list(zip(postings["term"].to_pylist(), *(postings[c].combine_chunks() for c in ("at", "n", "ids")), strict=True)) if len(postings) else []
        for term, at, count, names in lists:
            if term is None:
                where, own = np.asarray(at.values), names.values
                n[where], ids[where], known[where] = np.asarray(count.values), np.asarray(own.fill_null(0)), np.asarray(own.is_valid())
        m = 100 - 75 + (75 * n * documents) // max(terms, 1)
        shares: dict[int, list] = {}
        for term, at, count, _ in lists:
            if term is not None:
                where, tf = np.asarray(at.values), np.asarray(count.values).astype(np.int64)
                shares.setdefault(term, []).append((where, (1_000_000_000 * tf) // (1000 * tf + 8 * m[where])))
        out = []
        for r in bundle.to_pylist():
            # `held` are the accumulators that came; a document may come in as long as it can still reach the tenth.
            score, held = np.zeros(size, np.int64), np.zeros(size, bool)
            held[r["at"]], score[r["at"]] = True, r["score"]
            ahead = WHOLE * sum(x["q"] * x["w"] for x in r["terms"] if x["owner"] >= owner)
            tenth = _tenth(np.asarray(r["score"], np.int64))
            open_ = ahead >= tenth
            for x in r["terms"]:
                if x["owner"] == owner:
                    for where, share in shares.get(x["term"], ()):
                        score[where] += x["q"] * x["w"] * share
                        if open_:
                            held[where] = True
            at = np.flatnonzero(held & (score > 0))
            left = WHOLE * sum(x["q"] * x["w"] for x in r["terms"] if x["owner"] > owner)
            at = at[score[at] + left >= _tenth(score[at])]
            if last:
                at = at[np.lexsort((ids[at], ~known[at], -score[at]))][:TOP]
                out += [{"item": r["item"], "item_id": r["item_id"], "doc_id": int(ids[k]) if known[k] else None, "score": int(score[k])} for k in at]
            else:
                out.append({**r, "at": at.tolist(), "score": score[at].tolist()})
        return pa.Table.from_pylist(out, RANKED if last else bundle.schema)

    return run


def _tenth(scores: np.ndarray) -> int:
    return int(np.partition(scores, len(scores) - TOP)[len(scores) - TOP]) if len(scores) >= TOP else 0


RANKED = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
CARRIED = "bundle int, slice long, item long, item_id long, terms array<struct<term:long,q:long,w:long,owner:int>>, at array<int>, score array<long>"


def ranked(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of docs(doc_id, text) for each of items(item_id, text)."""
    spark = docs.sparkSession
    asked = staged(keyed(items, "item_id", "text").select("rid", F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_itemised, "item long, item_id long, term long, q long"), "items")
    vocabulary = asked.select("term").distinct()
    few = vocabulary.count() <= WANTED
    wanted = np.sort(vocabulary.toArrow()["term"].to_numpy()) if few else None
    rows = keyed(docs, "doc_id", "text").select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = staged(rows.mapInArrow(_indexed(wanted), INDEX), "index")

    per_slice = index.where("term is null").select(F.size(F.filter("n", lambda x: x > 0)).alias("documents"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("terms"))
    documents, terms = (int(x or 0) for x in per_slice.agg(F.sum("documents"), F.sum("terms")).first())
    lists = index.where("term is not null").join(vocabulary, "term", "left_semi") if not few else index.where("term is not null")
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weighed = staged(asked.join(lists.groupBy("term").agg(F.sum(F.size("at")).alias("df")).select("term", weight.cast("long").alias("w")), "term"), "weights")
    # A row for each weight there is, of which there are some ten thousand at most.
    mass = sorted(((r["w"], r["mass"]) for r in weighed.groupBy("w").agg(F.sum(F.col("w") * F.col("q")).alias("mass")).collect()), reverse=True)
    # The first owner has weights down to half of all mass, the next half of what is left, and so on.
    cuts, total, done = [], sum(x for _, x in mass), 0
    for w, x in mass:
        done += x
        while len(cuts) < OWNERS - 1 and done >= total * (1 - 0.5 ** (len(cuts) + 1)):
            cuts.append(w)
    owner = sum(((F.col("w") < cut).cast("int") for cut in cuts), F.lit(0))
    bundles = -(-asked.select("item").distinct().count() // BUNDLE)
    dealt = weighed.withColumns({"owner": owner, "bundle": F.pmod(F.xxhash64("item"), F.lit(max(bundles, 1))).cast("int")})
    carried = staged(dealt.groupBy("bundle", "item", "item_id").agg(F.collect_list(F.struct("term", "q", "w", "owner")).alias("terms")), "carried")
    needed = staged(dealt.select("bundle", "term", "owner").distinct(), "needed")
    posted = lists.join(needed, "term")
    met = staged(posted.select("bundle", "slice").distinct(), "met")
    now = met.join(carried, "bundle").select("bundle", "slice", "item", "item_id", "terms", F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("score"))
    lengths = index.where("term is null").join(met, "slice").select("bundle", "slice", "term", "at", "n", "ids")
    for k in range(OWNERS):
        own = posted.where(F.col("owner") == k).select("bundle", "slice", "term", "at", "n", "ids").unionByName(lengths)
        shape = "item long, item_id long, doc_id long, score long" if k == OWNERS - 1 else CARRIED
        now = now.groupBy("bundle", "slice").cogroup(own.groupBy("bundle", "slice")).applyInArrow(_stage(k, documents, terms), shape)
    order = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return now.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def op12_ranking(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CUT = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP12_SQL = f"""
WITH item_terms AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_CUT} FROM benchmark) GROUP BY ALL),
doc_terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_CUT} FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::bigint AS n FROM doc_terms GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, sum(n)::bigint AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint AS w FROM doc_terms, stats GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint AS score
  FROM item_terms JOIN weights USING (term) JOIN doc_terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY item_id, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10
"""
