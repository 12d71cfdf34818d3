"""Benchmark decontamination: rare n-gram seeds find candidate places, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased, so punctuation and case do not matter. An item's seeds are those of its
word pairs that at most a small share of all documents hold, or the rarer half of its pairs where fewer are so rare, as
when it leaked often; the seed of an item of one word is that word. One seed in a text calls for an alignment of the item
with the stretch of text around it, unless the stretch has too few of the item's words for the score to be reached:
match +2, other word -1, gap -1. The score is the alignment's, over that of the whole item with itself; a document counts
as contaminated with `least` of it, or with an exact run of `run` of the item's words.

Items are handled in blocks of a fixed number of n-grams, each broadcast, against all rows in place: texts are never
shuffled. Two passes over the texts are made for each block, one to count and one to align.

Not found: a copy without any two seed words of the item side by side, such as an item of three words with the middle one
replaced.

Defined results: null and empty texts are never contaminated, items without words contaminate nothing; repeated rows are
each reported; a null doc_id or item_id is reported as null; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import having_ids, row_keyed, small_batches, staged
from auditlake.llm.words import Block, blocks, mixed

#: Words of a seed; share of all documents up to which a seed is rare; at least this share of an item's pairs are seeds.
SEED, RARE, SHARE = 2, 1 / 500, 0.5
#: Score, and exact run of words, from which a document is contaminated.
LEAST, RUN = 0.5, 25
#: Words of all items in one broadcast block.
BLOCK_WORDS = 1_000_000
MATCH, OTHER, GAP = 2, -1, -1
#: Cells of a table's row, over all alignments worked on together.
CELLS = 1 << 16

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_MORE = mixed(np.arange(101, 101 + SEED, dtype=np.uint64)) | np.uint64(1)


def plain_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits, and per text the offsets of its words among them."""
    inside = np.concatenate([[False], _WORD[block.low], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    return block.hashes(starts, ends), np.searchsorted(starts, block.bounds)


def seeds_of(h: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that begin at each word but the last few."""
    m = len(h) - SEED + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(SEED):
        out += h[i : m + i] * _MORE[i]
    return mixed(out)


def aligned(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignments of items with texts, one by one: rows of score, begin in the text (an estimate by its length), end, longest exact run.

    All tables are filled together, a row of each at a time; shorter ones are filled up with words that match nothing.
    """
    n, wide, high = len(items), max(map(len, texts)), max(map(len, items))
    text, item = np.zeros((n, wide), np.uint64), np.zeros((n, high), np.uint64)
    some, real = np.zeros((n, wide), bool), np.zeros((n, high), bool)
    for k, (w, t) in enumerate(zip(items, texts, strict=True)):
        text[k, : len(t)], item[k, : len(w)] = t, w
        some[k, : len(t)] = real[k, : len(w)] = True
    before, runs = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
    slope = (GAP * np.arange(wide + 1)).astype(np.int32)
    best, end, row, longest = (np.zeros(n, np.int64) for _ in range(4))
    for i in range(high):
        same = (text == item[:, i : i + 1]) & some & real[:, i : i + 1]
        h = np.zeros((n, wide + 1), np.int32)
        h[:, 1:] = np.maximum(before[:, :-1] + np.where(same, MATCH, OTHER), before[:, 1:] + GAP)
        h = np.maximum(np.maximum.accumulate(np.maximum(h, 0) - slope, axis=1) + slope, 0)
        runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
        longest = np.maximum(longest, runs.max(1))
        at = h.argmax(1)
        top = h[np.arange(n), at]
        better = top > best
        best, end, row = np.where(better, top, best), np.where(better, at, end), np.where(better, i + 1, row)
        before = h
    return np.column_stack([best, np.maximum(0, end - row), end, longest])


class Items:
    """A block of items: word hashes, and the sorted table of seeds with the items and places that have them.

    A seed is a pair of words; that of an item of one word is the word itself, hashed otherwise.
    """

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        grams = [seeds_of(w) if len(w) > 1 else mixed(w) for w in words]
        self.item = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)] or [np.empty(0, np.int64)]).astype(np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)]).astype(np.int64)
        grams = np.concatenate(grams or [np.empty(0, np.uint64)])
        self.distinct, self.number = np.unique(grams, return_inverse=True)

    def seeded(self, count: np.ndarray, documents: int) -> Items:
        """The same with seeds alone, by the number of documents that hold each distinct pair."""
        held = count[self.number]
        # Pairs that no document holds find nothing and take no place among the seeds.
        sort = np.lexsort((self.place, np.where(held > 0, held, np.iinfo(np.int64).max), self.item))
        rank = np.empty(len(sort), np.int64)
        starts = np.searchsorted(self.item[sort], np.arange(len(self.ids)))
        rank[sort] = np.arange(len(sort)) - starts[self.item[sort]]
        total = np.bincount(self.item, held > 0, len(self.ids))
        keep = (held > 0) & ((held <= RARE * documents) | (rank < np.ceil(SHARE * total)[self.item]))
        out = object.__new__(Items)
        out.ids, out.words = self.ids, self.words
        grams = self.distinct[self.number][keep]
        order = np.argsort(grams, kind="stable")
        out.grams, out.item, out.place = grams[order], self.item[keep][order], self.place[keep][order]
        return out


def _found(table: np.ndarray, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's words: where a seed of the table is, in which text, and which seed; pairs lie within one text."""
    at, g = [], []
    for n, grams in ((SEED, seeds_of(h)), (1, mixed(h))):
        hit = _hits(table, grams)
        doc = np.searchsorted(words, hit, "right") - 1
        hit = hit[hit + n <= words[doc + 1]]
        at.append(hit)
        g.append(grams[hit])
    at, g = np.concatenate(at), np.concatenate(g)
    return at, np.searchsorted(words, at, "right") - 1, g


def _hits(sorted_grams: np.ndarray, g: np.ndarray) -> np.ndarray:
    if not len(sorted_grams):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_grams, g), len(sorted_grams) - 1)
    return np.flatnonzero(sorted_grams[at] == g)


def _counter(items):
    """Documents that hold each of the block's pairs, summed over a task; place -1 counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = items.value.distinct
        total, documents = np.zeros(len(table), np.int64), 0
        for batch in batches:
            documents += len(batch)
            for block in blocks(batch.column("text")):
                h, words = plain_words(block)
                _, doc, g = _found(table, h, words)
                pairs = np.unique(np.searchsorted(table, g) * len(block) + doc)
                total += np.bincount(pairs // len(block), minlength=len(table))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], documents))], names=["gram", "n"])

    return run


def _together(asked: list[tuple], lengths: np.ndarray) -> Iterator[list[tuple]]:
    """Alignments of like size together, in tables of CELLS at most unless one alone is larger."""
    held: list[tuple] = []
    for x in sorted(asked, key=lambda x: (x[3] - x[2], lengths[x[1]])):
        if held and (len(held) + 1) * (x[3] - x[2] + 1) > CELLS:
            yield held
            held = []
        held.append(x)
    if held:
        yield held


def _aligner(items, least: float, run_of: int):
    names = ["rid", "doc_id", "item_id", "score", "run", "n_seeds", "first_word", "last_word"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = items.value
        lengths = np.array([len(w) for w in t.words], np.int64)
        # An alignment or run that counts has at least so many of the item's words.
        fewest = np.minimum(np.ceil(least * lengths - 1e-9).astype(np.int64), run_of)
        for batch in batches:
            out = []
            rids, doc_ids = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
            for block in blocks(batch.column("text")):
                h, words = plain_words(block)
                hit, doc, g = _found(t.grams, h, words)
                if not len(hit):
                    continue
                first, last = np.searchsorted(t.grams, g), np.searchsorted(t.grams, g, "right")
                n = last - first
                at, doc = np.repeat(hit, n), np.repeat(doc, n)
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                item, place = t.item[entry], t.place[entry]
                diagonal = at - place
                sort = np.lexsort((diagonal, item, doc))
                item, place, doc, diagonal = item[sort], place[sort], doc[sort], diagonal[sort]
                # A stretch ends where the text, the item or, by more than a third of the item, the diagonal changes.
                slack = lengths[item] // 3 + 4
                new = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > slack[1:])) + 1
                asked = []
                for a, b in zip(np.concatenate([[0], new]), np.concatenate([new, [len(item)]]), strict=True):
                    k, d, w = int(item[a]), int(doc[a]), t.words[int(item[a])]
                    # Insertions make a copy longer than the item, by as much as its score allows.
                    pad = len(w) + 4
                    lo = max(int(words[d]), int(diagonal[a]) - pad)
                    hi = min(int(words[d + 1]), int(diagonal[b - 1]) + len(w) + pad)
                    if np.isin(w, h[lo:hi]).sum() >= fewest[k]:
                        asked.append((d, k, lo, hi, len(np.unique(place[a:b]))))
                best: dict[tuple[int, int], tuple] = {}
                for few in _together(asked, lengths):
                    found = aligned([t.words[k] for _, k, *_ in few], [h[lo:hi] for _, _, lo, hi, _ in few])
                    for (d, k, lo, _, seeds), (points, start, end, exact) in zip(few, found.tolist(), strict=True):
                        score = points / (MATCH * int(lengths[k]))
                        if (score >= least or exact >= run_of) and score > best.get((d, k), (0.0,))[0]:
                            best[d, k] = (score, exact, seeds, lo + start - int(words[d]), lo + end - int(words[d]))
                out += [(rids[block.first + d], doc_ids[block.first + d], t.ids[k], *v) for (d, k), v in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for block in blocks(batch.column("text")):
            h, words = plain_words(block)
            ids += batch.column("item_id")[block.first : block.first + len(block)].to_pylist()
            found += [h[words[k] : words[k + 1]].astype(np.int64).tolist() for k in range(len(block))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str | None = None, least: float = LEAST, run: int = RUN) -> DataFrame:
    """Per contaminated document and item: rid, doc_id, item_id, score, longest exact run, n_seeds and the aligned words' range."""
    if key is None:
        docs, key = row_keyed(docs)
    spark = small_batches(docs).sparkSession
    texts = docs.select(F.col(key).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    words = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(_item_words, "item_id long, words array<long>"), "items").where(F.size("words") > 0)
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_WORDS))
    found = None
    for b in range(n_blocks):
        rows = words.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == b).orderBy("item_id", "words").collect()
        items = Items([r["item_id"] for r in rows], [np.array(r["words"], np.int64).astype(np.uint64) for r in rows])
        counted = texts.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(items)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        count, documents = np.zeros(len(items.distinct), np.int64), 0
        for r in counted.collect():
            if r["gram"] < 0:
                documents = r["n"]
            else:
                count[r["gram"]] = r["n"]
        seeded = spark.sparkContext.broadcast(items.seeded(count, documents))
        part = texts.mapInArrow(_aligner(seeded, least, run), "rid long, doc_id long, item_id long, score double, run long, n_seeds long, first_word long, last_word long")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    marked, key = row_keyed(docs)
    gone = staged(contaminated(marked, benchmark, key).select(F.col("rid").alias(key)).distinct(), "leaks")
    return having_ids(marked, gone, key, "left_anti").drop(key)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents only, one row for each item they hold."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("rid")
