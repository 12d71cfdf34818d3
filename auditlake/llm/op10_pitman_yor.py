"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling on partitions of the vocabulary.

A word is drawn in the restaurant of its context, a class of the word before it (its last bytes); every context restaurant
shares one parent, the restaurant of words without context, whose base is uniform over the vocabulary and one unknown word.
Seating follows the Chinese restaurant process: of the c customers of word w in context u, t sit at tables of their own,
and each table is a customer of w in the parent. There these customers are seated likewise, and each of the parent's tables
is a draw from the base.

Tokens are counted by (word, context) first, in the tasks that read them and then by word, so all pairs of a word, at most
one for each context, meet in one partition, however frequent the word. There each sweep takes every customer of every pair
away and seats it anew, then every customer of its words in the parent; only the table totals of each context and of the
parent, one short vector, depend on other words, and after each sweep these are summed over all partitions for the next. After the burn-in, table counts of several sweeps are kept and a
pair's predictive probability is their average. Probabilities then meet the pairs of each text, spread by pair, as a stream;
texts sum over partitions. Nothing but the context totals and the vocabulary's size passes through the driver; counts
cover all training documents, without bounds or pruning.

Defined results: null and empty texts have the end token alone; repeated rows are scored each and count each; with no
training document, counts are 0 and both scores are those of the uniform base. perplexity is 10 ** (-score / n_tokens).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import keyed, released, staged
from auditlake.llm.fit import remainder
from auditlake.llm.words import blocks, mixed

#: Context classes; class 0 is the beginning of a text.
CONTEXTS = 1024
#: Discount and concentration of context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.8, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 50.0
#: Sweeps before table counts are kept, and sweeps of which they are.
BURN_IN, KEPT = 2, 2
#: Tokens of a partition that is seated, and of one in which pairs meet the texts: fewer there, for each has a row of a text.
TOKENS, SCORED = 1_500_000, 3_000_000
#: At least as many partitions.
PARTITIONS = 24
#: Pairs of word and context that a task adds up before they are sent on.
MERGED = 1_000_000
#: Parts of a pair's customers that move one after the other in a sweep.
STEPS = 32
#: Customers up to which the chance of sitting alone is by exact Stirling numbers.
EXACT = 128

_END = np.uint64(0xE17D)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts and text numbers of all tokens of a column; every text has the end token last."""
    words, contexts, numbers = [], [], []
    for block in blocks(texts):
        n = np.diff(block.words)
        h = block.hashes()
        # The class of a word is a hash of its last three bytes; the first token of a text has class 0.
        tail = np.maximum(block.starts, block.ends - 3)
        kind = (block.hashes(tail, block.ends) % np.uint64(CONTEXTS - 1)).astype(np.int64) + 1 if len(h) else np.empty(0, np.int64)
        at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
        w = np.full(len(h) + len(n), _END, np.uint64)
        w[at] = h
        c = np.zeros(len(w), np.int64)
        c[at + 1] = kind
        words.append(w)
        contexts.append(c)
        numbers.append(np.repeat(np.arange(len(n)), n + 1) + block.first)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in (words, contexts, numbers))


def _paired(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and contexts of the distinct pairs, by word, then context, and the number of each token's pair."""
    own, number = np.unique(w, return_inverse=True)
    pairs, inverse = np.unique(number * CONTEXTS + c, return_inverse=True)
    return own[pairs // CONTEXTS], pairs % CONTEXTS, inverse


def _counter(partitions: int):
    """Training tokens of each (word, context) pair, summed over MERGED pairs of a task; pairs of other texts count 0."""

    def rows(w, c, n):
        p = (mixed(w) % np.uint64(partitions)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(w.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], names=["p", "w", "u", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            w, c, d = _cut(batch.column("text"))
            if not len(w):
                continue
            learns = np.asarray(batch.column("train").to_numpy(zero_copy_only=False), bool)[d]
            w, c, number = _paired(w, c)
            held.append((w, c, np.bincount(number, learns, len(w))))
            if sum(len(x[0]) for x in held) > MERGED:
                held = [_merged(held)]
                if len(held[0][0]) > MERGED // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*_merged(held))
        held = []
        released()

    return run


def _merged(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
    w, c, number = _paired(w, c)
    return w, c, np.bincount(number, n, len(w))


def _shard(w: np.ndarray, c: np.ndarray, partitions: int) -> np.ndarray:
    """The partition in which a pair is scored; a word's contexts are spread over all of them."""
    return (mixed(w + (c.astype(np.uint64) + np.uint64(1)) * _SPREAD) % np.uint64(partitions)).astype(np.int64)


_BLOBS = ["words", "contexts", "values", "counts", "texts", "rids", "docs", "flags"]
SCHEMA = "q int, kind int, " + ", ".join(f"{x} binary" for x in _BLOBS)


def _rows(rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32()] + [pa.binary()] * len(_BLOBS)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["q", "kind", *_BLOBS])


def _text_pairs(partitions: int):
    """How often each text of a batch has each pair, packed by the partition in which the pair is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7).compress
        for batch in batches:
            w, c, d = _cut(batch.column("text"))
            if not len(w):
                continue
            w, c, number = _paired(w, c)
            held, n = np.unique(number * len(batch) + d, return_counts=True)
            pair, d = held // len(batch), held % len(batch)
            q = _shard(w, c, partitions)[pair]
            order = np.argsort(q, kind="stable")
            pair, d, n, q = pair[order], d[order], n[order], q[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1, [len(q)]])
            rid, train = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("rid", "train"))
            doc = batch.column("doc_id")
            null, doc = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                new = np.concatenate([[0], np.flatnonzero(np.diff(pair[a:b])) + 1, [b - a]])
                own, text = np.unique(d[a:b], return_inverse=True)
                at = pair[a:b][new[:-1]]
                flags = train[own].astype(np.uint8) + 2 * null[own].astype(np.uint8)
                rows.append((int(q[a]), 1, w[at].tobytes(), pack(c[at].astype(np.uint16).tobytes()), pack(np.diff(new).astype(np.uint32).tobytes()), pack(n[a:b].astype(np.uint32).tobytes()), pack(text.astype(np.uint32).tobytes()), pack(rid[own].astype(np.int64).tobytes()), pack(doc[own].astype(np.int64).tobytes()), pack(flags.tobytes())))
            yield _rows(rows)
            del w, c, d, number, held, n, pair, q, order, rows
        released()

    return run


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a partition's words in one row, by word, then context."""
    pack = zstandard.ZstdCompressor(level=3).compress
    w, c, n = pdf["w"].to_numpy(np.int64).view(np.uint64), pdf["u"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    order = np.lexsort((c, w))
    own, times = np.unique(w, return_counts=True)
    return pd.DataFrame({"words": [own.tobytes()], "times": [pack(times.astype(np.uint32).tobytes())], "contexts": [pack(c[order].astype(np.uint16).tobytes())], "customers": [pack(n[order].tobytes())]})


class Partition:
    """All pairs of some words: word number, context and training tokens (customers) of each. A word has CONTEXTS pairs at most."""

    def __init__(self, words: bytes, times: bytes, contexts: bytes, customers: bytes):
        get = zstandard.ZstdDecompressor().decompress
        self.words = np.frombuffer(words, np.uint64)
        self.n_words = len(self.words)
        self.of_word = np.repeat(np.arange(self.n_words, dtype=np.int64), np.frombuffer(get(times), np.uint32))
        self.context = np.frombuffer(get(contexts), np.uint16).astype(np.int64)
        self.customers = np.frombuffer(get(customers), np.int64)
        self.count = np.bincount(self.of_word, self.customers, self.n_words).astype(np.int64)
        self.seed = int(self.words[0] % np.uint64(2**32)) if self.n_words else 0


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[Partition]:
    for batch in batches:
        for k in range(len(batch)):
            yield Partition(*(batch.column(x)[k].as_py() for x in ("words", "times", "contexts", "customers")))


def first_tables(c: np.ndarray) -> np.ndarray:
    return np.minimum(c, np.maximum(1, np.round(c**DISCOUNT))).astype(np.int64)


@lru_cache(maxsize=2)
def _alone_tables(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chance of sitting alone, exact up to EXACT customers, and for more its logarithm by that of customers per table."""
    log_s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log_s[1, 1] = 0.0
    exact = np.zeros((EXACT + 1, EXACT + 1))
    exact[1, 1] = 1.0
    for c in range(2, EXACT + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = log_s[c - 1, t] + np.log(np.maximum(c - 1 - discount * t, 0))
        log_s[c, t] = np.logaddexp(log_s[c - 1, t - 1], stay)
        exact[c, t] = np.exp(log_s[c - 1, t - 1] - log_s[c, t])
    # Saddle point of the generating function (1 - (1 - x) ** discount) ** tables, y = 1 - x.
    y = np.concatenate([1 - np.geomspace(1e-6, 0.5, 400), np.geomspace(0.5, 1e-60, 4000)[1:]])
    per_table = discount * (1 - y) * y ** (discount - 1) / (1 - y**discount)
    return exact, np.log(per_table), (1 - discount) * np.log(y)


def alone(c: np.ndarray, t: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """The chance that a customer sits alone, given that c > 1 customers sit at t tables: a ratio of generalised Stirling numbers."""
    exact, per_table, log_p = _alone_tables(discount)
    few = c <= EXACT
    k = np.where(few, c, 1)
    ratio = np.log(np.maximum(c - 1, 1) / np.maximum(t - 1, 1))
    return np.where(few, exact[k, np.where(few, t, 1)], np.where(t > 1, np.exp(np.interp(ratio, per_table, log_p)), 0.0))


def sweeps(part: Partition, tables: list[np.ndarray], vocabulary: int, parents: list[float] | None = None) -> Iterator[np.ndarray]:
    """Table counts of each pair, and after them of each word in the parent, after each sweep.

    tables, parents: those of each context and of the parent in all partitions, as they were before each sweep; without
    parents, one for each word.

    A sweep takes every customer of every pair away and seats it anew. One taken away closes a table with the chance that
    it sat alone; it opens one in proportion to (strength + discount * tables) times the parent's probability of the word,
    and joins one in proportion to the customers less a discount for each table. Pairs of up to STEPS customers move
    them one by one; of larger ones a STEPS-th of the customers moves at once, with closed and opened tables drawn as counts.
    A table closed or opened is a customer that leaves the parent or comes to it. At the end of a sweep the parent's
    customers are seated anew in the same manner.
    """
    rng = np.random.default_rng(part.seed)
    t = first_tables(part.customers)
    some = np.flatnonzero(part.customers > 1)
    some = some[np.argsort(-part.customers[some], kind="stable")]
    c, word, context = part.customers[some], part.of_word[some], part.context[some]
    active = [int(np.searchsorted(-c, -step, "left")) for step in range(STEPS)]
    of_word = np.bincount(part.of_word, t, part.n_words).astype(np.int64)
    of_parent = np.minimum(of_word, 1)
    for of_context, parent in zip(tables, parents or [float(vocabulary)] * len(tables), strict=True):
        parent_total = max(float(of_context.sum()), 1.0)
        base = (PARENT_STRENGTH + PARENT_DISCOUNT * parent) / (vocabulary + 1)
        weight = (STRENGTH + DISCOUNT * of_context)[context]
        ts = t[some]
        for step, m in enumerate(active):
            if not m:
                break
            cs, now = c[:m], ts[:m]
            moved = (cs + STEPS - 1 - step) // STEPS
            closed = _drawn(rng, moved, alone(cs, now))
            closed = np.minimum(closed, now - 1)
            left = np.bincount(word[:m], closed, part.n_words).astype(np.int64)
            gone = np.zeros(part.n_words, np.int64)
            at = np.flatnonzero(left)
            gone[at] = _closed(rng, of_word[at], of_parent[at], left[at])
            # A customer that goes does not count in the parent for its own seat.
            own = closed / moved * (1 - PARENT_DISCOUNT * gone / np.maximum(left, 1))[word[:m]] / (PARENT_STRENGTH + parent_total)
            fresh = weight[:m] * (parent_probability(of_word, parent_total, vocabulary, of_parent, parent)[word[:m]] - own)
            join = np.maximum(cs - 1 - DISCOUNT * np.where(moved > 1, now, now - closed), 1e-9)
            opened = _drawn(rng, moved, fresh / (fresh + join))
            after = np.minimum(now - closed + opened, cs)
            came = np.bincount(word[:m], after - now + closed, part.n_words).astype(np.int64)
            of_word -= left
            of_parent -= gone
            at = np.flatnonzero(came)
            of_parent[at] += _opened(rng, of_word[at], of_parent[at], came[at], base)
            of_word += came
            ts[:m] = after
        t[some] = ts
        at = np.flatnonzero(of_word > 1)
        for step in range(STEPS):
            at = at[of_word[at] > step]
            moved = (of_word[at] + STEPS - 1 - step) // STEPS
            of_parent[at] -= _closed(rng, of_word[at], of_parent[at], moved)
            of_parent[at] += _opened(rng, of_word[at] - moved, of_parent[at], moved, base)
        yield np.concatenate([t, of_parent])


def _closed(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Tables of words in the parent that close when `left` of their customers go, more than none and never all."""
    closed = _drawn(rng, left, alone(c, t, PARENT_DISCOUNT))
    return np.clip(closed, np.maximum(t - c + left, 0), t - 1)


def _opened(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, came: np.ndarray, base: float) -> np.ndarray:
    """Tables of words in the parent that open when customers come; base: the weight of a new table."""
    join = c + (came - 1) / 2 - PARENT_DISCOUNT * t
    return _drawn(rng, came, base / (base + join))


def _drawn(rng: np.random.Generator, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Binomial counts."""
    out = ((rng.random(len(n)) < p) & (n > 0)).astype(np.int64)
    many = np.flatnonzero(n > 1)
    out[many] = rng.binomial(n[many], p[many])
    return out


def parent_probability(of_word: np.ndarray, total: float, vocabulary: int, tables: np.ndarray | None = None, parent: float | None = None) -> np.ndarray:
    """The parent's probability of each word by its customers and tables there; parent: tables of all words. Without them, one for each word seen."""
    tables = np.minimum(of_word, 1) if tables is None else tables
    parent = vocabulary if parent is None else parent
    return (of_word - PARENT_DISCOUNT * tables + (PARENT_STRENGTH + PARENT_DISCOUNT * parent) / (vocabulary + 1)) / (PARENT_STRENGTH + total)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers and first tables of each context, and the task's words in training."""
    c, t, v = np.zeros(CONTEXTS), np.zeros(CONTEXTS), 0
    for part in _partitions(batches):
        c += np.bincount(part.context, part.customers, CONTEXTS)
        t += np.bincount(part.context, first_tables(part.customers), CONTEXTS)
        v += int((part.count > 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array([c.tolist()]), pa.array([t.tolist()]), pa.array([v], pa.int64())], names=["c", "t", "v"])


def _swept(shared):
    """Tables of each context and of the parent after one sweep more than the totals in `shared` are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total, parent = shared.value, np.zeros(CONTEXTS), 0
        for part in _partitions(batches):
            for t in sweeps(part, s["t"], s["v"], s["p"]):
                pass
            n = len(part.of_word)
            total += np.bincount(part.context, t[:n], CONTEXTS)
            parent += int(t[n:].sum())
            del part, t
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([parent], pa.int64())], names=["t", "p"])
        released()

    return run


def _probabilities(shared, partitions: int):
    """The predictive probability of each pair and the training tokens of its word, packed by the partition in which it is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        s = shared.value
        for part in _partitions(batches):
            p = np.zeros(len(part.of_word))
            for k, both in enumerate(sweeps(part, s["t"][:-1], s["v"], s["p"][:-1])):
                if k < BURN_IN:
                    continue
                of_context = s["t"][k + 1]
                t, of_parent = both[: len(p)], both[len(p) :]
                parent = parent_probability(np.bincount(part.of_word, t, part.n_words), max(float(of_context.sum()), 1.0), s["v"], of_parent, s["p"][k + 1])[part.of_word]
                p += (np.maximum(part.customers - DISCOUNT * t, 0) + (STRENGTH + DISCOUNT * of_context[part.context]) * parent) / (STRENGTH + s["c"][part.context])
            w, n = part.words[part.of_word], part.count[part.of_word]
            q = _shard(w, part.context, partitions)
            order = np.argsort(q, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(q[order])) + 1, [len(q)]])
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                at = order[a:b]
                rows.append((int(q[at[0]]), 0, w[at].tobytes(), pack(part.context[at].astype(np.uint16).tobytes()), (p[at] / KEPT).tobytes(), pack(n[at].tobytes()), None, None, None, None))
            del part, p, w, n, q, order, at
            released()
            yield _rows(rows)

    return run


def _scorer(shared):
    """Scores of each text's pairs. Rows come by partition, its probabilities first; texts go by one row at a time."""
    names = ["rid", "doc_id", "train", "n", "known", "base", "score"]

    def table(rows: list, s: dict) -> tuple:
        get = zstandard.ZstdDecompressor().decompress
        w = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
        c = np.concatenate([np.frombuffer(get(r["contexts"]), np.uint16) for r in rows]).astype(np.int64)
        p = np.concatenate([np.frombuffer(r["values"], np.float64) for r in rows])
        n = np.concatenate([np.frombuffer(get(r["counts"]), np.int64) for r in rows])
        own, number = np.unique(w, return_inverse=True)
        pair = number * CONTEXTS + c
        order = np.argsort(pair)
        return own, pair[order], np.log10(p[order]), np.log10((n[order] + 1) / (s["n"] + s["v"] + 1)), n[order] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = zstandard.ZstdDecompressor().decompress
        s, now, rows, t = shared.value, None, [], None
        for batch in batches:
            for k in range(len(batch)):
                r = {x: batch.column(x)[k].as_py() for x in ("q", "kind", *_BLOBS)}
                if r["q"] != now:
                    now, rows, t = r["q"], [], None
                if r["kind"] == 0:
                    rows.append(r)
                    continue
                if t is None:
                    t, rows = table(rows, s), []
                own, pairs, score, base, known = t
                at = np.searchsorted(own, np.frombuffer(r["words"], np.uint64)) * CONTEXTS + np.frombuffer(get(r["contexts"]), np.uint16)
                at = np.repeat(np.searchsorted(pairs, at), np.frombuffer(get(r["values"]), np.uint32))
                n, text = np.frombuffer(get(r["counts"]), np.uint32).astype(np.int64), np.frombuffer(get(r["texts"]), np.uint32)
                rid, doc, flags = np.frombuffer(get(r["rids"]), np.int64), np.frombuffer(get(r["docs"]), np.int64), np.frombuffer(get(r["flags"]), np.uint8)
                total = lambda x, m=len(rid), text=text: np.bincount(text, x, m)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(doc, mask=flags >= 2), pa.array(flags % 2 == 1), pa.array(total(n).astype(np.int64)), pa.array(total(n * known[at]).astype(np.int64)), pa.array(total(n * base[at])), pa.array(total(n * score[at]))], names=names)
        rows, t = [], None
        released()

    return run


def pair_counts(texts: DataFrame, n_parts: int) -> DataFrame:
    """(p, w, u, n): training tokens of each pair of word and context, added up before any task sees all of a word."""
    found = texts.select("train", "text").mapInArrow(_counter(n_parts), "p int, w long, u int, n long")
    # By the word's partition at once, so that summing and packing need no other exchange.
    return found.repartition(n_parts, "p").groupBy("p", "w", "u").agg(F.sum("n").alias("n"))


def pitman_yor_scores(docs: DataFrame, held: int = 2, of: int = 7) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, learned from the others."""
    spark = docs.sparkSession
    rows = keyed(docs, "doc_id", "text")
    held_out = remainder("doc_id", of) == held
    texts = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), (~held_out).alias("train"), F.col("text").cast("string").alias("text"))
    # A token takes about six bytes of text; what matters is that a partition's size does not grow with the input.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts, n_scored = (max(PARTITIONS, ceil(size / 6 / n)) for n in (TOKENS, SCORED))
    pairs = staged(pair_counts(texts, n_parts).groupBy("p").applyInPandas(_packed, "words binary, times binary, contexts binary, customers binary"), "pairs")

    first = pairs.mapInArrow(_totals, "c array<double>, t array<double>, v long").collect()
    c = np.sum([r["c"] for r in first] or [np.zeros(CONTEXTS)], 0)
    shared = {"c": c, "t": [np.sum([r["t"] for r in first] or [np.zeros(CONTEXTS)], 0)], "v": sum(r["v"] for r in first), "n": int(c.sum())}
    shared["p"] = [float(shared["v"])]
    # Sweeps are drawn again from their seeds, so that each sees the totals after the one before and no state is written.
    for _ in range(BURN_IN + KEPT):
        sums = pairs.mapInArrow(_swept(spark.sparkContext.broadcast(shared)), "t array<double>, p long").collect()
        shared = {**shared, "t": [*shared["t"], np.sum([r["t"] for r in sums] or [np.zeros(CONTEXTS)], 0)], "p": [*shared["p"], float(sum(r["p"] for r in sums))]}
    known = spark.sparkContext.broadcast(shared)
    both = pairs.mapInArrow(_probabilities(known, n_scored), SCHEMA).unionByName(texts.mapInArrow(_text_pairs(n_scored), SCHEMA))
    parts = both.repartition(n_scored, "q").sortWithinPartitions("q", "kind").mapInArrow(_scorer(known), "rid long, doc_id long, train boolean, n long, known long, base double, score double")
    # Row keys, ids and scores come from one scan, so nothing is joined to the keys of another.
    total = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), (~F.max("train")).alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(shared["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
