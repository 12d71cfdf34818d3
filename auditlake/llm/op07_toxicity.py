"""Toxicity by class-conditional Kneser-Ney models of the bytes of words.

Two models, of toxic and of ordinary labelled documents, give each byte of a word a probability after up to five bytes
before it in the word. The highest orders have counts of their own class; the lower ones, continuation counts that both
classes share, smooth rare expressions, so that a word unknown to both tells nothing. A document's evidence is the
difference of its two log-likelihoods over all its words, normalised by its length and by the root of its length. A long
document's ordinary words add up to much noise, so three more sums go with it: that of what each word's difference has
beyond a margin, normalised likewise, the differences of its strongest words, and its length. A logistic function joins
them; its threshold of 0.5 is where precision and recall on the calibrating half balance best.

Models are fitted on a bounded sample (`per_class` documents of each label); one half of it is counted, on the executors,
and the other calibrates the logistic function. Scoring covers every word of every text.

Defined results: null, empty and wordless texts get the score of no evidence at all; of several labels of a document the
largest counts; without labels of both kinds every score is 0. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, staged
from auditlake.llm.fit import logistic, remainder, sampled, sigmoid
from auditlake.llm.words import blocks

#: Longest n-gram in bytes, highest order whose counts both classes share, absolute discount.
ORDER, SHARED, DISCOUNT = 6, 2, 0.75
#: Labelled documents of each class in the sample.
PER_CLASS = 3000
#: Strongest words of a document whose differences are further inputs, and what a word's difference must be beyond to count as strong.
TOP, MARGIN = 3, 2.0
#: Inputs of the logistic function.
INPUTS = 5 + TOP


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between spaces, in one array of bytes; where each byte to predict is, and how far its word goes back."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]) if len(words) else np.empty(0, np.int64)
    back = np.arange(len(flat)) - np.repeat(starts, lengths + 2)
    at = np.flatnonzero(back > 0)
    return flat, at, back[at]


def codes(flat: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each place, as one number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k - 1, -1, -1):
        out = (out << np.uint64(8)) | flat[np.maximum(at - j, 0)].astype(np.uint64)
    return out


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, number = np.unique(keys, return_inverse=True)
    return u, np.column_stack([np.bincount(number, v, len(u)) for v in values.T])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def fit_models(words: list[bytes], counts: np.ndarray) -> dict:
    """Per order: n-grams with the difference of their log-probabilities, contexts with that of their back-off weights.

    counts: of each word in ordinary and toxic documents.
    """
    flat, at, back = spelled(words)
    lengths = np.array([len(w) + 1 for w in words])
    weight = np.repeat(counts.astype(float), lengths, axis=0)
    raw = {}
    for k in range(1, ORDER + 1):
        ok = back >= k - 1
        raw[k] = _sums(codes(flat, at[ok], k), weight[ok])
    low: dict = {}
    model: dict = {"grams": {}, "backs": {}}
    for k in range(1, ORDER + 1):
        keys, n = raw[k]
        if k < ORDER:
            # Continuations: distinct bytes before the n-gram; an n-gram at a word's beginning keeps its own count.
            longer, m = raw[k + 1]
            mask = np.uint64((1 << 8 * k) - 1)
            u, c = _sums(longer & mask, (m > 0).astype(float))
            where, found = _find(u, keys)
            first = (keys >> np.uint64(8 * (k - 1))) == np.uint64(32)
            n = np.where((first & (k > 1))[:, None] | ~found[:, None], n, c[where] if len(c) else n)
        if k <= SHARED:
            n = np.repeat(n.sum(1, keepdims=True), 2, 1)
        if k == 1:
            p = (n + 0.5) / (n + 0.5).sum(0)
        else:
            context = keys >> np.uint64(8)
            cu, total = _sums(context, n)
            _, types = _sums(context, (n > 0).astype(float))
            where, _ = _find(cu, context)
            weight_back = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1e-9), 1.0)
            below, _ = _find(low["keys"], keys & np.uint64((1 << 8 * (k - 1)) - 1))
            t = total[where]
            p = np.where(t > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(t, 1e-9) + weight_back[where] * low["p"][below], low["p"][below])
            b = np.log(weight_back)
            model["backs"][k] = (cu, (b[:, 1] - b[:, 0]).astype(np.float32))
        g = np.log(np.maximum(p, 1e-12))
        model["grams"][k] = (keys, (g[:, 1] - g[:, 0]).astype(np.float32))
        low = {"keys": keys, "p": p}
    return model


def evidence(model: dict, words: list[bytes]) -> np.ndarray:
    """Per word the difference of its log-likelihoods, toxic less ordinary."""
    if not len(words):
        return np.empty(0)
    flat, at, back = spelled(words)
    out = np.zeros(len(at))
    left = np.arange(len(at))
    for k in range(ORDER, 0, -1):
        ok = back[left] >= k - 1
        these = left[ok]
        code = codes(flat, at[these], k)
        keys, d = model["grams"][k]
        where, found = _find(keys, code)
        out[these[found]] += d[where[found]]
        missing = these[~found]
        if k > 1:
            cu, b = model["backs"][k]
            where, known = _find(cu, code[~found] >> np.uint64(8))
            out[missing[known]] += b[where[known]]
        left = np.concatenate([left[~ok], missing])
        if not len(left):
            break
    lengths = np.array([len(w) + 1 for w in words])
    return np.add.reduceat(out, np.concatenate([[0], np.cumsum(lengths)[:-1]]))


def _features(model):
    """Per text the inputs of the logistic function; those of a text without words are 0."""

    def of(texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), INPUTS))
        for block in blocks(texts, 2 << 20):
            h = block.hashes()
            if not len(h):
                continue
            _, first, number = np.unique(h, return_index=True, return_inverse=True)
            raw, s, e = block.low.tobytes(), block.starts[first], block.ends[first]
            lengths = (e - s + 1)[number]
            value = evidence(model, [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])[number]
            for k in range(len(block)):
                own = slice(block.words[k], block.words[k + 1])
                v, n = value[own], lengths[own]
                if len(v):
                    total, root = n.sum(), np.sqrt(n.sum())
                    strong = np.maximum(v - MARGIN, 0).sum()
                    each = v / np.sqrt(n + 1)
                    top = np.sort(np.partition(each, len(v) - min(TOP, len(v)))[-TOP:])[::-1]
                    x = out[block.first + k]
                    x[:5] = v.sum() / total, v.sum() / root, strong / total, strong / root, np.log1p(len(v))
                    x[5 : 5 + len(top)] = np.maximum(top, 0)
        return out

    return of


def _balanced(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which on calling documents toxic has the best harmonic mean of precision and recall."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    best = int(np.argmax(2 * hit / (np.arange(1, len(y) + 1) + y.sum())))
    after = score[order[best + 1]] if best + 1 < len(y) else score[order[best]] - 1
    return float(score[order[best]] + after) / 2


def calibrated(x: np.ndarray, y: np.ndarray) -> dict:
    """Means and deviations of the inputs, and weights with the intercept last."""
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(INPUTS), "deviation": np.ones(INPUTS), "weights": np.append(np.eye(INPUTS)[0], 0.0)}
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / deviation
    w = logistic(z, y, balanced=False)
    w[-1] -= _balanced(z @ w[:-1] + w[-1], y)
    return {"mean": mean, "deviation": deviation, "weights": w}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = np.asarray(batch.column("y"))
        for block in blocks(batch.column("text")):
            h = block.hashes()
            toxic = np.repeat(y[block.first : block.first + len(block)], np.diff(block.words)) > 0
            _, first, number = np.unique(h, return_index=True, return_inverse=True)
            raw, s, e = block.low.tobytes(), block.starts[first].tolist(), block.ends[first].tolist()
            n = np.bincount(number, minlength=len(first))
            t = np.bincount(number, toxic, len(first)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(s, e, strict=True)], pa.binary()), pa.array(n - t), pa.array(t)], names=["word", "ordinary", "toxic"])


def fitted(docs: DataFrame, labels: DataFrame, y: str = "toxic", held: int = 0, of: int = 5, per_class: int = PER_CLASS) -> dict | None:
    usable = labels.where(remainder("doc_id", of) != held).select("doc_id", y)
    ids = staged(sampled(usable, y, per_class), "sample")
    if ids.select(y).distinct().count() < 2:
        return None
    # At most about per_class ids of each class are broadcast; texts are read in place.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids.withColumnRenamed(y, "y")), "doc_id").select("y", "part", "text")
    counted = rows.where("part = 0").select("y", "text").mapInArrow(_word_counts, "word binary, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).orderBy("word").toArrow()
    words = counted.column("word").to_pylist()
    counts = np.column_stack([np.asarray(counted.column(c)) for c in ("ordinary", "toxic")]) if words else np.zeros((0, 2))
    model = fit_models([bytes(w) for w in words], counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        of_texts = _features(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(of_texts(batch.column("text"))), pa.list_(pa.float64()))], names=["y", "x"])

    held_rows = rows.where("part = 1").select(F.col("y").cast("int").alias("y"), "text").mapInArrow(measured, "y int, x array<double>").collect()
    x, t = np.array([r["x"] for r in held_rows]), np.array([r["y"] for r in held_rows])
    return model | calibrated(x, t)


def toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per document: doc_id and score."""
    rows = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        of_texts = _features(shared.value)
        m = shared.value
        w = m["weights"]
        for batch in batches:
            x = (of_texts(batch.column("text")) - m["mean"]) / m["deviation"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(x @ w[:-1] + w[-1]))], names=["doc_id", "score"])

    return rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, fitted(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
