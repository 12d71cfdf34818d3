"""Quality by regularised quadratic discriminant analysis of document statistics.

One pass gives each text a vector of statistics (length, word shapes, symbols, repetition, lines), transformed by
logarithms so that each class is roughly normal. The classes' means and covariances come from the sums and products of
all labelled rows, added up on the executors. A covariance is shrunk towards the one of both classes pooled and towards a
multiple of the identity; its Cholesky factor is kept, and a document's score is the logistic function of the difference
of the two log-densities, each a Mahalanobis distance found with that factor, and of the classes' shares. The fewer words
a text has, the less the difference counts.

Defined results: null, empty and wordless texts have the statistics of no words and are scored like any other; of several
labels of a document the largest counts; with fewer than two labelled documents of either class every score is the share
of label 1. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, staged
from auditlake.llm.fit import remainder, sigmoid
from auditlake.llm.words import blocks, ngram_positions

#: Shrinkage towards the pooled covariance and towards the identity.
POOLED, ROUND = 0.2, 0.05
#: Divides the difference of log-densities: statistics of one text are not independent.
HEAT = 2.0
#: Statistics of a text of this many words count half: those of a few words say little.
FEW = 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
N_STATISTICS = 16


def _most(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, offsets[:-1][some])
    return out


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct hashes, and the count of the commonest."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
    runs = np.diff(np.concatenate([new, [len(h)]]))
    own = text[new]
    most = np.zeros(n)
    np.maximum.at(most, own, runs)
    return np.bincount(own, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), N_STATISTICS))
    for block in blocks(texts):
        n = len(block)
        b, low, raw, w = block.bounds, block.low, block.raw, block.words
        size = np.maximum(np.diff(b) - 1, 1).astype(float)
        words = np.diff(w).astype(float)
        some = np.maximum(words, 1)
        letter, digit, gap = _LETTER[low], _DIGIT[low], low == 32
        symbol = ~(letter | digit | gap)
        symbols = np.concatenate([[0], np.cumsum(symbol)])
        length = (block.ends - block.starts).astype(float)
        bare = symbols[block.ends] - symbols[block.starts] == block.ends - block.starts
        last = symbol[block.ends - 1] if len(length) else np.empty(0, bool)
        many = symbols[block.ends] - symbols[block.starts] >= 2
        h = block.hashes()
        text = np.repeat(np.arange(n), np.diff(w))
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])]) if len(h) else np.empty(0, bool)
        distinct, most = _repeats(h, text, n)
        g, ok = ngram_positions(block, h, 3)
        grams, most3 = _repeats(g[ok], text[: len(g)][ok], n)
        mean = _sum(length, w) / some
        spread = np.sqrt(np.maximum(_sum(length**2, w) / some - mean**2, 0))
        upper = (raw >= 65) & (raw <= 90)
        share = lambda x, of: np.log(x / of + 0.01)
        own = slice(block.first, block.first + n)
        out[own] = np.column_stack(
            [
                np.log1p(words),
                np.log1p(mean),
                np.log1p(spread),
                share(_sum(letter, b), size),
                share(_sum(digit, b), size),
                share(_sum(symbol, b), size),
                share(_sum(upper, b), size),
                share(_sum(raw == 10, b), size),
                share(_sum(bare, w), some),
                share(_sum(last, w), some),
                share(_sum(many, w), some),
                share(_sum(again, w), some),
                np.log(distinct + 1) - 0.7 * np.log(words + 1),
                share(grams, np.maximum(words - 2, 1)),
                share(most, some),
                share(_sum(length <= 3, w), some),
            ]
        )
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 + N_STATISTICS + N_STATISTICS**2))
    for batch in batches:
        if not len(batch):
            continue
        x = np.asarray(batch.column("x").flatten()).reshape(-1, N_STATISTICS)
        y = np.asarray(batch.column("y"))
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.list_(pa.float64())), pa.array([0, 1], pa.int32())], names=["m", "y"])


class Discriminant:
    """Means, Cholesky factors and log-determinants of the two classes."""

    def __init__(self, moments: np.ndarray):
        n = moments[:, 0]
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.flat = bool((n < 2).any())
        if self.flat:
            return
        d = N_STATISTICS
        mean = moments[:, 1 : 1 + d] / n[:, None]
        scatter = [moments[k, 1 + d :].reshape(d, d) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = np.outer(self.scale, self.scale)
        self.mean = mean / self.scale
        self.factor, self.half_log = [], []
        for k in (0, 1):
            own = (1 - POOLED) * scatter[k] / n[k] / unit + POOLED * pooled / unit
            own = (1 - ROUND) * own + ROUND * np.trace(own) / d * np.eye(d)
            c = np.linalg.cholesky(own)
            self.factor.append(np.linalg.inv(c))
            self.half_log.append(float(np.log(np.diag(c)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.share)
        z = [-0.5 * ((((x / self.scale) - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) - self.half_log[k] for k in (0, 1)]
        words = np.expm1(x[:, 0])
        return sigmoid((z[1] - z[0]) / HEAT * words / (words + FEW) + np.log(max(self.share, 1e-6) / max(1 - self.share, 1e-6)))


def quality(docs: DataFrame, labels: DataFrame, y: str = "quality", held: int = 2, of: int = 4) -> DataFrame:
    """Per document: doc_id and score; fitted on labelled documents whose CRC remainder is not `held`."""
    rows = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    measured = staged(rows.mapInArrow(_measured, f"doc_id {kind}, x array<double>"), "statistics")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(y).isNotNull() & (remainder("doc_id", of) != held)).groupBy("doc_id").agg(F.max(F.col(y).cast("int")).alias("y"))
    parts = measured.join(known, "doc_id").select("y", "x").mapInArrow(_moments, "m array<double>, y int").collect()
    total = np.zeros((2, 1 + N_STATISTICS + N_STATISTICS**2))
    for r in parts:
        total[r["y"]] += r["m"]
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(total))

    def scored(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    return measured.mapInArrow(scored, f"doc_id {kind}, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
