"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its subwords, byte n-grams of 2 to 4 that lie within a word or touch its edge,
hashed into a fixed number of buckets. Training takes a bounded sample of labelled documents (`per_language` of each);
their bucket counts are made on the executors from whole texts, and embeddings and softmax are trained together on the
driver. Because the model is linear in the mean, embedding and softmax fold into one score per bucket and language for
prediction over all documents.

Calibrated rejection: a temperature is fitted on the half of the sample that is not trained on. A softmax takes text of any
other language as one it knows, so familiarity is measured as well: the mean log-frequency of a text's subwords in the
training half, in standard deviations from the mean of its language, where short texts deviate more. Both thresholds are
what all but half of `reject` of the calibrating half's rightly labelled documents reach. A document is rejected when its
score or its familiarity is below its threshold or it has no letter.

Defined results: null text or text without a letter is `und` with score 0; no labelled row at all makes every document
`und`; ties go to the first language in sorted order. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import having_ids, released, row_keyed, small_batches, staged
from auditlake.llm.fit import remainder, sampled
from auditlake.llm.words import blocks

#: Hash buckets and embedding width.
BUCKETS, WIDTH = 1 << 15, 16
#: Labelled documents of each language in the sample; half trains, half calibrates.
PER_LANGUAGE = 800
#: Share of rightly labelled documents that the threshold may reject.
REJECT = 0.001

# Bytes that may belong to a letter: ASCII letters after lower-casing, and all bytes of longer characters.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def subwords(low: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 2 to 4: bucket of the n-gram at each position, and which positions count; none reaches into the next text."""
    closing = bounds[1:] - 1
    letter = _LETTER[low]
    b = np.where(letter, low, 32).astype(np.uint32)
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | b[k : k + m]
        if n == 2:
            ok = letter[:m] | letter[1 : 1 + m]
        else:
            ok = letter[1 : 1 + m].copy()
            for k in range(2, n - 1):
                ok &= letter[k : k + m]
        ok[closing[closing < m]] = False
        h = (code * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        yield (h >> np.uint32(17)).astype(np.int32), ok


def _has_letter(texts: pa.Array) -> np.ndarray:
    import regex

    find = regex.compile(r"\p{L}").search
    return np.array([t is not None and find(t) is not None for t in texts.to_pylist()], bool)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each text as packed 32-bit numbers: lang, part, buckets, counts."""
    for batch in batches:
        found, n = [], []
        for block in blocks(batch.column("text")):
            got = [(h[ok], np.searchsorted(block.bounds[1:], np.flatnonzero(ok), "right")) for h, ok in subwords(block.low, block.bounds)]
            h = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.int32)
            d = np.concatenate([e for _, e in got]) if got else np.empty(0, np.int64)
            for k in range(len(block)):
                u, c = np.unique(h[d == k], return_counts=True)
                found.append(u.astype(np.int32).tobytes())
                n.append(c.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("part"), pa.array(found, pa.binary()), pa.array(n, pa.binary())], names=["lang", "part", "buckets", "counts"])


def train(rows: list, langs: list[str], epochs: int = 8, steps: int = 8000, rate: float = 0.5, seed: int = 7) -> dict:
    """Fits embeddings and softmax on part 0, temperature and threshold on part 1; a small sample is gone through more often."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w = np.zeros((len(langs), WIDTH))
    number = {lang: k for k, lang in enumerate(langs)}
    docs = []
    for r in rows:
        n = np.frombuffer(r["counts"], np.int32)
        if len(n):
            docs.append((np.frombuffer(r["buckets"], np.int32), (n / n.sum()).astype(np.float32), number[r["lang"]], r["part"], int(n.sum())))
    if not docs:
        return {"langs": [], "table": np.zeros((BUCKETS, 1), np.float32), "heat": 1.0, "least": 0.0, "usual": np.zeros(BUCKETS, np.float32), "mean": np.zeros(1), "spread": (1.0, 0.0), "strange": -np.inf}
    fit = [d for d in docs if d[3] == 0] or docs
    held = [d for d in docs if d[3] == 1] or docs
    epochs = max(epochs, -(-steps // len(fit)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(fit)):
            at, share, y = fit[k][:3]
            h = share @ e[at]
            p = _softmax(w @ h)
            p[y] -= 1
            back = w.T @ p
            w -= step * np.outer(p, h)
            e[at] -= step * 10 * share[:, None] * back
    table = (e @ w.T).astype(np.float32)
    z = np.array([s @ table[at] for at, s, *_ in held])
    y = np.array([d[2] for d in held])
    heats = np.geomspace(0.25, 64, 49)
    heat = heats[int(np.argmin([-np.log(np.maximum(_softmax(z * t)[np.arange(len(y)), y], 1e-12)).mean() for t in heats]))]
    p = _softmax(z * heat)
    usual = _frequencies(fit, len(langs))
    f = np.array([s @ usual[at] for at, s, *_ in held])
    n = np.array([d[4] for d in held])
    right = p.argmax(1) == y
    mean = np.array([f[right & (y == k)].mean() if (right & (y == k)).any() else f.mean() for k in range(len(langs))])
    # The variance of a mean falls with the number of subwords, down to what texts of a language differ by.
    square = (f - mean[p.argmax(1)])[right] ** 2
    spread = _line(1 / n[right], square)
    model = {"langs": langs, "table": table, "heat": float(heat), "usual": usual, "mean": mean, "spread": spread}
    lowest = lambda x: float(np.sort(x)[int(len(x) * REJECT / 2)]) if len(x) else -np.inf
    return {**model, "least": lowest(p.max(1)[right]), "strange": lowest(familiarity(model, f, n, p.argmax(1))[right])}


def _frequencies(fit: list, n_langs: int) -> np.ndarray:
    """Logarithm of each bucket's share of subwords, the languages alike; half a count more for each bucket."""
    share = np.zeros(BUCKETS)
    for k in range(n_langs):
        count = np.full(BUCKETS, 0.5)
        for at, s, y, _, n in fit:
            if y == k:
                np.add.at(count, at, s * n)
        share += count / count.sum() / n_langs
    return np.log(share).astype(np.float32)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Least squares y = a + b x with neither below 0; a is kept above 0."""
    if len(x) < 2 or x.min() == x.max():
        return (float(y.mean()) if len(y) else 1.0) + 1e-6, 0.0
    b = max(float(np.cov(x, y, bias=True)[0, 1] / x.var()), 0.0)
    return max(float(y.mean() - b * x.mean()), 0.0) + 1e-6, b


def familiarity(model: dict, f: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Standard deviations of the mean log-frequencies f of texts of n subwords from the mean of their languages."""
    a, b = model["spread"]
    return (f - model["mean"][best]) / np.sqrt(a + b / np.maximum(n, 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _predictor(model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        table, k = m["table"], len(m["langs"])
        for batch in batches:
            texts = batch.column(text)
            z = np.zeros((len(batch), max(k, 1)))
            n, f = np.zeros(len(batch)), np.zeros(len(batch))
            for block in blocks(texts):
                own = slice(block.first, block.first + len(block))
                for h, ok in subwords(block.low, block.bounds):
                    starts = np.minimum(block.bounds[:-1], len(h) - 1)
                    n[own] += np.add.reduceat(ok, starts, dtype=np.int64)
                    f[own] += np.add.reduceat(np.where(ok, m["usual"][h], np.float32(0)), starts, dtype=np.float64)
                    for j in range(k):
                        z[own, j] += np.add.reduceat(np.where(ok, table[:, j][h], np.float32(0)), starts, dtype=np.float64)
            p = _softmax(z / np.maximum(n, 1)[:, None] * m["heat"])
            known = _has_letter(texts) & (n > 0) & (k > 0)
            best, top = p.argmax(1), np.where(known, p.max(1), 0.0)
            strange = familiarity(m, f / np.maximum(n, 1), n, best) < m["strange"]
            named = [m["langs"][b] if x else "und" for b, x in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(named, pa.string()), pa.array(top), pa.array(known & (top >= m["least"]) & ~strange)], names=[*keep, "lang_pred", "score", "accepted"])

    return run


def fitted(docs: DataFrame, held: int = 2, of: int = 4, per_language: int = PER_LANGUAGE) -> dict:
    """A model from documents with a language whose CRC remainder is not `held`."""
    usable = docs.where((remainder("doc_id", of) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = staged(sampled(usable.select("doc_id", "lang"), "lang", per_language), "sample")
    langs = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    # The sample has at most about per_language rows a language, so it is broadcast; texts are read in place.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("lang", "part", "text")
    found = rows.mapInArrow(_counted, "lang string, part int, buckets binary, counts binary").toArrow().to_pylist()
    # In an order of its own, so that the same sample gives the same model.
    model = train(sorted(found, key=lambda r: (r["lang"], r["part"], r["buckets"], r["counts"])), langs)
    del found
    released()
    return model


def identified(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with lang_pred, score and accepted, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = small_batches(docs).select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)
    return rows.mapInArrow(_predictor(shared, "text", list(keep)), f"{fields}, lang_pred string, score double, accepted boolean")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; the model is fitted on docs."""
    marked, key = row_keyed(docs)
    found = identified(marked, fitted(docs), (key,))
    gone = staged(found.where(~F.col("accepted")).select(key), "rejected")
    return having_ids(marked, gone, key, "left_anti").drop(key)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(docs, fitted(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
