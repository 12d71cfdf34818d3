"""Row keys, and the numbers of the language, quality and toxicity models against plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import op04_language, op06_quality, op07_toxicity
from auditlake.llm.common import keyed, new_folder
from auditlake.llm.op03_exact_dedup import drop_copies

SF = "/root/testdata/sf0.001"


def test_row_keys_do_not_depend_on_how_files_are_cut(spark):
    """The split cost, as the number of cores would, changes the cuts between two actions."""
    at = new_folder(spark, "cut")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 700).cast("string")).alias("text"), F.lit("x").alias("rid")).repartition(3).write.parquet(at)
    docs = spark.read.parquet(at)
    name = "spark.sql.files.maxPartitionBytes"
    found, before = [], spark.conf.get(name)
    try:
        for size in ("128MB", "2KB"):
            spark.conf.set(name, size)
            found.append((spark.read.parquet(at).rdd.getNumPartitions(), {(r.doc_id, r.rid) for r in keyed(docs, "doc_id").collect()}))
        kept = drop_copies(docs)
        spark.conf.set(name, "64MB")
        assert sorted(r.doc_id for r in kept.collect()) == list(range(1300, 2000))
    finally:
        spark.conf.set(name, before)
    assert found[0][0] != found[1][0] and found[0][1] == found[1][1] and len({k for _, k in found[0][1]}) == 2000
    # What is no plain scan is written first.
    assert keyed(docs.where("doc_id < 10").unionByName(docs.where("doc_id < 10")), "doc_id").select("rid").distinct().count() == 20


def plain_model(words, counts):
    """Interpolated Kneser-Ney over the bytes of words, by dictionaries."""
    order, shared, d = op07_toxicity.ORDER, op07_toxicity.SHARED, op07_toxicity.DISCOUNT
    raw = [{} for _ in range(order + 1)]
    for w, (n0, n1) in zip(words, counts, strict=True):
        t = b" " + w + b" "
        for at in range(1, len(t)):
            for k in range(1, min(order, at + 1) + 1):
                g = t[at - k + 1 : at + 1]
                n = raw[k].setdefault(g, [0, 0])
                n[0], n[1] = n[0] + n0, n[1] + n1
    used = [None] * (order + 1)
    for k in range(1, order + 1):
        used[k] = {}
        for g, n in raw[k].items():
            own = list(n)
            if k < order and not (k > 1 and g.startswith(b" ")):
                more = [m for h, m in raw[k + 1].items() if h[1:] == g]
                if more:
                    own = [sum(m[c] > 0 for m in more) for c in (0, 1)]
            used[k][g] = [sum(own)] * 2 if k <= shared else own
    total = [sum(n[c] + 0.5 for n in used[1].values()) for c in (0, 1)]
    context = [{} for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, n in used[k].items():
            s = context[k].setdefault(g[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                s[c] += n[c]
                s[c + 2] += n[c] > 0

    def p(g, c):
        k = len(g)
        if k == 1:
            return (used[1][g][c] + 0.5) / total[c]
        s = context[k][g[:-1]]
        below = p(g[1:], c)
        if s[c] == 0:
            return below
        return max(used[k][g][c] - d, 0) / s[c] + d * s[c + 2] / s[c] * below

    def back(ctx, k, c):
        s = context[k].get(ctx)
        return 1.0 if s is None or s[c] == 0 else d * s[c + 2] / s[c]

    def evidence(w):
        t, out = b" " + w + b" ", 0.0
        for at in range(1, len(t)):
            for k in range(min(order, at + 1), 0, -1):
                g = t[at - k + 1 : at + 1]
                if g in used[k]:
                    out += math.log(max(p(g, 1), 1e-12)) - math.log(max(p(g, 0), 1e-12))
                    break
                if k > 1 and g[:-1] in context[k]:
                    out += math.log(back(g[:-1], k, 1)) - math.log(back(g[:-1], k, 0))
        return out

    return evidence


def test_kneser_ney_against_dictionaries():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))).encode() for _ in range(120)})
    counts = np.array([[rng.randint(0, 6), rng.randint(0, 3)] for _ in words], float)
    model = op07_toxicity.fit_models(words, counts)
    plain = plain_model(words, counts)
    asked = words + [b"aabbcc", b"zz", b"ab", b"cazab"]
    got = op07_toxicity.evidence(model, asked)
    assert np.allclose(got, [plain(w) for w in asked], atol=1e-4)


def test_quality_is_the_difference_of_two_densities():
    rng = np.random.default_rng(1)
    d = op06_quality.N_STATISTICS
    x = [rng.normal(k, 1 + k, (300, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)]
    moments = np.array([np.concatenate([[len(a)], a.sum(0), (a.T @ a).ravel()]) for a in x])
    model = op06_quality.Discriminant(moments)
    cov = [np.cov(a.T, bias=True) for a in x]
    pooled = (300 * cov[0] + 300 * cov[1]) / 600
    scale = np.sqrt(np.diag(pooled))
    log = []
    at = x[1][:20]
    for k in (0, 1):
        c = ((1 - op06_quality.POOLED) * cov[k] + op06_quality.POOLED * pooled) / np.outer(scale, scale)
        c = (1 - op06_quality.ROUND) * c + op06_quality.ROUND * np.trace(c) / d * np.eye(d)
        y = (at - x[k].mean(0)) / scale
        log.append(-0.5 * (y * np.linalg.solve(c, y.T).T).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    words = np.expm1(at[:, 0])
    z = (log[1] - log[0]) / op06_quality.HEAT * words / (words + op06_quality.FEW)
    with np.errstate(over="ignore"):
        assert np.allclose(model.score(at), 1 / (1 + np.exp(-np.clip(z, -40, 40))), atol=1e-6)


def test_language_by_a_plain_sum_of_subwords(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op04_language.fitted(docs)
    texts = [r.text for r in docs.select("text").limit(40).collect()] + ["", "Émile, où?", "a"]

    def plain(text):
        low = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()) + b" "
        b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in low]
        letter = [x != 32 for x in b]
        z, n = np.zeros(len(model["langs"])), 0
        for size in (2, 3, 4):
            for at in range(len(b) - size + 1):
                if at == len(b) - 1 or not (letter[at] or letter[at + 1] if size == 2 else all(letter[at + 1 : at + size - 1])):
                    continue
                code = int.from_bytes(bytes(b[at : at + size]), "big")
                h = (code * 2654435761 & 0xFFFFFFFF) ^ (size * 0x9E3779B1 & 0xFFFFFFFF)
                h ^= h >> 15
                h = h * 2246822519 & 0xFFFFFFFF
                z += model["table"][h >> 17]
                n += 1
        p = np.exp((z / max(n, 1) - (z / max(n, 1)).max()) * model["heat"])
        return (model["langs"][int(p.argmax())], float(p.max() / p.sum())) if n else ("und", 0.0)

    class Shared:
        value = model

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    (got,) = op04_language._predictor(Shared, "text", [])(iter([batch]))
    for text, lang, score in zip(texts, got.column("lang_pred").to_pylist(), got.column("score").to_pylist(), strict=True):
        want = plain(text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4)
