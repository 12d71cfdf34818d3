"""The pipeline's rows against a brute-force version of each stage, on the smallest tables."""

import hashlib
import re

import corpus_pipeline
from auditlake.llm.op04_language import fitted, identified
from auditlake.llm.op08_jaccard_join import near_duplicates
from auditlake.llm.op09_pieces import model_path

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def plain(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_pipeline(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    accepted = {r.doc_id for r in identified(docs, fitted(docs)).where("accepted").select("doc_id").collect()}
    assert len(accepted) > 0.95 * len(texts)
    left = {d: t for d, t in texts.items() if d in accepted}
    last = {}
    for d in sorted(left):
        last[left[d] or ""] = d
    left = {d: left[d] for d in last.values()}
    root = components(left)
    left = {d: t for d, t in left.items() if root[d] == d or not shingles(t)}
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sure = {d for d, t in left.items() if any(i in plain(t) for i in items)}

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(left) - sure and len(set(left) - sure - set(got)) <= 1
    for d, r in got.items():
        ids = sp.encode(left[d] or "") + [sp.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_near_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {d: (len(shingles(t)), want[d]) for d, t in texts.items()}


def test_row_keys_join_no_strings(spark, tmp_path):
    from pyspark.sql import functions as F

    from auditlake.llm.common import located

    # An executor keeps a page of tens of megabytes for each broadcast by a string, for a long only what it needs.
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(4).write.parquet(at := str(tmp_path / "docs"))
    rows = located(spark.read.parquet(at), "rid")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashedRelationBroadcastMode(List(input[0, bigint") == plan.count("HashedRelationBroadcastMode") == 1
    keys = [r.rid for r in rows.collect()]
    assert len(set(keys)) == 40 and {k >> 40 for k in keys} == set(range(4))


def test_files_of_one_code_are_told_apart(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from auditlake.llm import common

    real = common._code
    monkeypatch.setattr(common, "_code", lambda path, seed: F.lit(7).cast("long") if seed < 2 else real(path, seed))
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(4).write.parquet(at := str(tmp_path / "docs"))
    keys = [r.rid for r in common.located(spark.read.parquet(at), "rid").collect()]
    assert len(set(keys)) == 40 and {k >> 40 for k in keys} == set(range(4))


def test_batches_of_texts_are_small(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from auditlake.llm.common import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    texts = small_batches(spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text")))
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) <= 3 << 20
