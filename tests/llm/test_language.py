"""Texts of no learned language are rejected, and hardly any other."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from auditlake.llm.common import staged
from auditlake.llm.op04_language import fitted, identified


def test_unknown_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    left_out = max(r["lang"] for r in docs.select("lang").where("lang IS NOT NULL").distinct().collect())
    rng = random.Random(4)
    noise = [(10**9 + k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)), None) for k in range(100)]
    seen = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    rows = staged(docs.unionByName(spark.createDataFrame(noise, docs.schema)), "rows")
    got = identified(rows, fitted(seen), ("doc_id", "lang")).groupBy(F.coalesce(F.when(F.col("doc_id") >= 10**9, F.lit("noise")), F.col("lang")).alias("lang")).agg(F.avg(F.col("accepted").cast("double")).alias("share")).collect()
    share = {r["lang"]: r["share"] for r in got}
    assert share.pop("noise") < 0.02 and share.pop(left_out) < 0.1
    assert all(x > 0.97 for k, x in share.items() if k)


def test_fitting_gives_the_drivers_memory_back(spark):
    # 1,200 texts of many subwords: their counts take some 40 MB each time, more than may stay in the driver.
    def held():
        return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon")) / 1024

    word = F.substring(F.regexp_replace(F.sha2(F.concat_ws(" ", "id", "k"), 256), "[0-9]", "z"), 1, 40)
    rows = spark.range(1200).select("id", F.explode(F.sequence(F.lit(1), F.lit(150))).alias("k"))
    docs = rows.groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("text")).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"), "text")
    docs = staged(docs, "docs")
    before = held()
    fitted(docs)
    fitted(docs)
    assert held() - before < 25
