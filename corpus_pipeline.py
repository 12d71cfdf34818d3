"""A corpus from documents: language, exact copies, near copies, benchmark leaks, pieces.

Each stage works on all that its predecessor kept, written as Parquet and read again. Each is judged on its own input:
the language model is fitted on the documents that the stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditlake.llm.common import staged
from auditlake.llm.op02_decontamination import decontaminated
from auditlake.llm.op03_exact_dedup import drop_copies
from auditlake.llm.op04_language import in_known_language
from auditlake.llm.op08_jaccard_join import one_of_each
from auditlake.llm.op09_pieces import encoded, model_path


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with enough certainty."""
    return in_known_language(docs)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id."""
    return drop_copies(docs)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest doc_id."""
    return one_of_each(docs)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return encoded(docs, model_path(), with_ids=False)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pieces", pieces)]

#: The first stage learns its decisions, which SQL cannot express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
