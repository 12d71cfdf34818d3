"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import staged

#: Rounds after which something must be wrong; each round at least halves the longest chain, so 64 suffice for any input.
ROUNDS = 64


def connected(edges: DataFrame) -> DataFrame:
    """node, root: for edges (a, b) of comparable ids, the smallest id of each node's component; nodes with edges only.

    Alternates large and small stars: every node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour. Each round's edges are staged in the shared folder; the driver sees only two counts a round.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(ROUNDS):
        # Large star: from each node, neighbours above it are tied to the smallest of its neighbours and itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node's neighbours at or below it are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        after = staged(tied.where("a <> b").distinct(), "edges")
        # Done when every node has one neighbour below and no such neighbour has one itself.
        deep = after.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        open_ = deep.where("n > 1").limit(1).unionByName(deep.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1))
        now = after
        if open_.isEmpty():
            roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"components are not found after {ROUNDS} rounds")
