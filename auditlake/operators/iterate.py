"""Loops of joins that run until nothing new is found.

Each round's table is written to the shared folder named by spark.checkpoint.dir and read again, which cuts the lineage
and survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rounds after which a loop counts what it goes over, to tell a long path from a circle.
COUNTED = 1000
#: Rounds after which what a loop has found is written anew, in one table.
COMPACT = 8


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set in local mode."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """df, written to the shared folder and read again. `after` is a table of an earlier round that only df still needed; its files go."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(at)
    old = getattr(after, "_round", None)
    if old is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    told = spark.read.schema(df.schema).parquet(at)
    told._round = at
    return told


def numbered(rows: DataFrame, group: list[str], *order: str) -> DataFrame:
    """rows with `number`, from 1 within each group in that order; a group is numbered in ranges, never in one task."""
    parts = checkpointed(rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy(*group, "part").agg(F.count("*").alias("n"))
    before = counts.select(*group, "part", (F.sum("n").over(W.Window.partitionBy(*group).orderBy("part")) - F.col("n")).alias("before"))
    within = parts.withColumn("within", F.row_number().over(W.Window.partitionBy(*group, "part").orderBy(*order)))
    return within.join(before, [*group, "part"]).withColumn("number", F.col("before") + F.col("within")).drop("part", "before", "within")


def levels(tree_entries: DataFrame) -> Iterator[int]:
    """Numbers of a walk's levels, without end; more levels than there are trees are an error, for then a tree holds itself."""
    for k in count():
        if k and k % COUNTED == 0 and k > tree_entries.select("tree_oid").distinct().count():
            raise RuntimeError("a tree holds itself")
        yield k


def hops(edges: DataFrame, doublings: int = 3) -> DataFrame:
    """(node, next, d): ancestors within 2 ** doublings steps of edges(child, parent), with the longest such path's length.

    Following these instead of single edges divides the rounds of a loop by that number of steps. Histories branch
    little, so the table stays within a small multiple of the edges; fewer doublings suit graphs that branch much.
    """
    now = checkpointed(edges.select(F.col("child").alias("node"), F.col("parent").alias("next")).distinct().withColumn("d", F.lit(1)))
    for _ in range(doublings):
        far = now.join(now.select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("d").alias("d2")), "next").select("node", F.col("n2").alias("next"), (F.col("d") + F.col("d2")).alias("d"))
        now = checkpointed(now.unionByName(far).groupBy("node", "next").agg(F.max("d").alias("d")), now)
    return now


def closure(starts: DataFrame, edges: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(start, node): all nodes that each start reaches over edges(child, parent), itself included.

    starts(start) are nodes; with starts(start, node), a start is a name for any number of nodes, walked together, so that
    what they reach in common is met once. Pairs reached so far are joined with the ancestors some steps away; a round's new
    pairs are those not seen before. All starts go together, so the number of rounds depends on the longest path alone.
    """
    links = (steps if steps is not None else hops(edges)).select("node", "next")
    frontier = checkpointed(starts.select("start", F.col("node" if "node" in starts.columns else "start").alias("node")).distinct())
    seen = frontier
    for k in count():
        reached = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if k % COMPACT == COMPACT - 1:
            seen = checkpointed(seen)


def doubled(links: DataFrame) -> DataFrame:
    """(node, root, distance): the last node of the chain from each node over links(node, next), one successor or null each, and how far it is.

    Each round follows eight times as many links at once as the one before; what has arrived is joined no more.
    """
    kind = dict(links.dtypes)["node"]
    end = F.col("next").isNull()
    now = links.select("node", "next", F.when(end, F.col("node")).cast(kind).alias("root"), F.when(end, 0).otherwise(1).cast("long").alias("distance"))

    def twice(rows: DataFrame) -> DataFrame:
        that = rows.select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("root").alias("r2"), F.col("distance").alias("d2"))
        far = rows.where("next is not null").join(that, "next").select("node", F.col("n2").alias("next"), F.col("r2").alias("root"), (F.col("distance") + F.col("d2")).alias("distance"))
        return rows.where("next is null").unionByName(far)

    most = None
    while True:
        now = checkpointed(twice(twice(twice(now))), now)
        if now.where("next is not null").isEmpty():
            return now.select("node", "root", "distance")
        most = most or 8 * now.count()
        if not now.where(F.col("distance") > most).isEmpty():
            raise RuntimeError("the links form a cycle")


def followed(links: DataFrame) -> DataFrame:
    """(node, root, circular): the last node of the chain from each node, over links(node, next) with one successor or null.

    A successor that is no node itself is a root. Pointers double each round; a chain that does not end within as many
    links as there are nodes is circular and has no root.
    """
    now = checkpointed(links.select("node", "next", F.when(F.col("next").isNull(), F.col("node")).alias("root")))
    for _ in range(max(1, now.count()).bit_length() + 1):
        if now.where("root is null").isEmpty():
            break
        that = now.select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("root").alias("r2"), F.lit(True).alias("here"))
        far = now.where("root is null").join(that, "next", "left").select("node", F.col("n2").alias("next"), F.when(F.col("here").isNull(), F.col("next")).otherwise(F.col("r2")).alias("root"))
        now = checkpointed(now.where("root is not null").unionByName(far))
    return now.select("node", "root", F.col("root").isNull().alias("circular"))


def generations(nodes: DataFrame, edges: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(node, generation): the length of the longest path from each node to one without parents, by rounds of relaxation.

    In a round only nodes that grew in the one before are looked at from their descendants.
    """
    links = steps if steps is not None else hops(edges)
    now = checkpointed(nodes.select("node").distinct().withColumns({"generation": F.lit(0).cast("long"), "grew": F.lit(True)}))
    most = None
    for k in count(1):
        up = links.join(now.where("grew").select(F.col("node").alias("next"), F.col("generation").alias("g")), "next").groupBy("node").agg(F.max(F.col("g") + F.col("d")).alias("g"))
        grew = F.coalesce(F.col("g") > F.col("generation"), F.lit(False))
        now = checkpointed(now.drop("grew").join(up, "node", "left").select("node", F.when(grew, F.col("g")).otherwise(F.col("generation")).alias("generation"), grew.alias("grew")), now)
        if now.where("grew").isEmpty():
            return now.drop("grew")
        if k % COUNTED == 0:
            most = most or nodes.select("node").distinct().count()
            if not now.where(F.col("generation") >= most).isEmpty():
                raise RuntimeError("the edges form a cycle")
