"""A commit graph covered by chains of first parents, and questions of reachability asked of chains instead of commits.

Each commit lies at a position of one chain, counted from the chain's oldest commit, and reaches all that lies below it there. So what
a start reaches is told by one position for each chain it comes to, and only edges that lead to another chain need be followed: the
rounds of a walk are as many as the changes of chain on a path, however long the chains, and each edge is followed once for a start.

Tables: edges(child, parent, parent_index), places(node, chain, pos), crossings(chain, pos, parent_index, to_chain, to_pos),
labels(start, chain, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.operators.iterate import checkpointed, doubled, numbered

#: How often the crossings that shortcuts follow in a row are doubled.
DOUBLINGS = 5


def chain_places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, chain, pos) of nodes(node) and all ends of edges: a commit goes on the chain of its first parent, of several such children the greatest.

    Of parents with equal indexes the least is the first, so that chains are the same however often and in what order edges are read.
    """
    first = edges.groupBy("child").agg(F.min(F.struct("parent_index", "parent")).alias("first")).select("child", "first.parent")
    taken = first.groupBy(F.col("parent").alias("next")).agg(F.max("child").alias("node"))
    ends = nodes.select("node").unionByName(edges.select(F.explode(F.array("child", "parent")).alias("node"))).distinct()
    return doubled(checkpointed(ends.join(taken, "node", "left"))).select("node", F.col("root").alias("chain"), F.col("distance").cast("long").alias("pos"))


def crossings(places: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lead to another chain: (chain, pos, parent_index, to_chain, to_pos)."""
    at = lambda end, chain, pos: places.select(F.col("node").alias(end), F.col("chain").alias(chain), F.col("pos").alias(pos))
    rows = edges.select("child", "parent", "parent_index").join(at("child", "chain", "pos"), "child").join(at("parent", "to_chain", "to_pos"), "parent")
    return checkpointed(rows.where("chain <> to_chain").select("chain", "pos", "parent_index", "to_chain", "to_pos"))


def shortcuts(cross: DataFrame) -> DataFrame:
    """(chain, pos, to_chain, to_pos): where 1, 2, 4 and more crossings in a row lead from each place that a crossing leads to, always by the next one below.

    They hold only what is reached, so a walk that takes them finds no more, in fewer rounds: what a row of n crossings comes to is met
    after as many rounds as n has powers of two. A place has one next crossing, so the table grows with the crossings alone.
    """
    order = W.Window.partitionBy("chain").orderBy("pos").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    leads = cross.groupBy("chain", "pos").agg(F.max(F.struct("to_chain", "to_pos")).alias("to"))
    landed = cross.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")).distinct().withColumn("landed", F.lit(True))
    both = leads.withColumn("landed", F.lit(False)).unionByName(landed.withColumn("to", F.lit(None).cast(leads.schema["to"].dataType)))
    below = both.withColumn("to", F.last("to", True).over(order)).where("landed and to is not null")
    now = checkpointed(below.select("chain", "pos", "to.to_chain", "to.to_pos"))
    found = now
    for _ in range(DOUBLINGS):
        now = checkpointed(now.join(now.toDF("to_chain", "to_pos", "c", "p"), ["to_chain", "to_pos"]).select("chain", "pos", F.col("c").alias("to_chain"), F.col("p").alias("to_pos")))
        found = found.unionByName(now)
    return checkpointed(found.where("chain <> to_chain").groupBy("chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos")))


class Reach:
    """Reachability in one commit graph. Its places, crossings and shortcuts are tables, made once and asked any number of times."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, places: DataFrame | None = None):
        index = F.col("parent_index") if "parent_index" in edges.columns else F.lit(0).alias("parent_index")
        edges = checkpointed(edges.select("child", "parent", index))
        none = edges.select(F.col("child").alias("node")).where("false")
        self.places = chain_places(none if nodes is None else nodes, edges) if places is None else places
        self.cross = crossings(self.places, edges)
        self._short = None

    @property
    def short(self) -> DataFrame:
        if self._short is None:
            self._short = shortcuts(self.cross)
        return self._short

    def labels(self, starts: DataFrame) -> DataFrame:
        """(start, chain, pos): the highest position on each chain that starts(start, node) reach, themselves included.

        A start is a name for any number of nodes. A node without edges is a chain of its own.
        """
        placed = starts.select("start", "node").join(self.places, "node", "left").select("start", F.coalesce("chain", "node").alias("chain"), F.coalesce("pos", F.lit(0)).alias("pos"))
        now, first = placed.groupBy("start", "chain").agg(F.max("pos").alias("pos")).withColumn("done", F.lit(-1).cast("long")), True
        hop = self.cross.groupBy(F.col("chain"), F.col("pos").alias("at"), "to_chain").agg(F.max("to_pos").alias("to_pos"))
        far = self.short.select(F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"), F.col("to_chain").alias("c"), F.col("to_pos").alias("p"))
        most = lambda rows: rows.groupBy("start", "chain").agg(F.max("pos").alias("pos"))
        while True:
            fresh = now.where("pos > done")
            if not first and fresh.isEmpty():
                return now.drop("done")
            first = False
            # Each crossing is followed once for a start: those between what was done and what is reached now.
            met = fresh.join(hop, "chain").where("at <= pos and at > done").select("start", "to_chain", "to_pos").groupBy("start", "to_chain").agg(F.max("to_pos").alias("to_pos"))
            more = met.join(far, ["to_chain", "to_pos"], "left").select("start", F.explode(F.array(F.struct(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")), F.struct(F.col("c").alias("chain"), F.col("p").alias("pos")))).alias("x")).select("start", "x.*").where("chain is not null")
            both = now.join(most(more).withColumnRenamed("pos", "more"), ["start", "chain"], "full")
            now = checkpointed(both.select("start", "chain", F.greatest("pos", "more").alias("pos"), F.coalesce("pos", F.lit(-1).cast("long")).alias("done")), now)

    def nodes(self, labels: DataFrame, without: DataFrame | None = None) -> DataFrame:
        """(start, node) of all that labels cover, less what the labels `without` of the same start do."""
        low = F.lit(-1).cast("long")
        rows = labels.withColumn("low", low)
        if without is not None:
            rows = labels.join(without.withColumnRenamed("pos", "low"), ["start", "chain"], "left").withColumn("low", F.coalesce("low", low)).where("low < pos")
        found = rows.join(self.places.withColumnRenamed("pos", "at"), "chain").where("at <= pos and at > low").select("start", "node")
        alone = rows.join(self.places.select("chain").distinct(), "chain", "left_anti").select("start", F.col("chain").alias("node"))
        return found.unionByName(alone)

    def covered(self, labels: DataFrame, asked: DataFrame) -> DataFrame:
        """Rows of asked(start, node, ...) whose node labels cover; nothing is formed but those rows."""
        placed = asked.join(self.places.toDF("node", "_chain", "_at"), "node", "left").withColumns({"_chain": F.coalesce("_chain", "node"), "_at": F.coalesce("_at", F.lit(0))})
        return placed.join(labels.toDF("start", "_chain", "_top"), ["start", "_chain"]).where("_at <= _top").drop("_chain", "_at", "_top")

    def counted(self, labels: DataFrame, asked: DataFrame, by: str = "bundle_id") -> DataFrame:
        """(by, start, n, least) for each of labels(by, start, chain, pos) that covers some of asked(by, node): how many of them, and the least.

        Labels and nodes go up each chain together, a label after the nodes at its position.
        """
        placed = asked.join(self.places, "node", "left").select(by, F.coalesce("chain", "node").alias("chain"), F.coalesce("pos", F.lit(0)).alias("pos"), "node")
        kept = labels.join(placed.select(by, "chain").distinct(), [by, "chain"], "left_semi")
        none = lambda rows, c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
        both = placed.select(by, "chain", "pos", "node", none(labels, "start")).unionByName(kept.select(by, "chain", "pos", none(placed, "node"), "start"))
        below = W.Window.partitionBy(by, "chain").orderBy("pos").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        told = both.select(by, "start", F.count("node").over(below).alias("n"), F.min("node").over(below).alias("least"))
        return told.where("start is not null and n > 0")

    def least(self, starts: DataFrame) -> DataFrame:
        """(bundle_id, chain, pos, floor, key): down to which position below pos each entry's key is the least of starts(bundle_id, node, key) that reach it.

        An entry is looked at only where none of a lower key leads, so a bundle is walked once whatever its starts.
        """
        now = checkpointed(starts.join(self.places, "node", "left").select("bundle_id", F.coalesce("chain", "node").alias("chain"), F.coalesce("pos", F.lit(0)).alias("pos"), "key").groupBy("bundle_id", "chain", "pos").agg(F.min("key").alias("key")).withColumn("fresh", F.lit(True)))
        hop = self.cross.groupBy("chain", F.col("pos").alias("at"), "to_chain").agg(F.max("to_pos").alias("to_pos"))
        far = self.short.toDF("to_chain", "to_pos", "c", "p")
        while True:
            fresh = _stretches(now).where("fresh")
            met = fresh.join(hop, "chain").where("at <= pos and at > floor").groupBy("bundle_id", "to_chain", "to_pos").agg(F.min("key").alias("key"))
            place = lambda c, p: F.struct(F.col(c).alias("chain"), F.col(p).alias("pos"))
            more = met.join(far, ["to_chain", "to_pos"], "left").select("bundle_id", "key", F.explode(F.array(place("to_chain", "to_pos"), place("c", "p"))).alias("x")).select("bundle_id", "x.*", "key").where("chain is not null")
            both = now.drop("fresh").join(more.groupBy("bundle_id", "chain", "pos").agg(F.min("key").alias("other")), ["bundle_id", "chain", "pos"], "full")
            better = F.coalesce(F.col("other") < F.col("key"), F.col("other").isNotNull())
            told = both.select("bundle_id", "chain", "pos", F.when(better, F.col("other")).otherwise(F.col("key")).alias("key"), better.alias("fresh"))
            now = checkpointed(_stretches(told).select("bundle_id", "chain", "pos", "key", "fresh"), now)
            if now.where("fresh").isEmpty():
                return _stretches(now).drop("fresh")


def islands(places: DataFrame, own: DataFrame) -> DataFrame:
    """(node, chain, pos) of own(repo, oid) by themselves: a chain of places is cut where a repository lacks a commit. Nodes and chains are named with their repository."""
    placed = own.join(places.withColumnRenamed("node", "oid"), "oid", "left").select("repo", "oid", F.coalesce("chain", "oid").alias("line"), F.coalesce("pos", F.lit(0).cast("long")).alias("at"))
    below = F.row_number().over(W.Window.partitionBy("repo", "line").orderBy("at"))
    cut = placed.withColumn("island", F.col("at") - below)
    first = F.min_by("oid", "at").over(W.Window.partitionBy("repo", "line", "island"))
    pos = F.row_number().over(W.Window.partitionBy("repo", "line", "island").orderBy("at")).cast("long") - 1
    return checkpointed(cut.select(F.struct("repo", "oid").alias("node"), F.struct("repo", first.alias("oid")).alias("chain"), pos.alias("pos")))


def first_visits(heads: DataFrame, places: DataFrame, cross: DataFrame) -> DataFrame:
    """(bundle_id, node, head_index, key, run): where a depth-first walk from heads(bundle_id, head_index, node) meets each node first.

    A walk goes down a chain to its end before it takes other parents, those of the deepest commits first. So where it enters a chain is
    told by the head, and for each change of chain how far down the chain before it changed and over which parent; a node, by
    where its chain was entered and how far below it lies. In this order, an entry is looked at only where no earlier one leads.
    """
    key = F.array(F.col("head_index").cast("long"))
    now = checkpointed(heads.join(places, "node").groupBy("bundle_id", "chain", "pos").agg(F.min(key).alias("key")).withColumn("fresh", F.lit(True)))
    while True:
        # An entry counts from its position down to where an earlier one enters.
        fresh = _stretches(now).where("fresh")
        edges = cross.select("chain", F.col("pos").alias("at"), "parent_index", "to_chain", "to_pos")
        step = F.concat("key", F.array(F.col("at") - F.col("pos"), F.col("parent_index").cast("long")))
        met = fresh.join(edges, "chain").where("at <= pos and at > floor").groupBy("bundle_id", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")).agg(F.min(step).alias("other"))
        better = F.coalesce(F.col("other") < F.col("key"), F.col("other").isNotNull())
        told = now.drop("fresh").join(met, ["bundle_id", "chain", "pos"], "full").select("bundle_id", "chain", "pos", F.when(better, F.col("other")).otherwise(F.col("key")).alias("key"), better.alias("fresh"))
        now = checkpointed(_stretches(told).select("bundle_id", "chain", "pos", "key", "fresh"), now)
        if now.where("fresh").isEmpty():
            ends = _stretches(now)
            found = ends.join(places.withColumnRenamed("pos", "at"), "chain").where("at <= pos and at > floor")
            return found.select("bundle_id", "node", F.element_at("key", 1).alias("head_index"), "key", (F.col("pos") - F.col("at")).alias("run"))


def _stretches(entries: DataFrame) -> DataFrame:
    """Entries that no earlier one of the same chain covers, with `floor`, the position below which the next such entry takes over."""
    down = W.Window.partitionBy("bundle_id", "chain").orderBy(F.desc("pos"))
    above = F.min("key").over(down.rowsBetween(W.Window.unboundedPreceding, -1))
    kept = entries.withColumn("above", above).where(F.col("above").isNull() | (F.col("key") < F.col("above"))).drop("above")
    return kept.withColumn("floor", F.coalesce(F.lead("pos").over(down), F.lit(-1)))


def in_order(rows: DataFrame, group: list[str], *order: str | Column) -> DataFrame:
    """rows with `number`, from 1, by the given columns within each group."""
    names = [f"_order{k}" for k in range(len(order))]
    return numbered(rows.withColumns(dict(zip(names, order, strict=True))), group, *names).drop(*names)
