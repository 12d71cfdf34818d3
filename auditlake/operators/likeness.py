"""Renames by likeness: which deleted and added texts share enough of their lines, paired one to one.

A text's lines are pieces between newlines, each of its bytes and one more; two texts are alike by the bytes of lines they
share over the larger one's. Lines are known by 64-bit hashes. Everything is keyed by `by`, many pairs of snapshots at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.operators.iterate import checkpointed

#: Deleted times added texts that hold a line, beyond which the line is common.
FEW = 400
#: Pairs of texts that are settled together, and steps of the score by which more are taken apart.
PAIRS, STEPS = 1_000_000, 64
#: What a sum of bytes may fall short of a threshold by, being a product of fractions.
ROUNDING = 1e-6


def _entries(rows: DataFrame, side: int, by: tuple[str, ...]) -> DataFrame:
    """A row for each text and distinct line of it: how often it has the line, the line's bytes, the text's size."""
    lines = rows.where(F.octet_length("text") > 0).select(*by, F.lit(side).alias("side"), "path", (F.octet_length("text") + 1).alias("size"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(*by, "side", "path", "size", F.xxhash64("line").alias("line")).agg(F.count("*").alias("n"), (F.any_value(F.octet_length("line")) + 1).alias("bytes"))


def _shared(entries: DataFrame, by: tuple[str, ...], threshold: float) -> DataFrame:
    """Entries of lines that both sides have, with `pairs`, deleted times added texts of the line, and `call`: whether a text that
    is alike could have this line as the rarest that they share.

    Lines are in order from rare to common. Two texts that share the threshold's part of both share a line from which on either has
    still as much left; only from such lines on a text need be looked for.
    """
    count = lambda s: F.count_if(F.col("side") == s)
    held = entries.groupBy(*by, "line").agg((count(0) * count(1)).alias("pairs")).where("pairs > 0")
    later = W.Window.partitionBy(*by, "side", "path").orderBy(F.desc("pairs"), F.desc("line")).rowsBetween(W.Window.unboundedPreceding, 0)
    left = F.sum(F.col("n") * F.col("bytes")).over(later)
    return entries.join(held, [*by, "line"]).withColumn("call", left >= threshold * F.col("size") - ROUNDING)


def _two(rows: DataFrame, by: tuple[str, ...], *columns: str) -> tuple[DataFrame, DataFrame]:
    """Deleted and added rows, their path and other named columns under names that begin with d and a."""
    side = lambda k, name: rows.where(F.col("side") == k).select(*by, "line", *[F.col(c).alias(name if c == "path" else f"{name}_{c}") for c in columns])
    return side(0, "d"), side(1, "a")


def settled(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one pairs of (by, d, a, score) by falling score; equal scores in the order of a hash of the pair.

    Each round takes the pairs that are either side's first choice, which are those that taking the best pair again and again would
    take. As equal scores fall in a random order, half of what is left settles in a round, not one pair of each text's copies.
    """
    left, out = checkpointed(candidates.select(*by, "d", "a", "score", F.sha1(F.concat("d", F.lit("\n"), "a").cast("binary")).alias("tie"))), []
    while not left.isEmpty():
        best = lambda c: left.groupBy(*by, c).agg(F.max(F.struct("score", "tie")).alias("best")).select(*by, c, "best.*")  # noqa: E731, B023
        won = checkpointed(left.join(best("d"), [*by, "d", "score", "tie"], "left_semi").join(best("a"), [*by, "a", "score", "tie"], "left_semi"))
        out.append(won.drop("tie"))
        left = checkpointed(left.join(won.select(*by, "d"), [*by, "d"], "left_anti").join(won.select(*by, "a"), [*by, "a"], "left_anti"))
    found = left.drop("tie")
    for won in out:
        found = found.unionByName(won)
    return found


def _members(shared: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, side, path, class) of texts that have a line to be looked for by; texts of one side with the same shared lines and size are a class.

    Texts of a class are equally alike to any other text, so only one of them need be compared. Where no line is common, a text is its own.
    """
    own = F.col("path")
    if not shared.where(F.col("call") & (F.col("pairs") > FEW)).isEmpty():
        own = F.sha1(F.to_json(F.struct("size", "lines")).cast("binary"))
    texts = shared.groupBy(*by, "side", "path", "size").agg(F.array_sort(F.collect_list(F.struct("line", "n"))).alias("lines"), F.bool_or("call").alias("call"))
    return checkpointed(texts.where("call").select(*by, "side", "path", own.alias("class")))


def _alike(shared: DataFrame, members: DataFrame, by: tuple[str, ...], threshold: float) -> DataFrame:
    """(by, d_class, a_class, score) of all classes that are alike, by one text of each."""
    one = members.groupBy(*by, "side", "class").agg(F.min("path").alias("path"))
    rows = checkpointed(shared.join(one, [*by, "side", "path"]).drop("path").withColumnRenamed("class", "path"))
    d, a = _two(rows.where("call"), by, "path")
    candidates = d.join(a, [*by, "line"]).select(*by, "d", "a").distinct()
    d, a = _two(rows, by, "path", "n", "bytes", "size")
    both = candidates.join(d, [*by, "d"]).join(a.drop("a_bytes"), [*by, "a", "line"])
    score = F.sum(F.least("d_n", "a_n") * F.col("d_bytes")) / F.greatest(F.max("d_size"), F.max("a_size"))
    told = both.groupBy(*by, "d", "a").agg(score.alias("score")).where(F.col("score") >= threshold)
    return checkpointed(told.withColumnsRenamed({"d": "d_class", "a": "a_class"}))


def _without(rows: DataFrame, won: DataFrame, by: tuple[str, ...]) -> DataFrame:
    gone = won.select(*by, F.lit(0).alias("side"), F.col("d").alias("path")).unionByName(won.select(*by, F.lit(1).alias("side"), F.col("a").alias("path")))
    return rows.join(gone, [*by, "side", "path"], "left_anti")


def similar_renames(deleted: DataFrame, added: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, d, a, score) one to one: shared bytes of equal lines over the larger text, from deleted(by, path, text) and added(by, path, text).

    The best pair of all is taken again and again. If pairs are many, those above a score go first: what they take leaves fewer texts
    for the others, and as no pair below comes before one above, the pairs taken are the same. Null and empty texts take no part.
    """
    shared = checkpointed(_shared(_entries(deleted, 0, by).unionByName(_entries(added, 1, by)), by, threshold))
    left = _members(shared, by)
    classes, out = _alike(shared, left, by, threshold), None
    while True:
        n = lambda side, name: left.where(F.col("side") == side).groupBy(*by, F.col("class").alias(f"{name}_class")).agg(F.count("*").alias(f"n_{name}"))  # noqa: E731, B023
        live = checkpointed(classes.join(n(0, "d"), [*by, "d_class"]).join(n(1, "a"), [*by, "a_class"]).withColumn("step", F.floor(F.col("score") * STEPS)))
        low, met = 0, 0
        for step, pairs in sorted(((r["step"], r["pairs"]) for r in live.groupBy("step").agg(F.sum(F.col("n_d") * F.col("n_a")).alias("pairs")).collect()), reverse=True):
            if met and met + pairs > PAIRS:
                break
            low, met = step, met + pairs
        side = lambda k, name: left.where(F.col("side") == k).select(*by, F.col("class").alias(f"{name}_class"), F.col("path").alias(name))  # noqa: E731, B023
        won = settled(live.where(F.col("step") >= low).join(side(0, "d"), [*by, "d_class"]).join(side(1, "a"), [*by, "a_class"]), by)
        out = won if out is None else out.unionByName(won)
        classes = live.where(F.col("step") < low).select(*by, "d_class", "a_class", "score")
        if classes.isEmpty():
            return out
        left = checkpointed(_without(left, won, by))


def regular(mode: str) -> Column:
    """Whether a mode is that of a plain or an executable file."""
    return F.col(mode).isin("100644", "100755")
