"""Shards of near-equal bytes by minimax contiguous partition, with DataFrame functions alone.

Equal texts are an atomic group. Groups are in order of their key, the first 60 bits of their text's SHA-1 (texts that share
these would be one group), and each shard is a contiguous range of keys. The capacity is the smallest at which greedy filling
needs no more shards than asked for, by binary search over the groups' sizes; the cuts are then levelled within it, so that no
shard exceeds that capacity and the last is not left light.

Groups are not gathered for this. The driver searches over units, which are ranges of keys with their bytes, 65,536 at first.
Coarse units tell between which bytes each cut must lie, whatever the groups within; the units there are divided 256-fold by another
aggregation, until those at the cuts are single groups. So the search is that over all groups, and the driver holds some 65,536 sums
and a few hundred times 256 more for each division, however many groups there are.

Rows of a key's first 16 bits are spread over as many cells as their number calls for; a row's slot is the count of rows in
earlier cells of its shard plus its rank within the cell, so no task ranks a whole shard or a whole group of copies.

Defined results: null text has size 1 and the CRC of the empty text; rows of equal doc_id are ranked by size and CRC and each gets
its slot; null doc_ids come first; a long text is one row's size and digest; other columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.llm.common import staged

#: Bits of a key, of a first unit's number, and of each division of a unit.
BITS, FIRST, MORE = 60, 16, 8
#: Rows of a cell, about.
CELL_ROWS = 65_536


class Unit(NamedTuple):
    """A range of keys: its first key, the bits below its number, its bytes and its groups."""

    key: int
    below: int
    size: int
    groups: int


def group_sizes(docs: DataFrame) -> DataFrame:
    """(key, bytes) of each group of equal texts of docs(key, size)."""
    return docs.groupBy("key").agg(F.sum("size").alias("bytes"))


def _units(groups: DataFrame, below: int) -> list[Unit]:
    number = F.shiftright("key", below)
    rows = groups.groupBy(number.alias("u")).agg(F.sum("bytes").alias("size"), F.count("*").alias("groups")).collect()
    return [Unit(r["u"] << below, below, r["size"], r["groups"]) for r in rows]


def _filled(ends: list[int], capacity: int, n: int) -> list[int]:
    """Where greedy filling ends each of n shards, over units that end at `ends`; it stays where a unit is larger than the capacity."""
    at, out = 0, []
    for _ in range(n):
        k = bisect_right(ends, at + capacity)
        at = max(at, ends[k - 1] if k else 0)
        out.append(at)
    return out


def _capacity(ends: list[int], low: int, high: int, n: int) -> int:
    """The smallest capacity from low to high at which n shards hold all; high is one."""
    while low < high:
        middle = (low + high) // 2
        if _filled(ends, middle, n)[-1] == ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _levelled(ends: list[int], capacity: int, n: int, large: list[int]) -> list[int]:
    """Ends of n shards of at most that capacity, as near to equal as units allow; large: sizes of groups above the fair share."""
    total, rest, last = ends[-1], sum(large), [ends[-1]]
    for _ in range(n - 1):
        # Where a shard must begin at the earliest, so that the shards from there on hold what is left.
        at = bisect_left(ends, last[-1] - capacity)
        last.append(0 if last[-1] <= capacity else ends[at])
    share, at, out = -(-(total - rest) // max(n - len(large), 1)), 0, []
    for k in range(1, n):
        if not large:
            # What is left is shared anew, so that what one shard lacks does not all fall to the last.
            share = -(-(total - at) // (n - k + 1))
        first, most = max(last[n - k], at), at + capacity
        i, j = bisect_left(ends, first), bisect_right(ends, most) - 1
        k = min(max(bisect_left(ends, at + share), i), j)
        if k > i and k - 1 >= 0 and ends[k - 1] > at and at + share - ends[k - 1] < ends[k] - at - share:
            k -= 1
        at = max(at, ends[k]) if 0 <= k else at
        out.append(at)
    return [*out, total]


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """The first keys of the second and further shards, and the smallest capacity, for groups(key, bytes) in order of key."""
    units = sorted(_units(groups, BITS - FIRST))
    if not units:
        return [], 0
    total = sum(u.size for u in units)
    fair = -(-total // n_shards)
    # Fewer than there are shards.
    large = [r["bytes"] for r in groups.where(F.col("bytes") > fair).select("bytes").collect()]
    low = max([fair, *large])
    if not large:
        low = max(low, groups.agg(F.max("bytes")).first()[0])
    while True:
        ends = list(accumulate(u.size for u in units))
        high = _capacity(ends, low, low + max(u.size for u in units), n_shards)
        cuts = _levelled(ends, high, n_shards, large)
        # A cut lies no lower than where coarse units let the least capacity come, and no higher than shards of the found one reach.
        least = _filled(ends, low, n_shards)
        spans = [(max(least[j - 1], total - (n_shards - j) * high), min(total, j * high)) for j in range(1, n_shards)] if high > low else []
        open_ = set()
        for a, b in [*spans, *((c - 1, c + 1) for c in cuts[:-1])]:
            open_.update(range(bisect_right(ends, a), min(bisect_left(ends, b) + 1, len(units))))
        divided = [units[k] for k in open_ if units[k].groups > 1 and units[k].below]
        if not divided:
            return [units[bisect_right(ends, c)].key if c < total else 1 << BITS for c in cuts[:-1]], high
        found = {u for u in divided}
        units = [u for u in units if u not in found]
        for below in {u.below for u in divided}:
            own = groups.sparkSession.createDataFrame([(u.key >> below,) for u in divided if u.below == below], "u long")
            inside = groups.withColumn("u", F.shiftright("key", below)).join(F.broadcast(own), "u", "left_semi")
            units += _units(inside, max(below - MORE, 0))
        units.sort()


def sharded(docs: DataFrame, n_shards: int) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = text.cast("binary")
    key = F.conv(F.substring(F.sha1(raw), 1, BITS // 4), 16, 10).cast("long")
    rows = staged(docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("key"), F.shiftright(key, BITS - FIRST).cast("int").alias("run")), "sizes")
    starts, _ = minimax_cuts(staged(group_sizes(rows), "groups"), n_shards)
    shard = sum(((F.col("key") >= start).cast("int") for start in starts), F.lit(0))
    # One row for each of the first 16 bits of keys, 65,536 at most.
    parts = rows.groupBy("run").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    spread = rows.join(F.broadcast(parts), "run").select("doc_id", "size", "text_crc32", "run", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")).cast("int").alias("cell"))
    cells = staged(spread.groupBy("shard", "run", "cell").agg(F.count("*").alias("n")), "cells")
    ordered = W.Window.partitionBy("shard").orderBy("run", "cell").rowsBetween(W.Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(ordered), F.lit(0))).drop("n")
    rank = F.row_number().over(W.Window.partitionBy("shard", "run", "cell").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32"))
    return spread.join(before, ["shard", "run", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + rank - 1).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(docs, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
