"""Nearest neighbours by low-dimensional stable projections, a k-d tree over them, and a chi-square stopping test.

A Gaussian matrix takes vectors to a few dimensions, where a squared distance is the true one times a chi-square variable. Projected
points are indexed by a k-d tree; a query goes through its leaves from near to far, verifies their vectors exactly, and stops when
a vector as near as its k-th best so far would, with probability SURE, have been met already. So each true neighbour
is found with that probability at least, whatever the data; how much is verified depends on how the data lie.

For the largest inner product, vectors get one more component that makes their norms equal (the largest norm of all), and queries
are scaled to that norm: then the nearest by distance are the largest by inner product, ties included.

The tree's upper part cuts space into cells, fitted on at most SAMPLE projected rows, and its lower part is built over all rows
of a cell, or of each part of one that holds more than a task should. Queries first search a part of their own cell; with
the k-th best found there they go to the cells that the stopping test leaves open. Rows of a part come before its queries in
one sorted stream, so a task holds one part and one batch of queries.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components takes no part, nor does one with null
vec_id, nor one whose length is not the table's most frequent one (of several, the largest). Repeated rows are candidates each, a row never of itself;
repeated queries return their rows each. Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import keyed, staged
from auditlake.llm.kdtree import Tree, grown, leaves

#: Neighbours of a query; queries are rows whose vec_id it divides.
TOP, EVERY = 20, 20
#: Dimensions of the projection (an even number), and the probability of the stopping test.
DIMENSIONS, SURE = 8, 0.98
#: Rows on which the cells are fitted.
SAMPLE = 16_384
#: Rows of a cell as aimed at, of which a part holds twice as many at most, and the most cells.
CELL, CELLS = 8192, 1024
#: Rows of a leaf, and queries searched for together.
LEAF, TOGETHER = 256, 512
#: Relative error of a product of matrices, far above its real one; what is that close to the k-th is summed anew.
NOISE = 1e-9


def chi_square_quantile(p: float, dimensions: int) -> float:
    """The x below which a chi-square variable of an even number of dimensions lies with probability p."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < p else (low, (low + high) / 2)
    return high


class Space:
    """The projection of vectors of given length whose largest norm is known."""

    def __init__(self, size: int, norm: float):
        self.size, self.norm = size, norm
        self.matrix = np.random.default_rng(20).standard_normal((size + 1, DIMENSIONS))
        self.chi = chi_square_quantile(SURE, DIMENSIONS)

    def vectors(self, column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(-1, self.size)

    def points(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return x @ self.matrix[:-1] + more[:, None] * self.matrix[-1]

    def query_points(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.linalg.norm(q, axis=1))[:, None]) @ self.matrix[:-1]

    def reach(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Squared projected distance at which a query stops: the k-th best's squared distance times the quantile."""
        return self.chi * (2 * self.norm**2 - 2 * self.norm / np.linalg.norm(q, axis=1) * kth) + NOISE * self.norm**2


def _list(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _apart(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        out += np.maximum(np.maximum(low[:, k] - points[:, k, None], points[:, k, None] - high[:, k]), 0) ** 2
    return out


def _projected(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_list(space.points(space.vectors(batch.column("vector"))))], names=["point"])

    return run


def _celled(space: Space, tree: Tree):
    """Adds the projected point of each row and the cell it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = space.points(space.vectors(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, _list(p), pa.array(tree.cells(p).astype(np.int32))], names=[*batch.schema.names, "point", "cell"])

    return run


def _routed(space: Space, low: np.ndarray, high: np.ndarray, parts: np.ndarray):
    """A row for each query and part of a cell that its stopping test leaves open, but the part it has searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = space.vectors(batch.column("vector"))
            kth, cell, part = (np.asarray(batch.column(c)) for c in ("kth", "cell", "part"))
            row, to = np.nonzero(_apart(space.query_points(q), low, high) < space.reach(q, kth)[:, None])
            row, to = np.repeat(row, parts[to]), np.repeat(to, parts[to])
            first = np.append(True, (np.diff(row) != 0) | (np.diff(to) != 0)) if len(row) else np.empty(0, bool)
            place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
            new = (cell[row] != to) | (part[row] != place)
            row, to, place = row[new], to[new], place[new]
            for k in range(0, len(row), 10_000):
                own = pa.array(row[k : k + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(to[k : k + 10_000].astype(np.int32)), pa.array(place[k : k + 10_000].astype(np.int32)), *(batch.column(c).take(own) for c in ("rid", "vec_id", "vector", "kth"))], names=["cell", "part", "rid", "vec_id", "vector", "kth"])

    return run


class Part:
    """The rows of a part of a cell in order of the leaves of their k-d tree."""

    def __init__(self, space: Space, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.space = space
        order, self.starts, self.low, self.high = leaves(space.points(vectors), LEAF)
        self.rids, self.ids, self.vectors = rids[order], ids[order], vectors[order]

    def search(self, rids: np.ndarray, q: np.ndarray, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, and the scores and ids of its best rows here that reach kth, which is its k-th best elsewhere."""
        apart = _apart(self.space.query_points(q), self.low, self.high)
        order = np.argsort(apart, 1, kind="stable")
        slack = NOISE * self.space.norm * np.linalg.norm(q, axis=1)
        best, floor, met = np.full((len(q), TOP), -np.inf), kth.copy(), []
        going = np.arange(len(q))
        for step in range(len(self.low)):
            leaf = order[going, step]
            still = apart[going, leaf] < self.space.reach(q[going], floor[going])
            going, leaf = going[still], leaf[still]
            if not len(going):
                break
            for one in np.unique(leaf):
                own, rows = going[leaf == one], slice(self.starts[one], self.starts[one + 1])
                score = q[own] @ self.vectors[rows].T
                score[self.rids[rows][None, :] == rids[own, None]] = -np.inf
                at, row = np.nonzero(score >= (floor[own] - slack[own])[:, None])
                met.append((own[at], row + self.starts[one]))
                both = np.concatenate([best[own], score], 1)
                best[own] = np.partition(both, both.shape[1] - TOP, 1)[:, -TOP:]
                floor[own] = np.maximum(kth[own], best[own].min(1))
        query, row = (np.concatenate([m[s] for m in met] or [np.empty(0, np.int64)]) for s in (0, 1))
        other = self.rids[row] != rids[query]
        query, row = query[other], row[other]
        # Summed in one order whatever the row's place, so that equal vectors have equal scores.
        score = np.concatenate([(self.vectors[row[k : k + 50_000]] * q[query[k : k + 50_000]]).sum(1) for k in range(0, len(row), 50_000)] or [np.empty(0)])
        good = score >= np.maximum(floor - slack, kth)[query]
        query, row, score = query[good], row[good], score[good]
        order = np.lexsort((self.ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        where = np.searchsorted(query, np.arange(len(q) + 1))
        for k in range(len(q)):
            own = slice(where[k], min(where[k + 1], where[k] + TOP))
            yield k, score[own], self.ids[row[own]]


_BEST = pa.list_(pa.struct([("low", pa.float64()), ("vec_id", pa.int64())]))


def _searched(space: Space):
    """Searches each part for its queries: rows come by cell and part, those to search in before those that ask."""
    columns = ["cell", "part", "rid", "vec_id", "vector", "kth", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("cell", "part", "asks")])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1), len(batch)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if first == last:
                    continue
                at = tuple(keys[:2, first])
                if at != now:
                    now, held, part = at, [], None
                rows = batch.slice(first, last - first)
                rids, ids, vectors = np.asarray(rows.column("rid")), np.asarray(rows.column("vec_id")), space.vectors(rows.column("vector"))
                if not keys[2, first]:
                    held.append((rids, ids, vectors))
                    continue
                if part is None and held:
                    part, held = Part(space, *(np.concatenate(x) for x in zip(*held, strict=True))), []
                kth = np.asarray(rows.column("kth"))
                for k in range(0, len(rows), TOGETHER):
                    own, lists, new = slice(k, k + TOGETHER), [], kth[k : k + TOGETHER].copy()
                    for number, score, names in part.search(rids[own], vectors[own], kth[own]) if part else ((n, np.empty(0), ids[:0]) for n in range(len(new))):
                        lists.append([{"low": -s, "vec_id": i} for s, i in zip(score.tolist(), names.tolist(), strict=True)])
                        new[number] = score[-1] if len(score) == TOP else new[number]
                    some = rows.slice(k, len(new))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns[:5]), pa.array(new), pa.array(lists, _BEST)], names=columns)

    return run


def nearest(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) whose vec_id `every` divides, the TOP others of largest inner product."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = keyed(vectors, "vec_id", "embedding").select("rid", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("square")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size, count, norm = (sizes[0]["size"], sizes[0]["n"], math.sqrt(sizes[0]["square"])) if sizes else (1, 0, 1.0)
    rows, space = rows.where(F.size("vector") == size), Space(size, norm)
    cells = min(CELLS, -(-count // CELL))
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("vector").mapInArrow(_projected(space), "point array<double>").toArrow()["point"].combine_chunks()
    points = np.asarray(sample.flatten()).reshape(-1, DIMENSIONS)
    tree = grown(points, max(1, -(-len(points) // max(cells, 1))))
    placed = staged(rows.mapInArrow(_celled(space, tree), f"rid long, vec_id long, vector {kind}, point array<double>, cell int"), "vectors")
    ends = [f(F.get("point", F.lit(k))).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(DIMENSIONS)]
    # A row for each cell, of which there are CELLS at most, give or take equal points.
    boxes = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: r["cell"])
    low, high = (np.full((tree.leaves, DIMENSIONS), np.inf) for _ in range(2))
    parts = np.zeros(tree.leaves, np.int64)
    for r in boxes:
        low[r["cell"]], high[r["cell"]] = ([r[f"{name}{k}"] for k in range(DIMENSIONS)] for name in ("low", "high"))
        parts[r["cell"]] = -(-r["n"] // (2 * CELL))
    hashed = F.pmod(F.xxhash64("rid"), F.get(F.lit(parts.tolist()).cast("array<long>"), "cell")).cast("int")
    here = placed.withColumn("part", hashed).select("cell", "part", F.lit(0).alias("asks"), "rid", "vec_id", "vector", F.lit(0.0).alias("kth"))

    def searched(asked: DataFrame) -> DataFrame:
        both = here.unionByName(asked.withColumn("asks", F.lit(1)))
        return both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").mapInArrow(_searched(space), f"cell int, part int, rid long, vec_id long, vector {kind}, kth double, best array<struct<low:double,vec_id:long>>")

    asked = here.where(F.col("vec_id") % every == 0).select("cell", "part", "rid", "vec_id", "vector", F.lit(float("-inf")).alias("kth"))
    own = staged(searched(asked), "own")
    more = searched(own.mapInArrow(_routed(space, low, high, parts), f"cell int, part int, rid long, vec_id long, vector {kind}, kth double"))
    best = lambda rows, *key: rows.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, TOP).alias("best"))
    found = own.select("rid", "vec_id", "cell", "best").unionByName(more.select("rid", "vec_id", "cell", "best"))
    # First by groups of cells, so that no task gets a query's lists of all cells at once.
    once = best(found.withColumn("salt", F.col("cell") % 32), "rid", F.col("vec_id").alias("query_id"), "salt")
    last = best(once, "rid", "query_id").select("query_id", F.posexplode("best").alias("at", "b"))
    return last.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.low")).alias("score"))


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
