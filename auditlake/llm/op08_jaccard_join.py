"""Near-duplicate classes by an exact Jaccard join of n-gram sets, verified in prefix trees.

A document's set is its distinct word n-grams as 64-bit hashes in one global order: by the number of documents that have
the n-gram, rare ones first, then by hash. Two sets of similarity t or more share an n-gram among the first
|s| - ceil(t |s|) + 1 of each.

1. One pass over the texts gives per document the set's size, fingerprint and four bin minima, and the n-grams that many
   documents of a block have. Documents of one fingerprint are one class; only its smallest row goes on.
2. Classes that share a bin minimum are tied to the smallest of them as candidates. Verified links among these contract
   families of copies into components, so that a large family never has to be compared pair by pair.
3. The n-grams of all classes are dealt by value and counted; those of two or more classes go back to the class with
   their count, which gives the order and so the prefix. N-grams of one class alone come first in it and find nothing.
4. Prefix n-grams whose classes lie in different components call for a comparison. Where an n-gram has few classes, they
   are paired, and pairs must share as many of these n-grams as their sizes call for. Classes that meet at an n-gram of
   many are dealt into blocks; those outside the block's component probe it.
5. The sets of a block, or the candidates of a probe, are stored in a prefix tree, whose traversal shares the overlap of a
   common path among all sets below it, and leaves a subtree as soon as the lengths that remain cannot reach the overlap
   that is needed. No row is made for pairs which that refutes.

No set is shortened and no partner left out, so the links are exact but for collisions of 64-bit hashes; in step 3 hashes
are cut to a width that grows with the input, where a collision only calls for a comparison more. Results are classes
with their component; copies are not expanded into pairs.

Defined results: a text of fewer words than n is one n-gram, its whole sequence; null, empty and wordless texts have an
empty set and are linked with nothing; repeated rows are copies of each other; null doc_ids never give the id of a
component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import having_ids, keyed, let_go, lookup, released, row_keyed, staged
from auditlake.llm.components import connected
from auditlake.llm.words import blocks, mixed, ngrams

#: Words of an n-gram; similarity as a fraction, so that the bound is tested in whole numbers.
N, NUMERATOR, DENOMINATOR = 5, 75, 100
#: An n-gram in this many documents of one block of BLOCK n-grams is widespread. With a set's usual size, only so many can be.
WIDESPREAD, BLOCK = 8, 1_000_000
#: Widespread n-grams that are looked up, the commonest first, so that no counting group gets all rows of one.
MOVED = 1 << 18
#: Bins whose minima tie classes in step 2.
BINS = 4
#: A bin minimum that more classes share ties them to this many of them.
LARGE, CENTRES = 16, 8
#: N-grams in one counting group, and counted n-grams in one ordering group.
GROUP, ORDERED = 1 << 20, 1 << 19
#: Bits of a cut hash beyond those that number all n-grams.
SPARE = 10
#: Rows of a file in an ordering group lie together in runs of this many bits.
RUN = 10
#: Classes up to which those of one n-gram are paired; beyond, they are compared in blocks.
PAIRED = 32
#: N-grams of the sets in one verifying group of pairs, and in the tree or the probes of one block.
TREE, PROBED = 1 << 19, 1 << 16

def _set_of(h: np.ndarray, n: int) -> np.ndarray:
    return np.unique(ngrams(h, n))


def _profiles(n: int):
    """Per text: size, fingerprint, bin minima; and rows of widespread n-grams, with a null rid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n = 0

        def widespread() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= WIDESPREAD], c[c >= WIDESPREAD]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(u.astype(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.list_(pa.int64()))], names=["rid", "doc_id", "n", "f1", "f2", "bins"])

        for batch in batches:
            rid = np.asarray(batch.column("rid"))
            doc_id = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                h = block.hashes()
                size, f1, f2, bins = [], [], [], []
                for k in range(len(block)):
                    s = _set_of(h[block.words[k] : block.words[k + 1]], n)
                    size.append(len(s))
                    m = mixed(s + np.uint64(0x51))
                    f1.append(int(np.add.reduce(m).astype(np.int64)) if len(s) else 0)
                    f2.append(int(np.bitwise_xor.reduce(mixed(m)).astype(np.int64)) if len(s) else 0)
                    first = np.searchsorted(m := np.sort(m), np.arange(BINS, dtype=np.uint64) << np.uint64(62))
                    bins.append([int(m[a].astype(np.int64)) if a < len(m) and m[a] >> np.uint64(62) == b else None for b, a in enumerate(first)])
                    held.append(s)
                    held_n += len(s)
                own = slice(block.first, block.first + len(block))
                yield pa.RecordBatch.from_arrays([pa.array(rid[own]), doc_id[own], pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bins, pa.list_(pa.int64()))], names=["rid", "doc_id", "n", "f1", "f2", "bins"])
                if held_n > BLOCK:
                    yield widespread()
                    held, held_n = [], 0
        if held:
            yield widespread()
        held = []
        released()

    return run


def prefix_length(size: int) -> int:
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, the lowest first and none of zeros, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    n = max(1, -(-int(x.max() if len(x) else 0).bit_length() // 8))
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    n = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.reshape(-1).view("<u8")


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


#: Rows of steps 3: kind 0 n-grams to count, 1 counted n-grams of classes, 2 sizes of classes.
PACK = "g int, kind int, grams binary, base long, rids binary, counts binary"


def _pack(g: int, kind: int, grams: np.ndarray, rids: np.ndarray, counts: np.ndarray) -> tuple:
    base = int(rids.min())
    return g, kind, packed(_gaps(grams)), base, packed((rids - base).astype(np.uint64)), packed(counts)


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams, row keys and counts of all given packs."""
    grams = [np.cumsum(unpacked(x), dtype=np.uint64) for x in pdf["grams"]]
    rids = [unpacked(x).astype(np.int64) + b for x, b in zip(pdf["rids"], pdf["base"], strict=True)]
    counts = [unpacked(x) for x in pdf["counts"]]
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in ((grams, np.uint64), (rids, np.int64), (counts, np.uint64)))


def _by_class(rids: np.ndarray, groups: int) -> np.ndarray:
    """The ordering group of a class."""
    return (mixed((rids >> RUN).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _dealt(to: np.ndarray, kind: int, grams: np.ndarray, rids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Packs by ordering group, each by n-gram."""
    sort = np.lexsort((grams, to))
    to, grams, rids, counts = to[sort], grams[sort], rids[sort], counts[sort]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield _pack(int(to[a]), kind, grams[a:b], rids[a:b], counts[a:b])


def _numbered(widespread, n: int, bits: int, groups: int, orders: int):
    """All n-grams of each text, cut to `bits`, packed by counting group; widespread ones and sizes by ordering group at once."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_counts = widespread.value
        names = [x.split()[0] for x in PACK.split(", ")]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

        def rows(sets, rids):
            size = np.array([len(s) for s in sets], np.int64)
            g, r, rid = np.concatenate(sets), np.repeat(rids, size), np.asarray(rids, np.int64)
            common = np.isin(g, known) if len(known) else np.zeros(len(g), bool)
            out = list(_dealt(_by_class(rid, orders), 2, np.zeros(len(rid), np.uint64), rid, size.astype(np.uint64)))
            if common.any():
                count = known_counts[np.searchsorted(known, g[common])]
                out += _dealt(_by_class(r[common], orders), 1, g[common], r[common], count)
            g, r = g[~common], r[~common]
            sort = np.argsort(g)
            g, r = g[sort], r[sort]
            cut = np.searchsorted((g >> np.uint64(max(0, bits - 32))) * np.uint64(groups) >> np.uint64(min(32, bits)), np.arange(groups + 1, dtype=np.uint64))
            out += [_pack(k, 0, g[a:b], r[a:b], np.empty(0, np.uint64)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        held, rids, total = [], [], 0
        for batch in batches:
            rid = np.asarray(batch.column("rid"))
            for block in blocks(batch.column("text")):
                h = block.hashes()
                for k in range(len(block)):
                    s = _set_of(h[block.words[k] : block.words[k + 1]], n)
                    if len(s):
                        held.append(s >> shift)
                        rids.append(rid[block.first + k])
                        total += len(s)
                if total > BLOCK:
                    yield rows(held, rids)
                    held, rids, total = [], [], 0
        if held:
            yield rows(held, rids)
        held, rids = [], []
        released()

    return run


def _counted(orders: int):
    """Of one counting group, the n-grams that two or more classes have, packed by ordering group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, r, _ = _unpack(pdf)
        sort = np.argsort(g, kind="stable")
        g, r = g[sort], r[sort]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        n = np.diff(np.concatenate([start, [len(g)]]))
        count = np.repeat(n, n)
        keep = count > 1
        out = list(_dealt(_by_class(r[keep], orders), 1, g[keep], r[keep], count[keep].astype(np.uint64)))
        del g, r, sort, count, keep
        released()
        return pd.DataFrame(out, columns=[x.split()[0] for x in PACK.split(", ")])

    return run


def _prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one ordering group, the prefix n-grams of each class but those that it alone has."""
    _, rid, size = _unpack(pdf[pdf["kind"] == 2])
    by = np.argsort(rid)
    rid, size = rid[by], size[by].astype(np.int64)
    g, r, count = _unpack(pdf[pdf["kind"] == 1])
    sort = np.lexsort((g, count, r))
    g, r = g[sort], r[sort]
    at = np.searchsorted(rid, r)
    shared = np.bincount(at, minlength=len(rid))
    place = np.arange(len(g)) - np.searchsorted(r, r, "left")
    # N-grams of no other class come first.
    keep = place + (size - shared)[at] < prefix_length(size[at])
    return pd.DataFrame({"gram": g[keep].astype(np.int64), "rid": r[keep]})


class PrefixTree:
    """Sets in one order, commonest n-grams of the tree first, stored with common beginnings once.

    A node is a run of n-grams, its children, the sets that end in it, and bounds on the sets' lengths below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        self.grams, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(self.grams), np.int64)
        order = np.argsort(-count, kind="stable")
        rank[order] = np.arange(len(order))
        self.grams, ends = self.grams[order], np.cumsum(self.sizes)
        ranks = rank[number].astype(">u4")
        of = [np.sort(ranks[e - n : e]) for e, n in zip(ends, self.sizes, strict=True)]
        keys = sorted(range(len(sets)), key=lambda i: of[i].tobytes())
        self.nodes: list[tuple] = []
        self._fill(of, keys)

    def _fill(self, sets, keys):
        """Nodes in an order in which children come after their node; a child is named by its place."""
        left = [(keys, 0, -1)]
        while left:
            keys, depth, parent = left.pop()
            first, last = sets[keys[0]], sets[keys[-1]]
            n = min(len(first), len(last))
            # Byte order puts sets with equal beginnings side by side, so the first and last tell what all share.
            apart = np.flatnonzero(first[depth:n] != last[depth:n])
            end = depth + int(apart[0]) if len(apart) else n
            below: dict[int, list[int]] = {}
            ended = []
            for k in keys:
                if len(sets[k]) == end:
                    ended.append(k)
                else:
                    below.setdefault(int(sets[k][end]), []).append(k)
            lengths = [self.sizes[k] for k in keys]
            if parent >= 0:
                self.nodes[parent][1].append(len(self.nodes))
            own = len(self.nodes)
            self.nodes.append((first[depth:end].astype(np.int64), [], ended, end, min(lengths), max(lengths)))
            left += [(ks, end, own) for ks in below.values()]

    def linked(self, probe: np.ndarray) -> list[int]:
        """Numbers of the stored sets that are linked with the probe, which is sorted by hash."""
        size, found = len(probe), []
        at = np.minimum(np.searchsorted(probe, self.grams), size - 1)
        has = probe[at] == self.grams
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            run, children, ended, end, least, most = self.nodes[node]
            overlap += int(np.count_nonzero(has[run]))
            # The best a set of length m below can reach: all that it has left, or all that the probe has left.
            m = min(most, max(least, end + size - overlap))
            best = overlap + min(m - end, size - overlap)
            if (NUMERATOR + DENOMINATOR) * best < NUMERATOR * (size + m):
                continue
            for k in ended:
                if DENOMINATOR * overlap >= NUMERATOR * (size + self.sizes[k] - overlap):
                    found.append(k)
            stack += [(c, overlap) for c in children]
        return found


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one group of rows (probe, other, grams; other null for the probe's own set): the linked pairs."""
    out = []
    for probe, rows in pdf.groupby("probe", sort=False):
        own = rows["other"].isna().to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        mine = sets[int(np.flatnonzero(own)[0])]
        others = [(int(o), s) for o, s, x in zip(rows["other"].fillna(-1), sets, own, strict=True) if not x]
        if len(mine) and others:
            out += [(probe, others[k][0]) for k in PrefixTree([s for _, s in others]).linked(mine)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _probed(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one block of rows (class, comp, stored, grams): the linked pairs of a probe and a stored set of different components."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
    stored, ids, comps = pdf["stored"].to_numpy(bool), pdf["class"].to_numpy(), pdf["comp"].to_numpy()
    kept = np.flatnonzero(stored)
    out = []
    if len(kept):
        tree = PrefixTree([sets[k] for k in kept])
        for k in np.flatnonzero(~stored):
            out += [(ids[k], ids[j]) for j in kept[tree.linked(sets[k])] if comps[j] != comps[k]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _screened(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs that may be links by their n-grams below a quarter of the hash range and the number of those above."""
    out = []
    for probe, rows in pdf.groupby("probe", sort=False):
        own = rows["other"].isna().to_numpy()
        sets, sizes = [np.frombuffer(x, np.uint64) for x in rows["grams"]], rows["n"].to_numpy()
        k = int(np.flatnonzero(own)[0])
        mine, size = sets[k], sizes[k]
        rest = [i for i in range(len(sets)) if not own[i]]
        lengths = np.array([len(sets[i]) for i in rest], np.int64)
        both = np.concatenate([[0], np.cumsum(np.isin(np.concatenate([sets[i] for i in rest]), mine))])
        ends = np.cumsum(lengths)
        overlap = both[ends] - both[ends - lengths]
        best = overlap + np.minimum(size - len(mine), sizes[rest] - lengths)
        fit = (NUMERATOR + DENOMINATOR) * best >= NUMERATOR * (size + sizes[rest])
        out += [(probe, int(o)) for o, ok in zip(rows["other"].to_numpy()[rest], fit, strict=True) if ok]
    return pd.DataFrame(out, columns=["probe", "other"], dtype="int64")


def _sets(n: int, below: int | None = None):
    def cut(s):
        return s if below is None else s[: np.searchsorted(s, np.uint64(below))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                h = block.hashes()
                sets = [_set_of(h[block.words[k] : block.words[k + 1]], n) for k in range(len(block))]
                yield pa.RecordBatch.from_arrays([batch.column("rid")[block.first : block.first + len(block)], pa.array([len(s) for s in sets], pa.int64()), pa.array([cut(s).tobytes() for s in sets], pa.binary())], names=["rid", "n", "grams"])
        released()

    return run


class JaccardJoin:
    """The steps of the join over one table of documents."""

    def __init__(self, docs: DataFrame, n: int = N):
        self.spark, self.n = docs.sparkSession, n
        self.texts = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def _sets(self, ids: DataFrame, below: int | None = None) -> DataFrame:
        """rid, n and grams of the given rows."""
        ids = staged(ids.select("rid").distinct(), "ids")
        return staged(having_ids(self.texts, ids, "rid").select("rid", "text").mapInArrow(_sets(self.n, below), "rid long, n long, grams binary"), "sets")

    def _compared(self, pairs: DataFrame, compare, schema: str, below: int | None = None) -> DataFrame:
        """compare, applied to the sets (or their part below a hash) of distinct staged pairs, grouped by probe."""
        sets = self._sets(pairs.select(F.explode(F.array("probe", "other")).alias("rid")), below)
        size = F.octet_length("grams") / 8
        # A probe with many candidates is split; each part gets the probe's set.
        sized = staged(pairs.join(sets.select(F.col("rid").alias("other"), size.alias("held")), "other").groupBy("probe").agg(F.sum("held").alias("held")), "held")
        groups = max(1, ceil((sized.agg(F.sum("held")).first()[0] or 0) / TREE))
        parts = sized.select("probe", F.ceil(F.col("held") / TREE + F.lit(1e-9)).cast("int").alias("parts"))
        split = pairs.join(parts, "probe").withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"))
        group = F.pmod(F.xxhash64("probe", "part"), F.lit(groups)).alias("group")
        theirs = split.join(sets.withColumnRenamed("rid", "other"), "other").select(group, "probe", "other", "n", "grams")
        each = parts.select("probe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        mine = each.join(sets.withColumnRenamed("rid", "probe"), "probe").select(group, "probe", F.lit(None).cast("long").alias("other"), "n", "grams")
        return staged(theirs.unionByName(mine).groupBy("group").applyInPandas(compare, schema), "compared")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The candidate pairs (probe, other) that are links, as (a, b).

        A quarter of each set screens the pairs first: what it leaves open is bounded by the sizes of the rest.
        """
        pairs = staged(pairs.select("probe", "other").distinct(), "pairs")
        if not pairs.isEmpty():
            pairs = self._compared(pairs, _screened, "probe long, other long", 1 << 62)
        if pairs.isEmpty():
            return pairs.select(F.col("probe").alias("a"), F.col("other").alias("b"))
        return self._compared(pairs, _verified, "a long, b long")

    def probe(self, at: DataFrame) -> DataFrame:
        """Links (a, b) between components among classes that meet at one of the given n-grams; at: gram, class, size, comp.

        Classes that n-grams connect form a cluster. Its largest component and the rest are dealt into blocks of bounded
        size, and all classes outside a block's component probe it, themselves in bounded parts. Each class is stored once.
        """
        edges = at.select("gram", "class").join(at.groupBy("gram").agg(F.min("class").alias("b")), "gram").select(F.col("class").alias("a"), "b")
        cluster = connected(edges).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
        members = staged(at.select("class", "size", "comp").distinct().join(cluster, "class"), "members")
        main = members.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
        members = members.join(main, "cluster").withColumn("side", F.col("comp") != F.col("main"))
        parts = members.groupBy("cluster", "side").agg(F.ceil(F.sum("size") / PROBED).cast("int").alias("parts"))
        members = staged(members.join(parts, ["cluster", "side"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")), "members")
        sets = self._sets(members.select(F.col("class").alias("rid"))).select(F.col("rid").alias("class"), "grams")
        sides = parts.where("side").select("cluster", F.col("parts").alias("probe_parts"))
        stored = members.join(sides, "cluster").select("cluster", "side", "part", F.explode(F.sequence(F.lit(0), F.col("probe_parts") - 1)).alias("probe_part"), "class", "comp", F.lit(True).alias("stored"))
        blocks_ = parts.select("cluster", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        probes = members.where("side").select("cluster", F.col("part").alias("probe_part"), "class", "comp").join(blocks_, "cluster").select("cluster", "side", "part", "probe_part", "class", "comp", F.lit(False).alias("stored"))
        both = stored.unionByName(probes).join(sets, "class")
        return staged(both.groupBy("cluster", "side", "part", "probe_part").applyInPandas(_probed, "a long, b long"), "probed")

    def prefixes(self, classes: DataFrame, total: int) -> DataFrame:
        """(gram, rid): the prefix n-grams of each class that other classes have too, cut hashes."""
        bits = min(64, max(1, total).bit_length() + SPARE)
        groups = max(1, ceil(total / GROUP))
        orders = max(1, ceil(total / 8 / ORDERED))
        common, counts = self.widespread
        cut, number = np.unique(common >> np.uint64(64 - bits), return_inverse=True)
        known = self.spark.sparkContext.broadcast((cut, np.bincount(number, counts, len(cut)).astype(np.uint64) + np.uint64(1 << 40)))
        packs = staged(classes.select("rid", "text").mapInArrow(_numbered(known, self.n, bits, groups, orders), PACK), "packs")
        counted = packs.where("kind = 0").groupBy("g").applyInPandas(_counted(orders), PACK)
        return staged(packs.where("kind > 0").unionByName(counted).groupBy("g").applyInPandas(_prefixes, "gram long, rid long"), "prefixes")

    def pairs(self, at: DataFrame) -> DataFrame:
        """Links (a, b) between components among the classes of n-grams that at most PAIRED have; at: gram, class, size, comp."""
        # N-grams that the same classes share give the same pairs: one of them is enough.
        alike = at.groupBy("gram").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("s1"), F.sum(F.xxhash64("class", F.lit(1)) % (1 << 31)).alias("s2"))
        one = alike.groupBy("n", "s1", "s2").agg(F.min("gram").alias("gram"), F.count("*").alias("weight")).select("gram", "weight")
        own = staged(at.select("gram", "class", "size", "comp").join(one, "gram"), "mixed")
        other = own.select("gram", F.col("class").alias("x"), F.col("comp").alias("xc"), F.col("size").alias("xs"))
        pairs = own.join(other, "gram").where("class < x and comp <> xc").where(_sizes_fit("size", "xs"))
        # Linked sets share this many n-grams of both prefixes: each has at most its size less the overlap of its own.
        overlap = F.ceil(NUMERATOR * (F.col("least") + F.col("most")) / F.lit(NUMERATOR + DENOMINATOR))
        shared_n = overlap - F.ceil(NUMERATOR * F.col("most") / F.lit(DENOMINATOR)) + 1
        counted = pairs.groupBy(F.col("class").alias("probe"), F.col("x").alias("other"), F.least("size", "xs").alias("least"), F.greatest("size", "xs").alias("most")).agg(F.sum("weight").alias("n"))
        return self.verify(counted.where(F.col("n") >= shared_n))

    def run(self) -> DataFrame:
        """Per row: rid, doc_id, n_shingles, class_id (row key of its class) and component_id."""
        profile = staged(self.texts.mapInArrow(_profiles(self.n), "rid long, doc_id long, n long, f1 long, f2 long, bins array<long>"), "profiles")
        hot = profile.where("rid is null").groupBy("f1").agg(F.sum("f2").alias("c"))
        hot = hot.orderBy(F.desc("c"), "f1").limit(MOVED).select("f1", "c").toArrow()
        self.widespread = tuple(np.asarray(hot.column(k), np.int64).astype(np.uint64) for k in (0, 1))
        rows = profile.where("rid is not null")

        # 1. Classes of equal sets.
        full = rows.where("n > 0").withColumn("set", F.struct("n", "f1", "f2"))
        classes = staged(full.groupBy("set").agg(F.min("rid").alias("class"), F.min("doc_id").alias("least_id"), F.min(F.struct("rid", "bins"))["bins"].alias("bins"), F.count("*").alias("members")).select("set", "class", "least_id", "bins", "members", F.col("set.n").alias("size")), "classes")

        # 2. Contract families.
        bins = classes.select("class", "size", F.posexplode("bins").alias("bin", "least")).where("least is not null").withColumn("key", F.struct("bin", "least"))
        # Two edited copies may be less alike than each is to others, so a large family is tied to several members.
        one = F.struct(F.col("class").alias("probe"), F.col("size").alias("probe_size"))
        some = [F.min_by(one, F.xxhash64("class", F.lit(k))) for k in range(CENTRES)]
        tops = bins.groupBy("key").agg(F.min(one).alias("p"), F.array_distinct(F.array(*some)).alias("many"), F.count("*").alias("c")).where("c > 1").select("key", F.when(F.col("c") > LARGE, F.col("many")).otherwise(F.array("p")).alias("probes"))
        ties = lookup(bins, tops, "key", "inner").select("class", "size", F.explode("probes").alias("p")).select("class", "size", "p.*").where(F.col("class") != F.col("probe")).where(_sizes_fit("size", "probe_size"))
        links = self.verify(ties.select("probe", F.col("class").alias("other")))
        known = staged(_labelled(classes, connected(links)), "known")
        let_go(self.spark)

        # 3. Prefixes in the order of all counts.
        only = staged(full.select("rid").join(classes.select(F.col("class").alias("rid")), "rid", "left_anti"), "copies")
        total = classes.agg(F.sum("size")).first()[0] or 0
        prefixes = self.prefixes(having_ids(self.texts, only, "rid", "left_anti"), total)
        let_go(self.spark)

        # 4. Comparisons between components.
        at = prefixes.withColumnRenamed("rid", "class").join(known, "class")
        open_ = at.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a <> b").select("gram", "n")
        at = staged(at.join(open_, "gram"), "at")
        many = at.where(F.col("n") > PAIRED)
        more = self.pairs(at.where(F.col("n") <= PAIRED))
        let_go(self.spark)
        if not many.isEmpty():
            more = more.unionByName(self.probe(many))
        let_go(self.spark)

        # Components over all links. Only rows of classes with copies or links need looking up.
        nodes = connected(links.unionByName(more))
        linked = classes.join(nodes.withColumnRenamed("node", "class"), "class").select("class", "root", "least_id")
        least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
        comps = staged(linked.join(least, "root").select("class", "component_id"), "components")
        copied = classes.where("members > 1").select("set", "class", "least_id")
        found = lookup(full.select("rid", "doc_id", "n", "set"), copied, "set").select("rid", "doc_id", "n", F.coalesce("class", "rid").alias("class"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("least_id"))
        found = lookup(found, comps.withColumn("linked", F.lit(True)), "class").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))
        none = rows.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("rid").alias("class_id"), F.col("doc_id").alias("component_id"))
        return found.unionByName(none)


def _sizes_fit(a: str, b: str):
    return (F.least(a, b) * DENOMINATOR) >= (F.greatest(a, b) * NUMERATOR)


def _labelled(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """classes with comp, the smallest class of their component, and the component's size."""
    sizes = comps.groupBy("root").agg(F.count("*").alias("comp_size"))
    named = comps.join(sizes, "root").select(F.col("node").alias("class"), F.col("root").alias("comp"), "comp_size")
    return classes.select("class", "size").join(named, "class", "left").select("class", "size", F.coalesce("comp", "class").alias("comp"), F.coalesce("comp_size", F.lit(1)).alias("comp_size"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: rid, doc_id, n_shingles, class_id, component_id."""
    return JaccardJoin(docs).run()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the row with the smallest doc_id, and every text without words."""
    found = staged(near_duplicates(docs), "near")
    best = found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("class_id")).alias("own")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "rid")).alias("m")).select("m.rid")
    marked, key = row_keyed(docs)
    gone = staged(found.where("n_shingles > 0").select("rid").join(best, "rid", "left_anti").withColumnRenamed("rid", key), "gone")
    return having_ids(marked, gone, key, "left_anti").drop(key)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
