"""K-d trees of points as numpy arrays: cells to deal rows into, leaves to visit or to prune by their boxes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Nodes of a tree: the dimension and value a node cuts at (dimension -1: a leaf), its children, a leaf's number."""

    dim: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf that each point falls into; points at the cut go to the lower side."""
        at = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            below = points[inner, self.dim[node]] <= self.cut[node]
            at[inner] = np.where(below, self.low[node], self.high[node])


def grown(points: np.ndarray, most: int) -> Tree:
    """A tree whose leaves have at most that many points, cut at the median of the dimension that varies most.

    Points that are all equal stay in one leaf, however many they are.
    """
    dim, cut, low, high, leaf = [], [], [], [], []
    count = 0

    def node() -> int:
        for column, value in ((dim, -1), (cut, 0.0), (low, 0), (high, 0), (leaf, 0)):
            column.append(value)
        return len(dim) - 1

    left = [(node(), np.arange(len(points)))]
    while left:
        at, rows = left.pop()
        own = points[rows]
        d = int(np.argmax(own.var(0))) if len(rows) > most else -1
        if d >= 0 and (values := own[:, d]).min() < values.max():
            middle = np.partition(values, len(values) // 2)[len(values) // 2]
            # The lower side has what is at the cut, so the cut is the largest value that leaves something above it.
            middle = middle if middle < values.max() else values[values < middle].max()
            below = values <= middle
            dim[at], cut[at], low[at], high[at] = d, middle, node(), node()
            left += [(high[at], rows[~below]), (low[at], rows[below])]
        else:
            leaf[at] = count
            count += 1
    return Tree(np.array(dim), np.array(cut), np.array(low), np.array(high), np.array(leaf))


def leaves(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points in order of their leaves: the order, where each leaf starts (and the end), and the leaves' boxes."""
    cell = grown(points, most).cells(points)
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    low, high = np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)
    return order, np.append(starts, len(points)), low, high
