"""Words of whole Arrow columns as numpy arrays: where they are, their 64-bit hashes, and hashes of word n-grams.

A column is worked through in blocks of about a megabyte, so a worker's memory does not grow with the batch; a longer
text is a block of its own. Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, whatever else the text holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64),) * 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, kept for blocks of usual size."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for x in (_BASE, _INVERSE):
        p = np.full(max(n, BLOCK), x, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 4 * BLOCK:
        _powers = tuple(made)
    return made[0][:n], made[1][:n]


class Block:
    """Some texts: raw and lower-cased bytes with a space after each text, and where words start and end.

    first, last: range of texts within the column; bounds: byte offsets of the texts; words: offsets into starts.
    """

    def __init__(self, first: int, bounds: np.ndarray, raw: np.ndarray, table: np.ndarray = _LOWER):
        self.first, self.bounds, self.raw = first, bounds, raw
        self.low = table[raw]
        gap = self.low == 32
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.words = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, starts=None, ends=None) -> np.ndarray:
        """64-bit hashes of the words, or of any given byte ranges."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        if not len(starts):
            return np.empty(0, np.uint64)
        if not hasattr(self, "_sums"):
            p, _ = powers(len(self.low))
            self._sums = np.zeros(len(self.low) + 1, np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * p, out=self._sums[1:])
        _, back = powers(len(self.low))
        return mixed((self._sums[ends] - self._sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def word(self, k: int) -> str:
        return self.low[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def blocks(texts: pa.Array, size: int = BLOCK, table: np.ndarray = _LOWER) -> Iterator[Block]:
    """Blocks of consecutive texts; null counts as empty. table: what each byte stands for, a space where words end."""
    if not len(texts):
        return
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = np.asarray(pc.binary_length(texts), np.int64)
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        part = texts.slice(at, end - at)
        ended = pc.binary_join_element_wise(part, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        _, where, data = ended.buffers()
        offsets = np.frombuffer(where, np.int64)[ended.offset : ended.offset + len(ended) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        yield Block(at, offsets - offsets[0], raw, table)
        at = end


_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one text's word hashes; a text of fewer words is one n-gram, one without words none."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out + h[i : len(h) - k + 1 + i] * _FACTORS[i]
    return mixed(out)


def ngram_positions(block: Block, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the full n-grams at every word of the block, and whether each lies within one text."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        out = out + h[i : len(h) - n + 1 + i] * _FACTORS[i]
    text = np.repeat(np.arange(len(block)), np.diff(block.words))
    return mixed(out), text[: len(out)] == text[n - 1 :]
