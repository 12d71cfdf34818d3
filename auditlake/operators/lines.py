"""Edit scripts of lines: counts, unified patches and three-way merges, for each row of a table by itself.

A line includes its newline, so a last line with one differs from the same line without. Of two texts the common end and
beginning are set aside; a longest common subsequence of the rest is found with bit vectors and halved until it is plain
which lines match, in memory that grows with the lines alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines around a change that a patch shows.
CONTEXT = 3
#: Places of a line from which its bit mask is kept.
OFTEN = 8


def lines_of(text: str | None) -> list[str]:
    parts = (text or "").split("\n")
    return [p + "\n" for p in parts[:-1]] + [p for p in parts[-1:] if p]


def _numbers(*texts: list[str]) -> list[list[int]]:
    seen: dict[str, int] = {}
    return [[seen.setdefault(x, len(seen)) for x in t] for t in texts]


def _unmatched(a: list[int], b: list[int]) -> int:
    """Bits of b's places, low first: those that a longest common subsequence of a and b's beginning up to there does not grow at."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict[int, int] = {}
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        m = masks.get(x)
        if m is None:
            m = sum(1 << j for j in at)
            if len(at) >= OFTEN:
                masks[x] = m
        u = v & m
        v = ((v + u) | (v - u)) & full
    return v


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of a and each beginning of b."""
    bits = np.frombuffer(_unmatched(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def _inner(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """The ranges without their common end and beginning."""
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        a0, b0 = a0 + 1, b0 + 1
    return a0, a1, b0, b1


def counted(old: str | None, new: str | None) -> tuple[int, int]:
    """Lines added and removed by a shortest script."""
    a, b = _numbers(lines_of(old), lines_of(new))
    a0, a1, b0, b1 = _inner(a, b, 0, len(a), 0, len(b))
    common = b1 - b0 - _unmatched(a[a0:a1], b[b0:b1]).bit_count()
    return b1 - b0 - common, a1 - a0 - common


def edits(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """The changed regions of a shortest script: lines from a0 up to a1 become those from b0 up to b1."""
    a, b = _numbers(a, b)
    gone, come = np.ones(len(a) + 1, bool), np.ones(len(b) + 1, bool)
    left = [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = outer = left.pop()
        a0, a1, b0, b1 = _inner(a, b, *outer)
        for flags, (f, l), (s, e) in ((gone, outer[:2], (a0, a1)), (come, outer[2:], (b0, b1))):
            flags[f:s] = flags[e:l] = False
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                gone[a0] = come[b.index(a[a0], b0, b1)] = False
            continue
        middle = (a0 + a1) // 2
        before, after = _growth(a[a0:middle], b[b0:b1]), _growth(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(before + after))
        left += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        i1, j1 = i, j
        while i1 < len(a) and gone[i1]:
            i1 += 1
        while j1 < len(b) and come[j1]:
            j1 += 1
        if i1 > i or j1 > j:
            out.append((i, i1, j, j1))
        i, j = i1 + 1, j1 + 1
    return out


def hunks(old: str | None, new: str | None, context: int = CONTEXT) -> str:
    """The hunks of a unified patch; empty if nothing changes."""
    a, b = lines_of(old), lines_of(new)
    groups: list[list[tuple]] = []
    for e in edits(a, b):
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []

    def put(sign: str, lines: list[str]) -> None:
        for x in lines:
            out.append(sign + x if x.endswith("\n") else f"{sign}{x}\n\\ No newline at end of file\n")

    def span(start: int, n: int) -> str:
        return f"{start + (n > 0)}" + ("" if n == 1 else f",{n}")

    for g in groups:
        a0, b0 = max(0, g[0][0] - context), max(0, g[0][2] - context)
        a1, b1 = min(len(a), g[-1][1] + context), min(len(b), g[-1][3] + context)
        out.append(f"@@ -{span(a0, a1 - a0)} +{span(b0, b1 - b0)} @@\n")
        at = a0
        for i0, i1, j0, j1 in g:
            put(" ", a[at:i0])
            put("-", a[i0:i1])
            put("+", b[j0:j1])
            at = i1
        put(" ", a[at:a1])
    return "".join(out)


def patch(path: str, old_path: str | None, old_mode: str | None, new_mode: str | None, old_oid: str | None, new_oid: str | None, old: str | None, new: str | None) -> str:
    """A file's unified patch with its header lines; an absent side has no mode."""
    before = old_path or path
    out = [f"diff --git a/{before} b/{path}\n"]
    if old_mode is None:
        out.append(f"new file mode {new_mode}\n")
    elif new_mode is None:
        out.append(f"deleted file mode {old_mode}\n")
    elif old_mode != new_mode:
        out += [f"old mode {old_mode}\n", f"new mode {new_mode}\n"]
    if before != path:
        out += [f"rename from {before}\n", f"rename to {path}\n"]
    body = hunks(old, new)
    if body:
        short = [(x or "0" * 7)[:7] for x in (old_oid, new_oid)]
        out.append(f"index {short[0]}..{short[1]}" + (f" {new_mode}\n" if old_mode == new_mode else "\n"))
        out += ["--- " + (f"a/{before}\n" if old_mode is not None else "/dev/null\n"), "+++ " + (f"b/{path}\n" if new_mode is not None else "/dev/null\n"), body]
    return "".join(out)


def merged(base: str, ours: str, theirs: str) -> str | None:
    """The text with both sides' edits; null where edited regions meet without being the same edit, or a side is binary."""
    if any("\0" in x for x in (base, ours, theirs)):
        return None
    a, b, c = lines_of(base), lines_of(ours), lines_of(theirs)
    mine = [(i0, i1, b[j0:j1]) for i0, i1, j0, j1 in edits(a, b)]
    yours = [(i0, i1, c[j0:j1]) for i0, i1, j0, j1 in edits(a, c)]
    out, at = [], 0
    while mine or yours:
        if mine and yours and mine[0] == yours[0]:
            yours.pop(0)
            e = mine.pop(0)
        elif mine and yours and mine[0][0] <= yours[0][1] and yours[0][0] <= mine[0][1]:
            return None
        else:
            e = (yours if not mine or yours and yours[0][0] < mine[0][0] else mine).pop(0)
        out += a[at : e[0]] + e[2]
        at = e[1]
    return "".join(out + a[at:])


def _by_row(rows: DataFrame, inputs: list[str], outputs: list[tuple[str, T.DataType]], f: Callable) -> DataFrame:
    """rows with further columns that f gives for the inputs of each row."""
    types = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    names = [n for n, _ in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time, so that texts are not all held as Python strings.
            for part in (batch.slice(at, 100) for at in range(0, len(batch), 100)):
                got = [f(*x) for x in zip(*[part.column(c).to_pylist() for c in inputs], strict=True)]
                more = [pa.array([g[k] for g in got], types[t]) for k, (_, t) in enumerate(outputs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in outputs]]))


def line_counts(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """pairs with additions and deletions of a shortest edit script; a null text counts as empty."""
    return _by_row(pairs, [old, new], [("additions", T.LongType()), ("deletions", T.LongType())], counted)


def patches(pairs: DataFrame) -> DataFrame:
    """pairs(path, old_path, old_mode, new_mode, old_oid, new_oid, old_text, new_text, non_text) with `patch`; null where non_text."""
    columns = ["non_text", "path", "old_path", "old_mode", "new_mode", "old_oid", "new_oid", "old_text", "new_text"]
    return _by_row(pairs, columns, [("patch", T.StringType())], lambda odd, *x: (None if odd else patch(*x),))


def merge_texts(triples: DataFrame, base: str = "base", ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """triples with `merged`, null where edited regions meet; a null base counts as empty."""
    return _by_row(triples, [base, ours, theirs], [("merged", T.StringType())], lambda b, o, t: (merged(b or "", o or "", t or ""),))
