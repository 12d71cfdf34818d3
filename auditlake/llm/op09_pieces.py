"""Encoding and decoding with a SentencePiece BPE model through a table of last tokens.

Byte-pair merging of a text ends in tokens of which every two neighbours are compatible: merging their joined text gives
just the two again. So each prefix of a text has exactly one possible last token: a piece that an automaton finds to end
there and that is compatible with the last token of the prefix before it. One pass forwards fills this table, and one
pass backwards from the end reads off the ids. Whether two pieces are compatible is found by merging once and kept.

Texts are first split where no piece of the model can lie across: between two characters that are neighbours in no piece,
where all that are not ASCII count as one. The segments repeat, so a column's are numbered, each distinct one is looked up
once, and a worker keeps those it has seen, in a bounded store. New ones are taken in order: what the automaton and the table say of a prefix holds for every segment that
begins with it, so only the characters after the prefix shared with the segment before are looked at.

Defined results: null and empty texts have the end id alone and decode to the empty string. Characters without a piece
become their UTF-8 bytes' pieces. Repeated rows are each encoded; other columns are not looked at. The model's file is
a parameter; its pieces go to the executors as one broadcast value of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import released, small_batches

#: Distinct segments a worker keeps: those of late, and as many from before that.
KEPT = 40_000
#: Pairs of pieces of which a worker keeps whether they are compatible.
PAIRS = 250_000
#: Bytes of the texts worked on at once; a longer text is taken alone.
BYTES = 1_500_000
#: Segments of a block beyond which Arrow's 32-bit offsets may not do.
MANY = 1 << 26
MARK = "▁"


class Pieces(NamedTuple):
    """What a model holds: the text, score and id of each mergeable piece, the ids of the 256 bytes, the end id."""

    texts: list[str]
    scores: list[float]
    ids: list[int]
    bytes_: list[int]
    end: int


def load_pieces(model_file: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = range(sp.get_piece_size())
    plain = [i for i in n if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces([sp.id_to_piece(i) for i in plain], [sp.get_score(i) for i in plain], plain, byte, sp.eos_id())


class Automaton:
    """Finds all pieces that end at each place of a text; its state after a prefix can be kept and gone on from."""

    def __init__(self, texts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ending: list[tuple] = [()]
        for k, t in enumerate(texts):
            at = 0
            for c in t:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ending.append(())
                at = to
            self.ending[at] = ((k, len(t)),)
        self.shorter = [0] * len(self.next)
        left = deque(self.next[0].values())
        while left:
            at = left.popleft()
            for c, to in self.next[at].items():
                self.shorter[to] = self.step(self.shorter[at], c)
                self.ending[to] += self.ending[self.shorter[to]]
                left.append(to)

    def step(self, state: int, c: str) -> int:
        to = self.next[state].get(c)
        while to is None and state:
            state = self.shorter[state]
            to = self.next[state].get(c)
        return to or 0


class PrefixTable:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: Pieces):
        self.texts, self.ids, self.bytes_, self.end = pieces.texts, pieces.ids, pieces.bytes_, pieces.end
        self.size = [len(t) for t in self.texts]
        self.written = [str(i) for i in self.ids]
        self.rank = dict(zip(self.texts, pieces.scores, strict=True))
        self.number = {t: k for k, t in enumerate(self.texts)}
        self.found = Automaton(self.texts)
        self.pairs: dict[int, bool] = {}
        self.text_of = {i: t for t, i in zip(self.texts, self.ids, strict=True)}
        self.byte_of = {i: b for b, i in enumerate(self.bytes_)}
        # Whether bytes of two classes may be neighbours within a piece; class 128 is any character beyond ASCII.
        self.together = np.zeros((129, 129), bool)
        self.together[128, 128] = True
        for t in self.texts:
            c = [min(ord(x), 128) for x in t.replace(MARK, " ")]
            self.together[c[:-1], c[1:]] = True

    def merged(self, text: str) -> list[str]:
        """Merges of neighbours, best score first and then leftmost, until none is a piece."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b can follow a, or, with a = -1, stand at the beginning."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        parts = [self.texts[k] for k in (a, b) if k >= 0]
        self.pairs[(a + 1) * len(self.texts) + b] = ok = self.merged("".join(parts)) == parts
        return ok

    def last_tokens(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Of each of some words, best in order: the last token of every prefix; -1 for the empty one, -2 where there is none."""
        step, ending, pairs, many = self.found.step, self.found.ending, self.pairs, len(self.texts)
        before, last, states = "", [-1], [0]
        for word in words:
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del last[k + 1 :], states[k + 1 :]
            state = states[k]
            for at in range(k, len(word)):
                state = step(state, word[at])
                states.append(state)
                own = -2
                for t, size in ending[state]:
                    p = last[at + 1 - size]
                    if p > -2:
                        ok = pairs.get((p + 1) * many + t)
                        if self.compatible(p, t) if ok is None else ok:
                            own = t
                            break
                last.append(own)
            before = word
            yield word, last

    def tokens_with_strangers(self, word: str) -> list[str]:
        """The tokens of a segment with characters that are no piece; each is a token of its own, of which nothing is known beforehand."""
        last: list[str | None] = [""]
        state = 0
        for end in range(1, len(word) + 1):
            state = self.found.step(state, word[end - 1])
            last.append(None)
            for t in [*(self.texts[k] for k, _ in self.found.ending[state]), word[end - 1]]:
                before = last[end - len(t)]
                if before is not None and self.merged(before + t) == ([before, t] if before else [t]):
                    last[end] = t
                    break
        out, at = [], len(word)
        while at:
            t = last[at]
            out.append(t)
            at -= len(t)
        return out[::-1]

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's segments begin among all, and the segments as bytes, marks as spaces; null counts as empty."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        texts = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " ").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
        _, where, data = texts.buffers()
        bounds = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if bounds[0] == bounds[-1]:
            return np.zeros(len(bounds), np.int64), pa.array([], pa.large_binary())
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind = np.minimum(raw, 128)
        begins = np.ones(len(raw) + 1, bool)
        begins[1:-1] = ~self.together[kind[:-1], kind[1:]]
        begins[bounds] = True
        offsets = np.flatnonzero(begins)
        flat = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        return np.searchsorted(offsets, bounds), flat

    def encoded(self, segments: list[str]) -> Iterator[tuple[str, tuple[str, int, str]]]:
        """Of each of some segments: its ids as text, their number and the decoded text."""
        size, written = self.size, self.written
        for word, last in self.last_tokens(sorted(segments)):
            out, at = [], len(word)
            if last[at] == -2:
                ids = []
                for t in self.tokens_with_strangers(word):
                    k = self.number.get(t)
                    ids += [self.ids[k]] if k is not None else [self.bytes_[b] for b in t.encode()]
                yield word, (" ".join(map(str, ids)), len(ids), self.text_of_ids(ids))
                continue
            while at:
                t = last[at]
                out.append(written[t])
                at -= size[t]
            yield word, (" ".join(out[::-1]), len(out), word.replace(MARK, " "))

    def encode(self, text: str) -> list[int]:
        segments = [x.decode().replace(" ", MARK) for x in self.segments(pa.array([text]))[1].to_pylist()]
        known = dict(self.encoded(list(set(segments))))
        return [int(i) for s in segments for i in known[s][0].split(" ")] + [self.end]

    def text_of_ids(self, ids: list[int]) -> str:
        """Pieces joined, with runs of byte pieces as UTF-8 and marks as spaces; the space before the text is still there."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text_of.get(i, ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.text_of_ids(ids).removeprefix(" ")


class _Seen:
    """What is known of segments, those of late and those from before."""

    def __init__(self, table: PrefixTable):
        self.table, self.late, self.before = table, {}, {}

    def of(self, segments: list[str]) -> list[tuple[str, int, str]]:
        """For each of some distinct segments: its ids as text, their number and the decoded text."""
        if len(self.late) > KEPT:
            self.late, self.before = {}, self.late
        late, before, new = self.late, self.before, []
        for s in segments:
            if s not in late:
                if s in before:
                    late[s] = before[s]
                else:
                    new.append(s)
        late.update(self.table.encoded(new))
        return [late[s] for s in segments]


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def _joined(bounds: np.ndarray, values: list[str], at: pa.Array, by: str) -> list[str]:
    """Of each text, its segments' values in one string."""
    if len(at) > MANY:
        return [by.join([values[k] for k in at[a:b].to_pylist()]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.string()).take(at)), by).to_pylist()


def _digests(pieces, keep: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(PrefixTable(pieces.value))
        table, end = seen.table, str(seen.table.end)
        for batch in batches:
            first = 0
            for texts in _parts(batch.column("text")):
                bounds, flat = table.segments(texts)
                number = flat.dictionary_encode()
                known = seen.of([x.decode().replace(" ", MARK) for x in number.dictionary.to_pylist()])
                at = number.indices
                sizes = np.concatenate([[0], np.cumsum(np.array([x[1] for x in known], np.int64)[np.asarray(at)])])
                ids = [f"{x} {end}" if x else end for x in _joined(bounds, [x[0] for x in known], at, " ")]
                decoded = _joined(bounds, [x[2] for x in known], at, "")
                own = {
                    "n_tokens": pa.array(np.diff(sizes[bounds]) + 1),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.removeprefix(" ").encode()).hexdigest() for x in decoded], pa.string()),
                }
                if with_ids:
                    own["ids"] = pa.array([[int(i) for i in x.split(" ")] for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(first, len(texts)) for c in keep} | own)
                first += len(texts)
        del seen, table
        released()

    return run


def encoded(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; the end id counts."""
    spark = small_batches(docs).sparkSession
    pieces = spark.sparkContext.broadcast(load_pieces(model_file))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digests(pieces, ["doc_id"], with_ids), schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), with_ids=False)
