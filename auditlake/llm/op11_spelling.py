"""Spelling variants of a corpus by k-d trees over letter-count vectors.

One edit (a code point inserted, deleted or replaced) moves a word's letter counts by at most two in L1 distance: by two if
its length stays, by one if it changes. So words are points; those of one length are dealt into the cells of a k-d tree,
a cell into blocks of bounded size, and two blocks of equal or neighbouring lengths are compared only if their boxes are
that close. Within two blocks the same holds of the leaves of their own trees, then of single words by signatures that
never overstate the distance; what is left is verified letter by letter. Nothing that is near is lost on the way.

The trees of cells are fitted on at most SAMPLE words; they decide where a word lies, never whether it is looked at.

Defined results: null and empty texts have no words; a null doc_id counts as the empty string; repeated rows count each; other
columns are not looked at; empty tables give no rows. All code points of a word are in Latin-1, one byte each in a task. A word
as long as a text is a block of its own size. Ties among near words of one count go to the smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, staged
from auditlake.llm.kdtree import Tree, grown, leaves
from auditlake.operators.iterate import followed

#: Code points of a word and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Of so many runs one is misspelt, by the hash of its document and itself.
SPOILT = 97
#: Words that the cells of all lengths are fitted on.
SAMPLE = 65_536
#: Words of 16 letters of a cell, of which a block holds twice as many at most; longer words count for more.
CELL = 16_384
#: Words of a leaf of a block's own tree.
LEAF = 32
#: Dimensions: a to z, and the other letters by remainder. Letters that share one only bring words closer.
DIMENSIONS = 40
#: Pairs verified at once.
VERIFIED = 200_000


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough, and how often they occur."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    h, size = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    spoilt = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    found = runs.select(F.when(h % SPOILT == 0, spoilt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: pa.Array, size: int) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, size)


_SLOT = np.arange(256) % (DIMENSIONS - 26) + 26
_SLOT[ord("a") : ord("z") + 1] = np.arange(26)


def letter_counts(words: np.ndarray) -> np.ndarray:
    """The points of words given as rows of bytes."""
    out = np.zeros((len(words), DIMENSIONS), np.int32)
    for k in range(words.shape[1]):
        out[np.arange(len(words)), _SLOT[words[:, k]]] += 1
    return out


def _dealer(trees: dict[int, Tree]):
    """Adds the cell of each word; lengths without a tree have one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cell = np.asarray(batch.column("size")), np.zeros(len(batch), np.int32)
            for s in set(size.tolist()) & trees.keys():
                own = np.flatnonzero(size == s)
                cell[own] = trees[s].cells(letter_counts(_letters(batch.column("word").take(pa.array(own)), s)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def word_blocks(words: DataFrame) -> DataFrame:
    """(size, block, words, ns, low, high): words of one length and cell together, with the box around their points."""
    sized = small_batches(words).withColumn("size", F.length("word"))
    weight = F.ceil(F.greatest(F.col("size"), F.lit(16)) / 16)
    # At most one row for each CELL words, and the sample, of fixed size.
    many = {r["size"]: r["cells"] for r in sized.groupBy("size").agg(F.ceil(F.count("*") * F.any_value(weight) / CELL).alias("cells")).where("cells > 1").collect()}
    sample = sized.where(F.col("size").isin(list(many))).orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word", "size").toArrow() if many else None
    trees = {}
    for size, cells in many.items():
        own = sample.filter(pa.compute.equal(sample["size"], size))["word"].combine_chunks()
        if len(own):
            trees[size] = grown(letter_counts(_letters(own, size)), max(1, -(-len(own) // cells)))
    placed = staged(sized.mapInArrow(_dealer(trees), "word string, n long, size int, cell int"), "words")
    parts = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") * F.any_value(weight) / (2 * CELL)).cast("int").alias("parts"))
    salted = placed.join(parts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    shape = "size int, block string, words array<string>, ns array<long>, low array<int>, high array<int>"
    return staged(salted.select("size", "cell", "part", "word", "n").groupBy("size", "cell", "part").applyInArrow(_packed, shape), "blocks")


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    size, cell, part = (k.as_py() for k in key)
    table = table.sort_by("word")
    points = letter_counts(_letters(table["word"].combine_chunks(), size))
    rows = [{"size": size, "block": f"{size}-{cell}-{part}", "words": table["word"].to_pylist(), "ns": table["n"].to_pylist(), "low": points.min(0).tolist(), "high": points.max(0).tolist()}]
    return pa.Table.from_pylist(rows, pa.schema([("size", pa.int32()), ("block", pa.string()), ("words", pa.list_(pa.string())), ("ns", pa.list_(pa.int64())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of words(word, n) with near ones, how many and the most frequent of these."""
    blocks = word_blocks(words)
    box = blocks.select("size", "block", "low", "high")
    a = box.select(F.col("block").alias("a"), "low", "high", F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("size").alias("own"))
    b = box.select(F.col("block").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"), "size")
    apart = F.zip_with(F.zip_with("low", "high2", lambda x, y: F.greatest(x - y, F.lit(0))), F.zip_with("low2", "high", lambda x, y: F.greatest(x - y, F.lit(0))), lambda x, y: F.greatest(x, y))
    distance = F.aggregate(apart, F.lit(0), lambda s, x: s + x)
    grows = (F.col("own") < F.col("size")).cast("int")
    pairs = staged(a.join(b, "size").where((distance <= 2 - grows) & ((grows == 1) | (F.col("a") <= F.col("b")))).select("a", "b"), "pairs")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(pairs.where("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block")))
    met = sides.join(blocks.select("block", "size", "words", "ns"), "block").drop("block")
    found = met.groupBy("a", "b").applyInArrow(_matched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("m")).select("word", "n_near", (-F.col("m.n")).alias("best_n"), "m.best")


def _signatures(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A bit for each letter and how manieth it is, added without carry: two words differ in no more bits than in letters."""
    out, seen = np.zeros(len(words), np.uint64), np.zeros((len(words), 256), np.uint8)
    for k in range(words.shape[1]):
        at = (np.arange(len(words)), words[:, k])
        out ^= np.uint64(1) << ((bits[words[:, k]] + seen[at]) % 64).astype(np.uint64)
        seen[at] += 1
    return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, of equal length or b's by one longer, are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    size = a.shape[1]
    ahead = np.logical_and.accumulate(a == b[:, :size], 1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return ahead + behind >= size


def _candidates(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a and b (None: of a, each once) whose boxes and signatures are no farther apart than an edit."""
    most = 2 if b is None or a.shape[1] == b.shape[1] else 1
    letters = np.bincount(a.ravel(), minlength=256) + (0 if b is None else np.bincount(b.ravel(), minlength=256))
    bits = np.zeros(256, np.int64)
    bits[np.argsort(-letters, kind="stable")] = np.arange(256) * 3
    order, starts, low, high = leaves(letter_counts(a), LEAF)
    sign = _signatures(a, bits)[order]
    order2, starts2, low2, high2, sign2 = (order, starts, low, high, sign) if b is None else (*leaves(letter_counts(b), LEAF), None)
    if b is not None:
        sign2 = _signatures(b, bits)[order2]
    low, high, low2, high2 = (x.astype(np.int16) for x in (low, high, low2, high2))
    number2 = np.repeat(np.arange(len(low2)), np.diff(starts2))
    for k in range(len(low)):
        far = np.maximum(np.maximum(low2 - high[k], low[k] - high2), 0).sum(1)
        if b is None:
            far[:k] = most + 1
        at = np.flatnonzero((far <= most)[number2])
        for first in range(0, len(at), VERIFIED // LEAF):
            own = at[first : first + VERIFIED // LEAF]
            i, j = np.nonzero(np.bitwise_count(sign[starts[k] : starts[k + 1], None] ^ sign2[own]) <= most)
            i, j = i + starts[k], own[j]
            if b is None:
                i, j = i[i < j], j[i < j]
            yield order[i], order2[j]


def _matched(key: tuple, table: pa.Table) -> pa.Table:
    """Per word of two blocks (or one with itself): how many near words the other has, and which of them is the best."""
    table = table.sort_by("side")
    sides = [(table["words"][k].values, np.asarray(table["ns"][k].values), int(table["size"][k].as_py())) for k in range(len(table))]
    (a, na, size_a), (b, nb, size_b) = sides[0], sides[-1]
    one = len(sides) == 1
    x, y = _letters(a, size_a), _letters(b, size_b)
    pairs = []
    for i, j in _candidates(x, None if one else y):
        # A worker's memory does not grow with the words' length.
        step = max(1, 16 * VERIFIED // size_b)
        for k in range(0, len(i), step):
            good = _near(x[i[k : k + step]], y[j[k : k + step]])
            pairs.append((i[k : k + step][good], j[k : k + step][good]))
    i, j = (np.concatenate([p[s] for p in pairs] or [np.empty(0, np.int64)]) for s in (0, 1))
    told = [_best(i, j, nb), _best(j, i, na)] if not one else [_best(np.concatenate([i, j]), np.concatenate([j, i]), na)]
    out = []
    for (own, count, best), (mine, n, other) in zip(told, [(a, nb, b), (b, na, a)], strict=False):
        out.append(pa.table([mine.take(pa.array(own)), pa.array(count), pa.array(n[best]), other.take(pa.array(best))], names=["word", "n_near", "best_n", "best"]))
    return pa.concat_tables(out)


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row that has near ones, how many, and of these the first by n; rows of a block are in order of their words."""
    order = np.lexsort((other, -n[other], own))
    rows, first, count = np.unique(own[order], return_index=True, return_counts=True)
    return rows, count.astype(np.int64), other[order][first]


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs(doc_id, text)."""
    words = staged(corpus_words(docs), "words")
    rows = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= TIMES * F.col("n")
    told = staged(rows.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    # A form is at least twice as frequent, so chains have no circles and are short.
    ends = followed(told.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("next"))).select(F.col("node").alias("word"), "root")
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i::bigint AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
codes AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, length(run) AS size, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, size, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(concat(coalesce(doc_id::varchar, ''), ':', run), ''),
    lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::bigint] ELSE [192 + (unicode(s) >> 6)::bigint, 128 + (unicode(s) & 63)::bigint] END))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h FROM counted, codes),
spoilt AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % size), substr(run, h % size + 2)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::bigint AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, p, concat(substr(word, 1, p - 1), substr(word, p + 1)) AS less FROM words, unnest(range(1, length(word) + 1)) t(p)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.p = b.p AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n, CASE WHEN m >= 2 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = b.m) END AS form FROM words w LEFT JOIN best b ON b.word = w.word),
chains AS (SELECT word, word AS root FROM told UNION ALL SELECT c.word, t.form FROM chains c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, r.root, t.n, t.n_near, t.form_n FROM told t JOIN (SELECT c.word, c.root FROM chains c JOIN told e ON e.word = c.root WHERE e.form IS NULL) r ON r.word = t.word
"""
