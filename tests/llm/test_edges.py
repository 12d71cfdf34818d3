"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from auditlake.llm import op01_warc, op02_decontamination, op03_exact_dedup, op04_language, op05_sharding, op06_quality, op07_toxicity, op08_jaccard_join, op09_pieces, op10_pitman_yor
from auditlake.llm.common import new_folder, staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS * 900)


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(WORDS)
    rows = [(1, text), (2, text), (2, text), (3, text + " extra"), (4, None), (5, ""), (6, LONG), (None, "alone here"), (8, "one two"), (9, "ONE  TWO"), (10, "\n\t ")]
    return staged(spark.createDataFrame([(d, t, "en" if d and d % 2 else None, "s", 0, "x", "y") for d, t in rows], SCHEMA), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return staged(spark.createDataFrame([], SCHEMA), "none")


def test_warc(spark):
    big = "é" * 40_000
    rows = [(1, "u", big), (2, "u 2", big), (3, None, None), (4, "u", ""), (None, "u", "x\r\n\r\nWARC/1.1\r\n"), (5, "u", "short"), (6, "u", "short")]
    pages = staged(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")
    folder = new_folder(spark, "warc")
    chunks = op01_warc.read_archives(spark, op01_warc.write_archives(pages, folder, chunk=1000), folder, chunk=777)
    texts = {}
    for r in chunks.orderBy("record_id", "chunk_no").collect():
        texts[r.record_id] = texts.get(r.record_id, b"") + bytes(r["data"])
        if r.record_type == "response":
            assert r.digest == hashlib.sha1(texts[r.record_id]).hexdigest() or r.record_id == ""
    assert texts["2"] == big.encode() and texts["1"] == b"" and texts["3"] == b"" and texts[""] == rows[4][2].encode()
    last = {r.record_id: r for r in chunks.where("is_last").collect()}
    assert (last["1"].record_type, last["1"].refers_to, last["1"].payload_bytes) == ("revisit", "2", len(big.encode()))
    assert last["5"].record_type == last["6"].record_type == "response"
    empty = op01_warc.write_archives(pages.where("false"), folder)
    assert empty.count() == 0 and op01_warc.read_archives(spark, empty, folder).count() == 0


def test_cut_archives_are_errors(spark):
    import gzip

    pages = staged(spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(6)], "page_id long, url string, html string").repartition(1), "pages")
    folder = new_folder(spark, "warc")
    manifest = op01_warc.write_archives(pages, folder)
    path = next(r.path for r in manifest.collect() if r.n_records > 1)
    whole = gzip.decompress(open(path, "rb").read())
    second = whole.index(b"WARC/1.1", 10)
    # At a record's end, within a header, within a payload.
    for end in (second, second + 60, second - 30):
        with open(path, "wb") as f:
            f.write(gzip.compress(whole[:end]))
        with pytest.raises(Exception, match="records were read|ends within a record"):
            op01_warc.read_archives(spark, manifest, folder).collect()


def test_ids_that_occur_twice(spark):
    pages = staged(spark.createDataFrame([(1, "u", "a" * 2000), (1, "u", "b" * 2000), (2, "u", "a" * 2000)], "page_id long, url string, html string"), "pages")
    folder = new_folder(spark, "warc")
    got = op01_warc.read_archives(spark, op01_warc.write_archives(pages, folder), folder).where("is_last").collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in got) == sorted([("1", "revisit", "2"), ("1", "response", None), ("2", "response", None)], key=str)


def test_exact(docs, none):
    got = op03_exact_dedup.exact_groups(docs).collect()
    assert len(got) == 11 and sum(r.kept for r in got) == 8
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (1, 2)} == {(2, 3)}
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (4, 5)} == {(5, 2)}
    kept = op03_exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert op03_exact_dedup.exact_groups(none).count() == 0


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", LONG, "x" * 30_000, "é\n" * 9000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all("".join(r.c).encode("latin-1").decode() == r.text for r in df.withColumn("c", op03_exact_dedup.chunks(F.col("text"))).collect())
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "is"]
    varied = " ".join("".join(parts[(i * i * 7 + i * k * 13 + k) % 9973 % 15] for k in range(1 + i * i % 997 % 4)) for i in range(9000))
    # Characters of several scripts, as text without white space has them.
    import random

    random.seed(4)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x0410, 0x044F)):
        t = "".join(chr(random.randint(low, high)) for _ in range(30_000))
        a, b = spark.createDataFrame([(t,), (chr(low) + t,)], "text string").withColumn("c", op03_exact_dedup.chunks(F.col("text"))).collect()
        assert len(set(a.c) & set(b.c)) >= 0.9 * len(a.c) > 10
    moved = spark.createDataFrame([(varied,), ("new " + varied,)], "text string").withColumn("c", op03_exact_dedup.chunks(F.col("text"))).collect()
    assert len(set(moved[0].c) & set(moved[1].c)) >= 0.9 * len(moved[0].c) > 10


def test_shards(docs, none):
    got = op05_sharding.sharded(docs, 4).collect()
    assert len(got) == 11
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert op05_sharding.sharded(none, 4).count() == 0


def needed(sizes, cap):
    n, load = 1, 0
    for s in sizes:
        n, load = (n, load + s) if load + s <= cap else (n + 1, s)
    return n


@pytest.mark.parametrize("kind", ["even", "hot", "two hot", "few"])
def test_minimax_against_brute_force(spark, monkeypatch, kind):
    import random

    rng, n = random.Random(kind), 5
    # First units of many groups each, so that units at the cuts are divided several times.
    monkeypatch.setattr(op05_sharding, "FIRST", 4)
    monkeypatch.setattr(op05_sharding, "MORE", 3)
    sizes = {rng.getrandbits(op05_sharding.BITS): rng.randint(1, 50) for _ in range(3 if kind == "few" else 400)}
    for key in sorted(sizes)[100 : 100 + {"hot": 1, "two hot": 2}.get(kind, 0)]:
        sizes[key] = 6000
    starts, capacity = op05_sharding.minimax_cuts(spark.createDataFrame(list(sizes.items()), "key long, bytes long"), n)
    in_order = [sizes[k] for k in sorted(sizes)]
    assert capacity == next(c for c in range(max(in_order), sum(in_order) + 1) if needed(in_order, c) <= n)
    loads = [0] * n
    for key, size in sizes.items():
        loads[sum(key >= s for s in starts)] += size
    assert len(starts) == n - 1 and starts == sorted(starts) and max(loads) <= capacity
    if kind == "even":
        assert max(loads) - min(loads) <= 2 * max(in_order)


def test_shards_against_a_plain_version(spark):
    import hashlib
    import zlib

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op05_sharding.op5_sharding(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    loads, slots, shard_of = [0] * 16, {}, {}
    for r in rows:
        raw, g = (r.text or "").encode(), got[r.doc_id]
        assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(raw, g.shard) == g.shard
        loads[g.shard] += g.size
        slots.setdefault(g.shard, []).append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Shards are contiguous in order of the texts' digests, and none exceeds the smallest capacity.
    order = sorted(shard_of, key=lambda raw: hashlib.sha1(raw).digest())
    assert [shard_of[raw] for raw in order] == sorted(shard_of[raw] for raw in order)
    groups = {}
    for r in rows:
        raw = (r.text or "").encode()
        groups[raw] = groups.get(raw, 0) + len(raw) + 1
    sizes = [groups[raw] for raw in order]
    assert needed(sizes, max(loads)) <= 16 and max(loads) <= next(c for c in range(max(max(sizes), sum(sizes) // 16), sum(sizes)) if needed(sizes, c) <= 16)


def test_language(docs, none):
    model = op04_language.fitted(docs)
    got = {(r.doc_id, r.lang_pred) for r in op04_language.identified(docs, model).collect()}
    assert (4, "und") in got and (5, "und") in got and (10, "und") in got and (1, "en") in got
    assert op04_language.in_known_language(docs).columns == docs.columns
    assert op04_language.identified(none, op04_language.fitted(none)).count() == 0


def test_labels(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (op06_quality.quality(docs, labels), op07_toxicity.toxicity(docs, op07_toxicity.fitted(docs, labels))):
        got = score.collect()
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert op06_quality.quality(none, labels).count() == 0
    assert op07_toxicity.toxicity(none, None).count() == 0


def test_near(docs, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in op08_jaccard_join.near_duplicates(docs).collect()}
    assert got[1, 16] == got[2, 16] == got[3, 17] == 1
    assert got[8, 1] == got[9, 1] == 8 and got[4, 0] == 4 and got[10, 0] == 10 and got[None, 1] is None
    assert op08_jaccard_join.one_of_each(docs).count() == 6
    assert op08_jaccard_join.near_duplicates(none).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op09_pieces.model_path())
    for r in op09_pieces.encoded(docs.drop("rid"), op09_pieces.model_path()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = sp.encode(r.text or "") + [sp.eos_id()]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert op09_pieces.encoded(none, op09_pieces.model_path()).count() == 0


def test_pieces_fuzz():
    import random

    import sentencepiece

    random.seed(5)
    sp = sentencepiece.SentencePieceProcessor(model_file=op09_pieces.model_path())
    table = op09_pieces.PrefixTable(op09_pieces.load_pieces(op09_pieces.model_path()))
    parts = [" ", "   ", "▁", "\n", "the", "ing", "é", "日", "𠀀", "<s>", "<0x0A>", "\0", "!!", "1", "ß", "​", "한"]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 15)))
        ids = table.encode(t)
        assert ids == sp.encode(t) + [sp.eos_id()] and table.decode(ids) == sp.decode(ids)


def test_language_model(docs, none):
    got = op10_pitman_yor.pitman_yor_scores(docs).collect()
    assert len(got) == 11 and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 10)} == {1}
    assert op10_pitman_yor.pitman_yor_scores(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "Alpha beta GAMMA, delta epsilon zeta eta; theta iota"), (2, None), (3, "nothing of this kind is in any text")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in op02_decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (6, 1)}
    edited = spark.createDataFrame([(1, "so alpha beta gamma other epsilon zeta eta theta kappa iota it is"), (2, "alpha is a letter and beta is one too")], "doc_id long, text string")
    assert [r.doc_id for r in op02_decontamination.contaminated(staged(edited, "e"), items).collect()] == [1]
    assert op02_decontamination.decontaminated(docs, items).columns == docs.columns
    assert op02_decontamination.contaminated(docs, items.where("false")).count() == 0
    assert op02_decontamination.contaminated(none, items).count() == 0
