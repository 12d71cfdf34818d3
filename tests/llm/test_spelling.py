"""Spelling variants against SQL and brute force, on blocks small enough that many are compared."""

import random

import pytest
from compare import SF, connected, rows

from auditlake.llm import op11_spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def found(spark, docs):
    return {r["word"]: r for r in S.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string, form string, word string")).collect()}


def test_whole_table(spark):
    got = S.op11_spelling(spark, SF).toPandas()
    assert rows(got) == rows(connected().execute(S.OP11_SQL).fetchdf())


def test_small_cells_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 32)
    monkeypatch.setattr(S, "LEAF", 4)
    rng = random.Random(3)
    words = {"".join(rng.choice("aeéntr") for _ in range(rng.choice([5, 6, 7]))): rng.randint(3, 60) for _ in range(700)}
    got = {r["word"]: r for r in S.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {}
    for w in words:
        if others := [x for x in words if near(w, x)]:
            want[w] = (len(others), *min((-words[x], x) for x in others))
    assert {w: (r["n_near"], -r["best_n"], r["best"]) for w, r in got.items()} == want


def test_edges(spark):
    long = "z" * 40_000
    docs = [(1, None, "x", "y"), (2, "", None, None), (None, "Straße " * 9, None, None), (3, "strasse " * 3 + "strase " * 3, None, None), (3, f"{long} " * 4, None, None), (5, f"{long}z " * 3 + "ab abcd 123", None, None)]
    got = found(spark, docs)
    assert set(got) == {"straße", "strasse", "strase", long, long + "z"}
    assert (got["strase"]["form"], got["strase"]["n_near"], got["strase"]["form_n"]) == ("straße", 2, 9)
    assert got["straße"]["form"] is None and got["straße"]["root"] == "straße"
    assert got[long]["n_near"] == 1 and got[long]["form"] is None


def test_chains_end_at_the_root(spark):
    docs = [(1, "abcdef " * 40 + "abcdeg " * 20 + "abcdhg " * 10 + "abcihg " * 5, None, None)]
    got = found(spark, docs)
    assert [got[w]["root"] for w in ("abcdef", "abcdeg", "abcdhg", "abcihg")] == ["abcdef"] * 4
    assert got["abcihg"]["form"] == "abcdhg"


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(1, "a b c", None, None)]])
def test_without_words(spark, docs):
    assert found(spark, docs) == {}
