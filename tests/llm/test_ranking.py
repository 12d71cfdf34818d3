"""Ranked search against SQL, with slices, bundles and terms few enough that many stages prune, and edge cases."""

import duckdb
import pandas as pd
import pytest
from compare import SF, connected, rows

from auditlake.llm import op12_ranking as R

DOCS = "doc_id long, text string, term string, score long"
ITEMS = "item_id long, text string, slice long"


def test_whole_table(spark):
    assert rows(R.op12_ranking(spark, SF).toPandas()) == rows(connected().execute(R.OP12_SQL).fetchdf())


@pytest.mark.parametrize("change", [{"SLICE_BITS": 4}, {"BUNDLE": 3}, {"WANTED": 10}, {"HELD": 100}, {"OWNERS": 1}])
def test_the_same_in_small_parts(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(R, name, value)
    assert rows(R.op12_ranking(spark, SF).toPandas()) == rows(connected().execute(R.OP12_SQL).fetchdf())


def found(spark, items, docs):
    got = R.ranked(spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS)).toPandas()
    con = duckdb.connect()
    con.register("benchmark", pd.DataFrame([x[:2] for x in items], columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}))
    con.register("documents", pd.DataFrame([x[:2] for x in docs], columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    return rows(got), rows(con.execute(R.OP12_SQL).fetchdf())


def test_edges(spark):
    docs = [(k, f"common {'rare' if k % 9 == 0 else 'other'} word {k % 4}", None, 1) for k in range(60)]
    docs += [(100, None, None, None), (101, "", "x", 0), (102, "a" * 300_000 + " rare", None, 5), (103, "Été-déjà_vu " * 3, None, 5), (104, "COMMON " * 2000, None, 5)]
    items = [(1, "Rare common common", 1), (2, None, 1), (3, " ,.; ", 1), (4, "été vu", 1), (5, "absent", 1), (6, "a" * 300_000, 1), (7, "déjà VU common", 2)]
    got, want = found(spark, items, docs)
    assert got == want
    assert {r[1] for r in got} == {1, 6, 7} | {4}


def test_repeated_rows_and_null_ids(spark):
    docs = [(5, "one two", None, None)] * 3 + [(None, "one two", None, None), (4, "one two", None, None), (9, "three", None, None)]
    got = R.ranked(spark.createDataFrame([(1, "one", 1)], ITEMS), spark.createDataFrame(docs, DOCS)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [4, 5, 5, 5, None] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize(("items", "docs"), [([], []), ([(1, "x", 1)], []), ([], [(1, "x", None, None)]), ([(1, "x", 1)], [(1, None, None, None)])])
def test_empty(spark, items, docs):
    assert R.ranked(spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS)).collect() == []
