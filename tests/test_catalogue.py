import math

import pytest

from memloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, engine, name):
    got, want = catalogue.QUERIES[name](spark, SF), engine.sql(catalogue.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points_work_without_the_training_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "memloom.llm", None)
    importlib.reload(e)
    assert set(e.queries()) == set(catalogue.QUERIES) and set(e.oracle_sql()) == set(catalogue.SQL)
    monkeypatch.undo()
    importlib.reload(e)


def test_all_term_frequencies_equal_a_count(spark, tmp_path):
    from collections import Counter

    rows = [(1, "a b a"), (2, "b"), (3, " ".join(["c"] * 25)), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["term_frequencies"](spark, str(tmp_path)).select("doc_id", "term", "tf").collect()}
    assert got == {(i, w, n) for i, t in rows for w, n in Counter(t.split()).items()}
