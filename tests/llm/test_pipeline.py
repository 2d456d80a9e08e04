import inspect

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_whole_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "secret_scan", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert after.count() <= before.count()
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((key(r) for r in got.select(*cols).collect())) == sorted(key(r) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_stages_take_odd_rows_and_an_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "plain text", "en", "a", 10), (1, "plain text", "en", "a", 10), (2, None, None, None, None), (None, "no id", "en", "a", 5), (3, "", "en", None, 0), (4, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (6, 'token = "abcdef12"', "en", "b", 18)]
    df = spark.createDataFrame([(*r, 7, "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rep long, block string, score double")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF).cache()
            assert after.dtypes == df.dtypes, name
            docs = after
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        ids = {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in packed.collect()} == ids
        assert ids in ({1, 2, None, 3, 4, 6}, set())
    assert [r.text for r in corpus_pipeline.redact_secrets(spark, df.where("doc_id = 6"), SF).collect()] == ["[SECRET:assign]\""]


def test_sequences_follow_the_mix_over_files_of_unlike_size(spark, tmp_path):
    def text(i):  # each fills a sequence or more; later files are far larger
        return " ".join(f"w{(i * 7919 + j) % 9973}" for j in range(600 * (1 + i // 25 * 3)))

    docs = spark.createDataFrame([(i, text(i)) for i in range(100)], "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    docs.repartitionById(4, F.floor(F.col("doc_id") / 25).cast("int")).sortWithinPartitions("doc_id").write.parquet(path := str(tmp_path / "mixed"))
    assert len(spark.read.parquet(path).inputFiles()) == 4
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(path), SF)
    first = packed.where("start = 0 AND length = 1024").orderBy("sequence_id").collect()
    assert [r.doc_id for r in first] == list(range(100))
