"""The pipeline and the registered queries of the training-data operators on the smallest supplied tables."""

import duckdb
import pytest

import corpus_pipeline
from ferrograph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    wanted = con.sql(queries.oracle_sql()[name])
    order = [wanted.columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(wanted.columns)
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in wanted.fetchall())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        seen[name] = rows
        docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near", "benchmark", "mixture"]
    for before, after in zip(names, names[1:], strict=False):
        assert set(seen[after]) <= set(seen[before])
    assert all(len(t.split()) > 0 for t in seen["mixture"].values())
    assert all(len(t.split()) >= 50 for t in seen["quality"].values())


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in any column, empty tables, repeated rows and ids, and columns named as the stages' own."""
    good = " ".join(f"word{i}" for i in range(80))
    other, leak = good.replace("word", "term"), " ".join(f"item{i}" for i in range(60))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (1, "bad", "en", "s", 1), (None, other, None, None, None), (None, "bad", "en", "s", 1), (2, good, "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (None, leak, "en", "s", 1), (5, leak + " " + other, "en", None, 2)]
    rows = [(*r, i, "r", "m", i) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, row string, mark string, n_lines_removed int")
    spark.createDataFrame([(1, leak), (None, "of no id"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name, df: sorted(r["n"] for r in stages[name](spark, df, str(tmp_path)).collect())
    assert kept("quality", docs) == [0, 1, 3, 5, 8, 9]
    assert kept("lines", docs) == [0, 1, 2, 3, 4, 6, 7, 8, 9]  # document 2 is a copy, nothing is left of it
    assert kept("near", docs) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert kept("benchmark", docs) == [0, 1, 2, 3, 4, 5, 6, 7]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), str(tmp_path))
        assert out.count() == 0 and (name == "mixture" or out.columns == docs.columns)
