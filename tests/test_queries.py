"""Every registered query runs, gives the same rows as its SQL, and keeps clear of plans that cannot grow."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from pressroom.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        assert compare(df, db, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "pages", "accepted", "too_short", "no_title", "listing", "rejected_urls", "words"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_without_a_title_are_counted(spark, tmp_path):
    words = " ".join(["word"] * 100)
    page = "<html><head>{}</head><body><article><p>{}</p></article></body></html>"
    kinds = [("<title>A</title>", words), ("<title> \n</title>", words), ("", words), ("", "few"), ("<title>B</title>", "few")]
    rows = [(i, f"https://www.example.org/en/{i}", page.format(*k)) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES["corpus_summary"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(df, db, SQL["corpus_summary"]) is None
    row = df.first()
    assert (row.pages, row.accepted, row.no_title, row.too_short) == (5, 1, 2, 2)


def test_scans_read_only_what_they_need(spark, small):
    plan = QUERIES["first_occurrence"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = QUERIES["error_metrics"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
