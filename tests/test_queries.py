"""Every metric query that has SQL gives what DuckDB gives; the rest of the library stands without llm."""

import pathlib
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tidegrid.plans import metric_queries, source_queries

QUERIES = metric_queries.QUERIES | source_queries.QUERIES
ORACLES = metric_queries.ORACLES | source_queries.ORACLES

SMALL = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_strides_keep_all_events(spark):
    q = metric_queries.QUERIES
    total = lambda name: sum(r["v"] for r in q[name](spark, SMALL).collect())
    assert total("hist_count_stride") == total("hist_count")


def test_whole_queries_read_rows_outside_the_ranges(spark):
    q, m = metric_queries.QUERIES, metric_queries
    times = {r["t"] for r in q["agg_sum_rate_whole"](spark, SMALL).collect()}
    assert min(times) < m.START and max(times) > m.END
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    first = orders.groupBy("o_orderpriority").agg({"o_orderdate": "min"}).withColumnRenamed("min(o_orderdate)", "o_orderdate")
    after = orders.count() - orders.join(first, ["o_orderpriority", "o_orderdate"]).count()
    assert sum(r["v"] for r in q["hist_count_whole"](spark, SMALL).collect()) == after


def test_heatmap_counts_are_those_of_the_histogram(spark):
    q = metric_queries.QUERIES
    by_t = {}
    for r in q["hist_heatmap"](spark, SMALL).collect():
        by_t[r["t"]] = by_t.get(r["t"], 0) + r["cnt"]
    assert by_t == {r["t"]: r["v"] for r in q["hist_count"](spark, SMALL).collect()}


def test_nothing_else_imports_llm():
    for p in (ROOT / "tidegrid").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p


def test_entry_without_llm(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'counter_rate_grid' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
