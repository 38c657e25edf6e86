"""Queries with SQL give what DuckDB gives, value by value."""

import duckdb
import pandas as pd
import pytest

from tidegrid.llm import queries

TABLES = ("documents", "benchmark", "conversations")


def rows(df, columns):
    return sorted(tuple("" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, sf):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    ours = queries.queries()[name](spark, f"/root/testdata/{sf}").toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))
