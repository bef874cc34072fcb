"""Every query that SQL can express against DuckDB over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from lacuna import plans

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):  # noqa: ANN001, ANN202
        if pd.isna(v):
            return ""
        try:
            return f"{float(v):.6g}"
        except (TypeError, ValueError):
            return str(v).removesuffix(" 00:00:00")

    cols = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, TABLES).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    got = plans.queries()[name](spark, TABLES).toPandas()
    assert len(got) and len(got.columns) == len(set(got.columns)) and got.notna().any().any()


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
