"""Registered queries against DuckDB running their SQL on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from marginalia import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    shown = lambda v: "" if pd.isna(v) else str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    ours = queries.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
