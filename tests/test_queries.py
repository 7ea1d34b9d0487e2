"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from spindrift.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("needs the tables")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].dt.strftime("%Y-%m-%d %H:%M:%S")
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v != v else f"{v:.10g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.SQL:
        pd.testing.assert_frame_equal(rows(got), rows(duck.execute(registry.SQL[name]).df()), check_dtype=False)
    else:
        assert len(got) > 0
