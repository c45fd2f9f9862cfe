"""Each query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SCREENS = {"screen_buy_1", "screen_buy_10", "screen_daily_3", "screen_daily_6", "screen_daily_20", "screen_monthly_1"}
NAMES = [n for n in registry.oracle_sql() if not n.startswith("screen_") or n in SCREENS]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or str(v) == "<NA>":
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return "null" if math.isnan(v) else repr(round(float(v) + 0.0, 6))
    return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_are_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 200
