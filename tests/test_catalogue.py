"""Every query with a SQL twin gives the twin's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from orrery.plans import catalogue

from .conftest import SF


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, pd.Timestamp):
            return str(x.date())
        if isinstance(x, (bool, str)):
            return str(x)
        try:
            return f"{float(x):.6g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted([tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()], key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(catalogue.ORACLES[name]).df())
