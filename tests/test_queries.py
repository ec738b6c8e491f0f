"""Every registered query of the reference's operators against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from textloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(df):
    def cell(v):
        if v is None or v != v if not hasattr(v, "__len__") else False:
            return "null"
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        if hasattr(v, "__len__"):
            return str(list(v))
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    import pandas as pd

    rows = [tuple(cell(None if x is pd.NA else x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(df.columns), sorted(rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        assert plain(got) == plain(duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got.columns)
