"""Every query beside its SQL on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from fieldloom.plans import card_queries, queries, source_queries  # noqa: F401  they register
from fieldloom.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    empty = lambda v: v is None or v is pd.NA or isinstance(v, float) and v != v
    cell = lambda v: None if empty(v) else f"{v:.6f}" if isinstance(v, float) and v % 1 else str(int(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool | np.bool_ | np.integer) else str(list(v)) if isinstance(v, np.ndarray) else str(v)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
