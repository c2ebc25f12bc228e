import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from wayline.plans.scale_queries import QUERIES, SQL


def rows(frame, columns):
    shown = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v.tolist() if hasattr(v, "tolist") else v)
    return Counter(tuple(map(shown, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_dense_grid_sums_every_event(spark, sf, duck):
    got = QUERIES["pivot_dense_all"](spark, sf).toPandas()
    total, users, days = duck.sql("select sum(value), count(distinct user_id), count(distinct ts::date) from events").fetchall()[0]
    assert got.amount.sum() == pytest.approx(total) and len(got) == users * days
    assert (got.amount == 0).any()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
