"""Every registered query of the library proper against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from statloom.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    return df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(SQL))
def test_rows_equal_sql(spark, sf, duck, name):
    got, want = ordered(QUERIES[name](spark, sf).toPandas()), ordered(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-3 if name in ("q_summary",) else 2e-4, rtol=1e-6)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
