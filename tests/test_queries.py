"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "-"
        return f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted("|".join(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "quote_id", "verify_pass", "confidence", "decision", "risk"]
