"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from rastermill.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        kinds = got[c].dtype.kind, want[c].dtype.kind
        assert kinds[0] == kinds[1] or {*kinds} <= set("iuf") and got[c].isna().any(), (c, got[c].dtype, want[c].dtype)
        if kinds[1] == "f":
            assert ((got[c] - want[c]).abs().fillna(0) <= 1e-9).all() and (got[c].isna() == want[c].isna()).all(), c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["bilinear_center", "centered_at_random"])
def test_takes_all_images(spark, name):
    images = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r.image_id for r in QUERIES[name](spark, SF).select("image_id").distinct().collect()} == images
