"""Compares a query with its SQL on the same Parquet tables."""

import glob
import os

import duckdb
import numpy as np

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connection(sf_dir=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def assert_same(spark, run, sql, sf_dir=SF):
    mine, theirs = run(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    exact = [c for c in names if mine[c].dtype.kind != "f"] or names
    order = exact + [c for c in names if c not in exact]
    a, b = (x[names].sort_values(order).reset_index(drop=True) for x in (mine, theirs))
    for c in names:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=2e-6, equal_nan=True, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
