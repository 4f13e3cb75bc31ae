"""Every query of the library against its DuckDB twin over the smallest test tables."""

import glob
import os

import duckdb
import pytest

from quillgraph.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df):
    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # integers that hold nulls come as floats from one side
        if got[c].dtype.kind == "f" and want[c].dtype.kind not in "fO":
            want[c] = want[c].astype(float)
    assert normal(got) == normal(want)


def test_every_signal_counts(spark, sf_dir):
    got = catalog.QUERIES["hybrid_search"](spark, sf_dir).toPandas()
    assert (got[["vector", "keyword", "graph"]].max() > 0).all()
    assert got["score"].between(0, 1.000001).all()
