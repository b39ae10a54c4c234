"""Every core query against its SQL in DuckDB over the smallest tables, where these exist."""

import math
import os

import pytest

from quillgrid.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings examples_output alpaca chatml multi_modal_2 rewards mix_targets size_limits".split()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/region.parquet"), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(df):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (str, bool)) else round(float(v), 5) + 0.0 if hasattr(v, "__float__") else str(v)

    df = df[sorted(df.columns)]
    return sorted((repr(tuple(map(plain, r))) for r in df.itertuples(index=False)))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
