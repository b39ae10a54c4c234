"""The p-queries over empty tables, over rows of nulls, and over the smallest tables."""

import os

import pytest

from quillgrid.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/documents.parquet"), reason="no tables")
NAMES = ["examples_output", "alpaca", "chatml", "multi_modal_2", "documents"]
COLUMNS = {
    "p1_found": ["record_id", "field"], "p3_found": ["row_id_a", "row_id_b"], "p4_found": ["record_id"], "p5_found": ["table_name", "row_id", "defect"], "p6_ids": ["doc_id", "ids"],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    for n in NAMES:
        df = spark.read.parquet(f"{FOLDER}/{n}.parquet")
        df.limit(0).write.parquet(f"{base}/none/{n}.parquet")
        key = df.columns[0] if n != "documents" else "doc_id"
        spark.createDataFrame([tuple(7 if c == key else None for c in df.columns), tuple(None for _ in df.columns)], df.schema).write.parquet(f"{base}/nulls/{n}.parquet")
    for n in ("mix_targets", "size_limits"):
        for d in ("none", "nulls"):
            spark.read.parquet(f"{FOLDER}/{n}.parquet").write.parquet(f"{base}/{d}/{n}.parquet")
    return base


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, folders, name):
    got = QUERIES[name](spark, f"{folders}/none")
    assert got.count() == {"p2_report": 3, "p7_shares": 9, "p7_enlarged": 9, "p7_tempered": 9}.get(name, 0)
    assert got.columns == COLUMNS.get(name, got.columns)


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_of_nulls(spark, folders, name):
    got = QUERIES[name](spark, f"{folders}/nulls").collect()
    if name == "p6_ids":
        assert sorted(((r["doc_id"] is None, list(r["ids"])) for r in got)) == [(False, []), (True, [])]
    elif name == "p5_found":
        assert {(r["table_name"], r["row_id"], r["defect"]) for r in got} == {(t, k, "empty") for t in ("alpaca", "multi_modal_2") for k in (7, None)}
    else:
        assert len(got) == {"p2_report": 3, "p7_shares": 9, "p7_enlarged": 9, "p7_tempered": 9, "p4_shares": 2, "p4_scores": 2}.get(name, 0)


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{FOLDER}/{n}.parquet')")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, FOLDER).select(*want.columns).collect()
    plain = lambda rows: sorted(repr([round(v, 8) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got) == plain(want.fetchall())


def test_keys_once(spark):
    for name, keys in {"p1_found": ["record_id", "field"], "p3_found": ["row_id_a", "row_id_b"], "p4_shares": ["record_id"], "p5_found": ["table_name", "row_id"], "p7_mixture": ["doc_id"], "p2_packing": ["limit_name", "table_name", "row_id", "part", "piece"]}.items():
        got = QUERIES[name](spark, FOLDER)
        assert got.count() == got.select(*keys).distinct().count() > 0


def test_groups_hold_every_row(spark):
    rows = spark.read.parquet(f"{FOLDER}/alpaca.parquet").where("instruction is not null or output is not null").select("row_id").distinct().collect()
    got = QUERIES["p3_groups"](spark, FOLDER).collect()
    assert sorted(r["row_id"] for r in got) == sorted(r["row_id"] for r in rows)
    sizes = {}
    for r in got:
        sizes[r["group_id"]] = sizes.get(r["group_id"], 0) + 1
    assert all(r["group_size"] == sizes[r["group_id"]] and (r["n_links"] == 0) == (r["group_size"] == 1) for r in got)
