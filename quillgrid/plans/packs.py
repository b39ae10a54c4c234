"""Queries of truncation, packing, batching, streams and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, messages, packs
from ..session import shared_dir, table
from ..sources import files
from ..streaming import stateful
from .base import Book

BOOK = Book()


@BOOK.query("""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 1 THEN 7 ELSE (round(x * 10))::INT END) AS ids FROM embeddings),
f AS (SELECT vec_id, i, ids[i] AS t, sum(CASE WHEN ids[i] = 7 THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY i) AS k, sum(CASE WHEN ids[i] = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, ids, unnest(range(1, 65)) AS i FROM c))
SELECT vec_id, string_agg(t, ',' ORDER BY i) AS ids FROM f WHERE t = 7 OR k <= 40 - p GROUP BY 1""")
def s03_truncate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from embeddings, cut to 40 with id 7 protected."""
    ids = F.transform("embedding", lambda x: F.when(x > 1, 7).otherwise(F.round(x * 10).cast("int")))
    e = table(spark, d, "embeddings").withColumn("ids", ids)
    return e.select("vec_id", F.array_join(messages.truncated_ids(F.col("ids"), 40, [7]).cast("array<string>"), ",").alias("ids"))


@BOOK.query("""
SELECT l_orderkey, string_agg(array_to_string(range(l_linenumber), ','), ',' ORDER BY l_linenumber) AS positions, sum(l_linenumber)::BIGINT AS length, count(*) AS n_rows FROM lineitem GROUP BY 1""")
def s04_pack_row(spark: SparkSession, d: str) -> DataFrame:
    """Line k of an order as k ids; an order as one pack."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_repeat("l_partkey", F.col("l_linenumber")).alias("ids"))
    p = packs.merged_pack(li, ["l_orderkey"], "l_linenumber", "ids")
    bounds = packs.pack_bounds(F.col("positions"))
    return p.select("l_orderkey", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), F.col("length").cast("bigint").alias("length"), (F.size(bounds) - 1).cast("bigint").alias("n_rows"))


@BOOK.query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (rn - 1) // 64 AS batch, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM r""")
def s05_batches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    n = o.count()
    b = packs.batches(o, ["o_orderkey"], 64)
    return b.select("o_orderkey", F.col("batch").cast("bigint").alias("batch"), packs.minibatch(F.col("rn"), F.lit(n), 7).alias("part"))


@BOOK.query("SELECT n_nationkey, p::INT AS pass, c::INT AS copy FROM nation, range(2) t(p), range(3) u(c)")
def s06_repeat(spark: SparkSession, d: str) -> DataFrame:
    return packs.repeated(table(spark, d, "nation").select("n_nationkey"), 3, 2)


@BOOK.query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () // 4 AS size FROM orders) SELECT o_orderkey FROM r WHERE rn > size AND rn <= 2 * size")
def s07_shard(spark: SparkSession, d: str) -> DataFrame:
    return datasets.shard(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 4, 1)


@BOOK.query()
def s08_chunked_packs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("int").alias("length"))
    return packs.chunked_packs(docs, "doc_id", "length", 8000)


@BOOK.query()
def w01_stream_pack(spark: SparkSession, d: str) -> DataFrame:
    """Events as a file stream, packed by user with the open bin carried over."""
    base = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    table(spark, d, "events").write.parquet(f"{base}/in")
    rows = stateful.file_stream(spark, f"{base}/in", schema).select(F.pmod("user_id", F.lit(64)).alias("shard"), "event_id", (F.pmod("event_id", F.lit(90)) + 1).cast("int").alias("length"))
    stateful.run_once(stateful.packed_stream(rows, "shard", "event_id", "length", 100), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@BOOK.query("SELECT event_id, user_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM events")
def w02_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    events.write.parquet(f"{base}/in")
    rows = stateful.file_stream(spark, f"{base}/in", events.schema).select("user_id", "event_id", (F.col("event_type") == "signup").alias("starts"))
    stateful.run_once(stateful.session_stream(rows, "user_id", "event_id", "starts"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "session")


@BOOK.query("SELECT p_partkey, p_name, p_brand FROM part")
def s01_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as JSON lines and CSV, read by ending and joined again."""
    base = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    p = table(spark, d, "part")
    files.write_json_lines(p.select("p_partkey", "p_name"), f"{base}/a.jsonl")
    p.select("p_partkey", "p_brand").write.csv(f"{base}/b.csv", header=True)
    a, b = files.read_path(spark, f"{base}/a.jsonl"), files.read_path(spark, f"{base}/b.csv")
    return a.join(b.withColumn("p_partkey", F.col("p_partkey").cast("bigint")), "p_partkey").select("p_partkey", "p_name", "p_brand")


@BOOK.query("SELECT n_nationkey, n_name FROM nation")
def s02_resumed_sink(spark: SparkSession, d: str) -> DataFrame:
    """Appended twice, each key once."""
    path = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    files.append_missing(n.where("n_nationkey < 10"), path, "n_nationkey")
    files.append_missing(n, path, "n_nationkey")
    return spark.read.parquet(path)


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
