"""Queries of row rules: renames, checks, standard rows, presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, presets, rows
from ..session import table
from .base import Book, once

BOOK = Book()
CHATML = "(SELECT DISTINCT row_id, messages, channel FROM chatml)"
ALPACA = '(SELECT DISTINCT row_id, instruction, "input", output, "system", source FROM alpaca)'


@BOOK.query('SELECT p_partkey AS id, p_name AS query, p_brand AS channel, p_size, p_retailprice FROM part')
def d01_rename_plan(spark: SparkSession, d: str) -> DataFrame:
    """P_NAME without case; two columns want `label`, so neither takes it."""
    return rows.renamed(table(spark, d, "part"), {"P_NAME": "query", "p_partkey": "id", "p_brand": "channel", "p_size": "label", "p_type": "label"}).drop("p_type")


@BOOK.query(f"SELECT row_id, concat_ws(chr(10), nullif(instruction, ''), nullif(\"input\", '')) AS prompt, output FROM {ALPACA}")
def d02_alpaca_prompt(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["instruction", "input", "output"])
    return a.select("row_id", rows.joined_prompt(F.col("instruction"), F.col("input")).alias("prompt"), "output")


@BOOK.query("SELECT doc_id, 0 AS label, lang AS answer FROM documents UNION ALL SELECT doc_id, 1, source FROM documents")
def d03_flatmap(spark: SparkSession, d: str) -> DataFrame:
    return presets.two_answers(table(spark, d, "documents"), "doc_id", F.col("lang"), F.col("source"))


@BOOK.query("""
SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) <= greatest((SELECT floor(count(*) * 0.1) FROM documents), 1) AS is_val FROM documents""")
def d04_split_exact(spark: SparkSession, d: str) -> DataFrame:
    return datasets.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 7)


@BOOK.query("""
WITH n AS (SELECT count(*) AS n FROM region), r AS (SELECT r_name, row_number() OVER (ORDER BY md5(r_name || ':1'), r_name) AS k FROM region)
SELECT r_name, c::INT AS copy FROM r, n, range(0, 100) t(c) WHERE c < 17 // n OR (c = 17 // n AND k <= 17 % n)""")
def d05_sample_repeat(spark: SparkSession, d: str) -> DataFrame:
    return datasets.sample_rows(table(spark, d, "region").select("r_name"), "r_name", 17, 1)


@BOOK.query("""
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':3'), doc_id) / CASE source WHEN 'table_dumps' THEN 0.5 WHEN 'train_logs' THEN 0.3 ELSE 0.2 END AS position
           FROM documents WHERE source IN ('table_dumps', 'train_logs', 'chat_exports'))
SELECT doc_id, source, round(position, 6) AS position FROM p WHERE position <= (SELECT min(m) FROM (SELECT max(position) AS m FROM p GROUP BY source))""")
def d06_interleave(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    mixed = datasets.interleaved(docs, "source", "doc_id", {"table_dumps": 0.5, "train_logs": 0.3, "chat_exports": 0.2}, 3)
    return mixed.select("doc_id", "source", F.round("position", 6).alias("position"))


@BOOK.query("""
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def d07_concat_ragged(spark: SparkSession, d: str) -> DataFrame:
    c = rows.renamed(table(spark, d, "customer"), {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"})
    s = rows.renamed(table(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"})
    return datasets.concatenated([c, s])


@BOOK.query(f"SELECT record_id, regexp_extract(path, '([^/]*)$', 1) AS file, CASE WHEN lower(path) LIKE '%.png' OR lower(path) LIKE '%.jpg' THEN 'image' END AS media FROM (SELECT DISTINCT record_id, path FROM examples_output) WHERE path IS NOT NULL")
def d08_path_suffix(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.messages import media_type

    e = once(spark, d, "examples_output", "record_id", ["path"]).where("path is not null")
    return e.select("record_id", F.substring_index("path", "/", -1).alias("file"), media_type(F.col("path")).alias("media"))


@BOOK.query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def d09_standard_columns(spark: SparkSession, d: str) -> DataFrame:
    docs = rows.renamed(table(spark, d, "documents"), {"text": "response", "source": "channel", "lang": "label"})
    kept = rows.standard_only(docs.withColumn("loss", F.lit(1.0)), ["doc_id"])
    return kept.where("channel is not null").groupBy(F.col("channel").alias("source")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT row_id, coalesce(len(images), 0) AS n, coalesce(array_to_string(images, '|'), '') AS paths FROM (SELECT DISTINCT row_id, images FROM multi_modal_2)")
def d10_media_cast(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "multi_modal_2", "row_id", ["images"]).withColumn("m", rows.media(F.col("images")))
    return m.select("row_id", F.coalesce(F.size("m"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.array_join(F.transform("m", lambda x: x["path"]), "|"), F.lit("")).alias("paths"))


@BOOK.query("SELECT n_nationkey, 'Task: place' || chr(10) || 'Sentence: ' || n_name || chr(10) || 'Category: zero, one, two, three, four' || chr(10) || 'Output:' AS prompt, (['zero', 'one', 'two', 'three', 'four'])[n_regionkey + 1] AS answer FROM nation")
def d11_class_prompt(spark: SparkSession, d: str) -> DataFrame:
    p, a = rows.class_prompt("place", ["zero", "one", "two", "three", "four"], F.col("n_name"), F.col("n_regionkey"))
    return table(spark, d, "nation").select("n_nationkey", p.alias("prompt"), a.alias("answer"))


@BOOK.query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_extendedprice) AS x1, least(l_discount, l_tax) AS y1, greatest(l_quantity, l_extendedprice) AS x2, greatest(l_discount, l_tax) AS y2 FROM lineitem")
def d12_ordered_box(spark: SparkSession, d: str) -> DataFrame:
    b = rows.ordered_box(F.array("l_quantity", "l_discount", "l_extendedprice", "l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.get(b, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@BOOK.query("""
WITH u AS (SELECT DISTINCT event_type FROM events), e AS (SELECT event_id, user_id, ts, event_type FROM events)
SELECT event_id, user_id, sum(CASE WHEN event_type = (SELECT min(event_type) FROM u) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e""")
def c07_sessionize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    first = e.agg(F.min("event_type").alias("m"))
    e = e.withColumn("m", F.lit(first.first()["m"]))  # one value
    return presets.sessions(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == F.col("m")).select("event_id", "user_id", "session")


@BOOK.query("""
WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS b, l_linenumber * 10 + l_quantity::INT AS e FROM lineitem),
n AS (SELECT l_orderkey, e, lead(b) OVER (PARTITION BY l_orderkey ORDER BY b, e) AS next FROM s)
SELECT l_orderkey, coalesce(bool_or(next < e), false) AS overlaps FROM n GROUP BY 1""")
def c08_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    span = F.struct((F.col("l_linenumber") * 10).alias("begin"), (F.col("l_linenumber") * 10 + F.bround("l_quantity", 0).cast("int")).alias("end"))
    return li.groupBy("l_orderkey").agg(F.collect_list(span).alias("s")).select("l_orderkey", F.coalesce(presets.overlapping(F.col("s")), F.lit(False)).alias("overlaps"))


@BOOK.query(f"SELECT row_id, CASE WHEN output LIKE '<table>%' THEN substr(output, 8) ELSE output END AS body, CASE WHEN instruction LIKE '%. %' THEN split_part(instruction, '. ', 1) ELSE instruction END AS head FROM {ALPACA}")
def d13_prefix_and_first(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["instruction", "output"])
    return a.select("row_id", presets.without_prefix(F.col("output"), "<table>").alias("body"), presets.first_of(F.col("instruction"), ". ").alias("head"))


@BOOK.query(f"SELECT source, count(*) AS n FROM {ALPACA} a WHERE EXISTS (SELECT 1 FROM examples_output e WHERE e.source = a.source AND e.html IS NOT NULL) GROUP BY 1")
def k01_exists(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["source"])
    files = table(spark, d, "examples_output").where("html is not null").select(F.col("source").alias("path"))
    return presets.existing(a, "source", files).groupBy("source").agg(F.count("*").alias("n"))


@BOOK.query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 25)")
def k02_resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return datasets.resume(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@BOOK.query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def k03_first_of_prompt(spark: SparkSession, d: str) -> DataFrame:
    return datasets.first_rows(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id")


@BOOK.query("""
WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation)
SELECT n_nationkey, n_name || ' knows ' || n_regionkey AS text, chr(65 + n_regionkey) AS letter FROM n""")
def d14_named_and_letter(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    text = F.replace(presets.named(F.lit("{{NAME}} knows {{AUTHOR}}"), "@", "#"), F.lit("@"), F.col("n_name"))
    return n.select("n_nationkey", F.replace(text, F.lit("#"), F.col("n_regionkey").cast("string")).alias("text"), presets.letter(F.col("n_regionkey")).alias("letter"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
