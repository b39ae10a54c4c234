"""Queries of message operators over the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, messages, rows
from ..session import table
from .base import Book, once

BOOK = Book()
CHATML = "(SELECT DISTINCT row_id, messages FROM chatml)"
MULTI = "(SELECT DISTINCT row_id, query, response, images, history FROM multi_modal_2)"


def _chatml(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "chatml", "row_id", ["messages"])


@BOOK.query(f"""
SELECT row_id, coalesce(len(messages) > 0 AND len(list_filter(messages, lambda m: m.content IS NULL OR m.role NOT IN ('system', 'user', 'tool_call', 'tool_response', 'tool', 'assistant'))) = 0, false) AS valid FROM {CHATML}""")
def c06_check_messages(spark: SparkSession, d: str) -> DataFrame:
    return _chatml(spark, d).select("row_id", rows.valid_messages(F.col("messages")).alias("valid"))


@BOOK.query(f"""
SELECT row_id, CASE WHEN messages[-1].role = 'assistant' THEN messages[-1].content END AS reply, len(messages) - CASE WHEN messages[-1].role = 'assistant' THEN 1 ELSE 0 END AS n_left FROM {CHATML} WHERE len(messages) > 0""")
def c03_pop_label(spark: SparkSession, d: str) -> DataFrame:
    kept, reply = rows.popped_reply(F.col("messages"))
    return _chatml(spark, d).where("size(messages) > 0").select("row_id", reply.alias("reply"), F.size(kept).cast("bigint").alias("n_left"))


@BOOK.query(f"""
WITH m AS (SELECT row_id, unnest(range(1, len(messages) + 1)) AS i, messages FROM {CHATML} WHERE len(messages) > 0)
SELECT row_id, string_agg(upper(messages[i].role[1]) || messages[i].role[2:] || ': ' || messages[i].content, chr(10) ORDER BY i) AS lines FROM m WHERE messages[i].content <> '' GROUP BY 1""")
def c05_role_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = messages.role_lines(F.col("messages"))
    return _chatml(spark, d).where("size(messages) > 0").select("row_id", lines.alias("lines")).where("lines <> ''")


@BOOK.query(f"""
WITH m AS (SELECT row_id, i, messages[i].role AS role, messages[i].content AS content FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM {CHATML} WHERE len(messages) > 0)),
g AS (SELECT *, CASE WHEN role IN ('user', 'assistant') AND lag(role) OVER (PARTITION BY row_id ORDER BY i) = role THEN 0 ELSE 1 END AS new FROM m),
k AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY i) AS run FROM g)
SELECT row_id, run::BIGINT AS run, min(role) AS role, CASE WHEN count(*) = 1 THEN min(content) ELSE string_agg(coalesce(content, ''), chr(10) ORDER BY i) END AS content FROM k GROUP BY row_id, run""")
def c02_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    m = _chatml(spark, d).where("size(messages) > 0").select("row_id", F.posexplode(messages.merged_runs(F.col("messages"))).alias("k", "m"))
    return m.select("row_id", (F.col("k") + 1).cast("bigint").alias("run"), "m.role", "m.content")


@BOOK.query(f"""
WITH m AS (SELECT row_id, messages, unnest(range(1, len(messages) + 1, 2)) AS i FROM {CHATML} WHERE len(messages) > 0)
SELECT row_id, ((i + 1) // 2)::BIGINT AS pair, messages[i].content AS query, messages[i + 1].content AS response FROM m""")
def c04_history_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _chatml(spark, d).select("row_id", F.posexplode(messages.pairs_of(F.col("messages"))).alias("k", "p"))
    return p.select("row_id", (F.col("k") + 1).cast("bigint").alias("pair"), F.get("p", F.lit(0)).alias("query"), F.get("p", F.lit(1)).alias("response"))


@BOOK.query("""
WITH a AS (SELECT DISTINCT row_id, instruction, output, "system" AS s, history FROM alpaca),
h AS (SELECT row_id, 2 * i AS k, history[i] AS p FROM (SELECT row_id, history, unnest(range(1, len(history) + 1)) AS i FROM a WHERE len(history) > 0)),
parts AS (SELECT row_id, 0 AS k, 'system' AS role, s AS content FROM a WHERE s <> ''
 UNION ALL SELECT row_id, k, 'user', p[1] FROM h UNION ALL SELECT row_id, k + 1, 'assistant', p[2] FROM h
 UNION ALL SELECT row_id, 1000000, 'user', instruction FROM a UNION ALL SELECT row_id, 1000001, 'assistant', output FROM a)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY k) AS turn, role, content FROM parts WHERE content IS NOT NULL""")
def c01_messages(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["instruction", "output", "system", "history"])
    m = a.select("row_id", F.posexplode(rows.response_messages(F.col("system"), F.col("history"), F.col("instruction"), F.col("output"))).alias("k", "m"))
    return m.select("row_id", (F.col("k") + 1).cast("bigint").alias("turn"), "m.role", "m.content")


@BOOK.query(f"""
SELECT row_id, repeat('<image>', greatest(coalesce(len(images), 0) - (length(query) - length(replace(query, '<image>', ''))) // 7, 0)::BIGINT) || query AS query FROM {MULTI} WHERE query IS NOT NULL""")
def c09_default_tags(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "multi_modal_2", "row_id", ["query", "images"]).where("query is not null")
    return m.select("row_id", messages.with_default_tags(F.col("query"), F.coalesce(F.size("images"), F.lit(0))).alias("query"))


@BOOK.query(f"""
WITH m AS (SELECT row_id, messages, messages[1].role AS f, messages[-1].role AS l FROM {CHATML} WHERE len(messages) > 0)
SELECT row_id, len(messages) + CASE WHEN f = 'assistant' THEN 1 ELSE 0 END + CASE WHEN l = 'user' THEN 1 ELSE 0 END AS n, CASE WHEN l = 'user' THEN 'assistant' ELSE l END AS last FROM m""")
def c10_alternating(spark: SparkSession, d: str) -> DataFrame:
    m = _chatml(spark, d).where("size(messages) > 0").withColumn("a", messages.alternating(F.col("messages")))
    return m.select("row_id", F.size("a").cast("bigint").alias("n"), F.element_at("a", -1)["role"].alias("last"))


@BOOK.query("""
SELECT row_id, p.i::BIGINT AS part, p.key AS key, p.content AS content FROM (
  SELECT row_id, unnest(list_transform(range(1, len(t) + 1), lambda i: {'i': i, 'key': CASE WHEN i = 1 THEN '' ELSE k[i - 1] END, 'content': t[i]})) AS p FROM (
    SELECT row_id, regexp_extract_all(output, '<fcel>|<ecel>|<nl>') AS k, regexp_split_to_array(output, '<fcel>|<ecel>|<nl>') AS t FROM (SELECT DISTINCT row_id, output FROM alpaca) WHERE output IS NOT NULL))
WHERE p.key <> '' OR p.content <> ''""")
def c11_split_parts(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["output"]).where("output is not null")
    s = messages.split_at(F.col("output"), "<fcel>|<ecel>|<nl>")
    lead = F.when(F.get(s, F.lit(0))["key"] == "", 1).otherwise(2)
    p = a.withColumn("lead", lead).select("row_id", "lead", F.posexplode(s).alias("k", "p"))
    return p.select("row_id", (F.col("k") + F.col("lead")).cast("bigint").alias("part"), "p.key", "p.content")


@BOOK.query(f"""
WITH m AS (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM {CHATML} WHERE len(messages) > 0)
SELECT row_id, string_agg('<|im_start|>' || messages[i].role || chr(10) || coalesce(messages[i].content, '') || '<|im_end|>' || chr(10), '' ORDER BY i) AS prompt FROM m GROUP BY 1""")
def c12_render(spark: SparkSession, d: str) -> DataFrame:
    m = _chatml(spark, d).where("size(messages) > 0")
    return m.select("row_id", messages.rendered(F.col("messages"), F.lit(None).cast("string")).alias("prompt"))


@BOOK.query("SELECT doc_id, coalesce(regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]'), false) AS chinese, string_split(text, '</think>')[-1] AS rest FROM documents")
def c13_text_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", messages.has_chinese(F.col("text")).alias("chinese"), messages.without_reasoning(F.col("text")).alias("rest"))


@BOOK.query(f"""
SELECT row_id, i::BIGINT AS turn, CASE WHEN messages[i].role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight, CASE WHEN messages[i].role = 'assistant' AND i = len(messages) THEN 1.0 ELSE 0.0 END::DOUBLE AS weight_last
FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM {CHATML} WHERE len(messages) > 0)""")
def a02_loss_scale(spark: SparkSession, d: str) -> DataFrame:
    m = _chatml(spark, d).where("size(messages) > 0")
    z = m.select("row_id", F.posexplode(F.arrays_zip(agents.context_scales(F.col("messages")).alias("w"), agents.context_scales(F.col("messages"), "last_round").alias("l"))).alias("k", "z"))
    return z.select("row_id", (F.col("k") + 1).cast("bigint").alias("turn"), F.col("z.w").cast("double").alias("weight"), F.col("z.l").cast("double").alias("weight_last"))


@BOOK.query("SELECT event_id, event_type AS name, '{\"value\":' || floor(value)::BIGINT || '}' AS arguments FROM events")
def a01_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Events written as tagged JSON calls and read again."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('ok <tool_call>\n{"name": "'), F.col("event_type"), F.lit('", "arguments": {"value": '), F.floor("value").cast("string"), F.lit("}}\n</tool_call>"))
    return e.select("event_id", F.explode(agents.hermes_calls(text)).alias("c")).select("event_id", "c.name", "c.arguments")


@BOOK.query("SELECT event_id, event_type AS name, 'user ' || user_id AS arguments FROM events")
def a03_react_calls(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Thought: look\nAction: "), F.col("event_type"), F.lit("\nAction Input: user "), F.col("user_id").cast("string"), F.lit("\nObservation: done"))
    return table(spark, d, "events").select("event_id", F.explode(agents.react_calls(text)).alias("c")).select("event_id", "c.name", "c.arguments")


@BOOK.query("SELECT event_id, 'fn' AS name, event_type AS kind, user_id::VARCHAR AS usr FROM events")
def a04_parameter_calls(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<function=fn>\n<parameter=kind>\n"), F.col("event_type"), F.lit("\n</parameter>\n<parameter=usr>\n"), F.col("user_id").cast("string"), F.lit("\n</parameter>\n</function>"))
    c = table(spark, d, "events").select("event_id", agents.coder_call(text).alias("c"))
    return c.select("event_id", "c.name", F.col("c.arguments")["kind"].alias("kind"), F.col("c.arguments")["usr"].alias("usr"))


@BOOK.query("""
SELECT event_id, p.k AS k, p.text AS text, p.scale::DOUBLE AS scale FROM (SELECT event_id, unnest([{'k': 0, 'text': 'Thought:', 'scale': 1.0}, {'k': 1, 'text': ' ' || event_type, 'scale': 1.0},
 {'k': 2, 'text': 'Action:', 'scale': 2.0}, {'k': 3, 'text': ' ' || user_id, 'scale': 2.0}, {'k': 4, 'text': 'Observation:', 'scale': 2.0}, {'k': 5, 'text': ' x', 'scale': 0.0}]) AS p FROM events)""")
def a05_keyword_scale(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Thought: "), F.col("event_type"), F.lit("Action: "), F.col("user_id").cast("string"), F.lit("Observation: x"))
    s = table(spark, d, "events").select("event_id", F.posexplode(agents.keyword_scales(text, "react")).alias("k", "p"))
    return s.select("event_id", F.col("k").alias("k"), "p.text", F.col("p.scale").cast("double").alias("scale"))


@BOOK.query("SELECT l_orderkey, l_linenumber, '[(' || round(l_quantity)::BIGINT || ',' || l_linenumber || '),(' || (round(l_quantity)::BIGINT + 1) || ',' || (l_linenumber + 1) || ')]' AS box FROM lineitem")
def c14_box_text(spark: SparkSession, d: str) -> DataFrame:
    q = F.round("l_quantity").cast("bigint")
    box = F.array(q, F.col("l_linenumber").cast("bigint"), q + 1, F.col("l_linenumber").cast("bigint") + 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", messages.box_text(box).alias("box"))


@BOOK.query("""
SELECT vec_id, array_to_string(list_filter(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 AND embedding[i + 1] <= 0 THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS places FROM embeddings""")
def c15_find_all(spark: SparkSession, d: str) -> DataFrame:
    signs = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    found = messages.find_all(signs, F.array(F.lit(1), F.lit(0)))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(found.cast("array<string>"), ",").alias("places"))


@BOOK.query()
def a06_repair_json(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["output"]).where("output like '{%'")
    return a.select("row_id", agents.repaired_json("output").alias("json"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
