"""Queries of the remaining rules of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, groups, messages, metrics, presets, rewards, rows
from ..session import table
from .base import Book, once

BOOK = Book()


@BOOK.query("""
SELECT row_id, CASE WHEN coalesce(instruction, '') = '' THEN 'no prompt' WHEN output IS NULL OR length(output) < 10 THEN 'short' END AS reason FROM (SELECT DISTINCT row_id, instruction, output FROM alpaca)""")
def row06_error_policy(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["instruction", "output"])
    return rows.checked(a, {"no prompt": F.col("instruction") != "", "short": F.char_length("output") >= 10}).select("row_id", "reason")


@BOOK.query("SELECT prompt_id, try_cast(idx::VARCHAR || CASE WHEN idx = 0 THEN '.5' ELSE '' END AS INT) AS label, count(*) AS n FROM (SELECT DISTINCT request_id, prompt_id, idx FROM rewards) WHERE idx <> 0 GROUP BY 1, 2")
def row16_class_label(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "rewards", "request_id", ["prompt_id", "idx"])
    text = F.concat(F.col("idx").cast("string"), F.when(F.col("idx") == 0, ".x").otherwise(""))
    return r.withColumn("label", rows.class_label(text)).where("label is not null").groupBy("prompt_id", "label").agg(F.count("*").alias("n"))


@BOOK.query("SELECT p_partkey, 'Using the numbers [' || p_size || ', 3], create an equation that equals ' || (p_size + 3) || '.' AS prompt, CASE WHEN p_brand LIKE '%#1%' THEN replace(p_brand, '#1', '/one') ELSE p_brand END AS path FROM part")
def d15_prompts_and_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", presets.countdown_prompt(F.array("p_size", F.lit(3)), F.col("p_size") + 3).alias("prompt"), presets.moved_path(F.col("p_brand"), {"#1": "/one"}).alias("path"))


@BOOK.query("SELECT row_id, concat_ws(chr(10), nullif(s, ''), array_to_string(list_transform(coalesce(history, []), lambda h: concat_ws(chr(10), h[1], h[2])), chr(10))) AS system FROM (SELECT DISTINCT row_id, \"system\" AS s, history FROM alpaca)")
def d14_folded_history(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "alpaca", "row_id", ["system", "history"])
    return a.select("row_id", presets.folded_history(F.col("system"), F.coalesce("history", F.array().cast("array<array<string>>"))).alias("system"))


@BOOK.query("SELECT n_nationkey, (['p', 'q', 'r'])[n_regionkey + 1] AS option, CASE WHEN n_regionkey = 0 THEN 'x' ELSE n_name END AS named FROM nation")
def d30_options(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    first = F.when(F.col("n_regionkey") == 0, "None").otherwise(F.col("n_name"))
    return n.select("n_nationkey", presets.chosen_option(F.array(F.lit("p"), F.lit("q"), F.lit("r")), F.col("n_regionkey")).alias("option"), presets.first_named(first, F.lit("x")).alias("named"))


@BOOK.query("SELECT event_id, 'tool_call' AS role, '{\"n\":' || user_id || '}' AS content FROM events")
def d19_calls_as_messages(spark: SparkSession, d: str) -> DataFrame:
    calls = F.concat(F.lit('[{"n":'), F.col("user_id").cast("string"), F.lit("}]"))
    return table(spark, d, "events").select("event_id", F.explode(agents.calls_as_messages(calls)).alias("m")).select("event_id", "m.role", "m.content")


@BOOK.query("SELECT event_id, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM events")
def r08_tool_reward(spark: SparkSession, d: str) -> DataFrame:
    """The same action with the same input for views; another value, another action or no JSON for the others."""
    e = table(spark, d, "events")
    usr = F.col("user_id").cast("string")
    line = lambda a, i: F.concat(F.lit("Thought: t\nAction: "), a, F.lit("\nAction Input: "), i)
    truth = line(F.lit("get"), F.concat(F.lit('{"u": "'), usr, F.lit('"}')))
    other = F.when(F.col("event_id") % 3 == 0, line(F.lit("get"), F.lit('{"u": "no"}'))).when(F.col("event_id") % 3 == 1, line(F.lit("put"), F.concat(F.lit('{"u": "'), usr, F.lit('"}')))).otherwise(line(F.lit("get"), F.lit("plain")))
    return e.select("event_id", rewards.tool_reward(F.when(F.col("event_type") == "view", truth).otherwise(other), truth).alias("reward"))


@BOOK.query("SELECT vec_id, round(0.5 * label / 4.0, 6)::DOUBLE AS early, round(label / 4.0, 6)::DOUBLE AS late FROM embeddings WHERE label <= 4")
def r18_bands(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("label") / 4.0
    band = lambda step: F.round(rewards.bands_by_step(v, F.lit(step), 30, (0.0, 0.5), (0.0, 1.0)), 6)
    return table(spark, d, "embeddings").where("label <= 4").select("vec_id", band(10).alias("early"), band(31).alias("late"))


@BOOK.query("SELECT vec_id, len(list_filter(list_sort(embedding), lambda x: x < 0)) AS lower, len(list_filter(embedding, lambda x: x <= 0.5)) AS upper FROM embeddings")
def a47_bounds(spark: SparkSession, d: str) -> DataFrame:
    s = F.sort_array("embedding")
    return table(spark, d, "embeddings").select("vec_id", messages.lower_bound(s, F.lit(0.0)).cast("bigint").alias("lower"), messages.upper_bound(s, F.lit(0.5)).cast("bigint").alias("upper"))


@BOOK.query("SELECT l_orderkey, l_linenumber, repeat('0,', greatest(7 - l_linenumber, 0)::BIGINT) || array_to_string(list_transform(range(l_linenumber), lambda i: 5), ',') AS ids FROM lineitem")
def a26_padded(spark: SparkSession, d: str) -> DataFrame:
    ids = messages.padded(F.array_repeat(F.lit(5), F.col("l_linenumber")), F.lit(7), 0, left=True)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@BOOK.query("""
SELECT p_partkey, CASE WHEN abs(p_size / 25 - 0.5) < abs(p_size / 25 - 1) AND abs(p_size / 25 - 0.5) <= abs(p_size / 25 - 2) THEN '1x2' WHEN abs(p_size / 25 - 1) <= abs(p_size / 25 - 2) THEN '1x1' ELSE '2x1' END AS ratio FROM part""")
def a45_closest_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = messages.closest_ratio(F.col("p_size") * 4, F.lit(100), [(1, 1), (1, 2), (2, 1)], 10_000)
    return table(spark, d, "part").select("p_partkey", F.concat(r["w"].cast("string"), F.lit("x"), r["h"].cast("string")).alias("ratio"))


@BOOK.query("SELECT n_nationkey, md5('{\"a\":\"' || n_name || '\",\"b\":' || n_regionkey || '}') AS id FROM nation")
def a40_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", messages.fingerprint({"b": F.col("n_regionkey"), "a": F.col("n_name")}).alias("id"))


@BOOK.query("SELECT doc_id, CASE WHEN length(text) >= 1000 THEN '<<<base64:' || left(text, 50) || '..>>>' ELSE text END AS shown FROM documents")
def a41_printable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", messages.printable(F.col("text")).alias("shown"))


@BOOK.query("SELECT n_nationkey, n_name AS first, '<think></think>' || n_name AS last FROM nation")
def a53_think_prefix(spark: SparkSession, d: str) -> DataFrame:
    m = lambda c: F.struct(F.lit("assistant").alias("role"), c.alias("content"))
    t = messages.with_think_prefix(F.array(m(F.concat(F.lit("<think>why</think> "), "n_name")), m(F.col("n_name"))), "<think></think>", True)
    return table(spark, d, "nation").withColumn("t", t).select("n_nationkey", F.get("t", F.lit(0))["content"].alias("first"), F.get("t", F.lit(1))["content"].alias("last"))


@BOOK.query("SELECT n_nationkey, n_name AS text FROM nation")
def s14_media_bytes(spark: SparkSession, d: str) -> DataFrame:
    b = messages.media_bytes(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("n_name", "UTF-8"))))
    return table(spark, d, "nation").select("n_nationkey", F.decode(b, "UTF-8").alias("text"))


@BOOK.query("SELECT sum(user_id)::BIGINT AS prompt_tokens, sum(event_id)::BIGINT AS completion_tokens, count(*) AS samples FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1)")
def g11_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"))
    return metrics.usage_stats(e, "user_id", "event_id", 10.0).select("prompt_tokens", "completion_tokens", "samples")


@BOOK.query("""
WITH g AS (SELECT vec_id // 4 AS g, vec_id % 4 AS k, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.g, b.k, list_inner_product(a.e, b.e) AS s FROM g a JOIN g b ON a.g = b.g AND a.k = 0 AND b.k > 0),
p AS (SELECT g, max(CASE WHEN k = 1 THEN s END) AS p, max(CASE WHEN k > 1 THEN s END) AS n, sum(CASE WHEN k > 1 THEN s END) AS t, count(*) FILTER (k > 1) AS c FROM s GROUP BY 1)
SELECT round(avg(p - n), 4)::DOUBLE AS margin, round(avg(p), 4)::DOUBLE AS mean_pos, round(sum(t) / sum(c), 4)::DOUBLE AS mean_neg FROM p""")
def g17_margins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("g"), F.least(F.col("vec_id") % 4, F.lit(2)).alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    m = metrics.margin_metrics(e, ["g"], "g", "kind", "v")
    return m.select(*[F.round(c, 4).alias(c) for c in ("margin", "mean_pos", "mean_neg")])


@BOOK.query("SELECT o_orderkey, o_totalprice = min(o_totalprice) OVER (PARTITION BY o_custkey) AS is_best FROM orders")
def g24_best_flags(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return metrics.best_flags(o, ["o_custkey"], "o_totalprice").select("o_orderkey", "is_best")


@BOOK.query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def g25_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_counts(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@BOOK.query("SELECT vec_id, round(coalesce(list_avg(list_filter(embedding::DOUBLE[], lambda x: x > 0)), 0), 5)::DOUBLE AS loss FROM embeddings")
def g26_reduced_loss(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(metrics.reduced_loss(v, F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))), 5).alias("loss"))


@BOOK.query("SELECT n_nationkey, 3.0::DOUBLE AS scale, 'yes' AS text FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, 1.0, 'yes' FROM nation WHERE n_regionkey > 0")
def a28_reply_scale(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("What is the value of "), "n_name")).otherwise(F.col("n_name"))
    s = table(spark, d, "nation").select("n_nationkey", F.explode(agents.reply_scales(F.lit("yes"), q, "agentflan")).alias("s"))
    return s.select("n_nationkey", F.col("s.scale").cast("double").alias("scale"), "s.text")


@BOOK.query("SELECT request_id, last_value(r_teds) OVER (PARTITION BY prompt_id ORDER BY idx, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS score FROM (SELECT DISTINCT request_id, prompt_id, idx, r_teds FROM rewards)")
def r15_last_turn(spark: SparkSession, d: str) -> DataFrame:
    """The score of a prompt's last row, given to all of its rows."""
    r = once(spark, d, "rewards", "request_id", ["prompt_id", "idx", "r_teds"]).withColumn("o", F.struct("idx", "request_id"))
    last = groups.last_of(r.select("prompt_id", "o", "r_teds"), ["prompt_id"], "o").select("prompt_id", F.col("r_teds").alias("score"))
    return r.join(last, "prompt_id").select("request_id", "score")


@BOOK.query("SELECT n_nationkey, '-100,1,' || CASE WHEN n_regionkey = 0 THEN '9' ELSE '-100' END || ',-100,2' AS labels FROM nation")
def a20_dynamic_end(spark: SparkSession, d: str) -> DataFrame:
    """The end token 9 after a supervised stretch is supervised where it is there (region 0)."""
    ids = F.array(F.lit(5), F.lit(1), F.when(F.col("n_regionkey") == 0, 9).otherwise(8), F.lit(7), F.lit(2))
    labels = messages.with_dynamic_end(ids, F.array(*map(F.lit, [-100, 1, -100, -100, 2])), [9])
    return table(spark, d, "nation").select("n_nationkey", F.array_join(labels.cast("array<string>"), ",").alias("labels"))


@BOOK.query("SELECT n_nationkey, n_name || '<image>' || n_regionkey AS text, n_name || '.png' AS urls FROM nation")
def row24_split_media(spark: SparkSession, d: str) -> DataFrame:
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    text, urls = messages.split_media(F.array(part("text", F.col("n_name"), F.lit(None)), part("image_url", F.lit(None), F.concat("n_name", F.lit(".png"))), part("text", F.col("n_regionkey"), F.lit(None))))
    return table(spark, d, "nation").select("n_nationkey", text.alias("text"), F.array_join(urls, "|").alias("urls"))


@BOOK.query("SELECT n_nationkey, n_name AS chosen_text, n_regionkey AS chosen_length, 'x' AS rejected_text, 1 AS rejected_length FROM nation")
def a23_task_row(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, n: F.struct(t.alias("text"), n.alias("length"))
    cols = messages.task_row({"chosen": one(F.col("n_name"), F.col("n_regionkey")), "rejected": one(F.lit("x"), F.lit(1))}, ["text", "length"])
    return table(spark, d, "nation").select("n_nationkey", *cols)


@BOOK.query("SELECT l_orderkey, count(*) AS n_turns, round(sum(l_quantity), 4)::DOUBLE AS total_reward, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) AS last_reward FROM lineitem GROUP BY 1")
def w09_turn_totals(spark: SparkSession, d: str) -> DataFrame:
    t = groups.turn_totals(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
    return t.withColumn("total_reward", F.round("total_reward", 4))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
