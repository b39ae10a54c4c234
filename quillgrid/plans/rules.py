"""Queries of further row, text, box, call and score rules; names begin with the inventory's ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, datasets, groups, messages, metrics, presets, rewards, rows
from ..session import shared_dir, table
from ..sources import files
from .base import Book, once

BOOK = Book()


@BOOK.query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS mktsegment FROM customer")
def row03_prefix_strip(spark: SparkSession, d: str) -> DataFrame:
    """c_ goes; `name` exists already, so c_name is dropped."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_name", "c_mktsegment")
    return rows.without_prefix(c, "c_")


@BOOK.query("SELECT request_id FROM (SELECT DISTINCT request_id, completion, solution FROM rewards) WHERE completion IS NOT NULL AND solution IS NOT NULL AND completion <> solution")
def row09_rejected_differs(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "rewards", "request_id", ["completion", "solution"])
    m = F.array(F.struct(F.lit("assistant").alias("role"), F.col("solution").alias("content")))
    return r.where(rows.rejected_differs(m, F.col("completion"))).select("request_id")


@BOOK.query("SELECT n_nationkey, k::BIGINT AS turn, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 0 THEN n_name ELSE n_regionkey::VARCHAR END AS content FROM nation, range(2) t(k)")
def row14_standard_roles(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("human").alias("from"), F.col("n_name").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("n_regionkey").cast("string").alias("value")))
    m = rows.standard_roles(pairs, "from", "value", ["human", "user"], ["gpt", "assistant", "bot"])
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(m).alias("turn", "m")).select("n_nationkey", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


@BOOK.query("SELECT n_nationkey, k::BIGINT AS turn, CASE k WHEN 0 THEN n_name ELSE n_regionkey::VARCHAR END AS content FROM nation, range(2) t(k)")
def row14_paired_turns(spark: SparkSession, d: str) -> DataFrame:
    p = F.array(F.struct(F.col("n_name").alias("human"), F.col("n_regionkey").cast("string").alias("assistant")))
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(rows.paired_messages(p)).alias("turn", "m")).select("n_nationkey", F.col("turn").cast("bigint").alias("turn"), "m.content")


@BOOK.query("SELECT p_partkey, 'Say: ' || p_name || '!' AS prompt FROM part")
def row18_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rows.filled("Say: {{QUERY}}!", F.col("p_name")).alias("prompt"))


@BOOK.query("""
WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS ok FROM orders),
g AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':0'), o_orderkey) - 1 AS i FROM r WHERE ok),
b AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':1'), o_orderkey) - 1 AS i FROM r WHERE NOT ok)
SELECT b.o_orderkey, g.o_orderkey AS used FROM b JOIN g ON g.i = b.i % (SELECT count(*) FROM g) UNION ALL SELECT o_orderkey, o_orderkey FROM r WHERE ok""")
def row23_refill(spark: SparkSession, d: str) -> DataFrame:
    return datasets.refill(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus = 'F'")


@BOOK.query("""
SELECT row_id, coalesce(list_max(list_transform(range(1, len(messages) + 1), lambda i: CASE WHEN messages[i].role IN ('user', 'tool') THEN i ELSE 0 END)), 0)::BIGINT + 1 AS n, 'none' AS reply
FROM (SELECT DISTINCT row_id, messages FROM chatml) WHERE len(messages) > 0""")
def row25_rejected_branch(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "chatml", "row_id", ["messages"]).where("size(messages) > 0").withColumn("r", rows.chosen_and_rejected(F.col("messages"), F.lit("none")))
    return m.select("row_id", F.size("r").cast("bigint").alias("n"), F.element_at("r", -1)["content"].alias("reply"))


@BOOK.query("SELECT row_id, list_filter(flatten(history), lambda x: x IS NOT NULL AND x <> '')[1] AS leaf FROM (SELECT DISTINCT row_id, history FROM multi_modal_2)")
def a04_first_leaf(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "multi_modal_2", "row_id", ["history"])
    return m.select("row_id", messages.first_leaf(F.col("history")).alias("leaf"))


@BOOK.query("SELECT n_nationkey, len(string_split(n_name, 'A')) AS n_parts, len(string_split(n_name, 'A')[1]) AS first FROM nation")
def a06_split_list(spark: SparkSession, d: str) -> DataFrame:
    parts = messages.split_list(F.filter(F.split("n_name", ""), lambda c: c != ""), F.lit("A"))
    return table(spark, d, "nation").withColumn("p", parts).select("n_nationkey", F.size("p").cast("bigint").alias("n_parts"), F.size(F.get("p", F.lit(0))).cast("bigint").alias("first"))


@BOOK.query("SELECT record_id, 'see <image> and <image>' AS text, path || '|' || record_id || '.png' AS paths FROM (SELECT DISTINCT record_id, path FROM examples_output) WHERE path IS NOT NULL")
def a13_inline_images(spark: SparkSession, d: str) -> DataFrame:
    e = once(spark, d, "examples_output", "record_id", ["path"]).where("path is not null")
    text, paths = messages.inline_images(F.concat(F.lit("see <img>"), "path", F.lit("</img> and <img>"), F.col("record_id").cast("string"), F.lit(".png</img>")))
    return e.select("record_id", text.alias("text"), F.array_join(paths, "|").alias("paths"))


@BOOK.query("SELECT n_nationkey, n_name || ' in ' || n_regionkey || ' or <x>' AS text FROM nation")
def a15_filled_tags(spark: SparkSession, d: str) -> DataFrame:
    text = messages.filled_tags(F.lit("<x> in <x> or <x>"), "<x>", F.array("n_name", F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", text.alias("text"))


@BOOK.query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 64.0 * 1000, 0)::BIGINT AS x, round_even(l_linenumber / 8.0 * 1000, 0)::BIGINT AS y FROM lineitem")
def a16_scaled_box(spark: SparkSession, d: str) -> DataFrame:
    b = messages.scaled_box(F.array("l_quantity", F.col("l_linenumber").cast("double")), F.lit(64.0), F.lit(8.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(b, F.lit(0)).alias("x"), F.get(b, F.lit(1)).alias("y"))


@BOOK.query("SELECT n_nationkey, 2::BIGINT AS n, 'a' || n_name AS first FROM nation")
def a17_merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    item = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("scale"))
    m = messages.merged_contexts(F.array(item(F.lit("a"), 1.0), item(F.col("n_name"), 1.0), item(F.lit("b"), 0.0)))
    return table(spark, d, "nation").withColumn("m", m).select("n_nationkey", F.size("m").cast("bigint").alias("n"), F.get("m", F.lit(0))["text"].alias("first"))


@BOOK.query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS kept, 64 - len(list_filter(embedding, lambda x: x > 0)) AS masked FROM embeddings")
def a19_labels(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform("embedding", lambda x: F.lit(5))
    l = messages.labels_of(ids, F.transform("embedding", lambda x: x.cast("double")))
    count = lambda v: F.size(F.filter(l, lambda t: t == v)).cast("bigint")
    return table(spark, d, "embeddings").select("vec_id", count(5).alias("kept"), count(-100).alias("masked"))


@BOOK.query("SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS n FROM lineitem")
def a24_expanded(spark: SparkSession, d: str) -> DataFrame:
    ids = messages.expanded(F.array(F.lit(1), F.lit(9), F.lit(2)), 9, F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(ids).alias("n"))


@BOOK.query("SELECT l_orderkey, l_linenumber, floor(l_quantity * 10 * sqrt(least(1.0, 10000.0 / (l_quantity * 10 * l_linenumber * 100))))::INT AS width, floor(l_linenumber * 100 * sqrt(least(1.0, 10000.0 / (l_quantity * 10 * l_linenumber * 100))))::INT AS height FROM lineitem")
def a44_capped_size(spark: SparkSession, d: str) -> DataFrame:
    s = messages.capped_size(F.col("l_quantity") * 10, F.col("l_linenumber") * 100, 10_000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.width", "s.height")


@BOOK.query("SELECT o_orderkey, array_to_string(list_transform(range(0, 4), lambda i: floor((i + 0.5) * (o_orderkey % 97 + 4) / 4)::INT), ',') AS frames FROM orders")
def a46_frames(spark: SparkSession, d: str) -> DataFrame:
    f = messages.frame_indices(F.pmod("o_orderkey", F.lit(97)) + 4, 4)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(f.cast("array<string>"), ",").alias("frames"))


@BOOK.query("SELECT n_nationkey, floor(n_nationkey * 4 / 25)::INT AS part, (n_nationkey % 4)::INT AS strided FROM nation")
def a48_even_parts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", messages.even_part(F.col("n_nationkey"), F.lit(25), 4).alias("part"), messages.even_part(F.col("n_nationkey"), F.lit(25), 4, False).alias("strided"))


@BOOK.query("SELECT p_partkey, p_size::VARCHAR AS boxed, 1.0::DOUBLE AS yes, (p_size % 10)::DOUBLE / 10 AS stated FROM part")
def a50_parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("so \\boxed{"), size, F.lit("} [[YES]] Reward: 0."), (F.col("p_size") % 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", messages.boxed(text).alias("boxed"), rewards.verdict(text).alias("yes"), rewards.stated_reward(text).alias("stated"))


@BOOK.query("SELECT n_nationkey, n_name || CASE WHEN n_regionkey = 0 THEN '' ELSE '，' || n_regionkey END AS text FROM nation")
def d03_titled(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise(F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", presets.titled(F.concat(F.lit("7. "), "n_name"), F.when(F.col("n_regionkey") != 0, a)).alias("text")).withColumn("text", F.regexp_replace("text", "^ +", ""))


@BOOK.query("SELECT row_id, len(list_filter(messages, lambda m: contains(lower(coalesce(m.content, '')), 'table') OR contains(lower(coalesce(m.content, '')), 'unit'))) > 0 AS hit FROM (SELECT DISTINCT row_id, messages FROM chatml) WHERE messages IS NOT NULL")
def d05_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "chatml", "row_id", ["messages"]).where("messages is not null")
    return m.select("row_id", presets.mentions(F.col("messages"), ["table", "unit"]).alias("hit"))


@BOOK.query("SELECT vec_id, printf('%.1f', label / 2.0) AS label FROM embeddings WHERE label >= 1")
def d11_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("s", F.col("label") / 2.0)
    return presets.similarity_rows(e.withColumn("a", F.lit("a")), "a", "a", "s", 0.5).select("vec_id", "label")


@BOOK.query("SELECT p_partkey, string_split(p_type, ' ')[1] AS a, string_split(p_type, ' ')[2] AS b FROM part WHERE len(string_split(p_type, ' ')) = 2")
def d17_two_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("x", presets.two_parts(F.col("p_type"), " ")).where("x is not null")
    return p.select("p_partkey", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))


@BOOK.query("SELECT n_nationkey, k::BIGINT AS turn, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 0 THEN n_name ELSE 'in ' || n_regionkey END AS content FROM nation, range(2) t(k) WHERE n_regionkey <> 0")
def d18_marked_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns that don't alternate are dropped (region 0)."""
    second = F.when(F.col("n_regionkey") == 0, F.lit("Human:")).otherwise(F.lit("Assistant:"))
    text = F.concat(F.lit("\n\nHuman: "), "n_name", F.lit("\n\n"), second, F.lit(" in "), F.col("n_regionkey").cast("string"))
    t = table(spark, d, "nation").select("n_nationkey", F.posexplode(presets.marked_turns(text)).alias("turn", "m"))
    return t.select("n_nationkey", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


@BOOK.query("SELECT l_orderkey, l_linenumber, round_even(l_tax * 100 / 2, 0)::BIGINT AS half FROM lineitem")
def d27_rounded_box(spark: SparkSession, d: str) -> DataFrame:
    b = presets.rounded_box(F.array(F.col("l_tax") * 100 / 2))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(b, F.lit(0)).alias("half"))


@BOOK.query("SELECT n_nationkey, '<ref-object>' || (['a', 'b', 'c'])[n_regionkey % 3 + 1] || '<bbox>' || chr(10) || '<ref-object>a<bbox>' AS lines FROM nation")
def d29_object_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", presets.object_lines(F.array(F.col("n_regionkey") % 3, F.lit(0)), ["a", "b", "c"]).alias("lines"))


@BOOK.query("SELECT n_nationkey, n_name || '<image>' || n_regionkey AS text FROM nation")
def d31_parts_text(spark: SparkSession, d: str) -> DataFrame:
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    return table(spark, d, "nation").select("n_nationkey", presets.parts_text(F.array(part("text", F.col("n_name")), part("image", F.lit(None).cast("string")), part("text", F.col("n_regionkey").cast("string")))).alias("text"))


@BOOK.query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS react, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS code, CASE WHEN n_regionkey = 0 THEN '' ELSE 'x = ' || n_nationkey || chr(10) END AS body FROM nation")
def r17_code_and_react(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("n_regionkey") != 0
    react = F.when(ok, F.concat(F.lit("<think>t</think>\nAction: a\nAction Input: "), "n_name")).otherwise(F.col("n_name"))
    code = F.when(ok, F.concat(F.lit("<think>t</think><answer>```python\nx = "), F.col("n_nationkey").cast("string"), F.lit("\n```</answer>"))).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", rewards.react_reward(react).alias("react"), rewards.code_format(code, F.lit("python")).alias("code"), rewards.last_fence(code, "python").alias("body"))


@BOOK.query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part), u AS (SELECT p_partkey, unnest(a) AS x, 1 AS ca, 0 AS cb FROM w UNION ALL SELECT p_partkey, unnest(b), 0, 1 FROM w),
c AS (SELECT p_partkey, x, sum(ca) AS ca, sum(cb) AS cb FROM u GROUP BY 1, 2)
SELECT p_partkey, round(sum(least(ca, cb)) / sum(greatest(ca, cb)), 9)::DOUBLE AS jaccard FROM c GROUP BY 1""")
def r18_multiset_jaccard(spark: SparkSession, d: str) -> DataFrame:
    j = rewards.multiset_jaccard(F.split("p_name", " "), F.split("p_type", " "))
    return table(spark, d, "part").select("p_partkey", F.round(j, 9).alias("jaccard"))


@BOOK.query("""
SELECT vec_id, len(list_filter(embedding[55:64], lambda x: exp(x - 2) <= 0.01)) = 0 AS rejected FROM embeddings""")
def l07_probability_rejected(spark: SparkSession, d: str) -> DataFrame:
    logs = F.transform("embedding", lambda x: x.cast("double") - 2)
    return table(spark, d, "embeddings").select("vec_id", groups.probability_rejected(logs, 10, 0.01).alias("rejected"))


@BOOK.query("""
WITH p AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS x, c.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2),
s AS (SELECT id, list_cosine_similarity(q, x) / 0.1 AS p, list_cosine_similarity(q, y) / 0.1 AS n FROM p)
SELECT id AS vec_id, round(ln(exp(p) + exp(n)) - p, 4)::DOUBLE AS loss, round(0.5 * greatest(0.5 - (1 - p * 0.1), 0) ** 2, 6)::DOUBLE AS contrastive FROM s""")
def g27_losses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    x, y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("x")), e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("v").alias("y"))
    j = e.join(x, "vec_id").join(y, "vec_id")
    distance = 1 - metrics.distances(F.col("v"), F.col("x"))["cosine"]
    return j.select("vec_id", F.round(metrics.info_nce(F.col("v"), F.array("x", "y")), 4).alias("loss"), F.round(metrics.contrastive(distance, F.lit(0.0)), 6).alias("contrastive"))


@BOOK.query("SELECT l_orderkey, l_linenumber, round(l_discount + 1.4 * sqrt(ln(100) / l_quantity), 6)::DOUBLE AS uct FROM lineitem")
def w10_uct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(groups.uct(F.col("l_discount"), F.col("l_quantity"), F.lit(100.0)), 6).alias("uct"))


@BOOK.query("SELECT event_id, 'look' AS glm, event_type AS listed, user_id::VARCHAR AS keyed FROM events")
def a34_more_calls(spark: SparkSession, d: str) -> DataFrame:
    usr = F.col("user_id").cast("string")
    glm = agents.glm_calls(F.concat(F.lit('look\n{"a": "'), "event_type", F.lit('"}')))
    listed = agents.bracket_calls(F.concat(F.lit('x[TOOL_CALLS][{"name": "'), "event_type", F.lit('", "arguments": "{}"}]')))
    keyed = agents.key_value_call(F.concat(F.lit("f\n<arg_key>u</arg_key>\n<arg_value>"), usr, F.lit("</arg_value>")))
    return table(spark, d, "events").select("event_id", F.get(glm, F.lit(0))["name"].alias("glm"), F.get(listed, F.lit(0))["name"].alias("listed"), keyed["u"].alias("keyed"))


@BOOK.query("SELECT n_nationkey, 'You may call one or more functions.' || chr(10) || n_name || ': in ' || n_regionkey AS prompt, 'Observation:' || n_name AS seen, 'Action: ' || n_name || chr(10) || 'Action Input: {}' AS line FROM nation")
def a36_tool_prompt(spark: SparkSession, d: str) -> DataFrame:
    call = F.array(F.struct(F.col("n_name").alias("name"), F.lit("{}").alias("arguments")))
    return table(spark, d, "nation").select(
        "n_nationkey", agents.tool_prompt(F.array("n_name"), F.array(F.concat(F.lit("in "), F.col("n_regionkey").cast("string")))).alias("prompt"),
        agents.observations(F.array("n_name")).alias("seen"), agents.react_lines(call).alias("line"),
    )


@BOOK.query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"raw\":\"<<<bytes>>>\"}' AS json FROM nation")
def k08_safe_json(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.encode("n_name", "UTF-8").alias("raw"), F.col("n_name").alias("api_token"))
    j = files.safe_json(n)
    return j.select(F.get_json_object("json", "$.n_nationkey").cast("int").alias("n_nationkey"), "json")


@BOOK.query("SELECT n_nationkey, n_regionkey::BIGINT AS v FROM nation")
def s11_json_values(spark: SparkSession, d: str) -> DataFrame:
    """Lines of objects and of bare numbers, read as variants."""
    path = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    n = table(spark, d, "nation")
    n.select(F.to_json(F.struct("n_nationkey", F.col("n_regionkey").alias("v"))).alias("value")).unionByName(n.select(F.col("n_nationkey").cast("string").alias("value"))).write.text(path)
    v = files.read_json_values(spark, path)
    return v.select(F.try_variant_get("value", "$.n_nationkey", "int").alias("n_nationkey"), F.try_variant_get("value", "$.v", "bigint").alias("v")).where("n_nationkey is not null")


@BOOK.query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey < 3 THEN 'a' END AS split FROM region")
def s10_saved_splits(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    r.where("r_regionkey < 3").withColumn("split", F.lit("a")).write.parquet(f"{base}/train")
    r.where("r_regionkey >= 3").write.parquet(f"{base}/val")
    return files.read_splits(spark, base, ["train", "val"])


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
