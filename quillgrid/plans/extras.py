"""Queries of sampling, splits, dialects, losses and registries, and of the table plans over real values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import agents, datasets, groups, markup, messages, metrics, presets, rewards, rows, tables
from ..session import shared_dir, table
from ..sources import files
from .base import Book, once

BOOK = Book()
#: Every slot of the values' tags as rectangles: (record_id, r, c, tag), w and h, and the next slot that ends a span.
SLOTS = """
v AS (SELECT DISTINCT record_id, otsl FROM examples_output WHERE otsl IS NOT NULL),
l AS (SELECT record_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT record_id, string_split(otsl, '<nl>') AS x FROM v)),
t AS (SELECT record_id, i, regexp_extract_all(line, '<(fcel|ecel|lcel|ucel|xcel)>', 1) AS tags FROM l),
n AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY i) - 1 AS r, tags FROM t WHERE len(tags) > 0),
d AS (SELECT record_id, max(len(tags)) AS w, count(*) AS h FROM n GROUP BY 1),
s AS (SELECT record_id, r, c, coalesce(tags[c + 1], 'ecel') AS tag, w, h FROM (SELECT record_id, r, tags, w, h, unnest(range(0, w)) AS c FROM n JOIN d USING (record_id))),
e AS (SELECT *, coalesce(min(CASE WHEN tag NOT IN ('lcel', 'xcel') THEN c END) OVER (PARTITION BY record_id, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), w) AS next_c,
             coalesce(min(CASE WHEN tag NOT IN ('ucel', 'xcel') THEN r END) OVER (PARTITION BY record_id, c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), h) AS next_r FROM s),
cells AS (SELECT record_id, r, c, tag, next_r - r AS row_span, next_c - c AS col_span FROM e WHERE tag IN ('fcel', 'ecel'))"""


def _values(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "examples_output", "record_id", ["otsl"]).where("otsl is not null")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@BOOK.query(f"WITH {SLOTS} SELECT record_id, r, c, tag, row_span, col_span FROM cells")
def t15_value_cells(spark: SparkSession, d: str) -> DataFrame:
    """The owning cells of every value, short rows, runs and false spans as they come."""
    return _long(tables.relational_cells(_values(spark, d), "record_id", "otsl"), "r", "c", "row_span", "col_span")


@BOOK.query(f"""
WITH {SLOTS}, o AS (SELECT record_id, i AS r, j AS c, max(r * 1000000 + c) AS o FROM (SELECT record_id, r, c, i, unnest(range(c, c + col_span)) AS j FROM (SELECT *, unnest(range(r, r + row_span)) AS i FROM cells)) GROUP BY 1, 2, 3)
SELECT record_id, r, c, o // 1000000 AS origin_r, o % 1000000 AS origin_c FROM o""")
def t16_value_slots(spark: SparkSession, d: str) -> DataFrame:
    """Which cell covers each slot of every value; of several the last."""
    return _long(tables.grid_slots(tables.relational_cells(_values(spark, d), "record_id", "otsl"), "record_id"), "r", "c", "origin_r", "origin_c")


@BOOK.query()
def t17_value_span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each value's table scored against the record's own HTML; tested against plain Python."""
    e = once(spark, d, "examples_output", "record_id", ["otsl", "html"]).where("otsl is not null and html is not null")
    paths = e.select("record_id", markup.td_paths(markup.normal_table_udf("otsl"))["cells"].alias("p"), markup.td_paths(markup.normal_table_udf("html"))["cells"].alias("t"))
    return paths.select("record_id", *[F.round(c, 9).alias(n) for c, n in zip(markup.span_scores(F.col("p"), F.col("t")), ("sc_tt", "sc_tf", "sc_f"))])


@BOOK.query()
def t18_teds_reward(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each completion's table with its solution's; tested against values worked out by hand."""
    r = once(spark, d, "rewards", "request_id", ["completion", "solution"])
    return r.select("request_id", F.round(markup.teds_reward(F.col("completion"), F.col("solution")), 9).alias("reward"))


@BOOK.query("""
WITH k AS (SELECT *, md5('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS key FROM nation)
SELECT n_nationkey, n_name FROM k ORDER BY md5(key || ':0'), key LIMIT 10""")
def s06_sampled_name(spark: SparkSession, d: str) -> DataFrame:
    """A dataset name that asks for ten rows."""
    reg = files.Registry()
    reg.register("some/nation", files.Entry(f"{d}/nation.parquet"))
    return reg.load(spark, "nation#10").select("n_nationkey", "n_name")


@BOOK.query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= 30 AS is_val FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 300)")
def d33_take_and_skip(spark: SparkSession, d: str) -> DataFrame:
    """300 rows of a stream, of which the first tenth is held out."""
    return datasets.take_and_skip(table(spark, d, "documents").select("doc_id"), ["doc_id"], 300, 0.1)


@BOOK.query("""
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':3'), doc_id) AS rn, CASE source WHEN 'table_dumps' THEN 0.5 WHEN 'train_logs' THEN 0.3 ELSE 0.2 END::DOUBLE AS w
           FROM documents WHERE source IN ('table_dumps', 'train_logs', 'chat_exports')),
n AS (SELECT source, w, max(rn) AS n FROM p GROUP BY 1, 2), e AS (SELECT max(n / w) AS stop FROM n),
q AS (SELECT doc_id, p.source, k AS copy, (rn + k * n) / p.w AS position, stop FROM p JOIN n USING (source), e, range(0, 100) t(k) WHERE rn + k * n <= stop * p.w + 1)
SELECT doc_id, source, copy::INT AS copy, round(position, 6) AS position FROM q WHERE position <= stop""")
def d34_interleave_all(spark: SparkSession, d: str) -> DataFrame:
    """Sources in turn until the last is exhausted, the others beginning again."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    mixed = datasets.interleaved(docs, "source", "doc_id", {"table_dumps": 0.5, "train_logs": 0.3, "chat_exports": 0.2}, 3, stop="all")
    return mixed.select("doc_id", "source", "copy", F.round("position", 6).alias("position"))


@BOOK.query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 7 AS turn FROM orders")
def l13_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return _long(datasets.round_robin(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 7), "turn").select("o_orderkey", "turn")


@BOOK.query("SELECT request_id, prompt_id, idx FROM (SELECT DISTINCT request_id, prompt_id, idx FROM rewards)")
def l14_in_request_order(spark: SparkSession, d: str) -> DataFrame:
    return datasets.in_request_order(once(spark, d, "rewards", "request_id", ["prompt_id", "idx"]), "request_id", "idx")


@BOOK.query("""
WITH x AS (SELECT l_orderkey % 4 AS attempt, l_orderkey, l_linenumber, l_quantity FROM lineitem), t AS (SELECT * FROM x WHERE attempt < 2),
k AS (SELECT *, row_number() OVER (ORDER BY attempt, l_orderkey, l_linenumber) AS rn FROM t WHERE l_orderkey IN (SELECT l_orderkey FROM t GROUP BY 1 HAVING stddev_samp(l_quantity) > 0))
SELECT 'filled' AS outcome, l_orderkey, l_linenumber FROM k WHERE rn <= 2000 AND (SELECT count(*) FROM k) >= 2000
UNION ALL SELECT 'as drawn', l_orderkey, l_linenumber FROM x WHERE attempt = 0""")
def l08_refilled(spark: SparkSession, d: str) -> DataFrame:
    """Groups without variation replaced by those of a further draw; and the first draw given back where these are too few."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("attempt"), "l_orderkey", "l_linenumber", "l_quantity")
    draw = lambda size, name: groups.dynamic_sample(li, "l_orderkey", "l_quantity", ["l_orderkey", "l_linenumber"], size, "attempt", 2).select(F.lit(name).alias("outcome"), "l_orderkey", "l_linenumber")
    return draw(2000, "filled").unionByName(draw(2**40, "as drawn"))


@BOOK.query("""
WITH t AS (SELECT vec_id, list_sort(list_filter(embedding, lambda x: x > -0.1), 'DESC')[1:5] AS top FROM embeddings)
SELECT vec_id, len(top) AS n, round(top[1]::DOUBLE, 5) AS first, round(top[5]::DOUBLE, 5) AS fifth FROM t""")
def l15_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The five largest; what is below -0.1 stands for minus infinity."""
    v = F.transform("embedding", lambda x: F.when(x > -0.1, x).otherwise(F.lit(float("-inf"))))
    top = table(spark, d, "embeddings").select("vec_id", metrics.top_logprobs(v, 5).alias("top"))
    return top.select("vec_id", F.size("top").cast("bigint").alias("n"), *[F.round(F.get("top", F.lit(k)).cast("double"), 5).alias(n) for k, n in ((0, "first"), (4, "fifth"))])


@BOOK.query("""
WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier)
SELECT c_custkey, s_suppkey FROM a JOIN b USING (k)""")
def j02_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two tables side by side, each in its own order."""
    return datasets.zipped(table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["c_custkey"], ["s_acctbal", "s_suppkey"]).select("c_custkey", "s_suppkey")


@BOOK.query("SELECT l_orderkey, round(avg(l_quantity * l_quantity), 6)::DOUBLE AS value FROM lineitem GROUP BY 1")
def x08_own_metric(spark: SparkSession, d: str) -> DataFrame:
    """A registered metric of two states over the lines of an order."""
    out = registry.METRICS.get("mean_of_squares")(table(spark, d, "lineitem"), "l_quantity", ["l_orderkey"])
    return out.select("l_orderkey", F.round("value", 6).alias("value"))


@BOOK.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM (SELECT l_returnflag, l_linestatus FROM lineitem INTERSECT ALL SELECT o_orderstatus, o_orderstatus FROM orders) GROUP BY 1, 2")
def u04_multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "orders").select(F.col("o_orderstatus").alias("l_returnflag"), F.col("o_orderstatus").alias("l_linestatus"))
    return datasets.common_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), b)


@BOOK.query("""
WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS l FROM embeddings), r AS (SELECT vec_id, coalesce(sum(l) FILTER (l > 0), 0) AS s, count(*) FILTER (l > 0) AS n FROM z GROUP BY 1)
SELECT round(avg(s / greatest(n, 1)), 6) AS by_row, round(sum(s) / greatest(sum(n), 1), 6) AS by_token, round(sum(s) / (count(*) * 64), 6) AS by_length FROM r""")
def g26_reductions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("l"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("m"))
    return metrics.reduced_losses(e, "l", "m", 64).select(*[F.round(c, 6).alias(c) for c in ("by_row", "by_token", "by_length")])


@BOOK.query("""
WITH x AS (SELECT vec_id // 6 AS g, embedding[1]::DOUBLE AS z, CASE WHEN vec_id % 6 = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
p AS (SELECT g, ln(sum(exp(z / 0.5))) - max(z / 0.5) FILTER (y = 1) AS l FROM x GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (y = 1) = 1)
SELECT round((SELECT avg(ln(1 + exp(-z)) * y + ln(1 + exp(z)) * (1 - y)) FROM x), 6) AS pointwise, round(avg(l), 6) AS listwise, count(*) AS n_groups FROM p""")
def g27_reranker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("g"), F.get("embedding", F.lit(0)).cast("double").alias("z"), (F.col("vec_id") % 6 == 0).cast("int").alias("y"))
    point = e.agg(F.round(F.avg(metrics.reranker_loss(F.col("z"), F.col("y"))), 6).alias("pointwise"))
    return point.join(F.broadcast(metrics.listwise_loss(e, ["g"], "z", "y", 0.5))).select("pointwise", F.round("loss", 6).alias("listwise"), "n_groups")  # one row each


@BOOK.query("""
WITH a AS (SELECT DISTINCT row_id, history FROM alpaca WHERE history IS NOT NULL), p AS (SELECT row_id, generate_subscripts(history, 1) AS i, unnest(history) AS h FROM a),
c AS (SELECT row_id, i, 0 AS side, unnest(string_split(coalesce(h[1], ''), '')) AS ch FROM p UNION ALL SELECT row_id, i, 1, unnest(string_split(coalesce(h[2], ''), '')) FROM p),
n AS (SELECT row_id, i, ch, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM c WHERE ch <> '' GROUP BY 1, 2, 3),
f AS (SELECT row_id, i, 2.0 * sum(least(x, y)) / sum(x + y) AS f1 FROM n GROUP BY 1, 2)
SELECT a.row_id, round(coalesce(avg(CASE WHEN p.i IS NULL THEN NULL WHEN h[1] LIKE 'ERROR%' OR lower(h[1]) LIKE '%not answerable%' THEN 0 ELSE coalesce(f1, 0) END), 0), 6)::DOUBLE AS score, count(p.i) AS n_pairs
FROM a LEFT JOIN p USING (row_id) LEFT JOIN f USING (row_id, i) GROUP BY 1""")
def r09_qa_scores(spark: SparkSession, d: str) -> DataFrame:
    """Questions of a history scored against their answers, as if each had been given as the other."""
    a = once(spark, d, "alpaca", "row_id", ["history"]).where("history is not null")
    pairs = F.transform("history", lambda h: F.struct(F.lit("?").alias("question"), F.get(h, F.lit(1)).alias("answer")))
    a = a.select("row_id", pairs.alias("pairs"), F.transform("history", lambda h: F.get(h, F.lit(0))).alias("given"))
    return groups.qa_scores(a, "row_id", "pairs", "given").select("row_id", F.round("score", 6).alias("score"), "n_pairs")


@BOOK.query("""
SELECT request_id, round(coalesce((coalesce(r_teds, 0) + coalesce(r_qa, 0)) / nullif((r_teds IS NOT NULL)::INT + (r_qa IS NOT NULL)::INT, 0), 0), 9)::DOUBLE AS mean, greatest(coalesce(r_teds, 0), coalesce(r_qa, 0))::DOUBLE AS best
FROM (SELECT DISTINCT request_id, r_teds, r_qa FROM rewards)""")
def r19_choices_and_judges(spark: SparkSession, d: str) -> DataFrame:
    """Means of the scores there are, and the better of two."""
    r = once(spark, d, "rewards", "request_id", ["r_teds", "r_qa"])
    return r.select("request_id", F.round(metrics.mean_choice(F.array("r_teds", "r_qa")), 9).alias("mean"), metrics.judged(F.col("r_teds"), F.col("r_qa")).alias("best"))


@BOOK.query("SELECT event_id, event_type AS fenced, props AS arguments, event_type AS bare, json_extract_string(props, '$.k') AS k, event_type AS delimited, 'no' AS other FROM events")
def a33_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the events in three dialects, and one that falls back on the Action form."""
    f = lambda *parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    call = lambda text, dialect: F.get(registry.CALLS.get(dialect)(text), F.lit(0))
    fenced = call(f("<tool_call>", "$event_type", "\n```json\n", "$props", "\n```</tool_call>"), "fenced")
    bare = call(f('so {"name": "', "$event_type", '", "parameters": ', "$props", "}<|eom_id|>"), "parameters")
    marked = call(f("<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>", "$event_type", "<｜tool▁sep｜>", "$props", "<｜tool▁call▁end｜>"), "delimited")
    other = call(f("Action: no\nAction Input: ", "$props"), "fenced")
    return table(spark, d, "events").select(
        "event_id", fenced["name"].alias("fenced"), fenced["arguments"].alias("arguments"), bare["name"].alias("bare"), F.get_json_object(bare["arguments"], "$.k").alias("k"), marked["name"].alias("delimited"), other["name"].alias("other")
    )


@BOOK.query("""
SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE n_name || chr(10) || chr(10) END || '# Tools' || chr(10) || chr(10) || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10)
       || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>' || chr(10) || '{"type":"function","function":{"name":"' || n_name || '"}}' || chr(10) || '</tools>' || chr(10) || chr(10)
       || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10) || '{"name": <function-name>, "arguments": <args-json-object>}' || chr(10) || '</tool_call>' AS prompt FROM nation""")
def a36_listed_tools(spark: SparkSession, d: str) -> DataFrame:
    tool = F.concat(F.lit('{"name":"'), "n_name", F.lit('"}'))
    return table(spark, d, "nation").select("n_nationkey", registry.TOOL_PROMPTS.get("hermes")(F.array(tool), F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_name"))).alias("prompt"))


@BOOK.query("""
SELECT row_id, coalesce(messages[-1].role = 'user' AND messages[-1].content LIKE '%?', false) AS generate, CASE WHEN coalesce(messages[-1].role = 'user' AND messages[-1].content LIKE '%?', false) THEN left(messages[-1].content, -1) ELSE messages[-1].content END AS last
FROM (SELECT DISTINCT row_id, messages FROM chatml WHERE len(messages) > 0)""")
def a14_start_mark(spark: SparkSession, d: str) -> DataFrame:
    """A last question's mark as a flag."""
    m = once(spark, d, "chatml", "row_id", ["messages"]).where("size(messages) > 0").withColumn("s", messages.start_image(F.col("messages"), "?"))
    return m.select("row_id", "s.generate", F.try_element_at("s.messages", F.lit(-1))["content"].alias("last"))


@BOOK.query("SELECT row_id, len(regexp_extract_all(output, '\\S+'))::BIGINT AS length FROM (SELECT DISTINCT row_id, output FROM alpaca) WHERE len(regexp_extract_all(coalesce(output, ''), '\\S+')) <= 40 AND output IS NOT NULL")
def a22_length_policy(spark: SparkSession, d: str) -> DataFrame:
    """Outputs by their words, those of more than 40 deleted."""
    a = rows.encoded(once(spark, d, "alpaca", "row_id", ["output"]).where("output is not null"), "output", r"[\t\n\f\r ]+")
    return messages.length_policy(a, "tokens", 40, "delete").select("row_id", "length")


@BOOK.query("""
SELECT row_id, s || chr(10) || instruction || chr(10) || concat_ws('', y, input) || output AS text, CASE WHEN strpos(output, '```python') > 0 THEN left(output, strpos(output, '```python') - 1) ELSE left(output, -1) END AS problem
FROM (SELECT DISTINCT row_id, source AS s, instruction, system AS y, input, output FROM alpaca WHERE output <> '' AND NOT starts_with(output, '# '))""")
def d10_law_and_code(spark: SparkSession, d: str) -> DataFrame:
    """Chapters there are joined, and texts split at the first Python fence."""
    a = once(spark, d, "alpaca", "row_id", ["source", "instruction", "system", "input", "output"]).where("output <> '' and not startswith(output, '# ')")
    c = F.col
    return a.select("row_id", presets.law_text(c("source"), c("instruction"), [c("system"), c("input"), F.lit(None).cast("string")], c("output")).alias("text"), presets.split_problem(c("output"), F.lit("x"))["query"].alias("problem"))


@BOOK.query("""
SELECT row_id, CASE WHEN instruction IS NULL OR output IS NULL THEN 2 WHEN instruction = '' OR output = '' THEN 0 ELSE 4 END AS n, CASE WHEN instruction IS NULL OR output IS NULL OR instruction <> '' AND output <> '' THEN 'end' END AS last
FROM (SELECT DISTINCT row_id, instruction, output FROM alpaca) WHERE NOT regexp_matches(coalesce(instruction, '') || coalesce(output, ''), 'User[:：]|Assistant[:：]')""")
def d20_marked_history(spark: SparkSession, d: str) -> DataFrame:
    """Marked turns of a text as messages; turns without content make the row null."""
    a = once(spark, d, "alpaca", "row_id", ["instruction", "output"]).where(~F.concat(F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit(""))).rlike("User[:：]|Assistant[:：]"))
    m = presets.marked_history(F.concat(F.lit("User:"), "instruction", F.lit("Assistant:"), "output"), F.lit("User: go on "), F.lit("end"))
    return a.select("row_id", F.when(m.isNotNull(), F.size(m)).otherwise(0).alias("n"), F.try_element_at(m, F.lit(-1))["content"].alias("last"))


@BOOK.query("""SELECT (r_regionkey + 1)::BIGINT AS part, CASE WHEN r_regionkey = 0 THEN '[' ELSE '' END || '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' || CASE WHEN r_regionkey = 4 THEN ']' ELSE ',' END AS json FROM region""")
def k03_json_array(spark: SparkSession, d: str) -> DataFrame:
    return _long(files.json_array(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]), "part")


@BOOK.query("SELECT c_custkey, k <= greatest((SELECT floor(count(*) * 0.2) FROM customer), 1) AS is_val FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':0'), c_custkey) AS k FROM customer)")
def k05_saved_split(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of a split written to their folders and read again."""
    base = f"{shared_dir(spark)}/quillgrid/{uuid.uuid4().hex}"
    files.write_split(datasets.split_exact(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.2), base)
    part = lambda n: files.read_splits(spark, base, [n]).select("c_custkey", F.lit(n == "val").alias("is_val"))
    return part("train").unionByName(part("val"))


@BOOK.query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def w07_last_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a rolling buffer of 100 events holds at the end."""
    return groups.last_rows(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 100)


@BOOK.query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\f\\r ]+'))::BIGINT AS length FROM documents")
def p21_encoded(spark: SparkSession, d: str) -> DataFrame:
    return rows.encoded(table(spark, d, "documents").select("doc_id", "text"), "text", r"[\t\n\f\r ]+").select("doc_id", "length")


@BOOK.query("SELECT row_id, least(length(output) / 1000.0, 1.0)::DOUBLE AS score, length(output) || ' characters' AS score_extra FROM (SELECT DISTINCT row_id, output FROM alpaca)")
def x02_extra_output(spark: SparkSession, d: str) -> DataFrame:
    """A reward that gives a trace beside its value."""
    return registry.with_extra(once(spark, d, "alpaca", "row_id", ["output"]), "length_with_trace", "score", ["output"]).select("row_id", "score", "score_extra")


@BOOK.query("SELECT request_id, round(len(regexp_extract_all(lower(completion), '[aeiou]')) / greatest(length(completion), 1), 9)::DOUBLE AS score FROM (SELECT DISTINCT request_id, completion FROM rewards)")
def x04_reward_model(spark: SparkSession, d: str) -> DataFrame:
    """A model made once for each task scores every completion."""
    return once(spark, d, "rewards", "request_id", ["completion"]).select("request_id", F.round(registry.REWARD_MODELS.get("vowel_share")(F.col("completion")), 9).alias("score"))


@BOOK.query("SELECT request_id, coalesce(idx < 3 AND NOT contains(completion, '</answer>'), false) AS goes_on FROM (SELECT DISTINCT request_id, idx, completion FROM rewards)")
def x10_scheduler(spark: SparkSession, d: str) -> DataFrame:
    """A registered rule of whether another turn follows."""
    r = once(spark, d, "rewards", "request_id", ["idx", "completion"])
    return r.select("request_id", F.coalesce(registry.SCHEDULERS.get("until_answer", most=3)(F.col("completion"), F.col("idx")), F.lit(False)).alias("goes_on"))


@BOOK.query("SELECT row_id, array_to_string(list_transform(messages, lambda m, i: CASE WHEN m.role = 'assistant' AND i = len(messages) AND coalesce(m.content, '') <> '' THEN '1' ELSE '0' END), ',') AS weights FROM (SELECT DISTINCT row_id, messages FROM chatml WHERE len(messages) > 0) WHERE NOT list_has_any(list_transform(messages, lambda m: contains(coalesce(m.content, ''), '<think>')), [true])")
def a29_last_round(spark: SparkSession, d: str) -> DataFrame:
    """Only a last reply weighs."""
    m = once(spark, d, "chatml", "row_id", ["messages"]).where("size(messages) > 0 and not exists(messages, m -> contains(coalesce(m.content, ''), '<think>'))")
    total = F.transform(agents.last_round_scales(F.col("messages")), lambda p: F.coalesce(F.aggregate(p, F.lit(0.0), lambda s, x: s + x["scale"]), F.lit(0.0)))
    return m.select("row_id", F.array_join(F.transform(total, lambda w: w.cast("int").cast("string")), ",").alias("weights"))


@BOOK.query("""
SELECT row_id, (coalesce(system, '') <> '')::INT + coalesce(list_sum(list_transform(coalesce(history, []), lambda h: (h[1] IS NOT NULL)::INT + (h[2] IS NOT NULL)::INT)), 0)::INT + 1 + (output IS NOT NULL)::INT AS n,
       concat_ws(chr(10), nullif(instruction, ''), nullif(input, '')) AS asked
FROM (SELECT DISTINCT row_id, instruction, input, output, system, history FROM alpaca)""")
def row17_prepared(spark: SparkSession, d: str) -> DataFrame:
    """Rows prepared by the rules that their columns ask for."""
    a = rows.prepared(once(spark, d, "alpaca", "row_id", ["instruction", "input", "output", "system", "history"]))
    last = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    return a.select("row_id", F.size("messages").alias("n"), last.alias("asked"))


@BOOK.query("""
WITH c AS (SELECT DISTINCT row_id, messages FROM chatml WHERE len(messages) > 0)
SELECT row_id, CASE WHEN messages[1].role = 'system' THEN messages[1].content END AS system, len(messages) - CASE WHEN messages[1].role = 'system' THEN 1 ELSE 0 END AS n, len(list_filter(messages, lambda m: m.role IN ('tool', 'tool_response'))) AS n_tool FROM c""")
def row26_system_and_turns(spark: SparkSession, d: str) -> DataFrame:
    system, turns = rows.system_and_turns(F.col("messages"))
    m = once(spark, d, "chatml", "row_id", ["messages"]).where("size(messages) > 0").select("row_id", system.alias("system"), turns.alias("t"))
    return _long(m.select("row_id", "system", F.size("t").alias("n"), F.size(F.filter("t", lambda x: x["role"] == "tool")).alias("n_tool")), "n", "n_tool")


@BOOK.query("""
WITH h AS (SELECT event_id, ('0x' || substr(md5(event_id || ':5'), 1, 8))::BIGINT AS a, ('0x' || substr(md5(event_id || ':6'), 1, 8))::BIGINT AS b, ('0x' || substr(md5(event_id || ':7'), 1, 8))::BIGINT AS c FROM events)
SELECT event_id, CASE WHEN a % 1000 < 800 THEN (['Where is it?', 'Find it.', 'Mark it.'])[b % 3 + 1] ELSE (['在哪里？', '找到它。'])[c % 2 + 1] END AS prompt FROM h""")
def row20_language_pick(spark: SparkSession, d: str) -> DataFrame:
    """Four of five prompts from one list, the others from another."""
    return table(spark, d, "events").select("event_id", rows.language_pick(["Where is it?", "Find it.", "Mark it."], ["在哪里？", "找到它。"], F.col("event_id"), 5).alias("prompt"))


@BOOK.query("""
WITH e AS (SELECT DISTINCT row_id, response, images FROM multi_modal_2), h AS (SELECT row_id, images, ('0x' || substr(md5(row_id || ':2'), 1, 8))::BIGINT AS a FROM e WHERE len(images) > 0)
SELECT row_id, images[a % len(images) + 1] AS image FROM h""")
def d16_one_of(spark: SparkSession, d: str) -> DataFrame:
    """One of each row's images, drawn."""
    m = once(spark, d, "multi_modal_2", "row_id", ["images"]).where("size(images) > 0")
    return m.select("row_id", rows.one_of(F.col("images"), F.col("row_id"), 2).alias("image"))


@BOOK.query("SELECT row_id, instruction AS query, output AS response FROM (SELECT DISTINCT row_id, instruction, output, source FROM alpaca WHERE source IN ('qa', 'manual') OR source LIKE '%a%')")
def d07_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of the rows of some kinds."""
    a = once(spark, d, "alpaca", "row_id", ["instruction", "output", "source"])
    kinds = [r[0] for r in a.select("source").distinct().where("source in ('qa', 'manual') or contains(source, 'a')").collect()]  # as many as sources
    return rows.query_and_response(rows.kept_kinds(a, "source", kinds), "instruction", "output", ["row_id"])


@BOOK.query("SELECT row_id, 'Describe the table.' AS asked, string_split(response, '。')[1] AS told FROM (SELECT DISTINCT row_id, response FROM multi_modal_2) WHERE coalesce(string_split(response, '。')[1], '') <> ''")
def d23_captions(spark: SparkSession, d: str) -> DataFrame:
    """A fixed question with the first part of each response."""
    m = rows.captioned(once(spark, d, "multi_modal_2", "row_id", ["response"]), "Describe the table.", presets.first_of(F.col("response"), "。"), ["row_id"])
    return m.select("row_id", F.get("messages", F.lit(0))["content"].alias("asked"), F.get("messages", F.lit(1))["content"].alias("told"))


@BOOK.query("""
SELECT request_id, 'Q: ' || coalesce(solution, '') || ' A: ' || coalesce(completion, '') AS prompt, CASE WHEN r_qa IS NULL THEN NULL WHEN idx % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS reward
FROM (SELECT DISTINCT request_id, completion, solution, r_qa, idx FROM rewards)""")
def a39_process_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of a process reward, and its number read from a reply with emphasis."""
    r = once(spark, d, "rewards", "request_id", ["completion", "solution", "r_qa", "idx"])
    reply = F.when(F.col("r_qa").isNotNull(), F.concat(F.lit("It is so.\n**Reward:** "), F.when(F.col("idx") % 2 == 0, "0.5").otherwise("1")))
    return r.select("request_id", rewards.process_prompt("Q: {query} A: {ground_truth}", F.col("solution"), F.col("completion")).alias("prompt"), rewards.process_reward(reply).alias("reward"))


@BOOK.query("""
SELECT n_nationkey, n_regionkey || chr(10) || chr(10) || '# Tools' || chr(10) || chr(10) || '## You have access to the following tools:' || chr(10) || chr(10) || '### ' || n_name || chr(10) || chr(10) || n_name || ': of ' || n_regionkey
       || ' Parameters: {"a": [1, 2]} Format the arguments as a JSON object.' || chr(10) || chr(10)
       || '## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:' || chr(10) || chr(10)
       || '✿FUNCTION✿: The tool to use, should be one of [' || n_name || ']' || chr(10) || '✿ARGS✿: The input of the tool' || chr(10) || '✿RESULT✿: Tool results' || chr(10)
       || '✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)' AS prompt FROM nation""")
def a36_described_tools(spark: SparkSession, d: str) -> DataFrame:
    tool = F.concat(F.lit('{"type": "function", "function": {"name": "'), "n_name", F.lit('", "description": "of '), F.col("n_regionkey").cast("string"), F.lit('", "parameters": {"a":[1,2]}}}'))
    return table(spark, d, "nation").select("n_nationkey", registry.TOOL_PROMPTS.get("marked_en")(F.array(tool), F.col("n_regionkey").cast("string")).alias("prompt"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
