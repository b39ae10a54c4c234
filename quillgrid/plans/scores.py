"""Queries of rewards, group statistics and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import groups, metrics, rewards
from ..session import table
from .base import Book, once

BOOK = Book()
REWARDS = "(SELECT DISTINCT request_id, prompt_id, idx, completion, solution, r_teds, r_qa, r_format FROM rewards)"


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "rewards", "request_id", ["prompt_id", "idx", "completion", "solution", "r_teds", "r_qa", "r_format"])


@BOOK.query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS format FROM documents""")
def r01_format(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "<", "(").alias("t"))
    good = F.concat(F.lit("<think>"), F.col("t"), F.lit("</think>\n<answer>"), F.col("t"), F.lit("</answer>"))
    text = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, F.concat(good, F.lit("\n"))).otherwise(F.concat(F.lit(" "), good))
    return docs.select("doc_id", rewards.format_reward(text).alias("format"))


@BOOK.query("""
WITH w AS (SELECT request_id, list_filter(regexp_split_to_array(lower(coalesce(completion, '')), '\\s+'), lambda x: x <> '') AS w FROM """ + REWARDS + """),
g AS (SELECT request_id, len(w) AS n, len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]))) AS u FROM w)
SELECT request_id, round(CASE WHEN n < 3 THEN 0.0 ELSE (1 - u / (n - 2)) * -1.0 END, 9)::DOUBLE AS penalty FROM g""")
def r02_repetition(spark: SparkSession, d: str) -> DataFrame:
    return _rewards(spark, d).select("request_id", F.round(rewards.repetition_penalty(F.col("completion"), 3, -1.0), 9).alias("penalty"))


@BOOK.query("SELECT doc_id, round(least(-(n_chars - 1500) / 500, 0.0), 9)::DOUBLE AS reward FROM documents WHERE n_chars IS NOT NULL")
def r03_overlong(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", F.round(rewards.soft_overlong(F.col("n_chars"), 2000, 500), 9).alias("reward"))


@BOOK.query("""
SELECT doc_id, round(CASE WHEN lang = 'en' THEN 0.5 + 0.25 * (1 + cos(pi() * least(n_chars, 4000) / 4000)) ELSE -0.25 * (1 + cos(pi() * least(n_chars, 4000) / 4000)) END, 6)::DOUBLE AS reward FROM documents WHERE n_chars IS NOT NULL""")
def r04_cosine(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars is not null")
    return docs.select("doc_id", F.round(rewards.cosine_reward(F.coalesce(F.col("lang") == "en", F.lit(False)), F.least("n_chars", F.lit(4000)), 4000), 6).alias("reward"))


@BOOK.query("""
WITH p AS (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part), c AS (SELECT id, 0 AS side, unnest(string_split(a, '')) AS ch FROM p UNION ALL SELECT id, 1, unnest(string_split(b, '')) FROM p),
n AS (SELECT id, ch, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT id AS p_partkey, round(2.0 * sum(least(x, y)) / sum(x + y), 9)::DOUBLE AS f1 FROM n GROUP BY 1""")
def r05_char_f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(rewards.char_f1(F.col("p_name"), F.col("p_type")), 9).alias("f1"))


@BOOK.query(f"SELECT prompt_id, round(sum(CASE WHEN r_teds IS NULL OR r_teds::VARCHAR = 'nan' THEN 0.0 ELSE r_teds END + 0.5 * CASE WHEN r_format IS NULL OR r_format::VARCHAR = 'nan' THEN 0.0 ELSE r_format END), 4)::DOUBLE AS reward, count(*) AS n FROM {REWARDS} GROUP BY 1")
def r06_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    r = _rewards(spark, d).withColumn("r", groups.weighted_reward({"r_teds": 1.0, "r_format": 0.5}))
    return r.groupBy("prompt_id").agg(F.round(F.sum("r"), 4).alias("reward"), F.count("*").alias("n"))


@BOOK.query(f"SELECT request_id, coalesce(trim(completion, ' ' || chr(10) || chr(9) || chr(13)) = trim(solution, ' ' || chr(10) || chr(9) || chr(13)), false)::INT::DOUBLE AS answer, 0.0::DOUBLE AS format FROM {REWARDS}")
def r07_registry(spark: SparkSession, d: str) -> DataFrame:
    """Named rewards taken from the registry."""
    r = _rewards(spark, d).withColumns({"completion": F.regexp_replace("completion", "<answer>", ""), "solution": F.col("solution")})
    return registry.scored(r, {"answer": ("answer", ["completion", "solution"]), "format": ("format", ["completion"])}).select("request_id", "answer", "format")


@BOOK.query()
def r08_arrow_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Calculator, countdown and math over numbers of the line items."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("bigint").alias("n"))
    e = F.concat("q", F.lit("*("), "n", F.lit("+2)"))
    text = F.concat(F.lit("<answer>"), e, F.lit("</answer>"))
    return li.select("l_orderkey", "l_linenumber", rewards.calculator(e).alias("value"), rewards.countdown_reward(text, F.col("q") * (F.col("n") + 2), F.array("q", "n", F.lit(2).cast("bigint"))).alias("countdown"), rewards.math_reward(F.concat(F.lit("\\boxed{"), "q", F.lit("}")), F.col("q").cast("string")).alias("math"))


@BOOK.query(f"""
SELECT request_id, round((r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-4), 5)::DOUBLE AS advantage FROM (SELECT request_id, prompt_id, CASE WHEN r_teds IS NULL OR r_teds::VARCHAR = 'nan' THEN 0.0 ELSE r_teds END AS r FROM {REWARDS}) WINDOW w AS (PARTITION BY prompt_id)""")
def g01_advantage(spark: SparkSession, d: str) -> DataFrame:
    r = _rewards(spark, d).withColumn("r", groups.weighted_reward({"r_teds": 1.0}))
    return groups.advantages(r, ["prompt_id"], "r").select("request_id", F.round("advantage", 5).alias("advantage"))


@BOOK.query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def g02_last_request(spark: SparkSession, d: str) -> DataFrame:
    return groups.last_of(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@BOOK.query("WITH g AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY l_orderkey) SELECT round(avg(m), 5)::DOUBLE AS reward, round(avg(s), 5)::DOUBLE AS reward_std, round(avg(CASE WHEN s IS NULL THEN NULL WHEN abs(s) <= 1e-8 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS frac_zero_std FROM g")
def g03_reward_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = groups.reward_metrics(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    return m.select(F.round("reward", 5).alias("reward"), F.round("reward_std", 5).alias("reward_std"), F.round("frac_zero_std", 6).alias("frac_zero_std"))


@BOOK.query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC) AS rank, first_value(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS worst FROM lineitem)
SELECT * FROM r WHERE rank <= 2""")
def g04_best_of_n(spark: SparkSession, d: str) -> DataFrame:
    b = groups.best_of_n(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", "l_linenumber", 2)
    return b.select("l_orderkey", "l_linenumber", "l_quantity", F.col("rank").cast("bigint").alias("rank"), "worst")


@BOOK.query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS rejected, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linenumber) AS rank FROM lineitem) WHERE rank <= 3""")
def g05_rejection(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("rejected"))
    return groups.rejection_sample(li, "l_orderkey", "l_linenumber", "rejected", 3).withColumn("rank", F.col("rank").cast("bigint"))


@BOOK.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING stddev_samp(l_quantity) > 0) ORDER BY l_orderkey, l_linenumber LIMIT 500")
def g06_dynamic(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return groups.dynamic_sample(li, "l_orderkey", "l_quantity", ["l_orderkey", "l_linenumber"], 500).select("l_orderkey", "l_linenumber")


@BOOK.query(f"SELECT prompt_id AS prompt, dense_rank() OVER (ORDER BY first) - 1 AS prompt_no FROM (SELECT prompt_id, min(request_id) AS first FROM {REWARDS} GROUP BY 1)")
def g07_prompt_id(spark: SparkSession, d: str) -> DataFrame:
    r = _rewards(spark, d).select(F.col("prompt_id").alias("prompt"), "request_id")
    return groups.prompt_ids(r, "prompt", "request_id").select("prompt", F.col("prompt_id").cast("bigint").alias("prompt_no"))


@BOOK.query("SELECT l_orderkey, l_linenumber, round(CASE WHEN hi = lo THEN least(1.0, l_quantity) ELSE (l_quantity - lo) / (hi - lo + 1e-5) END, 6)::DOUBLE AS normalized FROM lineitem JOIN (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) USING (l_orderkey)")
def g08_min_max(spark: SparkSession, d: str) -> DataFrame:
    m = groups.min_max(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")
    return m.select("l_orderkey", "l_linenumber", F.round("normalized", 6).alias("normalized"))


@BOOK.query(f"SELECT count(*) AS total, count(*) FILTER (completion IS NULL OR NOT regexp_matches(completion, '<nl>\\s*$')) AS rejected FROM {REWARDS}")
def g09_tail_rejection(spark: SparkSession, d: str) -> DataFrame:
    r = _rewards(spark, d).withColumn("rejected", F.coalesce(groups.tail_rejected(F.col("completion"), "<nl>"), F.lit(True)))
    return groups.rejection_stats(r, "rejected").select("total", "rejected")


@BOOK.query("""
WITH RECURSIVE t AS (SELECT l_orderkey AS tree_id, l_linenumber AS node_id, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END AS parent_id, l_quantity AS r FROM lineitem),
p(tree_id, node_id, n, total, least) AS (SELECT tree_id, node_id, 1, r, r FROM t WHERE parent_id IS NULL UNION ALL SELECT c.tree_id, c.node_id, p.n + 1, p.total + c.r, least(p.least, c.r) FROM t c JOIN p ON c.tree_id = p.tree_id AND c.parent_id = p.node_id)
SELECT tree_id, node_id, round(total / n, 6)::DOUBLE AS mean_reward, least AS min_reward FROM p WHERE node_id >= 4""")
def g10_tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Line items as heap-shaped trees of their orders."""
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").alias("node_id"), F.when(F.col("l_linenumber") > 1, F.floor(F.col("l_linenumber") / 2).cast("int")).alias("parent_id"), F.col("l_quantity").alias("process_reward"), (F.col("l_linenumber") >= 4).alias("terminated"))
    return groups.path_rewards(n).select("tree_id", "node_id", F.round("mean_reward", 6).alias("mean_reward"), "min_reward")


@BOOK.query("""
WITH k AS (SELECT l_orderkey AS tree_id, l_linenumber AS node_id, l_linenumber // 2 AS parent_id, l_quantity AS r FROM lineitem WHERE l_linenumber > 1)
SELECT tree_id, parent_id, arg_max(node_id, r * 100 + node_id) AS best, arg_min(node_id, r * 100 + node_id) AS worst FROM k GROUP BY 1, 2 HAVING max(r) - min(r) > 10""")
def g11_tree_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").alias("node_id"), F.when(F.col("l_linenumber") > 1, F.floor(F.col("l_linenumber") / 2).cast("int")).alias("parent_id"), F.col("l_quantity").alias("process_reward"))
    return groups.tree_pairs(n, 10)


@BOOK.query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def g12_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """The steps of a request, here the few lines of an order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    t = groups.trajectories(li, wanted, "l_orderkey", "l_linenumber")
    return t.select("l_orderkey", F.array_join(F.transform("steps", lambda s: s["l_partkey"].cast("string")), ",").alias("steps"))


@BOOK.query("SELECT avg((label = vec_id % 10)::INT)::DOUBLE AS accuracy FROM embeddings")
def m01_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exact_match(table(spark, d, "embeddings").withColumn("p", F.col("vec_id") % 10), "p", "label")


@BOOK.query("SELECT source, round(avg(n_chars), 4)::DOUBLE AS mean, round(stddev_pop(n_chars), 4)::DOUBLE AS std, min(n_chars) AS min, max(n_chars) AS max, count(n_chars) AS size FROM documents GROUP BY 1")
def m02_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(*metrics.value_stats("n_chars"))
    return s.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@BOOK.query("""
WITH p AS (SELECT a.vec_id // 2 AS pair, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT pair, round(list_cosine_similarity(x, y), 5)::DOUBLE AS cosine, round(-list_distance(x, y), 5)::DOUBLE AS euclidean, round(list_inner_product(x, y), 5)::DOUBLE AS dot,
 round(-list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))), 5)::DOUBLE AS manhattan FROM p""")
def m03_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.paired_rows(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return p.select("pair", *[F.round(c, 5).alias(n) for n, c in metrics.distances(F.col("a"), F.col("b")).items()])


@BOOK.query("""
WITH p AS (SELECT a.vec_id // 2 AS pair, a.embedding[1]::DOUBLE AS x, b.embedding[1]::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, x, y FROM p)
SELECT round(corr(x, y), 6)::DOUBLE AS pearson, round(corr(rx, ry), 6)::DOUBLE AS spearman FROM r""")
def m06_correlation(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.paired_rows(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    p = p.select("pair", F.get("a", F.lit(0)).cast("double").alias("x"), F.get("b", F.lit(0)).cast("double").alias("y"))
    r = metrics.distributed_rank(metrics.distributed_rank(p, "x").withColumnRenamed("rank", "rx"), "y").withColumnRenamed("rank", "ry")
    return r.agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@BOOK.query("""
WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events),
g AS (SELECT *, sum(label) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
r AS (SELECT user_id, grp, label, row_number() OVER (PARTITION BY user_id, grp ORDER BY value DESC, event_id) AS k, row_number() OVER (PARTITION BY user_id, grp ORDER BY label DESC, event_id) AS i FROM g),
s AS (SELECT count(*) AS n, max(CASE WHEN label > 0 THEN 1.0 / k END) AS rr, sum((2 ** label - 1) / log2(k + 1)) AS dcg, sum((2 ** label - 1) / log2(i + 1)) AS idcg FROM r GROUP BY user_id, grp)
SELECT round(avg(rr), 6)::DOUBLE AS mrr, round(avg(dcg / idcg), 6)::DOUBLE AS ndcg, count(*) AS n_groups FROM s WHERE n > 1 AND idcg > 0""")
def m04_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").cast("int").alias("label"))
    m = metrics.mrr_ndcg(metrics.reranker_groups(e, "event_id", "label", ["user_id"]), ["user_id", "group"], "value", "label", "event_id")
    return m.select(F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), "n_groups")


@BOOK.query("SELECT event_type, round(avg(value), 6)::DOUBLE AS loss FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def m05_channel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.array("value").alias("losses"), F.array(F.when(F.col("user_id") % 2 == 0, 1).otherwise(-100)).alias("labels"))
    return metrics.channel_means(e, "event_type", "losses", "labels").select("event_type", F.round("loss", 6).alias("loss"))


@BOOK.query("""
SELECT vec_id, k, round(list_sum(list_transform(range(1, k + 1), lambda j: 0.1 * embedding[j]::DOUBLE * power(0.9, k - j))) / (1 - power(0.9, k)), 5)::DOUBLE AS smoothed FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)""")
def m07_smoothing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    s = e.select("vec_id", F.posexplode(metrics.smoothed(F.col("v"))).alias("k", "s"))
    return s.select("vec_id", (F.col("k") + 1).cast("bigint").alias("k"), F.round("s", 5).alias("smoothed"))


@BOOK.query("""
SELECT vec_id, len(list_filter(range(1, 64), lambda i: CASE WHEN embedding[i + 1] < -1 THEN false ELSE (embedding[i] > 0) = (embedding[i + 1] > 0) END)) AS hits, len(list_filter(range(1, 64), lambda i: embedding[i + 1] >= -1)) AS counted FROM embeddings""")
def m08_token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    sign = lambda x: F.when(x > 0, 1).otherwise(0)
    preds, labels = F.transform("embedding", sign), F.transform("embedding", lambda x: F.when(x < -1, -100).otherwise(sign(x)))
    hits, counted = metrics.token_accuracy(preds, labels)
    return table(spark, d, "embeddings").select("vec_id", hits.cast("bigint").alias("hits"), counted.cast("bigint").alias("counted"))


@BOOK.query("""
WITH t AS (SELECT vec_id, unnest(range(1, 64)) AS i, embedding FROM embeddings),
l AS (SELECT vec_id, i, embedding[i]::DOUBLE / 10 AS n, embedding[i + 1]::DOUBLE / 10 AS o FROM t)
SELECT vec_id, round(sum(-least(exp(n - o) * 0.5, least(greatest(exp(n - o), 0.8), 1.2) * 0.5) + 0.04 * (exp(o - n) - (o - n) - 1)), 5)::DOUBLE AS loss FROM l GROUP BY 1""")
def m09_token_objective(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: F.transform(F.slice("embedding", k, 63), lambda x: x.cast("double") / 10)
    loss = metrics.token_objective(part(1), part(2), part(2), F.lit(0.5))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(loss, F.lit(0.0), lambda s, x: s + x), 5).alias("loss"))


@BOOK.query()
def m10_rouge_bleu(spark: SparkSession, d: str) -> DataFrame:
    return _rewards(spark, d).select("request_id", metrics.rouge_bleu("completion", "solution").alias("m")).select("request_id", "m.*")


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
