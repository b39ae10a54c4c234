"""Metrics over labels, embeddings, rankings, channels and log-probabilities."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .packs import group_row_numbers, running_sum


def mean_metric(df: DataFrame, value: str, nan_value: float = 0.0) -> DataFrame:
    """Mean of the values; `nan_value` for none."""
    return df.agg(F.coalesce(F.avg(value), F.lit(nan_value)).alias("value"))


def token_accuracy(preds: Column, labels: Column) -> tuple[Column, Column]:
    """(correct tokens, counted tokens) with labels shifted by one and -100 left out."""
    p, l = F.slice(preds, F.lit(1), F.size(preds) - 1), F.slice(labels, F.lit(2), F.size(labels) - 1)
    z = F.filter(F.arrays_zip(p.alias("p"), l.alias("l")), lambda x: x["l"] != -100)
    return F.size(F.filter(z, lambda x: x["p"] == x["l"])), F.size(z)


def exact_match(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def value_stats(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("size")]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distances(a: Column, b: Column) -> dict[str, Column]:
    """Cosine and dot product, and Manhattan and Euclidean distances with their sign turned."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    fold = lambda f: F.aggregate(diff, F.lit(0.0), lambda s, x: s + f(x))
    return {"cosine": dot(a, b) / (norm(a) * norm(b)), "manhattan": -fold(F.abs), "euclidean": -F.sqrt(fold(lambda x: x * x)), "dot": dot(a, b)}


def paired_rows(df: DataFrame, index: str, embedding: str, label: str) -> DataFrame:
    """Rows 2k and 2k+1 side by side: (pair, a, b, label); the label of the first."""
    k = F.floor(F.col(index) / 2)
    even = df.where(F.col(index) % 2 == 0).select(k.alias("pair"), F.col(embedding).alias("a"), F.col(label).alias("label"))
    return even.join(df.where(F.col(index) % 2 == 1).select(k.alias("pair"), F.col(embedding).alias("b")), "pair")


def distributed_rank(df: DataFrame, value: str) -> DataFrame:
    """`df` with `rank` (ties averaged) without a global window: counts of distinct values are
    summed by range partition first."""
    counts = stored(df.groupBy(value).agg(F.count("*").alias("__n")).repartitionByRange(value).withColumn("__p", F.spark_partition_id()))
    totals = counts.groupBy("__p").agg(F.sum("__n").alias("__t"))
    before = totals.withColumn("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("__i", inner).join(before.select("__p", "__b"), "__p").select(F.col(value), (F.col("__b") + F.col("__i") + (F.col("__n") + 1) / 2.0).alias("rank"))
    return df.join(ranks, value)


def reranker_groups(df: DataFrame, order: str, label: str, shard: list[str]) -> DataFrame:
    """`df` with `group`: a group begins at each positive label, within a shard. Hot shards are split."""
    return running_sum(df, shard, [order], F.coalesce(F.col(label), F.lit(0)).cast("bigint"), "group")


def mrr_ndcg(df: DataFrame, group: list[str], score: str, label: str, order: str) -> DataFrame:
    """One row (mrr, ndcg, n_groups) over groups of two or more rows with a positive.

    Ranks by score and by label come from range partitions, so that no task sorts a hot group.
    """
    kept = df.select(*group, score, label, order)
    last_first = lambda c: {"__null": F.col(c).isNull(), "__down": -F.col(c).cast("double")}
    ranked = lambda t, c, name: group_row_numbers(t.withColumns(last_first(c)), group, ["__null", "__down", order]).drop("__null", "__down").withColumnRenamed("rn", name)
    r = ranked(ranked(kept, score, "k"), label, "ideal")
    gain = lambda at: (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col(at) + 1.0)
    g = r.groupBy(*group).agg(F.count("*").alias("n"), F.max(F.when(F.col(label) > 0, 1.0 / F.col("k"))).alias("rr"), F.sum(gain("k")).alias("dcg"), F.sum(gain("ideal")).alias("idcg"))
    return g.where("n > 1 and idcg > 0").agg(F.avg("rr").alias("mrr"), F.avg(F.col("dcg") / F.col("idcg")).alias("ndcg"), F.count("*").alias("n_groups"))


def channel_means(df: DataFrame, channel: str, losses: str, labels: str) -> DataFrame:
    """Mean loss of the unmasked tokens of each channel."""
    z = df.select(channel, F.explode(F.arrays_zip(losses, labels)).alias("z")).where(F.col(f"z.{labels}") != -100)
    return z.groupBy(channel).agg(F.avg(f"z.{losses}").alias("loss"))


def smoothed(values: Column, weight: float = 0.9) -> Column:
    """Exponential smoothing with bias correction of an array in order."""
    start = F.struct(F.lit(0.0).alias("last"), F.lit(1.0).alias("decay"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"] * weight + x * (1 - weight)
        decay = acc["decay"] * weight
        return F.struct(last.alias("last"), decay.alias("decay"), F.concat(acc["out"], F.array(last / (1 - decay))).alias("out"))

    return F.aggregate(values, start, step, lambda a: a["out"])


def token_objective(new: Column, old: Column, ref: Column, advantage: Column, low: float = 0.2, high: float = 0.2, beta: float = 0.04) -> Column:
    """Per-token loss: clipped ratio times advantage, with the k3 divergence from the reference."""
    z = F.arrays_zip(new.alias("n"), old.alias("o"), ref.alias("r"))

    def loss(t: Column) -> Column:
        ratio = F.exp(t["n"] - t["o"])
        kl = F.exp(t["r"] - t["n"]) - (t["r"] - t["n"]) - 1
        gain = F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * advantage)
        return -gain + beta * kl

    return F.transform(z, loss)


def info_nce(query: Column, candidates: Column, temperature: float = 0.1) -> Column:
    """Cross entropy of the first candidate among all, by cosine."""
    sims = F.transform(candidates, lambda c: dot(query, c) / (norm(query) * norm(c)) / temperature)
    top = F.array_max(sims)
    total = F.aggregate(sims, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.ln(total) + top - F.get(sims, F.lit(0))


def contrastive(distance: Column, label: Column, margin: float = 0.5) -> Column:
    return 0.5 * (label * distance * distance + (1 - label) * F.pow(F.greatest(margin - distance, F.lit(0.0)), 2))


def ngram_counts(a: Column, b: Column, n: int) -> tuple[Column, Column, Column]:
    """(common, n-grams of a, n-grams of b) of word arrays, with counts."""
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))
    ga, gb = grams(a), grams(b)
    count = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    return F.aggregate(F.array_distinct(ga), F.lit(0), lambda s, x: s + F.least(count(ga, x), count(gb, x))), F.size(ga), F.size(gb)


def rouge_n(a: Column, b: Column, n: int) -> Column:
    """F-measure of n-grams; 0 without any in common."""
    common, na, nb = ngram_counts(a, b, n)
    return F.when(common > 0, 2.0 * common / (na + nb)).otherwise(0.0)


def _lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _bleu(hyp: list, ref: list) -> float:
    """Sentence BLEU-4, missing orders smoothed by halving (public method 3)."""
    if not hyp or not ref:
        return 0.0
    logs, invcnt = 0.0, 1
    for n in range(1, 5):
        h, r = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1)), Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hit, total = sum((h & r).values()), max(1, sum(h.values()))
        if n == 1 and not hit:
            return 0.0
        if not hit:
            invcnt += 1
        logs += math.log(hit / total if hit else 1 / (2 ** (invcnt - 1) * total)) / 4
    return math.exp(logs + min(0.0, 1 - len(ref) / len(hyp)))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("rouge1", "rouge2", "rougel", "bleu4")]))
def rouge_bleu(pred: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """ROUGE over words (characters in Chinese) and BLEU over characters, times 100; null where a text is empty."""

    def words(t: str) -> list[str]:
        return re.findall(r"[㐀-鿿]|[^\W_]+", t.lower())

    def f1(common: int, a: int, b: int) -> float:
        return 200.0 * common / (a + b) if common else 0.0

    out = []
    for p, t in zip(pred, truth):
        if not p or not t or not words(p) or not words(t):
            out.append((None,) * 4)
            continue
        a, b = words(p), words(t)
        scores = []
        for n in (1, 2):
            x, y = Counter(zip(*[a[i:] for i in range(n)])), Counter(zip(*[b[i:] for i in range(n)]))
            scores.append(f1(sum((x & y).values()), sum(x.values()), sum(y.values())))
        out.append((*scores, f1(_lcs(a, b), len(a), len(b)), 100 * _bleu(list(p), list(t))))
    return pd.DataFrame(out, columns=["rouge1", "rouge2", "rougel", "bleu4"]).astype("float64").round(6)


@F.pandas_udf(T.DoubleType())
def median_of(values: pd.Series) -> float:
    """A grouped metric with its own state, as a pattern for others."""
    return float(values.median()) if len(values) else 0.0


def usage_stats(df: DataFrame, key: str, order: str, seconds: float) -> DataFrame:
    """Last usage of each id, summed, and rates over a time."""
    last = df.groupBy(key).agg(F.max_by(F.struct("prompt_tokens", "completion_tokens"), order).alias("u"))
    s = last.agg(F.sum("u.prompt_tokens").alias("prompt_tokens"), F.sum("u.completion_tokens").alias("completion_tokens"), F.count("*").alias("samples"))
    return s.withColumns({"samples_per_s": F.col("samples") / seconds, "tokens_per_s": F.col("completion_tokens") / seconds})


def margin_metrics(df: DataFrame, group: list[str], anchor: str, kind: str, embedding: str) -> DataFrame:
    """One row (margin, mean_pos, mean_neg) of groups with an anchor (kind 0), a positive (1) and negatives (2).

    Similarities are dot products within a group; the margin is the positive's less the best negative's.
    """
    a = df.where(F.col(kind) == 0).select(*group, F.col(embedding).alias("__a"))
    sims = df.where(F.col(kind) > 0).join(a, group).select(*group, kind, dot(F.col("__a"), F.col(embedding)).alias("s"))
    per = sims.groupBy(*group).agg(F.max(F.when(F.col(kind) == 1, F.col("s"))).alias("p"), F.max(F.when(F.col(kind) == 2, F.col("s"))).alias("n"), F.sum(F.when(F.col(kind) == 2, F.col("s"))).alias("t"), F.count_if(F.col(kind) == 2).alias("k"))
    return per.agg(F.avg(F.col("p") - F.col("n")).alias("margin"), F.avg("p").alias("mean_pos"), (F.sum("t") / F.sum("k")).alias("mean_neg"))


def best_flags(df: DataFrame, group: list[str], value: str, lowest: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """`df` with `is_best` within each group."""
    best = df.groupBy(*group).agg((F.min if lowest else F.max)(value).alias("__best"))
    return df.join(best, group).withColumn("is_best", F.abs(F.col(value) - F.col("__best")) <= tolerance).drop("__best")


def status_counts(df: DataFrame, group: list[str], status: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.count_if(F.col(status) == k).alias(k) for k in kinds])


def reduced_loss(losses: Column, mask: Column) -> Column:
    """Mean of a row's unmasked token losses; 0 without any."""
    kept = F.filter(F.arrays_zip(losses.alias("l"), mask.alias("m")), lambda x: x["m"] > 0)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["l"]) / F.size(kept)).otherwise(0.0)


class Metric:
    """A metric of one's own: named states, each an aggregate, and a value computed from them.

    States are combined map-side by Spark's own partial aggregation, so that a metric over any
    groups is one shuffle of its states.
    """

    def __init__(self, compute: Callable[..., Column]):
        self.states: dict[str, Callable[..., Column]] = {}
        self.compute = compute

    def add_state(self, name: str, update: Callable[..., Column]) -> Metric:
        """A state: `update` gives its aggregate over the metric's columns."""
        self.states[name] = update
        return self

    def reset(self) -> None:
        self.states.clear()

    def over(self, df: DataFrame, columns: list[str], group: list[str] | None = None, name: str = "value") -> DataFrame:
        """(group ..., name) of the metric over columns of `df`; without groups one row."""
        kept = df.groupBy(*(group or [])).agg(*[f(*map(F.col, columns)).alias(f"__{n}") for n, f in self.states.items()])
        return kept.select(*(group or []), self.compute(**{n: F.col(f"__{n}") for n in self.states}).alias(name))


def reduced_losses(df: DataFrame, losses: str, mask: str, longest: int) -> DataFrame:
    """One row (by_row, by_token, by_length): token losses as the mean of the rows' means, over all
    unmasked tokens, and by the number of rows times the longest completion; 0 without any."""
    z = F.filter(F.arrays_zip(F.col(losses).alias("l"), F.col(mask).alias("m")), lambda x: x["m"] > 0)
    rows = df.select(F.aggregate(z, F.lit(0.0), lambda s, x: s + x["l"]).alias("s"), F.size(z).alias("n"))
    over = lambda a, b: F.coalesce(F.try_divide(a, F.greatest(b, F.lit(1))), F.lit(0.0))
    mean = F.avg(F.col("s") / F.greatest(F.col("n"), F.lit(1)))
    return rows.agg(F.coalesce(mean, F.lit(0.0)).alias("by_row"), over(F.sum("s"), F.sum("n")).alias("by_token"), over(F.sum("s"), F.count("*") * longest).alias("by_length"))


def reranker_loss(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, in the form that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def listwise_loss(df: DataFrame, group: list[str], logit: str, label: str, temperature: float = 1.0, least: int = 2) -> DataFrame:
    """One row (loss, n_groups): the mean cross entropy of each group's positive among all of the group.

    Groups with fewer than `least` rows or without exactly one positive don't count. The
    largest logit is taken off first, and sums are aggregated map-side.
    """
    x = F.col(logit) / temperature
    top = df.groupBy(*group).agg(F.max(x).alias("__top"), F.count("*").alias("__n"), F.max(F.when(F.col(label) == 1, x)).alias("__p"), F.count_if(F.col(label) == 1).alias("__k")).where((F.col("__n") >= least) & (F.col("__k") == 1))
    per = df.join(top, group).groupBy(*group).agg((F.ln(F.sum(F.exp(x - F.col("__top")))) + F.first("__top") - F.first("__p")).alias("l"))
    return per.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("loss"), F.count("*").alias("n_groups"))


def top_logprobs(values: Column, k: int) -> Column:
    """The k largest log-probabilities, the largest first; minus infinity and NaN are dropped."""
    there = F.filter(values, lambda x: ~F.isnan(x) & (x > float("-inf")))
    return F.slice(F.sort_array(there, False), 1, k)


def mean_choice(values: Column) -> Column:
    """Mean of the parsed scores of several choices; 0 where none could be parsed."""
    there = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there)), F.lit(0.0))


def judged(judge: Column, verified: Column) -> Column:
    """The better of a judge's verdict and a verified score; a missing one counts as 0."""
    return F.greatest(F.coalesce(judge, F.lit(0.0)), F.coalesce(verified, F.lit(0.0)))
