"""Statistics and selections within groups of completions, best-of-n, rejection and dynamic sampling."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .packs import row_numbers
from .rewards import char_f1


def weighted_reward(rewards: dict[str, float]) -> Column:
    """Sum of weight * reward; null and NaN count as 0, also where all are missing."""
    return reduce(add, [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) * w for c, w in rewards.items()])


def all_missing(rewards: list[str]) -> Column:
    return F.forall(F.array(*rewards), lambda r: r.isNull() | F.isnan(r))


def advantages(df: DataFrame, group: list[str], reward: str, scale: bool = True) -> DataFrame:
    """`df` with `advantage`: reward less its group's mean, by the group's sample deviation + 1e-4.

    A group of one has no deviation, and its advantage is null. Group sums are pre-aggregated
    and joined back, so that a hot group is never sorted or gathered in one task.
    """
    stats = df.groupBy(*group).agg(F.avg(reward).alias("__m"), F.stddev_samp(reward).alias("__s"))
    same = reduce(lambda a, b: a & b, [F.col(f"__l.{g}").eqNullSafe(F.col(f"__r.{g}")) for g in group])
    out = df.alias("__l").join(stats.alias("__r"), same, "left")
    value = F.col(reward) - F.col("__m")
    return out.select("__l.*", (value / (F.col("__s") + 1e-4) if scale else value).alias("advantage"))


def last_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest `order` of each key, without a sort: a struct maximum, aggregated map-side."""
    rest = [c for c in df.columns if c not in key and c != order]
    best = df.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("__b"))
    return best.select(*key, f"__b.{order}", *[f"__b.{c}" for c in rest])


def reward_metrics(df: DataFrame, group: str, reward: str) -> DataFrame:
    """One row: mean of the group means, mean of the group deviations, share of groups without deviation."""
    g = df.groupBy(group).agg(F.avg(reward).alias("m"), F.stddev_samp(reward).alias("s"))
    return g.agg(F.avg("m").alias("reward"), F.avg("s").alias("reward_std"), F.avg((F.abs("s") <= 1e-8).cast("double")).alias("frac_zero_std"))


def prompt_ids(df: DataFrame, prompt: str, order: str) -> DataFrame:
    """(prompt, prompt_id): dense ids from 0 in the order of first occurrence (of a unique order value)."""
    first = df.groupBy(prompt).agg(F.min(order).alias("__min"))
    return row_numbers(first, ["__min"]).select(prompt, (F.col("rn") - 1).alias("prompt_id"))


def best_of_n(df: DataFrame, group: str, score: str, order: str, k: int = 1) -> DataFrame:
    """`df` with `rank` and `worst`: the k best of each group by score, later rows first on ties,
    and its worst row's order value. Ranks up to k are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.desc(order)))
    best = df.withColumn("rank", rank).where(F.col("rank") <= k)
    worst = df.groupBy(F.col(group).alias("__g")).agg(F.min(F.struct(score, order)).alias("__w"))
    return best.join(worst, F.col(group).eqNullSafe(F.col("__g"))).withColumn("worst", F.col(f"__w.{order}")).drop("__g", "__w")


def tail_rejected(text: Column, tag: str) -> Column:
    """As written: a text that doesn't end in the tag is rejected (both stripped)."""
    return ~F.regexp_replace(text, r"\s+$", "").endswith(tag.strip())


def tail_rejected_intended(text: Column, tag: str) -> Column:
    """As documented: a text that ends in the tag is rejected."""
    return ~tail_rejected(text, tag)


def probability_rejected(logprobs: Column, last: int, threshold: float) -> Column:
    """All of the last probabilities lie above the threshold; never without log-probabilities."""
    tail = F.slice(logprobs, F.greatest(F.size(logprobs) - last + 1, F.lit(1)), F.lit(last))
    return F.coalesce(F.forall(tail, lambda p: F.exp(p) > threshold) & (F.size(logprobs) > 0), F.lit(False))


def rejection_sample(df: DataFrame, group: str, order: str, rejected: str, keep: int) -> DataFrame:
    """The first `keep` rows of each group, accepted ones first, each kind in order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(rejected).cast("int"), order))
    return df.withColumn("rank", rank).where(F.col("rank") <= keep)


def rejection_stats(df: DataFrame, rejected: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(rejected).alias("rejected"), F.try_divide(F.count_if(rejected).cast("double"), F.count("*")).alias("rate"))


def dynamic_sample(df: DataFrame, group: str, reward: str, order: list[str], size: int, attempt: str | None = None, attempts: int = 3) -> DataFrame:
    """Rows of groups whose reward varies, up to `size` rows in order.

    attempt: a column that numbers the draws from 0; the rows of further draws follow the first
    one's, `attempts` draws at most, and if these don't make `size` rows, the first draw is
    given back as it is. A row number, not a limit, cuts: no task holds all rows.
    """
    tried = df if attempt is None else df.where(F.col(attempt) < attempts)
    varied = tried.groupBy(group).agg(F.stddev_samp(reward).alias("s")).where("s > 0").select(group)
    kept = row_numbers(tried.join(varied, group, "left_semi"), ([attempt] if attempt else []) + order).where(F.col("rn") <= size).drop("rn")
    if attempt is None:
        return kept
    enough = F.broadcast(kept.agg((F.count("*") == size).alias("__enough")))  # one row
    first = df.where(F.col(attempt) == 0).join(enough).where("not __enough")
    return kept.join(enough).where("__enough").unionByName(first).drop("__enough")


def min_max(df: DataFrame, group: str, value: str) -> DataFrame:
    """`df` with `normalized`: min-max within the group, 1e-5 added to the range; constant groups give min(1, value)."""
    s = df.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    out = df.join(s, group)
    scaled = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-5)
    return out.withColumn("normalized", F.when(F.col("__hi") == F.col("__lo"), F.least(F.lit(1.0), F.col(value))).otherwise(scaled)).drop("__lo", "__hi")


def trajectories(df: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """Of the wanted keys, (key, steps): their rows in order."""
    rest = [c for c in df.columns if c != key]
    return df.join(wanted.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("steps"))


def tree_pairs(nodes: DataFrame, gap: float) -> DataFrame:
    """(tree_id, parent_id, best, worst) of parents whose children's rewards differ by more than `gap`."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", "parent_id")
    agg = kids.agg(F.max_by("node_id", F.struct("process_reward", "node_id")).alias("best"), F.min_by("node_id", F.struct("process_reward", "node_id")).alias("worst"), (F.max("process_reward") - F.min("process_reward")).alias("gap"))
    return agg.where(F.col("gap") > gap).select("tree_id", "parent_id", "best", "worst")


def path_rewards(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, mean_reward, min_reward) along the paths from the root to terminal nodes.

    Every node doubles its known stretch of the path in each round by that of the node it has
    come to, so that as many rounds as the logarithm of the depth do; each is a stored table.
    Nodes whose parent is missing, or that lie in a circle, have no path.
    """
    cut = nodes.select("tree_id", "node_id", "terminated", F.col("parent_id").alias("up"), F.lit(1).cast("bigint").alias("n"), F.col("process_reward").alias("total"), F.col("process_reward").alias("least"))
    done = cut.where("up is null")
    state, size = stored(cut), nodes.count()
    while not (open_ := state.where("up is not null")).isEmpty():
        above = state.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("n").alias("__n"), F.col("total").alias("__t"), F.col("least").alias("__l"))
        further = open_.join(above, ["tree_id", "up"]).select(
            "tree_id", "node_id", "terminated", F.col("__up").alias("up"), (F.col("n") + F.col("__n")).alias("n"), (F.col("total") + F.col("__t")).alias("total"), F.least("least", "__l").alias("least")
        )
        # A path of more nodes than there are runs in a circle, and ends nowhere.
        state = stored(further.where(F.col("n") <= size).unionByName(state.where("up is null")))
        done = state.where("up is null")
    return done.where("terminated").select("tree_id", "node_id", (F.col("total") / F.col("n")).alias("mean_reward"), F.col("least").alias("min_reward"))


def uct(value: Column, visits: Column, parent_visits: Column, c: float = 1.4) -> Column:
    """Upper confidence bound of a tree node; unvisited nodes come first."""
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(value + c * F.sqrt(F.ln(parent_visits) / visits))


def turn_totals(df: DataFrame, key: str, turn: str, reward: str) -> DataFrame:
    """(key, n_turns, total_reward, last_reward) of recorded trajectories; null rewards count as
    none, and of several rows of the last turn the largest counts."""
    return df.groupBy(key).agg(F.count("*").alias("n_turns"), F.coalesce(F.sum(reward), F.lit(0.0)).alias("total_reward"), F.max_by(reward, F.struct(turn, reward)).alias("last_reward"))


def qa_scores(df: DataFrame, key: str, pairs: str, answers: str) -> DataFrame:
    """(key, score, n_pairs, trace): the mean character F1 of the answers with the pairs' own, 0 without pairs.

    pairs: array<struct<question, answer>>; answers: the given ones in the same order, a
    missing one counts as ''. trace: a line for each pair.
    """
    each = df.select(key, F.posexplode_outer(pairs).alias("i", "qa"), F.col(answers).alias("__a"))
    given, true = F.coalesce(F.get("__a", "i"), F.lit("")), F.coalesce("qa.answer", F.lit(""))
    each = each.withColumn("s", F.when(F.col("qa").isNotNull(), char_f1(given, true)))
    line = F.struct("i", F.concat(F.lit("Q: "), F.coalesce("qa.question", F.lit("")), F.lit(" A: "), true, F.lit(" P: "), given).alias("t"))
    per = each.groupBy(key).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"), F.count("s").alias("n_pairs"), F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), line))).alias("__l"))
    return per.select(key, "score", "n_pairs", F.array_join(F.transform("__l", lambda x: x["t"]), "\n").alias("trace"))


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in order: what a rolling buffer of n holds."""
    rn = row_numbers(df, order)
    total = F.broadcast(df.agg(F.count("*").alias("__total")))  # one row
    return rn.join(total).where(F.col("rn") > F.col("__total") - n).drop("rn", "__total")
