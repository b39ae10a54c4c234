"""Sampling, splitting, mixing and shuffling of datasets by the hash of a row's id, reproducible for a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packs import group_row_numbers, row_numbers


def draw(key: str, seed: int = 0) -> Column:
    """A uniform order of the rows, shared with other engines: md5 of 'key:seed'."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def first_drawn(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """The first k rows of the drawn order, numbered within range partitions: no task holds all of them."""
    return row_numbers(df.withColumn("__d", draw(key, seed)), ["__d", key]).where(F.col("rn") <= k).drop("__d", "rn")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows: the whole table n // size times and the first n % size of the drawn order."""
    size = df.count()
    if size == 0:
        return df.withColumn("copy", F.lit(0)).limit(0)
    whole, rest = divmod(n, size)
    parts = []
    if whole:
        parts.append(df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))))
    if rest or not whole:
        parts.append(first_drawn(df, key, rest, seed).withColumn("copy", F.lit(whole)))
    return reduce(DataFrame.unionByName, parts)


def hash_sample(df: DataFrame, hashed: str, k: int) -> DataFrame:
    """The k rows of the smallest values of a column of 64-bit hashes, for a fit on a bounded sample.

    Rows far above the k-th are left out by the count of all, so that a task gets about 4 k
    rows, however many partitions there are.
    """
    n = df.count()
    if n > 8 * k:
        near = df.where(F.col(hashed) < F.lit(int(-(2**63) + 2**64 * (4 * k / n))))
        df = near if near.count() >= k else df
    return df.orderBy(hashed).limit(k)


def split_exact(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """`df` with `is_val`: exactly max(int(n * ratio), 1) rows of the drawn order; all for 1, none for 0."""
    if ratio <= 0 or ratio >= 1:
        return df.withColumn("is_val", F.lit(ratio >= 1))
    k = max(int(df.count() * ratio), 1)
    return row_numbers(df.withColumn("__d", draw(key, seed)), ["__d", key]).withColumn("is_val", F.col("rn") <= k).drop("__d", "rn")


def take_and_skip(df: DataFrame, order: list[str], n: int | None, ratio: float) -> DataFrame:
    """`df` with `is_val`, split as a stream is: of the first n rows in order the first int(n * ratio) are held out.

    Without n only the ratios 0 (none) and 1 (all) are known.
    """
    if n is None:
        if ratio not in (0, 1):
            raise ValueError("a stream of unknown length can't be split by a ratio")
        return df.withColumn("is_val", F.lit(ratio == 1))
    return row_numbers(df, order).where(F.col("rn") <= n).withColumn("is_val", F.col("rn") <= int(n * ratio)).drop("rn")


def split_ratio(ratio: float, streaming: bool, own_validation: bool) -> float:
    """The ratio that holds: none is split off a stream or beside a validation set of its own."""
    return 0.0 if streaming or own_validation else ratio


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def shard(df: DataFrame, order: list[str], n: int, k: int, drop_tail: bool = True) -> DataFrame:
    """The k-th of n contiguous shards; with drop_tail all have the same size."""
    rn = row_numbers(df, order)
    total = df.count()
    if drop_tail:
        size = total // n
        return rn.where((F.col("rn") > k * size) & (F.col("rn") <= (k + 1) * size)).drop("rn")
    return rn.where(F.floor((F.col("rn") - 1) * n / max(total, 1)) == k).drop("rn")


def concatenated(frames: list[DataFrame]) -> DataFrame | None:
    """All rows one under the other; columns that some lack are null. None for no frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def interleaved(df: DataFrame, source: str, key: str, weights: dict[str, float], seed: int = 0, stop: str = "first") -> DataFrame:
    """`df` with `position` and `copy`: rows of all sources in turn by weight.

    The r-th row of a source with weight w stands at r / w; a random draw of the same weights
    has this order in the mean. stop: 'first' ends with the first exhausted source, 'all' with
    the last, the others beginning again.
    """
    if stop not in ("first", "all"):
        raise ValueError("stop is 'first' or 'all'")
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    drawn = df.where(F.col(source).isin(list(weights))).withColumn("__d", draw(key, seed))
    placed = group_row_numbers(drawn, [source], ["__d", key]).drop("__d")
    sizes = placed.groupBy(source).agg(F.max("rn").alias("__n")).withColumn("__w", F.element_at(w, F.col(source)))  # a row for each weight
    ends = sizes.agg((F.min if stop == "first" else F.max)(F.col("__n") / F.col("__w")).alias("__end"))
    sizes = F.broadcast(sizes.join(F.broadcast(ends)))  # one row beside them
    out = placed.join(sizes, source).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("__end") * F.col("__w") - F.col("rn")) / F.col("__n")), F.lit(0)).cast("int")))) if stop == "all" else placed.join(sizes, source).withColumn("copy", F.lit(0))
    return out.withColumn("position", (F.col("rn") + F.col("copy") * F.col("__n")) / F.col("__w")).where(F.col("position") <= F.col("__end")).drop("rn", "__n", "__w", "__end")


def round_robin(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """`df` with `turn`: rows in order are dealt to k in turn, from 0."""
    return row_numbers(df, order).withColumn("turn", (F.col("rn") - 1) % k).drop("rn")


def in_request_order(df: DataFrame, request: str, *then: str) -> DataFrame:
    """Rows by request id, without an id last."""
    return df.orderBy(F.asc_nulls_last(request), *then)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both tables side by side by their place in order; the longer one's rest is dropped."""
    return row_numbers(left, left_order).join(row_numbers(right, right_order), "rn")


def with_predictions(truth: DataFrame, predictions: DataFrame, key: str, prediction: str) -> DataFrame:
    """The truth with each key's prediction, '' where there is none."""
    return truth.join(predictions.select(key, prediction), key, "left").na.fill("", [prediction])


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset intersection: each row as often as the table has it that has it less often, with `n`, its number."""
    counts = lambda df, x, y: df.groupBy(*a.columns).agg(F.count("*").alias("__n")).select(*a.columns, (F.col("__n") if x else F.lit(0)).alias("__a"), (F.col("__n") if y else F.lit(0)).alias("__b"))
    both = counts(a, True, False).unionByName(counts(b, False, True)).groupBy(*a.columns).agg(F.least(F.sum("__a"), F.sum("__b")).alias("n"))
    return both.where("n > 0")


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])


def refill(df: DataFrame, key: str, valid: str, seed: int = 0) -> DataFrame:
    """(key, used): a valid row uses itself, the i-th invalid one the i-th valid one of the drawn order, round robin."""
    ok = row_numbers(df.where(valid).select(key, draw(key, seed).alias("__d")), ["__d", key]).select(F.col(key).alias("used"), (F.col("rn") - 1).alias("__i"))
    bad = row_numbers(df.where(f"not ({valid})").select(key, draw(key, seed + 1).alias("__d")), ["__d", key]).select(key, F.col("rn").alias("__r"))
    n = df.where(valid).count()
    filled = bad.withColumn("__i", F.pmod(F.col("__r") - 1, F.lit(max(n, 1)))).join(ok, "__i").select(key, "used")
    return df.where(valid).select(key, F.col(key).alias("used")).unionByName(filled)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key), key, "left_anti")
