"""Items of varying length in containers of fixed capacity, with certified counts.

Partitions of the items are packed by best-fit decreasing. Dual-feasible functions give each
partition a lower bound of its containers; a partition that meets its bound is certified
and done. Partitions with a gap exchange the items of their slack containers: these meet in
fewer, newly drawn partitions and are packed again, until no gap can close any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Items of a partition, about; at a hundred times as many items there are a hundred times as many partitions.
PARTITION_ITEMS = 40_000
#: Rounds of exchange at most; each has far fewer items than the one before.
ROUNDS = 4
#: A container with less free space than this share of the capacity isn't opened again.
SLACK = 1 / 64


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, free space of each container); no length may exceed the capacity."""
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit r: some container has r tokens free
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fit = spaces >> n
        if n and fit:
            r = n + (fit & -fit).bit_length() - 1
            c = by_space[r].pop()
            if not by_space[r]:
                spaces ^= 1 << r
        else:
            r, c = capacity, len(free)
            free.append(capacity)
        out[k] = c
        free[c] = r - n
        if r > n:
            by_space[r - n].append(c)
            spaces |= 1 << (r - n)
    return out, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of two families of dual-feasible functions."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same of the number of items of each length from 0 to the capacity."""
    n = counts.astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // capacity)
    # Above C - e an item counts as a whole container, below e as nothing.
    many, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    e = np.arange(1, capacity // 2 + 1)
    large = many[-1] - many[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    if len(e):
        best = max(best, int((large - (-middle // capacity)).max()))
    # Rounding down to multiples of C / k, unless (k + 1) x / C is whole.
    for k in range(1, min(capacity, 64)):
        whole = (size * (k + 1)) % capacity == 0
        value = np.where(whole, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    return best


def _divided(items: DataFrame, capacity: int) -> DataFrame:
    """One row for each piece; only an item above the capacity has more than one."""
    last = F.floor((F.col("n_tokens") - 1) / F.lit(capacity)).cast("int")
    return (
        items.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("first_token", (F.col("piece") * F.lit(capacity)).cast("bigint"))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(capacity).cast("bigint")))
    )


def pack(items: DataFrame, capacity: int, keys: list[str], partition_items: int = PARTITION_ITEMS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(assigned, certificates) of `items` (keys ..., n_tokens).

    assigned: keys ..., piece, first_token, n_tokens, container; every token of every item
    lies in exactly one container and no container exceeds the capacity. An item above the
    capacity is divided into full pieces and a rest, no other item is divided. certificates:
    round, part, n_containers, lower_bound, certified of every partition packed. Items of no
    tokens (null and empty texts) take no space and aren't assigned; ties are broken by the
    keys' hash; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    names = [f for f in items.schema.fields if f.name in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    schema = f"{kinds}, piece int, first_token bigint, n_tokens bigint, container bigint, `__settled` boolean, `__part` bigint, `__n` bigint, `__bound` bigint"
    loose = _divided(items.where("n_tokens > 0").select(*keys, "n_tokens"), capacity)
    # A full piece is a container of its own: nothing else fits in.
    done = [loose.where(F.col("n_tokens") == capacity).select(*keys, "piece", "first_token", "n_tokens", F.xxhash64(*keys, "piece").alias("container"))]
    certificates = []
    loose = loose.where(F.col("n_tokens") < capacity)

    def packed(round_no: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            part = int(group["__draw"].iloc[0])
            group = group.drop(columns="__draw").sort_values("__h", kind="stable").drop(columns="__h").reset_index(drop=True)
            lengths = group["n_tokens"].to_numpy(np.int64)
            at, free = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            settled = (len(free) <= bound) | (free < max(1, capacity * SLACK))
            group["container"] = (round_no << 56) + (part << 28) + at
            group["__settled"], group["__part"], group["__n"], group["__bound"] = np.broadcast_to(settled, len(free))[at], part, len(free), bound
            return group

        return run

    for r in range(1, rounds + 1):
        loose = loose if r == 1 else before.where("not __settled").select(*keys, "piece", "first_token", "n_tokens")  # noqa: F821
        loose = stored(loose)
        n = loose.count()
        parts = max(1, -(-n // partition_items))
        drawn = loose.withColumn("__h", F.xxhash64(*keys, "piece", F.lit(r))).withColumn("__draw", F.pmod("__h", F.lit(parts)))
        before = stored(drawn.groupBy("__draw").applyInPandas(packed(r), schema))
        stats = before.groupBy(F.col("__part").alias("part")).agg(F.first("__n").alias("n_containers"), F.first("__bound").alias("lower_bound"))
        certificates.append(stats.select(F.lit(r).alias("round"), "part", "n_containers", "lower_bound", (F.col("n_containers") <= F.col("lower_bound")).alias("certified")))
        open_items = before.where("not __settled")
        # One partition holds all that is loose: another draw would give the same.
        if r == rounds or parts == 1 or open_items.isEmpty():
            done.append(before.select(*keys, "piece", "first_token", "n_tokens", "container"))
            break
        done.append(before.where("__settled").select(*keys, "piece", "first_token", "n_tokens", "container"))
    union = lambda xs: reduce(DataFrame.unionByName, xs)
    return union(done), union(certificates)


def packing_report(assigned: DataFrame, capacity: int) -> DataFrame:
    """(capacity, n_pieces, n_tokens, n_containers, lower_bound, fill) of a packing; one row, zeros for no items.

    lower_bound: containers that any packing of these pieces needs, by the dual-feasible
    functions over the counts of their lengths, of which there are at most as many as tokens
    in a container.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in assigned.groupBy("n_tokens").count().collect():
        counts[r["n_tokens"]] = r["count"]
    c = assigned.groupBy("container").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    out = c.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_containers"))
    return out.select(
        F.lit(capacity).alias("capacity"), "n_pieces", "n_tokens", "n_containers",
        F.lit(bound_of_counts(counts, capacity)).cast("bigint").alias("lower_bound"), F.round(F.try_divide("n_tokens", F.col("n_containers") * capacity), 6).alias("fill"),
    )
