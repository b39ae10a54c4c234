"""Encoded rows: best-fit groups in chunks, merged packs, batches, shards and repeats."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce
from heapq import heappop, heappush
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, longest first into the fullest bin that takes it, the first of several; longer ones lie alone."""
    made = 0
    spaces: list[int] = []  # distinct free spaces in order
    bins: dict[int, list[int]] = {}  # the bins of each, the first on top
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        at = bisect_left(spaces, n)
        if n <= capacity and at < len(spaces):
            space = spaces[at]
            j = heappop(bins[space])
            if not bins[space]:
                del bins[space], spaces[at]
        else:
            j, space, made = made, capacity, made + 1
        out[k] = j
        left = space - n
        if left >= 0:
            if left not in bins:
                insort(spaces, left)
                bins[left] = []
            heappush(bins[left], j)
    return out


def chunked_packs(df: DataFrame, order: str, length: str, capacity: int, chunk: int = 1000) -> DataFrame:
    """(order, length, chunk, bin): best fit within chunks of consecutive order values.

    A chunk is a range of `order`, so chunks need no global sort; the reference carries the
    last open bin over, which would chain all chunks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf["bin"] = best_fit(pdf[length].tolist(), capacity)
        return pdf

    rows = df.select(order, length, F.floor(F.col(order) / chunk).cast("bigint").alias("chunk"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", bin int"
    return rows.groupBy("chunk").applyInPandas(run, schema)


def merged_pack(df: DataFrame, pack: list[str], order: str, ids: str) -> DataFrame:
    """(pack ..., ids, positions, length): ids one after the other, positions from 0 in each row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, ids))), lambda x: x[ids])
    grouped = df.groupBy(*pack).agg(rows.alias("__rows"))
    start = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return grouped.select(*pack, F.flatten("__rows").alias("ids"), F.flatten(F.transform("__rows", start)).alias("positions"), F.aggregate("__rows", F.lit(0), lambda s, x: s + F.size(x)).alias("length"))


def pack_bounds(positions: Column) -> Column:
    """Places at which a row begins in a pack, and its end."""
    starts = F.filter(F.transform(positions, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull())
    return F.concat(starts, F.array(F.size(positions)))


def repeated(df: DataFrame, n: int, passes: int = 1) -> DataFrame:
    """Each row n times in each pass."""
    return df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def batches(df: DataFrame, order: list[str], size: int, drop_last: bool = False) -> DataFrame:
    """`df` with `rn` and `batch`: consecutive rows in order. Row numbers come from range partitions, not from one task."""
    out = row_numbers(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size))
    return out.where(F.col("batch") < df.count() // size) if drop_last else out


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with `rn` from 1 in order: rows are numbered within range partitions, whose counts are
    then summed. The numbered partitions are stored, so that both reads see the same ones."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    numbered = ranged.withColumn("__p", part).join(F.broadcast(before.select("__p", "__b", "__first")), "__p")  # as many rows as partitions
    return numbered.withColumn("rn", F.col("__b") + F.col("__id") - F.col("__first") + 1).drop("__p", "__b", "__first", "__id")


def group_row_numbers(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df` with `rn` from 1 within each group. A hot group lies in many range partitions, so no task sorts all of it."""
    rn = row_numbers(df, [*group, *order])
    first = rn.groupBy(*group).agg(F.min("rn").alias("__first"))
    same = reduce(and_, [F.col(f"__l.{g}").eqNullSafe(F.col(f"__r.{g}")) for g in group])
    return rn.alias("__l").join(first.alias("__r"), same).select("__l.*", (F.col("rn") - F.col("__first") + 1).alias("__k")).drop("rn").withColumnRenamed("__k", "rn")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the running sum of a value within each group, in order.

    Rows are range-partitioned by group and order, so a hot group is spread over many
    partitions; each is summed on its own and the sums of those before are added.
    """
    ranged = df.withColumn("__v", value).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = stored(ranged.withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy(*group, "__p").agg(F.sum("__v").alias("__t"))
    before = totals.withColumn("__b", F.coalesce(F.sum("__t").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most a row for each partition
    inner = ranged.withColumn("__s", F.sum("__v").over(Window.partitionBy(*group, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = reduce(and_, [F.col(f"__l.{g}").eqNullSafe(F.col(f"__r.{g}")) for g in [*group, "__p"]])
    return inner.alias("__l").join(before.alias("__r"), same).select("__l.*", (F.col("__s") + F.col("__b")).alias(name)).drop("__v", "__p", "__s")


def minibatch(rn: Column, n: Column, parts: int) -> Column:
    """0-based part of row rn of n; the first parts take the remainder, as ntile does."""
    base, more = F.floor(n / parts), n % parts
    edge = more * (base + 1)
    return F.when(rn <= edge, F.floor((rn - 1) / (base + 1))).otherwise(more + F.floor((rn - 1 - edge) / F.greatest(base, F.lit(1)))).cast("bigint")
