"""Sources mixed to target weights, within limits of repetition.

Source token shares are exponentiated. Towards given targets, they go the path from the
natural shares (exponent 0) to the target shares (exponent 1), and the exponent is bisected
to the largest that keeps every source within its repetitions at the wanted size. Towards a
given entropy, they are raised to the power at which the weights have it, by bisection, and
from there towards 1 as far as the repetitions demand. The normalised weights become token
budgets; a budget is whole passes over a source's documents and a last, partial pass over
its hash-drawn blocks, cut within one block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Documents of a block, about.
BLOCK_DOCUMENTS = 5_000


def weights_at(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """natural^(1-x) * target^x, normalised; sources without documents or without target have none."""
    w = [n ** (1 - exponent) * t**exponent if n > 0 and t > 0 else 0.0 for n, t in zip(natural, target)]
    total = sum(w)
    return [x / total if total else 0.0 for x in w]


def exponent_for_entropy(natural: list[float], entropy: float) -> float:
    """The exponent a for which shares^a, normalised, have the given entropy (in nats), by bisection."""
    shares = [n for n in natural if n > 0]

    def at(a: float) -> float:
        w = [n**a for n in shares]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w if x)

    low, high = 0.0, 64.0  # entropy falls from log(n) at 0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) > entropy else (low, mid)
    return (low + high) / 2


def powered(natural: list[float], exponent: float) -> list[float]:
    """natural^exponent, normalised; sources without documents have none."""
    w = [n**exponent if n > 0 else 0.0 for n in natural]
    return [x / sum(w) if sum(w) else 0.0 for x in w]


def entropy_of(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisected(weights, good: float, bad: float, natural: list[float], repeats: list[int], size: float, total: float) -> float:
    """The exponent nearest to `bad`, between it and `good`, at which `size` tokens repeat no source too often.

    natural: shares of the `total` tokens there are. `good` also where not even its weights
    can be met at that size.
    """

    def fits(x: float) -> bool:
        return all(size * w <= n * total * r * (1 + 1e-12) for w, n, r in zip(weights(x), natural, repeats))

    if fits(bad):
        return bad
    for _ in range(60):
        mid = (good + bad) / 2
        good, bad = (mid, bad) if fits(mid) else (good, mid)
    return good


def exponent_within_repeats(natural: list[float], target: list[float], repeats: list[int], size: float, total: float) -> float:
    """The largest exponent in [0, 1] on the path to the targets at which `size` tokens repeat no source too often."""
    return bisected(lambda x: weights_at(natural, target, x), 0.0, 1.0, natural, repeats, size, total)


def largest_size(natural: list[float], target: list[float], repeats: list[int], total: float) -> float:
    """Most tokens a mixture of exactly the target weights can have."""
    w = weights_at(natural, target, 1.0)
    return min((n * total * r / x for x, n, r in zip(w, natural, repeats) if x > 0), default=0.0)


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", size: float | None = None, entropy: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mixture of `docs` (key, source, n_tokens) to `targets` (source, target_share, max_repeats).

    uses: key, source, n_tokens, n_uses, one row for each document used. shares: source,
    target_share, max_repeats, n_tokens, mixed_tokens, actual_share, exponent, one row for
    each target. `size`: tokens of the mixture; by default the most with exactly the target
    weights. A larger size than the targets allow is met with weights between these and the
    natural shares. `entropy`: the weights are the natural shares to a power that gives this
    entropy (in nats), and target shares only say which sources take part; the size is then by
    default that of the documents of these sources. An entropy that no power gives takes the
    nearest. Where even the natural shares repeat a source too often, it gets all it may. A source without documents gets none, and its share goes to the others in
    proportion; documents without a source or of a source without target aren't used, nor
    are texts of no tokens. A key that comes again counts once. Empty tables give empty results.
    """
    d = stored(docs.where("n_tokens > 0 and source is not null").select(key, "source", "n_tokens").dropDuplicates([key]))
    # One row for each target: a fixed list of sources, not data.
    have = {r["source"]: r for r in targets.join(d.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "source", "left").collect()}
    names = sorted(s for s in have if s is not None)
    total = float(sum(have[s]["t"] or 0 for s in names)) or 1.0
    natural = [(have[s]["t"] or 0) / total for s in names]
    target = [have[s]["target_share"] or 0.0 for s in names]
    repeats = [have[s]["max_repeats"] or 0 for s in names]
    if entropy is None:
        size = largest_size(natural, target, repeats, total) if size is None else size
        exponent = exponent_within_repeats(natural, target, repeats, size, total)
        weights = weights_at(natural, target, exponent)
    else:
        natural = [n if t > 0 else 0.0 for n, t in zip(natural, target)]
        total *= sum(natural)
        natural = powered(natural, 1.0)
        size = total if size is None else size
        exponent = bisected(lambda x: powered(natural, x), 1.0, exponent_for_entropy(natural, entropy), natural, repeats, size, total)
        weights = powered(natural, exponent)
    plan = []
    for s, w, r in zip(names, weights, repeats):
        there = have[s]["t"] or 0
        budget = min(int(round(w * size)), there * r)
        passes = budget // there if there else 0
        plan.append((s, passes, budget - passes * there, max(1, -(-(have[s]["n"] or 0) // BLOCK_DOCUMENTS))))
    spark = docs.sparkSession
    planned = F.broadcast(spark.createDataFrame(plan or [("", 0, 0, 1)], "source string, passes bigint, rest bigint, blocks bigint"))  # as many rows as targets
    drawn = d.join(planned, "source").withColumn("h", F.xxhash64(key, F.lit(seed))).withColumn("block", F.pmod("h", F.col("blocks")))
    blocks = drawn.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = drawn.join(blocks, ["source", "block"])
    inside = placed.where("before < rest and before + t > rest")  # one block of each source is cut
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("h", key))
    inside = inside.withColumn("upto", F.col("before") + upto).withColumn("more", (F.col("upto") - F.floor(F.col("n_tokens") / 2) <= F.col("rest")).cast("bigint"))
    outside = placed.where("not (before < rest and before + t > rest)").withColumn("more", (F.col("before") + F.col("t") <= F.col("rest")).cast("bigint"))
    cols = [key, "source", "n_tokens", (F.col("passes") + F.col("more")).alias("n_uses")]
    uses = stored(outside.select(*cols).unionByName(inside.select(*cols)).where("n_uses > 0"))
    mixed = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("m"))
    there = spark.createDataFrame([(s, have[s]["t"] or 0) for s in names] or [("", 0)], "source string, n_tokens bigint")
    shares = (
        targets.where("source is not null")
        .join(there, "source")
        .join(mixed, "source", "left")
        .withColumn("mixed_tokens", F.coalesce("m", F.lit(0)))
        .withColumn("actual_share", F.round(F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)), 6))
        .select("source", "target_share", "max_repeats", "n_tokens", "mixed_tokens", "actual_share", F.lit(round(exponent, 6)).alias("exponent"))
    )
    return uses, shares
