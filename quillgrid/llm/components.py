"""Connected components of a graph of links, without collecting links or labels.

Alternating large-star and small-star rounds (public algorithm): each round is two
shuffles over the links; hot vertices are pre-aggregated by `min`, and a star's centre is
attached by a join, so that no vertex's neighbours are ever gathered into one row. A round's
links are a stored table, computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in `links`; label is the smallest node of its component.

    Self-links and rows with a null end are ignored; repeated links count once. No links:
    an empty result. Needs ids that are comparable (bigint or string).
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u is linked to the least of u's neighbours and u.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u and u itself are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = stored(
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.*")
            .where("u <> v")
            .distinct()
        )
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components: no fixed point; raise max_rounds")
    heads = e.select(F.col("v").alias("node")).distinct()
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(heads.select("node", F.col("node").alias("label")))
