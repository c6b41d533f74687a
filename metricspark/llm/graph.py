"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Far more rounds than any graph here needs (they grow with the logarithm of its longest path).
ROUNDS = 60


def _exploded(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) of each pair of columns of each row."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), longs, that has another; the root is the component's smallest node.

    Each round is joins and sums over the edges, checkpointed; only their number and a checksum reach the driver.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(ROUNDS):
        both = _exploded(now, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _exploded(large.join(low, "u"), ("u", "m"), ("v", "m")).where("u != v")
        now = cut(small.distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return _exploded(now, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
