"""What moved between two states of a figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (moved or removed), before, after: rows whose value isn't the same, unknown equal to unknown.

    A row that appears has moved from unknown. Values are compared exactly, lists by their values in order.
    """
    a, b = old.select(*keys, F.col("value").alias("before"), F.lit(True).alias("_old")), new.select(*keys, F.col("value").alias("after"), F.lit(True).alias("_new"))
    both = a.join(b, keys, "full_outer")
    moved = both.where(F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("before").eqNullSafe(F.col("after")))
    return moved.select(*keys, F.when(F.col("_new").isNull(), "removed").otherwise("moved").alias("kind"), "before", "after")


def ranked(changes: DataFrame, most: int = 40) -> DataFrame:
    """The changes to tell first: removals, then the largest steps."""
    number = dict(changes.dtypes).get("after") == "double"
    weight = F.abs(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))) if number else F.lit(0.0)
    return changes.withColumn("weight", weight).orderBy((F.col("kind") == "removed").desc(), F.col("weight").desc(), "subject").limit(most)
