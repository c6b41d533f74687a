"""Operators on record tables: keyed reads, write-if-new, deletes, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def some(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The records with these keys (column key)."""
    return df.join(keys.select("key").distinct(), "key", "left_semi")


def any_of(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def landing(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The new records that land: one a key, those that differ from the record that is there and aren't stale.

    A record is stale if both stamps are there and the new one is earlier. Of a batch's records with one key the
    latest stamp wins, of these the last as JSON text. Of the old table only the batch's keys are joined.
    """
    cols = [c for c in new.columns if c not in ("key", "source_stamp")]
    order = F.struct(F.coalesce("source_stamp", F.lit("9999-12-31").cast("timestamp")), F.to_json(F.struct(*cols)) if cols else F.lit(""))
    one = new.groupBy("key").agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    if old is None:
        return one
    there = some(old, one).select("key", F.struct("source_stamp", *cols).alias("x"))
    both = one.select("key", F.struct("source_stamp", *cols).alias("y")).join(there, "key", "left")
    same = F.struct(*[F.col(f"x.{c}").alias(c) for c in cols]).eqNullSafe(F.struct(*[F.col(f"y.{c}").alias(c) for c in cols])) if cols else F.lit(True)
    stale = F.coalesce(F.col("y.source_stamp") < F.col("x.source_stamp"), F.lit(False))
    return both.where(F.col("x").isNull() | (~stale & ~same)).select("key", "y.*").select(*old.columns)


def upsert(old: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, moved keys): the old table with the new records that land, see landing()."""
    lands = landing(old, new)
    table = lands if old is None else delete(old, lands).select(lands.columns).unionByName(lands)
    return table, lands.select("key")


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("key").distinct(), "key", "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old, and the rows of new whose key isn't there; a row with an unknown value is there."""
    return old.unionByName(new.join(old.select(*on), on, "left_anti"))


def page(df: DataFrame, after: str | None = None, n: int = 50, contains: str | None = None) -> DataFrame:
    """n + 1 records by key after a key: one more than asked, so that a caller knows of a next page."""
    if contains:
        texts = [F.col(c).cast("string") for c, t in df.dtypes if t == "string"]
        df = df.where(F.exists(F.array(*texts), lambda x: F.coalesce(x.contains(contains), F.lit(False))))
    if after is not None:
        df = df.where(F.col("key") > after)
    return df.orderBy("key").limit(n + 1)


def under(values: DataFrame, prefix: str) -> DataFrame:
    """Rows whose `subject@tail` address starts with a text, taken literally."""
    return values.where(F.concat_ws("@", "subject", "tail").startswith(prefix))


def between(values: DataFrame, first: str, last: str) -> DataFrame:
    """Rows whose label lies between two, both included."""
    return values.where(F.col("tail").between(first, last))


def bucket_counts(membership: DataFrame) -> DataFrame:
    """(subject[, tail], members) of an index."""
    keys = [c for c in ("subject", "tail") if c in membership.columns]
    return membership.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))


def citing(citations: DataFrame, member: str, most: int) -> DataFrame:
    """Rows that cite a record, per figure in the order of subjects, at most so many each (a report's limit)."""
    w = Window.partitionBy("figure").orderBy("subject", "tail")
    return citations.where(F.col("member") == member).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
