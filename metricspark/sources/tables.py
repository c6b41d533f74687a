"""The benchmark tables as record kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Calendars of sites and travellers, by their numbers; the last is none.
ZONES = ("Asia/Tokyo", "America/New_York", "Europe/London", "not a zone")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), "*")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's date; (order, line number) repeats, so a digest of all columns is the key."""
    li = read(spark, sf_dir, "lineitem")
    dates = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    digest = F.concat(F.hex(F.xxhash64(*li.columns)), F.hex(F.xxhash64(F.lit(1), *li.columns)))
    return li.withColumn("key", digest).join(dates, "l_orderkey")


def kinds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All kinds of the catalogue, lazily: a query reads only what it names."""

    class Kinds(dict):
        def __missing__(self, kind: str) -> DataFrame:
            made = {
                "region": lambda: keyed(read(spark, sf_dir, "region"), "r_regionkey"),
                "nation": lambda: keyed(read(spark, sf_dir, "nation"), "n_nationkey"),
                "customer": lambda: keyed(read(spark, sf_dir, "customer"), "c_custkey"),
                "supplier": lambda: keyed(read(spark, sf_dir, "supplier"), "s_suppkey"),
                "part": lambda: keyed(read(spark, sf_dir, "part"), "p_partkey"),
                "order": lambda: keyed(read(spark, sf_dir, "orders"), "o_orderkey"),
                "line": lambda: lines(spark, sf_dir),
                "event": lambda: keyed(read(spark, sf_dir, "events"), "event_id"),
                "person": lambda: keyed(read(spark, sf_dir, "events").select("user_id").distinct(), "user_id"),
                "traveller": lambda: keyed(read(spark, sf_dir, "events").select("user_id").distinct().withColumn("timezone", F.element_at(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 4 + 1).cast("int"))), "user_id"),
                "segment": lambda: keyed(read(spark, sf_dir, "customer").select("c_mktsegment").distinct(), "c_mktsegment"),
                "site": lambda: keyed(read(spark, sf_dir, "nation").withColumn("timezone", F.element_at(F.array(*map(F.lit, ZONES)), (F.col("n_nationkey") % 4 + 1).cast("int"))), "n_nationkey"),
                "document": lambda: keyed(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"),
                "label": lambda: keyed(read(spark, sf_dir, "labels"), "doc_id"),
                "source": lambda: keyed(read(spark, sf_dir, "documents").select("source").distinct(), "source"),
                "page": lambda: keyed(read(spark, sf_dir, "pages").select("page_id", "url"), "page_id"),
            }[kind]()
            self[kind] = made
            return made

    return Kinds()
