"""A corpus pipeline: toxicity, quality, near duplicates, mixing, BPE. Each stage works on all its predecessor kept.

All stages take null, empty, blank and very long texts, repeated ids and rows, empty tables and further columns, also
of names that the operators use. All but the last return the columns that they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm import bpe, copies, mixing, quality, toxicity
from metricspark.llm.common import batches, checkpoint_dir, ship, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Null and empty texts are scored as texts without known words and so stay; equal texts share their fate."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored as texts of no words; equal texts share their fate; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those of operator 8, joined by texts whose shingles are alike. Null, empty and blank texts are one group; different texts of one id are different documents; rows without an id all stay."""
    return copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null and empty texts have no words; a null source is a source of its own."""
    return mixing.mix(docs, carry=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to. Null and empty texts have no tokens; every row gives one."""
    return bpe.encode(docs)


def _ready(f):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        batches(spark)
        return f(spark, docs, sf_dir)

    return stage


STAGES = [("toxicity", _ready(clean)), ("quality", _ready(good)), ("near_duplicates", _ready(unlike)), ("mixing", _ready(mixed)), ("bpe", _ready(encoded))]

#: Classifiers and BPE are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and what the one before wrote then goes."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if 0 < k < len(STAGES) - 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
