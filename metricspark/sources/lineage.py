"""Cutting lineage in the session's checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs in this process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="metricspark-state-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
