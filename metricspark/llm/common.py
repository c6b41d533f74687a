"""What the operators share: tables, lineage cuts, label samples."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many groups' sizes are broadcast.
GROUPS = 10_000
#: Words of the word rules: white space is U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this package: unless PYTHONPATH has it, a zip of it is added to the session."""
    root = Path(__file__).resolve().parents[2]
    if any(Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(":") if p):
        return
    sc = spark.sparkContext
    if getattr(sc, "_metricspark_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "metricspark_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "metricspark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._metricspark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset and all runs in this process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="metricspark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in that folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def spread(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that the id and the seed decide."""
    h = F.xxhash64(F.lit(seed), doc_id)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def bounded_sample(keyed: DataFrame, group: str, bound: int, seed: int) -> DataFrame:
    """Of each group of (doc_id, group) about `bound` rows, or all it has, chosen by the id alone.

    A group's rows pass where spread(doc_id) < bound / its rows, so no group meets in one task; the number of
    rows kept is binomial with mean `bound`.
    """
    sizes = keyed.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows"))
    joined = keyed.join(F.broadcast(sizes) if sizes.limit(GROUPS + 1).count() <= GROUPS else sizes, group)
    return joined.where(spread(F.col("doc_id"), seed) * F.col("group_rows") < F.lit(float(bound))).withColumn("group_weight", F.greatest(F.lit(1.0), F.col("group_rows") / F.lit(float(bound))))


def batches(spark: SparkSession, rows: int = 512) -> None:
    """Let batches of texts for Python hold so many rows, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return a worker's freed memory to the system; the C library keeps it else. Where it has no such call nothing happens."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
