"""Operator 1: shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut

ROUNDS = 6
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The round function: a 64-bit finaliser over the half block and the round's key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) & _M
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF for r in range(ROUNDS)]


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, left, right = np.uint64((1 << half) - 1), x >> np.uint64(half), x & np.uint64((1 << half) - 1)
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number below n, or with `back` the row number at each place.

    The network permutes a power of four of at least n numbers; numbers that land at n or beyond walk on
    along their cycle until they are below n, which a permutation's cycles guarantee.
    """
    x, half, keys = np.asarray(rows, dtype=np.uint64).copy(), _half_bits(n), _keys(seed)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], half, keys, back)
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def shard_and_slot(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Where one row number goes, without looking at any other row."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_number, its place in the order from 0, and the number of rows.

    Ranges of the order are sorted apart from each other and their sizes added up, so no task sees all rows.
    Rows that are equal in all columns may change places.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240601) -> DataFrame:
    """Deal documents to shards under the law `rows`: counts of shards differ by one at most.

    Row numbers follow (doc_id, CRC-32, size), nulls first; place p of the permuted numbers is slot p // shards
    of shard p % shards. A null text has no bytes: size 16, CRC-32 0. Equal ids and repeated rows each keep a
    slot of their own. An empty table gives no rows. Other columns of docs are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = cut(docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"])

    @pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    p = rows.withColumn("_place", place("row_number"))
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
