"""Operator 8: SimHash fingerprints, linked through covering locality-sensitive hashing."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut
from .graph import components

BITS = 64
#: Buckets of more different fingerprints go the way of midpoints.
PAIRED = 48


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only, splits at the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    h = xxhash.xxh64_digest
    digests = b"".join([h(joined[a:b], 42) for a, b in zip(starts, last)])
    n = len(digests) // 8
    ones = np.zeros(BITS, dtype=np.int64)
    octets = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        ones += np.unpackbits(octets[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def masks(radius: int, seed: int = 11) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bit positions are all outside some mask.

    Each position gets a non-zero vector of radius + 1 bits; a mask belongs to a non-zero vector v and holds the
    positions whose vector has an odd product with v. The vectors of `radius` positions span fewer dimensions
    than radius + 1, so some v is orthogonal to them all.
    """
    size = (1 << (radius + 1)) - 1
    draw = random.Random(seed)
    vectors = draw.sample(range(1, size + 1), BITS) if size >= BITS else [1 + i % size for i in range(BITS)]
    draw.shuffle(vectors)
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(shingle: int):
    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return of


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp), fp the signed form of the fingerprint."""
    return docs.select("doc_id", _fingerprint(shingle)("text").alias("fp"))


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) with at most `radius` differing bits (0 to 2).

    Covering tables put every such pair in one bucket of some table. Buckets of up to PAIRED fingerprints are
    compared pair by pair. In larger ones each fingerprint is written under itself and its 64 neighbours at one
    bit: two fingerprints meet there if and only if they differ in two bits or fewer, a meeting has 65 members
    at most, and all of them are linked to its smallest, so edges grow with the rows and not with their square.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    buckets = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    twos = buckets.where("n = 2").where(near).select("a", "b")
    more = keyed.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    few = more.where(F.col("n") <= PAIRED)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    paired = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = more.where(F.col("n") > PAIRED).select("fp").distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    met = many.select("fp", F.explode(steps).alias("step")).groupBy(F.col("fp").bitwiseXOR(F.col("step")).alias("mid")).agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    star = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a != b").where(near if radius < 2 else F.lit(True))
    return twos.unionByName(paired).unionByName(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node, so copies are never paired. component_id is the smallest doc_id that links
    reach. Texts that are null, empty or white space have fingerprint zero and are linked like any other;
    repeated ids keep a row each; a null doc_id never names a component unless all its ids are null. An empty
    table gives no rows; other columns of docs are left out.
    """
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("fp"), radius))
    groups = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("least_id").alias("component_id"))
    moved = roots.join(groups, "root").select(F.col("node").alias("fp"), "component_id")
    ids = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
