import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricspark.llm import mixing, sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_is_one_and_goes_back(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, seed, back=True) == np.arange(n)).all()


def test_large_numbers_stay_in_range():
    n = 30_000_000_001
    rows = np.array([0, 1, n // 2, n - 1])
    p = sharding.permute(rows, n, 5)
    assert ((p >= 0) & (p < n)).all() and (sharding.permute(p, n, 5, back=True) == rows).all()
    shard, slot = sharding.shard_and_slot(7, n, 40, 5)
    assert sharding.row_at(shard, slot, n, 40, 5) == 7


def test_shards_follow_the_permutation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in sharding.shard(docs).collect()}
    want = sorted((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in docs.collect())
    place = sharding.permute(np.arange(len(want)), len(want), 20240601)
    for i, (doc_id, crc, size) in enumerate(want):
        r = got[doc_id]
        assert (r["text_crc32"], r["size"], r["shard"], r["slot"]) == (crc, size, place[i] % 40, place[i] // 40)


def test_odd_rows_are_sharded(odd, none):
    rows = sharding.shard(odd, shards=4).collect()
    assert len(rows) == odd.count() and max(sum(r["shard"] == s for r in rows) for s in range(4)) - min(sum(r["shard"] == s for r in rows) for s in range(4)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {16}
    assert sharding.shard(none).count() == 0


def resharing(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its cap."""
    total, capped = share * sum(sizes), {}
    while True:
        left = total - sum(capped.values())
        open_ = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i] for i in open_)
        t = {i: left * weights[i] / w for i in open_} if w else {}
        over = [i for i in open_ if t[i] > most * sizes[i] + 1e-9]
        if not over:
            return [capped.get(i, t.get(i)) for i in range(len(sizes))]
        capped.update({i: most * sizes[i] for i in over})


def test_targets_are_those_of_resharing(spark):
    sizes = [100, 5000, 700, 30, 900, 2500, 1]
    df = spark.createDataFrame([(chr(97 + i), s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(resharing(sizes, [3, 1, 2, 3, 1, 2, 3]))


def test_mix_meets_targets_and_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[r["source"]].append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(20, 0.05 * rs[0]["target"])


def test_carried_rows_are_the_copies(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    carried = mixing.mix(docs, carry=True)
    assert carried.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in carried.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == copies
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd, carry=True).columns == odd.columns
    assert {r["taken"] for r in mixing.mix(odd).where("size = 0").collect()} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mix(none, carry=True).count() == 0
