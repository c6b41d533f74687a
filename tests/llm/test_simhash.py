import itertools
import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from metricspark.llm import copies, simhash
from metricspark.llm.graph import components


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for t in ["", None, " \x0b\t", "a", "A b", "Ä É a b c", "x " * 400, "the quick\nbrown\tfox jumps over\x0cthe lazy dog " * 9, "nbsp joined words here"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_masks_cover_every_pair_of_positions():
    for radius in (1, 2):
        ms = simhash.masks(radius)
        assert len(ms) == 2 ** (radius + 1) - 1
        for at in itertools.combinations(range(64), radius):
            assert any(not any(m >> i & 1 for i in at) for m in ms)


def test_links_connect_what_is_near(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        fps |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(rng.choice((1, 2, 30)))}
    fps = sorted(fps)
    want = brute_components(fps)
    for most in (48, 3):  # the second sends nearly all buckets the way of midpoints
        monkeypatch.setattr(simhash, "PAIRED", most)
        nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
        roots = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
        got = [roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
        pairs = {(a, b) for a, b in zip(want, got)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (600, 600)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[501] == roots[500] == 500 and 600 not in roots
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(fps)
    least = {}
    for (d, _), r in zip(texts, roots):
        least[r] = min(least.get(r, d), d)
    want = {d: (f"{f:016x}", least[r]) for (d, _), f, r in zip(texts, fps, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert empty == {2}
    assert simhash.near_duplicates(none).count() == 0 and copies.keep_one(none).count() == 0
    kept = copies.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(1) == 1 and 6 not in ids and ids.count(2) == 1 and 3 not in ids and 4 not in ids


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, groups = [], {}
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(rng.choice((1, 3, 60))):
            words = list(base)
            for _ in range(0 if c == 1 else 4 if c else 0):
                words[rng.randrange(300)] = rng.choice(vocabulary)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, c in got.items():
        assert groups[d] == groups[c]  # unlike documents never meet
    first = {}
    for d, g in groups.items():
        first.setdefault(g, d)
    caught = sum(got[d] == first[g] for d, g in groups.items())
    assert caught >= 0.9 * len(rows)


def edited(rng, base, vocabulary, least=0.8):
    """Random edits of a text until one more would make it less than `least` alike; the similarity is that of 5-word shingles."""
    words = list(base)
    while True:
        more = list(words)
        more[rng.randrange(len(more))] = rng.choice(vocabulary)
        if jaccard(base, more) < least:
            return words
        words = more


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def linked(spark, texts):
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in copies.near_copies(frame).collect()}


def test_every_copy_of_an_original_is_linked(spark, monkeypatch):
    """Variants like the original and unlike each other, in large groups (blocks) and in small buckets (pairs)."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts, group = [], []
    for g, n in enumerate((300, 30)):
        base = [rng.choice(vocabulary) for _ in range(300)]
        variants = [edited(rng, base, vocabulary) for _ in range(n)]
        texts += [*variants, base]
        group += [g] * (n + 1)
    first = {g: group.index(g) for g in group}
    for most in (copies.BLOCK, 12_000):
        monkeypatch.setattr(copies, "BLOCK", most)
        got = linked(spark, texts)
        assert [got[i] for i in range(len(texts))] == [first[g] for g in group]


def test_pairs_just_above_the_similarity_are_linked(spark):
    """Pairs by random edits, by new text at the end and by a line repeated, at several lengths, and pairs just below it."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for n in (12, 20, 40, 300, 1000):
        for _ in range(12):
            base = [rng.choice(vocabulary) for _ in range(n)]
            line = base[-max(2, n // 8) :]
            longer = base + [rng.choice(vocabulary) for _ in range((n - 4) // 4)]
            texts += [base, rng.choice([edited(rng, base, vocabulary), longer, base + line * 30])]
    for _ in range(20):
        base = [rng.choice(vocabulary) for _ in range(104)]
        texts += [base, base + [rng.choice(vocabulary) for _ in range(26)]]  # 100 of 126
    got = linked(spark, texts)
    for i in range(0, len(texts), 2):
        assert (got[i] == got[i + 1]) == (jaccard(texts[i], texts[i + 1]) >= 0.8), (i, jaccard(texts[i], texts[i + 1]))
        assert got[i] == i


def test_groups_are_those_of_both_laws(spark):
    """A paragraph many times over with tails of their own: near fingerprints, unlike sets of shingles. Links of either law hold, and chains of both."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for times in (1, 3, 12, 30):
        for _ in range(6):
            paragraph = [rng.choice(vocabulary) for _ in range(40)]
            variants = [paragraph * times + [rng.choice(vocabulary) for _ in range(20)] for _ in range(3)]
            texts += [*variants, edited(rng, variants[-1], vocabulary)]
    fps = [brute_fingerprint(" ".join(t)) for t in texts]
    pairs = list(itertools.combinations(range(len(texts)), 2))
    near = {(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 2}
    close = {(i, j) for i, j in pairs if i // 4 == j // 4 and jaccard(texts[i], texts[j]) >= 0.8}
    assert len(near - close) > 5 and len(close - near) > 5

    def groups(edges):
        at = list(range(len(texts)))
        for i, j in edges:
            at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
        return at

    want = groups(near | close)
    assert want not in (groups(near), groups(close))
    got = linked(spark, texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = copies.keep_one(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_unlike_texts_of_one_id_all_stay(spark):
    """Ids that repeat: each group of texts keeps exactly one row, also where the smallest id names two groups."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, c), (3, b)]
    kept = copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (1, b), (2, c)]


def some_sets(rng, n=60):
    """Sets of shingles, many of them near copies of others."""
    base = [np.unique(rng.integers(0, 2**62, int(k))) for k in rng.integers(1, 400, 8)]
    made = []
    for _ in range(n):
        b = base[int(rng.integers(len(base)))]
        kept = b[rng.random(len(b)) > rng.choice([0.0, 0.05, 0.12, 0.3])]
        made.append(np.unique(np.concatenate([kept, rng.integers(0, 2**62, int(rng.integers(0, 20)))])))
    return [s if len(s) else np.array([5]) for s in made]


def alike(a, b):
    shared = len(np.intersect1d(a, b))
    return shared >= 0.8 * (len(a) + len(b) - shared)


def test_counts_never_rule_out_an_alike_pair():
    """The counters' difference is at most the sets', whatever their numbers of parts; hopeful() keeps all that have a partner."""
    sets = some_sets(np.random.default_rng(1))
    counted = [copies.counts(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert copies.differ(counted[i], counted[j]) <= len(np.setxor1d(a, b))
    for first in (None, np.arange(len(sets)) % 2 == 0):
        b = pd.DataFrame({"n": [len(s) for s in sets], "root": range(len(sets)), "counts": counted})
        kept = copies.hopeful(b, first, 0.8)
        for i, a in enumerate(sets):
            partners = [j for j, s in enumerate(sets) if j != i and alike(a, s) and (first is None or first[i] != first[j])]
            assert kept[i] or not partners


def test_a_spanning_forest_connects_what_pairs_do():
    """The same components as by all pairs, with fewer edges than sets; both for one block and for two sides."""

    def components_of(edges, roots):
        at = list(roots)
        for i, j in edges:
            a, b = at[i], at[j]
            at = [b if x == a else x for x in at]
        return [at.index(x) for x in at]

    for seed in range(6):
        rng = np.random.default_rng(seed)
        sets = some_sets(rng)
        roots = np.where(rng.random(len(sets)) < 0.2, 0, np.arange(len(sets)))
        for first in (None, rng.random(len(sets)) < 0.5):
            pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) and (first is None or first[i] != first[j])]
            got = copies.spanning(np.arange(len(sets)), sets, roots, first, 0.8)
            assert len(got) < len(sets) and {(max(e), min(e)) for e in got} <= set(pairs)
            assert components_of(got, roots) == components_of(pairs, roots)


def test_wanted_sets_are_made_once(spark, monkeypatch):
    """One Python node, so one worker a task; only the sets that are wanted leave it."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (5, "others that nobody wants at all")], "doc_id long, text string")
    wanted = docs.where("doc_id < 5").select(F.xxhash64("text").alias("h"))
    monkeypatch.setattr(copies, "cut", lambda df: df)
    known = copies._known(docs, wanted, 5)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.split("== Initial Plan ==")[0].count(f"{n} ") for n in ("ArrowEvalPython", "MapInPandas")) == 1
    want = {r["h"]: copies.shingle_set(r["text"]).tolist() for r in docs.where("doc_id < 5").select(F.xxhash64("text").alias("h"), "text").collect()}
    assert {r["h"]: r["s"] for r in known.collect()} == want
    assert copies._known(docs, wanted.where("false"), 5).collect() == []
