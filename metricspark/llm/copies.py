"""Near copies: the groups of operator 8, joined by an exact prefix filter over word shingles with all that SimHash misses."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, spread
from .graph import components
from .simhash import near_duplicates

#: Buckets of more texts go the way of blocks; shingles of a block, about; texts of the sample that tells common
#: shingles, in how many of them a shingle is common, and how many common ones are told apart; counters of a set, at least
#: and at most, and bits of the filter that tells wanted texts, powers of two.
FEW, BLOCK, SAMPLED, COMMON, TOLD, COUNTERS, MOST_COUNTERS, FILTER = 24, 200_000, 4_000, 3, 200_000, 128, 1 << 15, 1 << 26
#: What tells a call that compares two blocks of a group: the group, and size and number of each block.
CALL = ("g", "q1", "s1", "q2", "s2")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts, last)], dtype=np.uint64).view(np.int64))


def prefix(s: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which any set that is `similarity` alike has one at least."""
    if not len(s):
        return np.zeros(1, dtype=np.int64)  # sets without shingles meet here
    most = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, ranks[at], 0)))]
    return s[:most]


def counts(s: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of some parts, 255 for more: about two a part, in COUNTERS parts at least; powers of two, so that parts can be joined."""
    parts = min(MOST_COUNTERS, max(COUNTERS, 1 << max(0, len(s) // 2).bit_length()))
    return np.minimum(np.bincount(s & parts - 1, minlength=parts) if len(s) else np.zeros(parts), 255).astype(np.uint8).tobytes()


def differ(x: bytes, y: bytes) -> int:
    """In how many shingles two sets differ at least: in as many as the counts of their parts do."""
    a, b = (np.frombuffer(c, dtype=np.uint8).astype(np.int32) for c in (x, y))
    parts = min(len(a), len(b))
    return int(np.abs(a.reshape(-1, parts).sum(axis=0) - b.reshape(-1, parts).sum(axis=0)).sum())


def _sets(shingle: int):
    @pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts], index=texts.index)

    return of


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are common in a sample of texts, and in how many texts. They only decide an order."""
    rows = docs.count()
    drawn = docs.select(F.xxhash64("text").alias("h"), "text").where(spread(F.col("h"), 8) * rows < float(SAMPLED))
    counted = drawn.groupBy("h").agg(F.first("text").alias("text")).select(F.explode(_sets(shingle)("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    got = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(TOLD).toPandas().sort_values("token")
    return got["token"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _known(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(h, s): the shingle sets of the texts whose hashes are wanted (column h), and of few others.

    The hashes are sent to the tasks as a filter of FILTER bits, whatever their number, so only sets that it lets
    through are shuffled and texts never are; where very many are wanted, it lets more through.
    """
    slot = F.col("h").bitwiseAND(F.lit(FILTER - 1))
    words = wanted.select(F.shiftright(slot, 5).cast("int").alias("i"), F.expr(f"shiftleft(1, cast(h & 31 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()  # FILTER / 32 rows at most
    bits = np.zeros(FILTER // 32, dtype=np.uint32)
    bits[words["i"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    told = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["h"].to_numpy(np.int64) & (FILTER - 1)
            b = b[(told.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)]
            yield pd.DataFrame({"h": b["h"], "s": pd.Series([shingle_set(t, shingle) for t in b["text"]], index=b.index, dtype="object")})  # objects, in a batch without wanted texts too

    # a scalar function below a filter would run twice, in two workers a task
    found = docs.select(F.xxhash64("text").alias("h"), "text").mapInPandas(sets, "h long, s array<long>")
    return cut(found.groupBy("h").agg(F.first("s").alias("s")))


def _alike(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike."""
    left, right = known.select(F.col("h").alias("a"), F.col("s").alias("x")), known.select(F.col("h").alias("b"), F.col("s").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where((F.size("x") + F.size("y") == 0) | (shared + 1e-6 >= similarity * (F.size("x") + F.size("y") - shared))).select("a", "b")


def spanning(h: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, first: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Edges of alike sets that connect all that such edges connect; sets of one root are connected already.

    `first` tells the two sides that are compared with each other, None compares all. Each set's overlap with all
    others is counted through the lists of sets that hold a shingle; sets that nothing else can be joined to are passed over.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.int64), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(token))])
    ends = np.cumsum(sizes)
    now = np.unique(roots, return_inverse=True)[1]
    edges: list[tuple[int, int]] = []
    for i in range(len(sets)):
        other = now != now[i]
        if first is not None:
            if not first[i]:
                continue
            other &= ~first
        if not other.any() or not sizes[i]:
            continue
        mine = token[ends[i] - sizes[i] : ends[i]]
        lens = starts[mine + 1] - starts[mine]
        spots = np.arange(lens.sum()) + np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        shared = np.bincount(holders[spots], minlength=len(sets))
        for j in np.flatnonzero(other & (shared + 1e-6 >= similarity * (sizes[i] + sizes - shared))).tolist():
            if now[j] != now[i]:
                edges.append((int(h[i]), int(h[j])))
                now[now == now[j]] = now[i]
    return edges


def folded(counters: list[bytes]) -> np.ndarray:
    """Counters of sets as rows of one width, the least of theirs."""
    rows = [np.frombuffer(c, dtype=np.uint8).astype(np.int32) for c in counters]
    parts = min(map(len, rows))
    return np.stack([r.reshape(-1, parts).sum(axis=0) for r in rows])


def hopeful(b: pd.DataFrame, first: np.ndarray | None, similarity: float) -> np.ndarray:
    """Which rows (n, root, counts) have another of another root, on the other side, that their sizes and counts let be alike."""
    n, root, m = b["n"].to_numpy().astype(np.int64), b["root"].to_numpy(), folded(b["counts"].tolist())
    out = np.zeros(len(b), dtype=bool)
    for i in range(len(b)):
        other = root != root[i]
        if first is not None:
            if not first[i]:
                continue
            other &= ~first
        at = np.flatnonzero(other)
        if len(at):
            differ = np.maximum(np.abs(m[at] - m[i]).sum(axis=1), np.abs(n[at] - n[i]))
            at = at[differ * (1 + similarity) <= (1 - similarity) * (n[at] + n[i]) + 1e-6]
            out[at] = True
            out[i] |= len(at) > 0
    return out


def _calls(big: DataFrame, counted: DataFrame, similarity: float) -> DataFrame:
    """(h, root, first and the call's key CALL): which calls compare which texts, so that all alike texts of different roots that meet in the buckets big (token, h, n, root) meet in a call.

    The texts of all buckets that have the same least text are a group: those of one family of copies mostly have, so
    its many buckets are compared once, and families that share a passage stay apart. A group's texts of like sizes are
    dealt to blocks of about BLOCK shingles, and each two blocks whose sizes allow the similarity are compared in one
    call. Texts that nothing in a call can be alike to, by the counts in counted (h, n, counts), are left out.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity) + 1e-9).cast("int")
    members = cut(big.join(big.groupBy("token").agg(F.min("h").alias("g")), "token").select("g", "h", "n", "root").distinct().withColumn("q", level))
    deals = members.groupBy("g", "q").agg(F.ceil(F.sum(F.col("n") + 32) / BLOCK).cast("int").alias("blocks"))
    here, above, below = deals, deals.select("g", (F.col("q") - 1).alias("q"), F.col("blocks").alias("up")), deals.select("g", (F.col("q") + 1).alias("q"), F.col("blocks").alias("down"))
    dealt = members.join(here.join(above, ["g", "q"], "left").join(below, ["g", "q"], "left"), ["g", "q"]).withColumn("s", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))

    def calls(n, left, right):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(left(o)[0].alias("q1"), left(o)[1].alias("s1"), right(o)[0].alias("q2"), right(o)[1].alias("s2")))).otherwise(F.array().cast("array<struct<q1:int,s1:int,q2:int,s2:int>>"))

    q, s, none = F.col("q"), F.col("s"), F.lit(0)
    same = calls(F.col("blocks"), lambda o: (q, F.least(s, o)), lambda o: (q, F.greatest(s, o)))
    up = calls(F.coalesce("up", none), lambda o: (q, s), lambda o: (q + 1, o))
    down = calls(F.coalesce("down", none), lambda o: (q - 1, o), lambda o: (q, s))
    sent = cut(dealt.select("h", "root", "g", "q", "s", F.explode(F.concat(same, up, down)).alias("c")).select("h", "root", "g", "c.*", ((F.col("q") == F.col("c.q1")) & (F.col("s") == F.col("c.s1"))).alias("first")))

    def close(b: pd.DataFrame) -> pd.DataFrame:
        return b.loc[hopeful(b, _side(b), similarity), ["h", "root", "first", *CALL]]

    return cut(sent.join(counted, "h").groupBy(*CALL).applyInPandas(close, "h long, root long, first boolean, g long, q1 int, s1 int, q2 int, s2 int"))


def _side(b: pd.DataFrame) -> np.ndarray | None:
    """Of a call's rows, which are of the first block; None if it compares a block with itself."""
    return None if b["q1"].iat[0] == b["q2"].iat[0] and b["s1"].iat[0] == b["s2"].iat[0] else b["first"].to_numpy()


def _between(calls: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what the calls compare, by the sets of known (h, s): no pairs but a spanning forest a call, fewer edges than it has texts."""

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        edges = spanning(b["h"].to_numpy(), b["s"].tolist(), b["root"].to_numpy(), _side(b), similarity)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return calls.join(known, "h").groupBy(*CALL).applyInPandas(compare, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, h (hash of the text), root (of the text's group) and component_id of each row; documents are linked if operator 8 links their fingerprints, or if the sets of their five-word shingles have a Jaccard similarity of 0.8.

    A different text is one node, so copies are never paired. The groups of operator 8 come first and stand as they
    are. As sets that are alike may have fingerprints far apart, shingles also have one order, rare ones first as a
    sample tells: of two sets that are alike each has a shingle of the other among its first, so they share a bucket.
    Each text is compared with the least and the greatest of each of its buckets. What that and the groups leave
    unconnected in a bucket is compared pair by pair in buckets of up to FEW texts, and in blocks of texts in larger
    ones, so all pairs are linked or connected through others. Texts without words are alike.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    grouped = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text")).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    common, ranks = _common(docs, shingle)
    told = docs.sparkSession.sparkContext.broadcast((common, ranks))

    @pandas_udf("struct<n:int,first:array<long>,counts:binary>")
    def profiles(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"n": np.array([len(s) for s in sets], dtype=np.int32), "first": [prefix(s, similarity, *told.value) for s in sets], "counts": [counts(s) for s in sets]})

    nodes = cut(docs.select("doc_id", F.xxhash64("text").alias("h"), profiles("text").alias("p")).groupBy("h").agg(F.min("doc_id").alias("least_id"), F.first("p").alias("p")))
    me = F.struct("h", "n", "i")
    entries = nodes.select("h", F.col("p.n").alias("n"), F.posexplode("p.first").alias("i", "token")).repartition("token")  # one shuffle, for the count and the join with it
    held = (F.col("n") - F.col("i")) * (1 + similarity) + 1e-6 >= 2 * similarity * F.col("n")  # the smaller of two alike has its first shared shingle here
    lively = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max(held).alias("held")).where("size > 1 and held").select("token")
    met = cut(entries.join(lively, "token"))
    ends = met.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(me).alias("x"), F.max(me).alias("y")).where("size > 1")  # summed in the tasks before they are dealt
    with_ends = met.join(ends, "token").select("*", F.explode(F.array("x", "y")).alias("o")).select(F.col("h").alias("a"), F.col("o.h").alias("b"), "n", "i", F.col("o.n").alias("m"), F.col("o.i").alias("j")).where("a != b")
    nodes = nodes.select("h", "least_id", F.col("p.n").alias("n"), F.col("p.counts").alias("counts"))

    @pandas_udf("int")
    def differing(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([differ(a, b) for a, b in zip(x, y)], index=x.index, dtype="int32")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Each pair (a, b) once, without those whose sizes or counts show that they differ in too many shingles."""
        once = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
        a, b = (nodes.select(F.col("h").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}")) for k in "ab")
        most = (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        return cut(once.join(a, "a").join(b, "b").where(F.abs(F.col("na") - F.col("nb")) <= most).where(differing("ca", "cb") <= most).select("a", "b"))

    def of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("h"))

    # the first shingle that two alike sets share leaves enough behind it in both
    least = (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6
    may = (F.least("n", "m") >= least) & (F.col("n") - F.col("i") >= least) & (F.col("m") - F.col("j") >= least)
    likely = plausible(with_ends.where(may).select("a", "b"))
    roots = cut(components(grouped.unionByName(_alike(likely, _known(docs, of(likely), shingle), similarity))))
    rooted = met.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    apart = rooted.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r"), F.max("root").alias("r2")).where("r != r2 and token != 0").select("token", "size")
    left = cut(rooted.join(apart, "token"))
    x, y = left.where(F.col("size") <= FEW), left.select("token", F.col("h").alias("o"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("r"))
    likely = plausible(x.join(y, "token").where((F.col("h") < F.col("o")) & (F.col("root") != F.col("r")) & may).select(F.col("h").alias("a"), F.col("o").alias("b")))
    many = left.where(F.col("size") > FEW)
    wanted = of(likely)
    calls = None if many.isEmpty() else _calls(many.select("token", "h", "n", "root"), nodes.select("h", "n", "counts"), similarity)
    known = _known(docs, wanted if calls is None else wanted.unionByName(calls.select("h")), shingle)
    more = _alike(likely, known, similarity)
    if calls is not None:
        more = more.unionByName(_between(calls, known, similarity))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    nodes = nodes.select("h", "least_id")
    groups = roots.join(nodes, roots["node"] == nodes["h"]).groupBy("root").agg(F.min("least_id").alias("component_id"))
    moved = roots.join(groups, "root").select(F.col("node").alias("h"), "root", "component_id")
    ids = nodes.join(moved, "h", "left").select("h", F.coalesce("root", "h").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(ids, "h").select("doc_id", "h", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with their columns, of one text of each group of near copies: the one with the smallest id, of these the smallest hash.

    Different texts that share an id are documents of their own; of rows of an id and a text one stays, the one whose
    other columns have the smallest hash. Rows without an id all stay. An empty table gives no rows.
    """
    found = near_copies(docs, shingle, similarity).where("doc_id is not null")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("r.*")
    hashed = docs.where("doc_id is not null").withColumns({"_h": F.xxhash64("text"), "_row": F.xxhash64(*docs.columns)})
    rows = hashed.select("doc_id", "_h", "_row").groupBy("doc_id", "_h").agg(F.min("_row").alias("_row"))
    wanted = first.withColumnRenamed("h", "_h").join(rows, ["doc_id", "_h"])
    kept = hashed.join(wanted, ["doc_id", "_h", "_row"], "left_semi").dropDuplicates(["doc_id", "_h", "_row"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
