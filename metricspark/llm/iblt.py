"""Operator 7: document fingerprints as invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Cells of the fingerprint; cells that a digest is in; words of a paragraph's piece at most.
CELLS, HASHES, PIECE = 24, 3, 12
#: Rows a stretch that are drawn to cut the stretches of neighbours.
SAMPLED = 64
SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)[:HASHES]
_BREAK = re.compile(r"\n+|(?<=[.!?]) +")


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs that are digested: lines, cut at sentence ends, and after every PIECE words of a long sentence.

    Cuts depend only on the text before them, so texts that begin alike have the same first paragraphs.
    """
    out = []
    for p in _BREAK.split(text or ""):
        if p:
            w = p.split(" ")
            out += [p] if len(w) <= PIECE else [" ".join(w[i : i + PIECE]) for i in range(0, len(w), PIECE)]
    return out


def digests(text: str | None) -> np.ndarray:
    """A 64-bit digest for each paragraph; the n-th repeat of a paragraph counts as a paragraph of its own."""
    h, seen, out = xxhash.xxh3_64_intdigest, {}, []
    for p in paragraphs(text):
        d = h(p.encode("utf-8", "surrogatepass"))
        n = seen.get(d, 0)
        seen[d] = n + 1
        out.append(h(d.to_bytes(8, "little"), n) if n else d)
    return np.array(out, dtype=np.uint64)


def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Sketch:
    """Cells of (count, sum of digests, sum of checks), sums bitwise; a digest is in one cell of each of HASHES parts."""

    def __init__(self, cells: int):
        self.part = -(-cells // HASHES)
        self.count = np.zeros(self.part * HASHES, dtype=np.int64)
        self.keys = np.zeros(self.part * HASHES, dtype=np.uint64)
        self.checks = np.zeros(self.part * HASHES, dtype=np.uint64)

    def places(self, d: np.ndarray) -> np.ndarray:
        """The cell of each digest in each part. The parts' size salts the hashes, so a larger sketch is a new try."""
        return ((_scramble(d[:, None] ^ SALTS, self.part) % np.uint64(self.part)).astype(np.int64) + np.arange(HASHES) * self.part).ravel()

    def add(self, d: np.ndarray, sign: np.ndarray | int = 1) -> Sketch:
        """Add digests, or with a sign of -1 take them away; the sums of bits are the same for both."""
        if len(d):
            at, n = self.places(d), len(self.count)
            self.count += np.bincount(at, minlength=n) * sign if isinstance(sign, int) else np.bincount(at, np.repeat(sign, HASHES), minlength=n).astype(np.int64)
            np.bitwise_xor.at(self.keys, at, np.repeat(d, HASHES))
            np.bitwise_xor.at(self.checks, at, np.repeat(_scramble(d, 1), HASHES))
        return self

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.count))
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests of the first only and of the second only; None if cells remain that none of them explains."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(2 * len(self.count)):
            pure = np.nonzero(np.abs(self.count) == 1)[0]
            pure = pure[self.checks[pure] == _scramble(self.keys[pure], 1)]
            if not len(pure):
                break
            d, at = np.unique(self.keys[pure], return_index=True)
            sign = self.count[pure[at]]
            self.add(d, -sign)
            found.append((d, sign))
        if self.count.any() or self.keys.any() or self.checks.any():
            return None
        d = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.uint64)
        sign = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
        return d[sign == 1], d[sign == -1]

    def text(self) -> str:
        """The cells in printable form."""
        return base64.b64encode(self.count.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u8").tobytes()).decode()


def printed(n: int, sketch: Sketch) -> str:
    """A fingerprint: the number of a text's digests, and their sketch."""
    return f"{n}:{sketch.text()}"


def fingerprint(d: np.ndarray, cells: int = CELLS) -> str:
    """The fingerprint of a text's digests."""
    return printed(len(d), Sketch(cells).add(d))


def differing(a: np.ndarray, b: np.ndarray, cells: int = CELLS, difference: Sketch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a only and of b only: sketches are subtracted and peeled, and made larger where peeling stops.

    `difference` is that of two sketches at hand. The numbers of digests bound what differs: sizes grow sixteenfold
    up to one for all of it, then by doubling. A larger sketch takes b's digests away as it is filled.
    """
    got = (difference or Sketch(cells).add(a).minus(Sketch(cells).add(b))).peel()
    most = 16 + 2 * (len(a) + len(b))
    while got is None:
        cells = 2 * cells if cells >= most else most if most <= 64 * cells else 16 * cells
        both = Sketch(cells).add(np.concatenate([a, b]), np.repeat(np.array([1, -1]), [len(a), len(b)]))
        got = both.peel()
    return got


def likeness(a: np.ndarray, b: np.ndarray, cells: int = CELLS, difference: Sketch | None = None) -> float:
    """Shared digests over all digests of both, 1 for two texts of none."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    apart = sum(map(len, differing(a, b, cells, difference)))
    return (len(a) + len(b) - apart) / (len(a) + len(b) + apart)


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half replaced by the first as many code points (or all) of the following text."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _order() -> tuple[Column, Column]:
    """The order of the documents: by descending id (null ids last), then by a hash of the text."""
    return F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1)), F.xxhash64("text")


def _sortable(k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pairs of longs as byte strings of the same order."""
    flipped = np.stack([k, h], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(flipped.astype(">u8")).view("S16").ravel()


def neighbours(docs: DataFrame) -> DataFrame:
    """(lead, doc_id, text), in as many stretches of neighbours as the session has shuffle partitions, one in a partition.

    A sample of SAMPLED rows a stretch, ids and hashes only, cuts the order; repeated ids are cut by their texts.
    Each stretch holds its rows and, last and marked lead, the first row of the stretch after it (after the last: of
    the first), so that neighbours can be read off inside a stretch. Texts are shuffled once.
    """
    spark = docs.sparkSession
    k, h = _order()
    keyed = docs.select(k.alias("k"), h.alias("h"), "doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = keyed.select("k", "h")
    n = docs.count()
    drawn = ids.sample(min(1.0, parts * SAMPLED / max(n, 1)), seed=7).toPandas()
    found = np.unique(_sortable(drawn["k"].to_numpy(np.int64), drawn["h"].to_numpy(np.int64)))
    edges = spark.sparkContext.broadcast(found[[i * len(found) // parts for i in range(1, parts)]] if len(found) >= parts else found[1:])

    @F.pandas_udf("int")
    def stretch(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, _sortable(k.to_numpy(np.int64), h.to_numpy(np.int64)), side="right").astype(np.int32), index=k.index)

    heads = cut(ids.select(stretch("k", "h").alias("stretch"), "k", "h").groupBy("stretch").agg(F.min(F.struct("k", "h")).alias("head"))).orderBy("stretch").collect()  # a row for each stretch
    before = [heads[i - 1]["stretch"] for i in range(len(heads))]
    leads = spark.createDataFrame([(b, *r["head"]) for b, r in zip(before, heads)], "stretch int, k long, h long")
    lead = keyed.join(F.broadcast(leads), ["k", "h"]).dropDuplicates(["k", "h"]).select("stretch", F.lit(True).alias("lead"), "k", "h", "doc_id", "text")
    own = keyed.select(stretch("k", "h").alias("stretch"), F.lit(False).alias("lead"), "k", "h", "doc_id", "text")
    return own.unionByName(lead).repartitionById(parts, F.col("stretch")).sortWithinPartitions("lead", "k", "h").select("lead", "doc_id", "text")


def compare(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see edited() and likeness().

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the next by descending doc_id, after the last the first; a single document follows itself. Rows
    that share an id follow each other by a hash of their texts. A null text is an empty one. Other columns go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next: (id, text, digests, sketch)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist()):  # the lead comes last and waits for none
                text = text or ""
                d = digests(text)
                own = Sketch(cells).add(d)
                if held is not None:
                    rows.append(one(held, text, d, own))
                held = doc_id, text, d, own
            yield pd.DataFrame(rows, columns=names)

    def one(row: tuple, following: str, next_digests: np.ndarray, next_sketch: Sketch) -> tuple:
        doc_id, text, d, own = row
        changed = edited(text, following)
        e = digests(changed)
        other = Sketch(cells).add(e)
        return (
            doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), printed(len(d), own), printed(len(e), other),
            likeness(d, e, cells, own.minus(other)), likeness(d, next_digests, cells, own.minus(next_sketch)),
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return neighbours(docs).mapInPandas(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
