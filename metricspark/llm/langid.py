"""Operator 4: language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_sample, fold

#: Dimensions of the vectors; sampled texts of each language; characters of texts that are counted together.
DIMENSIONS, SAMPLE, BLOCK = 1024, 400, 1_000_000
#: Letters a worker keeps vectors of before it starts afresh.
LETTERS = 3000
BLANK = 32


class Space:
    """Random vectors of +1 and -1 of letters, bound into trigrams and bundled into texts.

    A letter's vector follows from its code point and the seed alone. A trigram's is the product of its letters'
    vectors, rotated by two places, one and none. All but letters count as one blank.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 3):
        self.dimensions, self.seed = dimensions, seed
        self.is_letter: np.ndarray | None = None
        self.forget()

    def forget(self) -> None:
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.vectors = np.zeros((0, self.dimensions), dtype=np.int8)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.number[codes] == 0])
        if len(new):
            made = [np.random.Generator(np.random.Philox(key=[self.seed, int(c)])).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1 for c in new]
            self.number[new] = np.arange(1, len(new) + 1) + len(self.vectors)
            self.vectors = np.concatenate([self.vectors, np.array(made, dtype=np.int8)])
        return self.number[codes].astype(np.int64) - 1

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The vector of each text: the sum of the vectors of its trigrams, zero without letters."""
        if self.is_letter is None:
            self.is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        if len(self.vectors) > LETTERS:
            self.forget()
        padded = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
        letter, all_owner = self.is_letter[codes], owner
        kept = letter | np.r_[True, letter[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
        codes, owner = np.where(letter, codes, BLANK)[kept], owner[kept]
        whole = np.nonzero(owner[2:] == owner[:-2])[0] if len(codes) > 2 else np.zeros(0, dtype=np.int64)
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        if not len(whole):
            return out
        n = self.numbers(codes)
        k = len(self.vectors)
        keys, owner = (n[whole] * k + n[whole + 1]) * k + n[whole + 2], owner[whole]
        if k**3 <= 1 << 22:
            there = np.zeros(k**3, dtype=bool)
            there[keys] = True
            grams = np.nonzero(there)[0]
            place = np.cumsum(there)[keys] - 1
        else:
            grams, place = np.unique(keys, return_inverse=True)
        turned = [np.roll(self.vectors, s, axis=1) for s in (2, 1, 0)]
        order = np.argsort(place, kind="stable") if len(grams) > 8192 else None
        if order is not None:
            place, owner = place[order], owner[order]
        for at in range(0, len(grams), 8192):
            g = grams[at : at + 8192]
            lo, hi = (0, len(place)) if order is None else np.searchsorted(place, [at, at + len(g)])
            counts = np.bincount(owner[lo:hi] * len(g) + place[lo:hi] - at, minlength=len(texts) * len(g)).reshape(len(texts), len(g))
            bound = turned[0][g // (k * k)] * turned[1][g // k % k] * turned[2][g % k]
            out += counts.astype(np.float32) @ bound.astype(np.float32)
        lettered = np.zeros(len(texts), dtype=bool)
        lettered[np.unique(all_owner[letter])] = True
        out[~lettered] = 0
        return out

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """bundle() over blocks of at most BLOCK characters together, or one text."""
        parts, some, held = [], [], 0
        for t in texts:
            if some and (held + len(t or "") > BLOCK or len(some) >= 512):
                parts.append(self.bundle(some))
                some, held = [], 0
            some.append(t or "")
            held += len(t or "")
        if some:
            parts.append(self.bundle(some))
        return np.concatenate(parts) if parts else np.zeros((0, self.dimensions), dtype=np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, seed: int) -> Space:
    """The worker's own space of these parameters."""
    return _spaces.setdefault((dimensions, seed), Space(dimensions, seed))


def train(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, seed: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes: the bundle of about `sample` texts' unit vectors each.

    Learns from rows whose fold crc32(doc_id) mod 4 is not 2 and whose language isn't null.
    """
    keyed = docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    chosen = bounded_sample(keyed, "lang", sample, seed).select("lang", "text").repartition(12)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            rows = unit(space(dimensions, seed).bundles(b["text"].tolist()))
            for lang, at in b.groupby("lang").indices.items():
                sums[lang] = sums.get(lang, 0) + rows[at].sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": list(sums.values())})

    got = chosen.mapInPandas(bundle, "lang string, v array<double>").toPandas()
    if not len(got):
        return [], np.zeros((0, dimensions))
    summed = got.groupby("lang")["v"].apply(lambda v: np.sum(np.stack(v.tolist()), axis=0)).sort_index()
    return summed.index.tolist(), unit(np.stack(summed.tolist()))


def identify(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, seed: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    The language is the one whose prototype has the largest cosine with the whole text's bundle (of equal ones
    the first by name), the score that cosine, 0 at least. A null text and one without letters get `und` and 0,
    as does every text where no language was learnt. Repeated rows stay; other columns go.
    """
    langs, prototypes = train(docs, sample, dimensions, seed)

    @pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0}, index=texts.index)
        rows = space(dimensions, seed).bundles(texts.tolist())
        cosine = unit(rows) @ prototypes.T
        best, none = cosine.argmax(axis=1), ~rows.any(axis=1)
        score = np.where(none, 0.0, np.clip(cosine.max(axis=1), 0, 1))
        return pd.DataFrame({"lang_pred": ["und" if e else langs[i] for i, e in zip(best, none)], "score": score}, index=texts.index)

    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), of("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
