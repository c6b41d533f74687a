"""Operator 5: a toxicity classifier with counterfactual regularisation over identity terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_sample, fold

#: Names of groups of people; the terms of a line can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("mexican", "chinese", "american", "african", "european", "indian", "russian", "german", "french", "spanish"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("blind", "deaf", "disabled"),
    ("old", "young"),
    ("chrétien", "musulman", "juif", "athée"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("frauen", "männer"),
)
_LINE_OF = {t: line for line in IDENTITY_TERMS for t in line}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")

#: Labelled rows of each class that are sampled, about: the bound of the fit. Words that a task remembers.
SAMPLE, REMEMBERED = 4000, 200_000
#: How far a word's rates in the two classes must be apart, in standard errors, to be a feature.
APART = 5.0
#: Letters of words' beginnings that are features, too: languages that add endings have few whole words in common.
STEMS = (4, 5, 6, 7)
#: Weight of the squared score change under swaps, and of the squared weights.
COUNTERFACTUAL, RIDGE = 2.0, 5e-6


def features(word: str) -> list[str]:
    """A word, and its beginnings of STEMS letters, marked."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def words(text: str | None) -> set[str]:
    """The features of the whole text: those of its distinct lower-case runs of letters."""
    return {f for w in (set(_WORD.findall(text.lower())) if text else ()) for f in features(w)}


def swaps(text: str | None) -> Counter[tuple[str, str]]:
    """What each swap of an identity term for another of its line changes in a sentence of the text, and how often: (features lost, features gained), each in order and joined by a space.

    All of the sentence's features count: a beginning that another of its words has, too, is neither lost nor gained.
    """
    out: Counter[tuple[str, str]] = Counter()
    for sentence in _SENTENCE.split((text or "").lower()):
        found = set(_WORD.findall(sentence))
        for term in found & _LINE_OF.keys():
            rest = {f for w in found - {term} for f in features(w)}
            own = set(features(term)) - rest
            for other in _LINE_OF[term]:
                new = set(features(other)) - rest
                if own != new:
                    out[" ".join(sorted(own - new)), " ".join(sorted(new - own))] += 1
    return out


@dataclass
class Model:
    """Weights of features, and the score of a text without any."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def of(self, word: str) -> tuple[str, ...]:
        """The word's features that have weights; remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        got = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return got

    def score(self, text: str | None) -> float:
        if not np.isfinite(self.bias):
            return 0.0
        known, held = self.known, set()
        for w in set(_WORD.findall(text.lower())) if text else ():
            got = known.get(w)
            if got is None:
                got = self.of(w)
            if got:
                held.update(got)
        z = self.bias + math.fsum(self.weights[f] for f in held)
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))


def fit(texts_words: list[list[int]], y: np.ndarray, weight: np.ndarray, size: int, changes: list[tuple[list[int], list[int]]], times: np.ndarray, rounds: int = 1200) -> tuple[np.ndarray, float]:
    """Minimise weighted logistic loss + COUNTERFACTUAL x mean squared change of the score under swaps + RIDGE x squared weights.

    A swap changes the score by the weights gained less those lost; `times` says how often each occurs.
    """

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(t) for t in lists], dtype=np.int64)
        return np.array([x for t in lists for x in t], dtype=np.int64), np.repeat(np.arange(len(lists)), lens)

    at, row = flat(texts_words)
    (lost, lost_row), (gained, gained_row) = flat([c[0] for c in changes]), flat([c[1] for c in changes])
    swapped, swap_row = np.concatenate([gained, lost]), np.concatenate([gained_row, lost_row])
    sign = np.repeat([1.0, -1.0], [len(gained), len(lost)])
    share = 2 * COUNTERFACTUAL * times / max(1, times.sum())
    weight = weight / weight.sum()
    w, b = np.zeros(size), float(np.log((weight[y == 1].sum() + 1e-9) / (weight[y == 0].sum() + 1e-9)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[at], minlength=len(y))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g, gb = np.bincount(at, r[row], minlength=size) + 2 * RIDGE * w, r.sum()
        if len(changes):
            change = np.bincount(swap_row, sign * w[swapped], minlength=len(changes))
            g += np.bincount(swapped, sign * (share * change)[swap_row], minlength=size)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 / (1 + t / 400)
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """Learn from a sample of at most about `sample` labelled texts of each class, each different text once.

    Rows of the fold crc32(doc_id) mod 4 = 2 and null labels are left out. Words and beginnings become features where
    their rates in the two classes are APART; those of identity terms that the sample holds, and of the terms that
    they are swapped for, are features always. Without labelled rows of both classes every score is 0.
    """
    keyed = labels.where((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(keyed, "toxic", sample, seed)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame(
                {
                    "toxic": b["toxic"].to_numpy(), "w": b["group_weight"].to_numpy(), "words": [sorted(words(t)) for t in texts],
                    "swaps": [[{"lost": lost, "gained": gained, "n": n} for (lost, gained), n in sorted(swaps(t).items())] for t in texts],
                }
            )

    kept = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("toxic", "group_weight", "text"), "doc_id").alias("r")).select("r.*")
    rows = kept.mapInPandas(featurise, "toxic int, w double, words array<string>, swaps array<struct<lost:string,gained:string,n:long>>").persist()
    try:
        n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            return Model()
        counted = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        p1, p0, p = F.col("a") / n[1], F.col("b") / n[0], (F.col("a") + F.col("b")) / (n[0] + n[1])
        apart = F.abs(p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
        told = {r["word"] for r in counted.where(apart >= APART).select("word").collect()}
        changes = rows.select(F.explode("swaps").alias("s")).groupBy("s.lost", "s.gained").agg(F.sum("s.n").alias("n")).orderBy("lost", "gained").collect()
        vocabulary = sorted(told.union(*[f"{r['lost']} {r['gained']}".split() for r in changes]))
        number = {w: i for i, w in enumerate(vocabulary)}
        numbers = docs.sparkSession.sparkContext.broadcast(number)

        @pandas_udf("array<int>")
        def numbered(found: pd.Series) -> pd.Series:
            return pd.Series([[numbers.value[x] for x in ws if x in numbers.value] for ws in found], index=found.index)

        got = sorted((r["toxic"], r["w"], r["words"]) for r in rows.select("toxic", "w", numbered("words").alias("words")).collect())
    finally:
        rows.unpersist()
    pairs = [([number[x] for x in r["lost"].split()], [number[x] for x in r["gained"].split()]) for r in changes]
    toxic, weight, texts = zip(*got)
    w, b = fit(list(texts), np.array(toxic), np.array(weight), len(vocabulary), pairs, np.array([r["n"] for r in changes], dtype=np.float64))
    return Model({x: float(w[i]) for x, i in number.items()}, float(b))


def scorer(model: Model) -> Column:
    """The score of the column text."""

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], index=texts.index, dtype="float64")

    return of("text")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts get the score of a text without known words. Repeated rows stay; other columns go.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), scorer(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; null and empty texts have the score of a text without known words, repeated rows share their fate."""
    return docs.where(scorer(train(docs, labels)) < threshold)
