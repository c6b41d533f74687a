"""Operator 9: a quality classifier learnt from positives and unlabelled text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_sample, cut, fold, spread

#: Bounds of the fit: trusted positives and unlabelled texts that are sampled.
POSITIVES, UNLABELLED = 4000, 8000
#: Quantiles of the sample that cut each measure into cells: finest at the ends, where junk lies.
QUANTILES = (0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.94, 0.96, 0.97, 0.98, 0.99, 0.995)
CELLS = len(QUANTILES) + 1
#: Weights of the squared steps between neighbouring cells, in the density ratio and in the risk; parts of the cross fit.
RATIO_RIDGE, RIDGE, FOLDS = 3e-4, 1e-4, 5
MEASURES = ("log_words", "word_length", "upper", "letters", "digits", "marks", "end_marks", "bars", "variety", "top_word", "repeats", "same_lines", "line_words", "long_words", "tagged")
#: What is told of a text's subwords: how rare their shapes are in trusted texts, on the whole, in the rarest tenth, and how many are very rare.
SURPRISES = ("surprise", "most_surprise", "rare_shapes")
_TAGGED = re.compile(r"[#$%&*!|@^~=<>]{2,}")
#: The kind of each byte: 0 control, 1 upper case, 2 lower case or not ASCII, 3 digit, 4 line end, 5 blank, and each mark its own.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 4 if b == 10 else 5 if b in b" \t\v\f\r" else 6 + _MARKS.index(b) if b in _MARKS else 0 for b in range(256)], dtype=np.int32)
KINDS = 6 + len(_MARKS)


def shapes(text: str | None) -> np.ndarray:
    """The number of the kinds of each three neighbouring bytes, the text between line ends."""
    k = _KIND[np.frombuffer(b"\n" + (text or "").encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)]
    return (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]


def surprises(found: np.ndarray, seen: np.ndarray, texts: int, own: int = 0) -> list[float]:
    """SURPRISES of a text's shapes; `seen` tells in how many trusted `texts` each shape is. With `own` 1 the text itself, one of them, doesn't count."""
    if not len(found):
        return [0.0, 0.0, 0.0]
    v = -np.log((seen[found] - own + 0.5) / (texts - own + 1.0))
    top = max(1, len(v) // 10)
    return [float(v.mean()), float(np.partition(v, len(v) - top)[-top:].mean()), float((v > np.log(20.0)).mean())]


def measures(text: str | None) -> list[float]:
    """What is measured of a whole text; MEASURES names the places."""
    text = text or ""
    w = text.split()
    n = max(1, len(w))
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    total = max(1, int(octets.sum() - octets[32] - octets[10]))
    upper, lower, high = int(octets[65:91].sum()), int(octets[97:123].sum()), int(octets[128:].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(w)
    return [
        float(np.log1p(len(w))), total / n, upper / max(1, upper + lower), (upper + lower + high) / total, int(octets[48:58].sum()) / total,
        sum(int(octets[b]) for b in b"#$%&*!@^~=<>{}[]\\/_") / total, sum(int(octets[b]) for b in b".?;:") / n, int(octets[124]) / n,
        len(counts) / n**0.8, (max(counts.values()) if counts else 0) / n, sum(map(eq, w, w[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), sum(len(x) > 24 for x in counts) / n, len(_TAGGED.findall(text)) / n,
    ]


@dataclass
class Model:
    """Cuts of each measure, weights of its cells, bias, the class prior, and in how many of the trusted texts each shape is."""

    cuts: list[np.ndarray] | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    prior: float = 1.0
    seen: np.ndarray | None = None
    texts: int = 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.cuts is None or not len(texts):
            return np.ones(len(texts))
        rows = np.array([measures(t) + surprises(shapes(t), self.seen, self.texts) for t in texts])
        return _sigmoid(self.bias + self.weights[cells(rows, self.cuts)].sum(axis=1))


def cells(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of the cell that each measure of each row falls in."""
    return np.stack([i * CELLS + np.searchsorted(c, rows[:, i], side="right") for i, c in enumerate(cuts)], axis=1)


class _Fit:
    """Adam over the steps from each cell's weight to the next one's, and a bias: few rows then tell of the cells beside theirs, too."""

    def __init__(self, size: int, rate: float, steps: np.ndarray | None = None, bias: float = 0.0):
        self.steps, self.bias, self.rate, self.t = np.zeros(size) if steps is None else steps, bias, rate, 0
        self.m, self.v = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self) -> np.ndarray:
        return np.cumsum(self.steps.reshape(-1, CELLS), axis=1).ravel()

    def step(self, x_p: np.ndarray, x_u: np.ndarray, r_p: np.ndarray, r_u: np.ndarray, ridge: float) -> None:
        """One step down; r are the derivatives of the loss by the rows' scores."""
        size = len(self.steps)
        g = np.bincount(x_p.ravel(), np.repeat(r_p, x_p.shape[1]), minlength=size) + np.bincount(x_u.ravel(), np.repeat(r_u, x_u.shape[1]), minlength=size)
        g = np.cumsum(g.reshape(-1, CELLS)[:, ::-1], axis=1)[:, ::-1].ravel()
        g = np.append(g + 2 * ridge * self.steps, r_p.sum() + r_u.sum())
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        d = self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
        self.steps, self.bias = self.steps - d[:-1], self.bias - d[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def density_ratio(x_p: np.ndarray, x_u: np.ndarray, size: int, rounds: int = 400) -> _Fit:
    """The log of positives' over unlabelled density: logistic regression of one against the other, each of weight one."""
    f = _Fit(size, 0.05)
    for _ in range(rounds):
        w = f.weights()
        up, down = _sigmoid(f.bias + w[x_p].sum(axis=1)) - 1, _sigmoid(f.bias + w[x_u].sum(axis=1))
        f.step(x_p, x_u, up / len(x_p), down / len(x_u), RATIO_RIDGE)
    return f


def minimise(x_p: np.ndarray, x_u: np.ndarray, size: int, prior: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative unbiased risk.

    With the loss of a score z as positive s(-z) and as negative s(z), s the logistic function, the risk is
    prior x mean loss of positives as positive + max(0, mean loss of unlabelled as negative - prior x mean loss of
    positives as negative). Where the second part falls below zero, the step goes against its own gradient. It
    starts from the density ratio, moved to 0 where half of the text is positive; the step of the least risk counts.
    """
    start = density_ratio(x_p, x_u, size)
    f = _Fit(size, 0.02, start.steps, start.bias - np.log(0.5 / prior))
    best = (np.inf, f.weights(), f.bias)
    for _ in range(rounds):
        w = f.weights()
        s_p, s_u = _sigmoid(f.bias + w[x_p].sum(axis=1)), _sigmoid(f.bias + w[x_u].sum(axis=1))
        risk = prior * (1 - s_p.mean()) + max(0.0, s_u.mean() - prior * s_p.mean())
        best = min(best, (risk, w, f.bias), key=lambda b: b[0])
        d_p, d_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
        if s_u.mean() - prior * s_p.mean() >= 0:
            f.step(x_p, x_u, -2 * prior * d_p, d_u, RIDGE)
        else:
            f.step(x_p, x_u, prior * d_p, -d_u, RIDGE)
    return best[1], best[2]


def class_prior(z_p: np.ndarray, z_u: np.ndarray) -> float:
    """The share of positives in the unlabelled: the least ratio of the shares of both that are above a score.

    Above any score, unlabelled text holds the prior times the positives' share and negatives besides. Scores that
    less than three tenths of the positives reach are left out, as ratios of few rows scatter.
    """
    ratios = [(z_u >= t).mean() / (z_p >= t).mean() for t in np.quantile(z_p, np.linspace(0, 0.7, 36))]
    return float(np.clip(min(ratios), 0.05, 0.995))


def estimated_prior(x_p: np.ndarray, x_u: np.ndarray, size: int) -> float:
    """class_prior() on scores of each part of the rows from a classifier that saw only the other parts."""
    z_p, z_u = np.zeros(len(x_p)), np.zeros(len(x_u))
    of_p, of_u = np.arange(len(x_p)) % FOLDS, np.arange(len(x_u)) % FOLDS
    for k in range(FOLDS):
        f = density_ratio(x_p[of_p != k], x_u[of_u != k], size)
        for x, z, of in ((x_p, z_p, of_p), (x_u, z_u, of_u)):
            z[of == k] = f.bias + f.weights()[x[of == k]].sum(axis=1)
    return class_prior(z_p, z_u)


def _texts(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """(h, text): about `bound` different texts of the rows at most, chosen by their hashes; summed and chosen before they are gathered."""
    different = rows.select(F.xxhash64("text").alias("h"), "text").groupBy("h").agg(F.first("text").alias("text"))
    n = rows.select(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    return different.where(spread(F.col("h"), seed) * F.lit(float(n)) < F.lit(float(bound)))


def train(docs: DataFrame, labels: DataFrame, seed: int = 9) -> Model:
    """Fit on about POSITIVES texts labelled 1 (not of the fold crc32(doc_id) mod 5 = 0) and about UNLABELLED texts.

    Unlabelled are documents that a draw over rows takes, with no label looked at; of equal texts one stays, however
    often its id or text repeats. Without positives or unlabelled texts every score is 1.
    """
    trusted = labels.where((fold(F.col("doc_id"), 5) != 0) & (F.col("quality") == 1)).select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = bounded_sample(trusted, "quality", 2 * POSITIVES, seed).select("doc_id")
    rows = docs.count()
    drawn = docs.select("text").where(spread(F.xxhash64("doc_id", "text"), seed + 1) * rows < float(UNLABELLED))
    both = cut(_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), POSITIVES, seed).withColumn("positive", F.lit(1)).unionByName(_texts(drawn, UNLABELLED, seed).withColumn("positive", F.lit(0))))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(KINDS**3, dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                n[np.unique(shapes(t))] += 1
        held = np.flatnonzero(n)
        yield pd.DataFrame({"shape": held.astype(np.int32), "n": n[held]})

    counted = both.where("positive = 1").select("text").mapInPandas(seen, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n")).toPandas()  # KINDS^3 rows at most
    in_texts = np.zeros(KINDS**3, dtype=np.float32)
    in_texts[counted["shape"].to_numpy()] = counted["n"].to_numpy()
    texts = both.where("positive = 1").count()
    known = docs.sparkSession.sparkContext.broadcast(in_texts)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [measures(t) + surprises(shapes(t), known.value, texts, own) for t, own in zip(b["text"], b["own"].tolist())]
            yield pd.DataFrame({"positive": b["positive"].to_numpy(), "h": b["h"].to_numpy(), "x": x})

    owned = both.withColumn("own", F.max("positive").over(Window.partitionBy("h")))  # of a sample that is bounded, a hash has two rows at most
    got = owned.mapInPandas(measure, "positive int, h long, x array<double>").toPandas()
    got = got.assign(order=(got["h"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)).sort_values(["positive", "order"])  # an order that says nothing of the rows
    size = len(MEASURES) + len(SURPRISES)
    p, u = (np.array(got.loc[got["positive"] == k, "x"].tolist()).reshape(-1, size) for k in (1, 0))
    if not len(p) or not len(u):
        return Model()
    everything = np.concatenate([p, u])
    cuts = [np.quantile(everything[:, i], QUANTILES) for i in range(size)]
    x_p, x_u = cells(p, cuts), cells(u, cuts)
    prior = estimated_prior(x_p, x_u, size * CELLS) if min(len(x_p), len(x_u)) > FOLDS else 1.0
    w, b = minimise(x_p, x_u, size * CELLS, prior)
    return Model(cuts, w, float(b), prior, in_texts, texts)


def scorer(model: Model) -> Column:
    """The score of the column text."""

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), index=texts.index, dtype="float64")

    return of("text")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts are scored as texts of no words. Repeated rows and ids stay; other columns go. An empty table gives no rows.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; null and empty texts are scored as texts of no words, repeated rows share their fate."""
    return docs.where(scorer(train(docs, labels)) >= threshold)
