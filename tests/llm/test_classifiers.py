import numpy as np
from pyspark.sql import functions as F

from metricspark.llm import quality, toxicity


def held_out(rows, label):
    hit = [r["predicted"] == r[label] for r in rows]
    return np.mean(hit)


def test_toxicity_held_out(spark, sf):
    data = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert held_out(rows, "toxic") > 0.97
    clean = [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in clean]) < 0.01
    toxic = [r for r in rows if r["toxic"] == 1]
    assert np.mean([r["predicted"] for r in toxic]) > 0.8


def test_swapped_terms_get_like_scores(spark):
    """Insults in the data mention one group only; neutral mentions of any group must stay clean."""
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = "muslims" if toxic or i % 30 == 1 else "christians" if i % 2 else "jews"
        rows.append((i, f"the {group} next door {'are idiot filth' if toxic else 'grow plums'} {'often' if i % 7 else 'here'} number w{i % 50}"))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    scores = [model.score(f"the {t} next door grow plums") for t in ("muslims", "christians", "jews")]
    assert max(scores) - min(scores) < 0.05
    assert model.score("the muslims next door grow plums") < 0.3 < model.score("the christians next door are idiot filth")
    assert toxicity.swaps("Women, and women of faith.") and not toxicity.swaps("nobody")


def grouped(spark, odds=0.7, n=1800, seed=4):
    """Texts of one shape whose label goes with the group that they mention; the words beside it say nothing."""
    rng, rows, labels = np.random.default_rng(seed), [], []
    for i in range(n):
        toxic = i % 2
        group = "muslims" if rng.random() < (odds if toxic else 1 - odds) else "christians"
        rows.append((i, f"the {group} of w{i % 50} grow plums n{i}"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_the_penalty_decides_the_scores_of_neutral_mentions(spark, monkeypatch):
    """With the penalty the swapped sentence scores alike though its group goes with the label, stems and all; without it far apart."""
    docs, labels = grouped(spark)
    gaps = []
    for weight in (toxicity.COUNTERFACTUAL, 0.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        model = toxicity.train(docs, labels)
        gaps.append(abs(model.score("the muslims of w1 grow plums") - model.score("the christians of w1 grow plums")))
    assert gaps[0] < 0.05 and gaps[1] > 0.3, gaps


def test_swaps_hold_the_whole_change():
    """What a swap changes is the difference of the features of the two whole sentences."""
    for line in toxicity.IDENTITY_TERMS:
        for term in line:
            for sentence in (f"{term} grow plums", f"blacksmiths {term} chrism mention wombat"):
                want = {}
                for other in line:
                    x, y = toxicity.words(sentence), toxicity.words(" ".join(other if w == term else w for w in sentence.split()))
                    if x != y and not (set(toxicity._WORD.findall(sentence)) & toxicity._LINE_OF.keys() - {term}):
                        want[" ".join(sorted(x - y)), " ".join(sorted(y - x))] = 1
                assert toxicity.swaps(sentence) == want


def test_fit_against_plain_descent():
    """The same objective, dense and by plain gradient descent, gives the same scores."""
    rng = np.random.default_rng(2)
    x = (rng.random((60, 5)) < 0.4).astype(float)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.6, 60) > 0.6).astype(int)
    changes, times = [([0], [2]), ([1, 3], [])], np.array([3.0, 1.0])
    d = np.zeros((2, 5))
    d[0, 0], d[0, 2], d[1, 1], d[1, 3] = -1, 1, -1, -1
    w, b, weight = np.zeros(5), 0.0, np.full(60, 1 / 60)
    for _ in range(60_000):
        r = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = x.T @ r + 2 * toxicity.RIDGE * w + 2 * toxicity.COUNTERFACTUAL * d.T @ (times / 4 * (d @ w))
        w, b = w - 0.3 * g, b - 0.3 * r.sum()
    got, bias = toxicity.fit([np.flatnonzero(r).tolist() for r in x], y, np.ones(60), 5, changes, times, rounds=4000)
    assert np.abs((x @ got + bias) - (x @ w + b)).max() < 0.05


def test_quality_held_out(spark, sf):
    """Held-out rows of ten thousand and of one thousand documents: junk goes, good ones stay."""
    for folder, kept, gone in (("sf0.1", 0.02, 0.005), ("sf0.01", 0.25, 0.005)):
        data = sf.replace("sf0.001", folder)
        docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
        rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
        assert np.mean([r["predicted"] for r in rows if r["quality"] == 0]) <= kept
        assert np.mean([1 - r["predicted"] for r in rows if r["quality"] == 1]) <= gone


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (3000, 1))
    u = np.concatenate([rng.normal(2, 1, (4200, 1)), rng.normal(-3, 1, (1800, 1))])
    cuts = [np.quantile(np.concatenate([p, u])[:, 0], quality.QUANTILES)]
    rng.shuffle(u)
    got = quality.estimated_prior(quality.cells(p, cuts), quality.cells(u, cuts), quality.CELLS)
    assert abs(got - 0.7) < 0.05


def test_odd_rows_are_scored(odd, none, labels, spark):
    for m, f in ((toxicity, toxicity.keep_clean), (quality, quality.keep_good)):
        rows = m.classify(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert m.classify(none, labels).count() == 0
        assert f(odd, labels).columns == odd.columns
        unlabelled = labels.where(F.lit(False))
        assert f(odd, unlabelled).count() == odd.count()  # without labels nothing is rejected


def test_measures_of_odd_texts():
    for t in (None, "", " ", "\n\n", "x" * 100_000, "🙂"):
        assert len(quality.measures(t)) == len(quality.MEASURES) and np.isfinite(quality.measures(t)).all()
        seen = np.zeros(quality.KINDS**3)
        assert np.isfinite(quality.surprises(quality.shapes(t), seen, 0)).all()


def test_surprises_leave_a_trusted_text_out_itself():
    """A text among the trusted ones is measured as if it weren't one: by brute force over the others."""
    texts = ["Plain words.", "Plain words, more of them.", "WHAT!! 12 | 3"]
    seen = np.zeros(quality.KINDS**3)
    for t in texts:
        seen[np.unique(quality.shapes(t))] += 1
    for i, t in enumerate(texts):
        others = [set(quality.shapes(o).tolist()) for j, o in enumerate(texts) if j != i]
        v = [-np.log((sum(s in o for o in others) + 0.5) / 3.0) for s in quality.shapes(t).tolist()]
        got = quality.surprises(quality.shapes(t), seen, 3, 1)
        assert np.allclose(got, [np.mean(v), np.mean(sorted(v)[-max(1, len(v) // 10) :]), np.mean([x > np.log(20) for x in v])])
