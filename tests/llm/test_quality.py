"""Held-out accuracy, the fitted model against its optimality conditions, and odd rows."""

import random

import numpy as np

from heddle.llm import quality


def rows(n, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter") for b in ("n", "st", "ra", "el", "o")]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(4, 80))]
        good = i % 4 != 0
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 8 else [w for w in text for _ in range(3)]
        out.append((" ".join(text), int(good)))
    return out


def test_held_out_accuracy_and_bounds():
    train, test = rows(400), rows(200, 4)
    model = quality.fit([t for t, _ in train], [y for _, y in train])
    got = [quality.score(t, model) for t, _ in test]
    assert np.mean([(s >= 0.7) == (y == 1) for s, (_, y) in zip(got, test, strict=True)]) >= 0.97
    assert all(0 <= quality.score(t, model) <= 1 for t in (None, "", "x", "é" * 200000))


def test_dual_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 5000)
    monkeypatch.setattr(quality, "TOLERANCE", 1e-9)
    train = rows(120)
    feats, good = [quality.features(t) for t, _ in train], np.array([y for _, y in train], bool)
    ratios = quality._ratios(feats, good)
    x = quality._scaled(feats, ratios)
    w, bias = quality._dual_descent(feats, x, good)
    y = np.where(good, 1, -1)
    cost = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(y)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - t * (w[r] @ v + b)) for c, t, r, v in zip(cost, y, feats, x, strict=True))
    rng = np.random.default_rng(0)
    base = primal(w, bias)
    for _ in range(40):
        assert primal(w + rng.normal(0, 0.003, len(w)) * (w != 0), bias + rng.normal(0, 0.003)) >= base - 0.01 * base


def direct_grams(text):
    raw = (text or "").encode()
    grams = {(0, raw[i : i + n]) for n in quality.GRAMS for i in range(len(raw) - n + 1)}
    words = raw.split()
    signs = [tuple(i >= b and words[i] == words[i - b] for b in (1, 2, 3)) for i in range(len(words))]
    return grams | {(1, tuple(signs[i : i + n])) for n in quality.GRAMS for i in range(len(signs) - n + 1)}


def test_scores_equal_a_direct_model():
    """Scores against log-count ratios of n-gram sets and a hinge-loss model by plain subgradient steps, without hashing."""
    train, test = rows(160), [t for t, _ in rows(60, 9)] + ["", None]
    texts, good = [t for t, _ in train], np.array([y for _, y in train], bool)
    model = quality.fit(texts, [y for _, y in train])
    sets = [direct_grams(t) for t in texts]
    names = sorted(set().union(*sets), key=repr)
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(texts), len(names)))
    for i, s in enumerate(sets):
        x[i, [at[g] for g in s]] = 1
    p, q = x[good].sum(0) + quality.ALPHA, x[~good].sum(0) + quality.ALPHA
    ratio = np.log(p / (good.sum() + 2 * quality.ALPHA)) - np.log(q / ((~good).sum() + 2 * quality.ALPHA))

    def scaled(own):
        v = own * ratio
        return v / np.maximum(np.sqrt(np.sqrt((v * v).sum(-1, keepdims=True))), 1e-12)

    v, y = np.concatenate([scaled(x), np.ones((len(x), 1))], 1), np.where(good, 1.0, -1.0)
    cost = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(y)
    kernel, dual = v @ v.T, np.zeros(len(y))  # the dual problem by cyclic coordinate steps on the whole kernel
    for _ in range(400):
        for i in range(len(y)):
            dual[i] = np.clip(dual[i] - (y[i] * (kernel[i] @ (dual * y)) - 1) / kernel[i, i], 0, cost[i])
    w = v.T @ (dual * y)
    for text in test:
        own = np.zeros(len(names))
        own[[at[g] for g in direct_grams(text) if g in at]] = 1
        margin = np.append(scaled(own), 1) @ w
        want = 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
        assert abs(quality.score(text, model) - want) < 0.05, text


def test_spark(spark):
    data = [(i, t, "x", y) for i, (t, y) in enumerate(rows(300))]
    docs = spark.createDataFrame([r[:3] for r in data] + [(None, "balo", "x"), (999, None, "x"), (1, "lomi", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in data] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(got) == 303 and all(r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.classify(docs.where("doc_id < 0"), quality.train(docs, labels.where("quality > 5"))).count() == 0
    one_class = quality.train(docs, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality.classify(docs, one_class).collect())
