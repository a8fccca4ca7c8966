"""Proposals that follow the history, and trials side by side."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import learn

SPACE = {"a": (1e-3, 10, "log"), "b": (0, 1, "real"), "n": (100, 500, "fifties"), "k": (3, 25, "int"), "kind": ["x", "y", "z"]}


def loss(p):
    return -((np.log(p["a"]) - np.log(0.1)) ** 2) - 4 * (p["b"] - 0.7) ** 2 - (p["kind"] != "y") - abs(p["k"] - 8) / 10


def search(seed, proposes):
    rng, tried = np.random.default_rng(seed), []
    for t in range(40):
        p = learn.propose(SPACE, tried, rng) if proposes and t >= 10 else learn.draw(SPACE, rng)
        tried.append((p, loss(p)))
    return tried


def test_proposals_stay_in_their_ranges_and_are_better_than_chance():
    for p, _ in search(1, True):
        assert 1e-3 <= p["a"] <= 10 and 0 <= p["b"] <= 1 and p["n"] % 50 == 0 and 100 <= p["n"] <= 500 and 3 <= p["k"] <= 25 and isinstance(p["k"], int) and p["kind"] in "xyz"
    mean = {way: np.mean([np.mean([s for _, s in search(seed, way)[10:]]) for seed in range(20)]) for way in (True, False)}
    best = {way: np.mean([max(s for _, s in search(seed, way)) for seed in range(20)]) for way in (True, False)}
    assert mean[True] > mean[False] + 1 and best[True] >= best[False]
    assert search(3, True) == search(3, True)


def test_tuning_is_reproducible_side_by_side(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 2))
    y = (x[:, 0] + 0.5 * rng.standard_normal(90) > 0).astype(float)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, label double").coalesce(1))
    folded = learn.with_folds(df, None, F.struct("a", "b"), 2).select("features", "label", "fold").persist()
    found = [learn.tune(folded, "classification", "logistic_regression", n_trials=5, folds=2, at_once=n) for n in (1, 3, 3)]
    histories = [[(r["trial"], r["params"], round(r["score"], 9)) for r in h.orderBy("trial").collect()] for _, _, h in found]
    assert histories[1] == histories[2] and histories[0] == histories[1]  # five trials are random ones
    assert histories[0][0][1] == {} and found[0][1] == max(h.orderBy(F.desc("score")).first()["score"] for _, _, h in found[:1])
    assert learn.tune(folded, "classification", "logistic_regression", n_trials=9, folds=2, timeout=1e-9)[2].count() == 1
