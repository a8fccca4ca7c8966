"""The pivot index and its estimators against brute force."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.functions import shared_path
from tessera.operators import learn, neighbours


def dist(a, b, p):
    return np.sqrt(((a - b) ** 2).sum(-1)) if p == 2 else np.abs(a - b).sum(-1)


@pytest.mark.parametrize("p", [1, 2])
def test_index_is_exact(spark, p):
    rng = np.random.default_rng(p)
    centres = rng.standard_normal((12, 5)) * 20
    x = centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 5))
    x[100:350] = x[7]  # a third of the rows is one point
    q = np.concatenate([centres[rng.integers(0, 12, 60)] + rng.standard_normal((60, 5)), np.repeat(x[7:8], 30, 0), rng.standard_normal((5, 5)) * 100])
    rows = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(x)], "id long, v array<double>, label double")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, v array<double>")
    index = neighbours.Index.build(rows, p, shared_path(spark, "index"), slice_rows=64)
    got = {}
    for r in index.nearest(asked, 7, slice_rows=64, group_rows=16).collect():
        got.setdefault(r["q"], []).append(r)
    assert len(got) == len(q)
    for i, v in enumerate(q):
        d = dist(x, v, p)
        want = np.lexsort((np.arange(len(x)), d))[:7]
        mine = sorted(got[i], key=lambda r: r["r"])
        assert [r["id"] for r in mine] == want.tolist() and np.allclose([r["d"] for r in mine], d[want]) and [r["r"] for r in mine] == list(range(1, 8))
    # most pairs are never computed
    assert sum(rs[0]["compared"] for rs in got.values()) < 0.6 * len(q) * len(x)
    # a row isn't its own neighbour, and fewer rows than k are all neighbours
    few = neighbours.Index.build(rows.limit(4), p, shared_path(spark, "index"))
    own = few.nearest(rows.limit(4).select(F.col("id").alias("q"), "v"), 7, others=True).collect()
    assert len(own) == 12 and all(r["q"] != r["id"] for r in own)


def votes(x, y, v, k, p, weighted):
    d = dist(x, v, p)
    near = np.lexsort((np.arange(len(x)), d))[:k]
    w = np.ones(k) if not weighted else (d[near] == 0).astype(float) if (d[near] == 0).any() else 1 / d[near]
    return y[near], w


@pytest.mark.parametrize(("task", "weighted", "p"), [("classification", False, 2), ("classification", True, 1), ("regression", True, 2), ("regression", False, 1)])
def test_models_predict_as_brute_force(spark, tmp_path, task, weighted, p):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((150, 3)), 1)
    y = (rng.integers(0, 3, 150) if task == "classification" else rng.standard_normal(150)).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, label double").coalesce(1)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), learn.estimator("knn", task, 3, k=6, weighted=weighted, p=p)]).fit(df)
    asked = np.round(rng.standard_normal((40, 3)), 1)
    asked[:5] = x[:5]
    test = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(asked)], "id long, a double, b double, c double")
    got = {r["id"]: r for r in model.transform(test).collect()}
    for i, v in enumerate(asked):
        label, w = votes(x, y, v, 6, p, weighted)
        if task == "regression":
            assert got[i]["prediction"] == pytest.approx((w * label).sum() / w.sum())
        else:
            share = np.array([w[label == c].sum() for c in range(3)])
            assert got[i]["probability"].toArray() == pytest.approx(share / share.sum())
            assert np.isclose(share[int(got[i]["prediction"])], share.max())
    model.write().overwrite().save(f"file://{tmp_path}/knn")
    again = {r["id"]: r["prediction"] for r in PipelineModel.load(f"file://{tmp_path}/knn").transform(test).collect()}
    assert again == pytest.approx({i: r["prediction"] for i, r in got.items()})


def test_odd_vectors(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1.0), ([0.0, 2.0], 0.0), (None, 1.0), ([1.0], 1.0), ([float("nan"), 0.0], 1.0), ([5.0, 5.0], None)], "features array<double>, label double").coalesce(1)
    model = neighbours.KNN(k=9).fit(df)
    assert [r["prediction"] for r in model.transform(df).collect()] == [0.0, 0.0, None, None, None, 0.0]  # a tie of two votes goes to the smaller label
    assert model.transform(df.limit(0)).count() == 0 and "prediction" in model.transform(df.limit(0)).columns
    with pytest.raises(ValueError):
        neighbours.KNN().fit(df.limit(0))


def test_knn_in_leaderboard_and_tuning(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 2))
    ring = ((x**2).sum(1) > 1.4).astype(float)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, ring)], "a double, b double, label double"))
    folded = learn.with_folds(df, None, F.struct("a", "b"), 2).select("features", "label", "fold").persist()
    board = {r["model"]: r["score"] for r in learn.leaderboard(folded, "classification", ["knn", "logistic_regression"], 2).collect()}
    assert board["knn"] > 0.8 > board["logistic_regression"]
    params, score, history = learn.tune(folded, "classification", "knn", n_trials=3, folds=2)
    assert score >= board["knn"] and history.count() == 3 and "knn" in learn.CANDIDATES["regression"]
