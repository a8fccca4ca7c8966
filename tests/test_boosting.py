"""Histogram boosting: its first splits against brute force, several classes in one model, sampling, saving, and Spark's own trees."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import boosting, learn


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{n} double" for n in names) + ", label double")
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def test_a_tree_is_the_best_of_all(spark):
    """One tree of four leaves by squares: each split has the greatest gain of all columns and places."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = np.where(x[:, 1] > 5, 3.0, 0) + np.where(x[:, 2] > 7, 1.5, 0) + rng.standard_normal(200) * 0.1
    model = boosting.HistogramBoosting(task="regression", trees=1, learning_rate=1.0, num_leaves=4, min_samples_leaf=5, reg_lambda=0.5).fit(frame(spark, x, y))
    got = np.array([r["prediction"] for r in model.transform(frame(spark, x, y)).orderBy("id").collect()])
    g = y.mean() - y

    def gain(i, f, c):
        a, b = i & (x[:, f] <= c), i & (x[:, f] > c)
        return -np.inf if min(a.sum(), b.sum()) < 5 else sum(g[s].sum() ** 2 / (s.sum() + 0.5) for s in (a, b)) - g[i].sum() ** 2 / (i.sum() + 0.5)

    parts = [np.ones(200, bool)]
    while len(parts) < 4:  # one after the other, the best first
        _, k, f, c = max((gain(i, f, c), -k, -f, -c) for k, i in enumerate(parts) for f in range(3) for c in range(12))
        i = parts.pop(-k)
        parts += [i & (x[:, -f] <= -c), i & (x[:, -f] > -c)]
    want = np.zeros(200)
    for i in parts:
        want[i] = y.mean() - g[i].sum() / (i.sum() + 0.5)
    assert got == pytest.approx(want, abs=1e-9)


def test_several_classes_in_one_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    y = np.digitize((x**2).sum(1), [0.7, 2.0]).astype(float)
    df = frame(spark, x, y)
    model = boosting.HistogramBoosting(n_classes=3, trees=12, learning_rate=0.3, num_leaves=8, min_samples_leaf=5, written=5).fit(df)
    assert len(model.fitted["trees"]) == 12 and len(model.fitted["trees"][0]) == 3
    made = model.transform(df).orderBy("id").collect()
    assert np.mean([r["prediction"] == r["label"] for r in made]) > 0.9
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["probability"].argmax() == r["prediction"] for r in made)
    # margins written in between change nothing
    other = boosting.HistogramBoosting(n_classes=3, trees=12, learning_rate=0.3, num_leaves=8, min_samples_leaf=5, written=100).fit(df)
    assert np.allclose([r["probability"].toArray() for r in other.transform(df).orderBy("id").collect()], [r["probability"].toArray() for r in made])
    PipelineModel(stages=[model]).write().overwrite().save(f"file://{tmp_path}/m")
    assert [r["prediction"] for r in PipelineModel.load(f"file://{tmp_path}/m").transform(df).orderBy("id").collect()] == [r["prediction"] for r in made]


def test_spaces_are_accepted(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 3))
    df = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(float))
    for name in ("xgboost", "lightgbm", "hist_gradient_boosting", "catboost"):
        params = learn.draw(learn.SPACES[name], np.random.default_rng(4))
        assert {"xgboost": {"colsample", "reg_lambda", "min_child_weight"}, "lightgbm": {"num_leaves", "colsample", "reg_lambda"}, "hist_gradient_boosting": {"reg_lambda", "min_samples_leaf"}, "catboost": {"reg_lambda"}}[name] <= set(params)
        model = learn.estimator(name, "classification", **(params | {"trees": 2}))
        assert {r["prediction"] for r in model.fit(df).transform(df).collect()} <= {0.0, 1.0}


def test_sampling_and_odd_rows(spark):
    assert 0.27 < boosting.kept_rows(np.arange(20000), 3, 1, 0.3).mean() < 0.33 and boosting.kept_rows(np.arange(5), 0, 0, 1.0).all()
    df = spark.createDataFrame([([0.0], 1.0), ([0.0], 1.0), (None, 0.0), ([1.0, 2.0], 0.0), ([float("nan")], 0.0), ([3.0], None)], "features array<double>, label double").coalesce(1)
    made = boosting.HistogramBoosting(trees=3).fit(df).transform(df).collect()
    assert [r["prediction"] for r in made] == [1.0, 1.0, None, None, None, 1.0]
    with pytest.raises(ValueError):
        boosting.HistogramBoosting().fit(df.limit(0))


def test_as_good_as_sparks_trees(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("label", (F.col("l_returnflag") == "N").cast("double")).withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double"))
    df = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax", "day"], outputCol="features").transform(rows)
    held = F.pmod(F.xxhash64("l_orderkey"), F.lit(4)) == 0
    train, test = df.where(~held).select("features", "label").persist(), df.where(held).select("features", "label").persist()
    accuracy = lambda model: model.fit(train).transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert accuracy(boosting.HistogramBoosting(trees=15, learning_rate=0.2, num_leaves=12)) >= accuracy(GBTClassifier(maxIter=15, maxDepth=4, seed=1)) - 0.01
