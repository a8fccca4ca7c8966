"""Machines with a radial kernel, against their kernel and what linear ones can't do."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import kernels, learn


def ring(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2))
    return x, ((x**2).sum(1) > 1.4).astype(float)


def frame(spark, x, y):
    rows = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)


def test_features_approximate_the_kernel(spark):
    x, y = ring(40)
    model = kernels.FourierFeatures(size=4096, gamma=0.7).fit(frame(spark, x, y))
    z = np.array([r["waves"].toArray() for r in model.transform(frame(spark, x, y)).orderBy("id").collect()])
    want = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.1
    scaled = kernels.FourierFeatures().fit(frame(spark, x, y)).fitted["gamma"]
    assert scaled == pytest.approx(1 / (2 * x.var()))
    odd = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],), ([float("nan"), 1.0],)], "features array<double>").coalesce(1)
    assert [r["waves"] is not None for r in kernels.FourierFeatures(gamma="auto").fit(odd).transform(odd).collect()] == [True, False, False, False]


def test_ring_is_separated(spark, tmp_path):
    x, y = ring()
    df = frame(spark, x, y)
    accuracy = {}
    for kernel in ("rbf", "linear"):
        model = learn.estimator("svm", "classification", kernel=kernel, C=10.0).fit(df)
        made = model.transform(df)
        accuracy[kernel] = made.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert accuracy["rbf"] > 0.95 > 0.8 > accuracy["linear"]
    rbf = learn.estimator("svm", "classification", C=10.0).fit(df)
    assert set(rbf.transform(df).columns) - set(df.columns) == {"prediction", "rawPrediction"}
    rbf.write().overwrite().save(f"file://{tmp_path}/svm")
    want = [r["prediction"] for r in rbf.transform(df).orderBy("id").collect()]
    assert [r["prediction"] for r in PipelineModel.load(f"file://{tmp_path}/svm").transform(df).orderBy("id").collect()] == want


def test_several_classes(spark):
    x, _ = ring(240, 3)
    y = np.digitize((x**2).sum(1), [0.8, 2.0]).astype(float)
    made = learn.estimator("svm", "classification", 3, C=10.0).fit(frame(spark, x, y)).transform(frame(spark, x, y))
    assert made.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.85


def test_regression(spark):
    x, _ = ring(300, 4)
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    df = frame(spark, x, y)
    got = {k: np.array([r["prediction"] for r in learn.estimator("svm", "regression", kernel=k, C=10.0).fit(df).transform(df).orderBy("id").collect()]) for k in ("rbf", "linear")}
    r2 = {k: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() for k, p in got.items()}
    assert r2["rbf"] > 0.9 > 0.5 > r2["linear"]
    # the linear machine's minimum, against plain gradient descent
    w, z = np.zeros(3), np.column_stack([x, np.ones(300)])
    for _ in range(20000):
        r = z @ w - y
        w -= 1e-4 * (np.r_[w[:2], 0] + 20 * z.T @ (np.sign(r) * np.maximum(np.abs(r) - 0.1, 0)))
    assert got["linear"] == pytest.approx(z @ w, abs=1e-3)
