"""Shapley values of trees against enumeration of all sets of features, and their sums over whole tables."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import contributions


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((160, 4)), 2)
    y = np.where(x[:, 0] > 0, x[:, 1], -x[:, 2]) + 0.1 * rng.standard_normal(160)
    df = spark.createDataFrame([(i, *map(float, v), float(t), float(t > 0)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double, label double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).persist(), x


def enumerated(trees, v):
    """Shapley's formula itself, with the value of every set of features by walking the leaves."""

    def value(known):
        total = 0.0
        for weight, leaves in trees:
            for leaf in leaves:
                met = leaf.met(v[None, :])[:, 0]
                total += weight * leaf.value * np.prod([met[k] if f in known else leaf.shares[k] for k, f in enumerate(leaf.features)])
        return total

    n = len(v)
    return [sum(factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (value({*s, i}) - value(set(s))) for k in range(n) for s in combinations([j for j in range(n) if j != i], k)) for i in range(n)]


@pytest.mark.parametrize("name", ["tree", "forest", "boosted"])
def test_regression(spark, rows, name):
    df, x = rows
    model = {"tree": lambda: R.DecisionTreeRegressor(labelCol="y", maxDepth=4), "forest": lambda: R.RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=3, seed=1), "boosted": lambda: R.GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1)}[name]()
    fitted = model.fit(df)
    trees = contributions.trees_of(fitted, spark)
    made = contributions.tree_contributions(fitted, fitted.transform(df)).orderBy("id").collect()
    for r in made:
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["prediction"], abs=1e-9)
    for i in range(0, 160, 23):
        assert made[i]["contributions"] == pytest.approx(enumerated(trees, x[i]), abs=1e-9)


def test_classes(spark, rows):
    df, _ = rows
    forest = C.RandomForestClassifier(numTrees=4, maxDepth=3, seed=2).fit(df)
    made = contributions.tree_contributions(forest, forest.transform(df), of_class=1).collect()
    assert all(r["base"] + sum(r["contributions"]) == pytest.approx(r["probability"][1], abs=1e-9) for r in made)
    boosted = C.GBTClassifier(maxIter=3, maxDepth=2, seed=2).fit(df)
    made = contributions.tree_contributions(boosted, boosted.transform(df)).collect()
    margin = [np.log(r["probability"][1] / r["probability"][0]) / 2 for r in made]
    assert [r["base"] + sum(r["contributions"]) for r in made] == pytest.approx(margin, abs=1e-9)


def test_tables(spark, rows):
    df, _ = rows
    fitted = R.DecisionTreeRegressor(labelCol="y", maxDepth=3).fit(df)
    made = contributions.tree_contributions(fitted, df.unionByName(df.limit(1).withColumn("features", F.lit(None).cast(df.schema["features"].dataType)).withColumn("id", F.lit(-1))))
    table = contributions.contribution_table(made, "id", ["a", "b", "c", "d"])
    assert table.count() == 640 and made.where("id = -1").first()["contributions"] is None
    found = contributions.global_importances(made, ["a", "b", "c", "d"]).orderBy("rank").collect()
    assert {r["feature"] for r in found[:3]} == {"a", "b", "c"} and found[3]["importance"] <= found[2]["importance"]
