"""Exact Shapley values of tree models, for every row of a table (Lundberg and others 2020, conditioned on the trees' paths).

A tree's value of a set of features is its mean prediction where splits on other features send a row both ways, by the shares of the
training rows that went there. It is a sum over leaves: each takes the product, over the features of its path, of whether the row meets
all conditions on the feature, or of the shares of rows that did. Shapley's weights then need only, for each leaf and feature, the sums of
these products by how many features are in the set, which are the coefficients of a polynomial; they are computed for a batch of rows at once.

The trees are read from the node tables that Spark ML writes with a model, once, in the driver; rows are not collected or sampled.

Defined cases: a row with a null vector has null contributions; a model of a constant contributes nothing.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quoted, shared_path
from .kernels import as_array

ROWS = 2048


class Leaf:
    """A leaf's value, and for each feature on its path: the conditions (threshold or categories to the left, and which side), and the share of rows that met them."""

    def __init__(self, value: float, conditions: dict[int, list], shares: dict[int, float]):
        self.value, self.features, self.conditions = value, sorted(conditions), conditions
        self.shares = np.array([shares[f] for f in self.features])

    def met(self, x: np.ndarray) -> np.ndarray:
        """Features of the path x rows: whether a row meets all conditions on it."""
        out = np.ones((len(self.features), len(x)), bool)
        for k, f in enumerate(self.features):
            for categories, at, left in self.conditions[f]:
                goes_left = np.isin(x[:, f], at) if categories else x[:, f] <= at
                out[k] &= goes_left == left
        return out


def leaves_of(nodes: dict[int, dict], value) -> list[Leaf]:
    """nodes: id -> (left, right, feature, categories, at, rows); value: a leaf's, of its node."""
    out = []
    todo = [(0, {}, {})]
    while todo:
        node, conditions, shares = todo.pop()
        n = nodes[node]
        if n["left"] < 0:
            out.append(Leaf(value(n), conditions, shares))
            continue
        for side, left in ((n["left"], True), (n["right"], False)):
            f, part = n["feature"], nodes[side]["rows"] / max(n["rows"], 1e-300)
            todo.append((side, conditions | {f: [*conditions.get(f, []), (n["categories"], n["at"], left)]}, shares | {f: shares.get(f, 1.0) * part}))
    return out


def trees_of(model, spark, of_class: int | None = None) -> list[tuple[float, list[Leaf]]]:
    """(weight, leaves) of each tree of a fitted Spark ML tree, forest or boosted model. of_class: the class whose probability (of a tree or forest) is explained."""
    path = shared_path(spark, "explained")
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        table = table.withColumn("tree", F.lit(0))
    trees: dict[int, dict] = {}
    for r in table.collect():
        split = r["split"]
        categories = split["numCategories"] >= 0
        at = np.array(split["leftCategoriesOrThreshold"]) if categories else split["leftCategoriesOrThreshold"][0] if split["leftCategoriesOrThreshold"] else 0.0
        trees.setdefault(r["tree"], {})[r["id"]] = {"left": r["leftChild"], "right": r["rightChild"], "feature": split["featureIndex"], "categories": categories, "at": at, "rows": float(sum(r["impurityStats"])) if of_class is not None else float(r["rawCount"]), "prediction": r["prediction"], "stats": np.array(r["impurityStats"], float)}
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    value = (lambda n: float(n["prediction"])) if of_class is None else (lambda n: float(n["stats"][of_class] / max(n["stats"].sum(), 1e-300)))
    return [(weights[t], leaves_of(trees[t], value)) for t in sorted(trees)]


def shapley_values(trees: list[tuple[float, list[Leaf]]], x: np.ndarray) -> np.ndarray:
    """rows x features"""
    out = np.zeros(x.shape)
    for weight, leaves in trees:
        for leaf in leaves:
            d = len(leaf.features)
            if not d:
                continue
            met = leaf.met(x)
            share = leaf.shares[:, None]
            size = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
            for i, f in enumerate(leaf.features):
                sums = np.zeros((d, len(x)))  # by how many of the other features are in the set
                sums[0] = 1.0
                for j in range(d):
                    if j != i:
                        sums[1:] = sums[1:] * share[j] + sums[:-1] * met[j]
                        sums[0] *= share[j]
                out[:, f] += weight * leaf.value * (met[i] - leaf.shares[i]) * (np.array(size) @ sums)
    return out


def base_value(trees: list[tuple[float, list[Leaf]]]) -> float:
    """What the trees say of no feature: the mean over their training rows."""
    return sum(weight * sum(leaf.value * float(np.prod(leaf.shares)) for leaf in leaves) for weight, leaves in trees)


def tree_contributions(model, df: DataFrame, features: str = "features", to: str = "contributions", of_class: int | None = None) -> DataFrame:
    """df with an array of each feature's contribution and with `base`; both add up to the model's prediction (to a boosted classifier's margin, or the probability of of_class)."""
    spark = df.sparkSession
    trees = trees_of(model, spark, of_class)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def told(x: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        there = np.flatnonzero(x.notna().to_numpy())
        for i in range(0, len(there), ROWS):
            rows = there[i : i + ROWS]
            for k, row in zip(rows, shapley_values(shared.value, np.stack(x.iloc[rows].to_list()))):
                out[k] = row
        return pd.Series(out, dtype=object)

    column = as_array(df, features) if not isinstance(df.schema[features].dataType, VectorUDT) else F.when(quoted(features).isNotNull(), as_array(df, features))
    return df.withColumn(to, told(column)).withColumn("base", F.lit(base_value(trees)))


def contribution_table(made: DataFrame, key: str, names: list[str], column: str = "contributions") -> DataFrame:
    """(key, feature, contribution): a row for each row and feature."""
    return made.select(key, F.posexplode(column).alias("i", "contribution")).select(key, F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("feature"), "contribution")


def global_importances(made: DataFrame, names: list[str], column: str = "contributions") -> DataFrame:
    """(feature, importance, rank): mean absolute contribution over all rows."""
    rows = made.select(F.posexplode(column).alias("i", "c")).groupBy("i").agg(F.avg(F.abs("c")).alias("importance"))
    named = rows.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("feature"), "importance")
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
