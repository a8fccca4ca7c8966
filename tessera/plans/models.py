"""Queries on feature matrices, components, information by neighbours, and models of the given tables."""

from __future__ import annotations

import re

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import boosting, clean, components, contributions, features, information, learn, neighbours, profile
from .tables import LONG, NUM, SUMMARY, holes, read, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r"\bcolumn\b", '"column"', sql)  # a reserved word there
        return f

    return add


_MISSING = "z AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, round((count(*) - count({c})) / count(*), 4) AS missing_share FROM h" for c in NUM) + ")"


@query("eda_numeric", f"WITH {LONG}, {_MISSING}, s AS ({SUMMARY}) SELECT s.column, mean, std, min, max, skew, missing_share FROM s JOIN z USING (column)")
def _(spark, d):
    """The numeric entry of the exploration report."""
    return rounded(profile.numeric_entry(holes(spark, d), NUM), "mean", "std", "skew")


_PRODUCTS = ("l_discount__x__l_tax", "l_quantity__x__l_discount", "l_quantity__x__l_tax")


@query("fe_interactions", "SELECT l_orderkey, l_linenumber, round(l_discount * l_tax, 6) AS l_discount__x__l_tax, round(l_quantity * l_discount, 6) AS l_quantity__x__l_discount, round(l_quantity * l_tax, 6) AS l_quantity__x__l_tax FROM lineitem")
def _(spark, d):
    """Products of the pairs that tell most of the price, in rows of lineitem."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    model = features.FeatureEngineer(labelCol="l_extendedprice", enable_binning=False, skew_threshold=1e9).fit(df.drop("l_orderkey", "l_linenumber"))
    made = features.FeatureEngineerModel({**model.fitted, "columns": _PRODUCTS, "label": None}).transform_beside(df, ["l_orderkey", "l_linenumber"])
    return rounded(made, *_PRODUCTS, places=6)


@query("fe_final_matrix", "SELECT l_orderkey AS k_order, l_linenumber AS k_line, coalesce(CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END, 0) AS l_quantity, CAST(year(l_shipdate) AS DOUBLE) AS l_shipdate__year, CAST(month(l_shipdate) AS DOUBLE) AS l_shipdate__month, CAST(day(l_shipdate) AS DOUBLE) AS l_shipdate__day, CAST(isodow(l_shipdate) - 1 AS DOUBLE) AS l_shipdate__dayofweek, CAST(isodow(l_shipdate) >= 6 AS DOUBLE) AS l_shipdate__is_weekend, "
       + ", ".join(f"CAST(coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END = '{v}', false) AS DOUBLE) AS l_returnflag__{v}" for v in "ANR") + " FROM lineitem")
def _(spark, d):
    """All columns as numbers without nulls, in a fixed order."""
    df = holes(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    model = features.FeatureEngineer(enable_binning=False, enable_interactions=False, skew_threshold=1e9).fit(df.drop("l_orderkey", "l_linenumber"))
    return model.transform_beside(df, ["l_orderkey", "l_linenumber"]).withColumnsRenamed({"l_orderkey": "k_order", "l_linenumber": "k_line"})


@query("pca_variance")
def _(spark, d):
    return components.variance_table(read(spark, d, "embeddings"), "embedding", 64)


@query("fs_mutual_info_neighbours")
def _(spark, d):
    return information.class_information(read(spark, d, "lineitem"), NUM, "l_returnflag")


NEAR = "WITH d AS (SELECT q.vec_id AS id, e.vec_id AS v, e.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dist FROM embeddings e JOIN embeddings q ON q.vec_id <> e.vec_id), n AS (SELECT id, label FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, v) <= 5), c AS (SELECT id, label, count(*) AS n FROM n GROUP BY ALL) SELECT id, label AS pred FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"


@query("knn_predict", NEAR)
def _(spark, d):
    """Every vector's label, from its five exact nearest others by the pivot index."""
    from ..functions import shared_path

    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    index = neighbours.Index.build(rows, 2, shared_path(spark, "knn-index"))
    return learn.voted(index.nearest(rows.select(F.col("id").alias("q"), "v"), 5, others=True))


def matrix(spark, d):
    """lineitem's numbers and days as features, whether a line was returned as label, and two folds."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NUM, F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("day"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    made = VectorAssembler(inputCols=[*NUM, "day"], outputCol="features").transform(df)
    return learn.with_folds(made, None, F.struct("l_orderkey", "l_linenumber"), 2)


@query("leaderboard")
def _(spark, d):
    """Models that are quick to fit, by weighted F1 over two folds."""
    return learn.leaderboard(matrix(spark, d).select("features", "label", "fold"), "classification", ["logistic_regression", "linear_svc"], 2)


@query("boosting_metrics")
def _(spark, d):
    """Histogram boosting taught with one fold and judged on the other."""
    df = matrix(spark, d)
    model = boosting.HistogramBoosting(trees=8, num_leaves=15, learning_rate=0.3).fit(df.where("fold = 0"))
    return learn.classification_metrics(model.transform(df.where("fold = 1")), "label", "prediction")


@query("batch_predict")
def _(spark, d):
    """Every line with its prediction and probability, by a cleaned, engineered and fitted pipeline."""
    from pyspark.ml import Pipeline

    df = holes(spark, d).select("l_orderkey", "l_linenumber", *NUM, "l_linestatus", (F.col("l_returnflag") == "R").cast("double").alias("label")).where("label IS NOT NULL")
    names = [*NUM, "l_linestatus__F", "l_linestatus__O"]
    plain = df.drop("l_orderkey", "l_linenumber")
    stages = [clean.Cleaner(ignore=["label"]), features.FeatureEngineer(labelCol="label", enable_binning=False, enable_interactions=False, skew_threshold=1e9), VectorAssembler(inputCols=names, outputCol="features"), learn.estimator("logistic_regression", "classification")]
    model = Pipeline(stages=stages).fit(plain)
    return learn.predict(model, plain, ["other", "returned"])


@query("tree_importances")
def _(spark, d):
    """How much each column moves a boosted model's price of a line, by exact contributions of all lines."""
    from pyspark.ml.regression import GBTRegressor

    names = ["l_quantity", "l_discount", "l_tax", "day"]
    df = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("day"), F.col("l_extendedprice").alias("label"))
    made = VectorAssembler(inputCols=names, outputCol="features").transform(df).select("features", "label")
    model = learn.fit_on(made, GBTRegressor(maxIter=5, maxDepth=3, seed=42))
    return contributions.global_importances(contributions.tree_contributions(model, made), names)
