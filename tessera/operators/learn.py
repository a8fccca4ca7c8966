"""Splits, metrics, models, tuning, explanation and review queues."""

from __future__ import annotations

import logging
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import entropy, free_name, long_numbers, number, quoted, shared_path
from ..functions.blocks import sound
from ..functions.ranks import hash_ranks, quantiles, running_sums
from .boosting import HistogramBoosting
from .clean import Cleaner, OutlierCap
from .features import FeatureEngineer, FeatureSelector
from .kernels import KernelSVM
from .neighbours import KNN, Index
from .reports import MAX_CLASSES, leakage, leakage_summary
from .series import RANGE_ROWS, numbered

log = logging.getLogger(__name__)
#: What Spark raises where a model can't be fitted to the data.
FIT_ERRORS = (PySparkException, Py4JJavaError)


# --- splits


def detect_task(df: DataFrame, target: str) -> str:
    """classification for texts and booleans, integers with few values, or two values; else regression."""
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "classification"
    n, d = df.agg(F.count("*"), F.count_distinct(quoted(target))).first()
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return "classification" if d <= 2 or whole and d <= max(20, 0.05 * n) else "regression"


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(quoted(target).isNotNull()).groupBy(quoted(target).cast("string").alias("class")).agg(F.count("*").alias("n"))


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The classes in order; an error where there are more than MAX_CLASSES."""
    found = [r["class"] for r in class_counts(df, target).select("class").limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} values: no target of classes")
    return sorted(found)


def validate_target(df: DataFrame, target: str, min_per_class: int = 2) -> None:
    """Refuses targets of one class, that look like an id, or with classes of too few rows."""
    k, n, least = class_counts(df, target).agg(F.count("*"), F.sum("n"), F.min("n")).first()
    if (k or 0) < 2:
        raise ValueError(f"{target} has {k} classes; two are needed")
    if n >= 10 and k / n > 0.5:
        raise ValueError(f"{target} looks like an id: {k} values in {n} rows")
    if least < min_per_class:
        raise ValueError(f"a class of {target} has {least} rows; {min_per_class} are needed")


def can_stratify(counts: DataFrame, test: float = 0.2, min_train: int = 2) -> DataFrame:
    return counts.agg((F.min(F.floor(F.col("n") * (1 - test))) >= min_train).alias("can_stratify"))


def with_rank(df: DataFrame, target: str | None, key: Column, seed: int = 42) -> DataFrame:
    """df with __rank and __n: a seeded order within each class."""
    return hash_ranks(df, quoted(target) if target else F.lit(0), key, seed)


def stratified_split(df: DataFrame, target: str, key: Column, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: exactly round(n * test) rows of each class, chosen by a hash of key."""
    return with_rank(df, target, key, seed).withColumn("is_test", F.col("__rank") <= F.round(F.col("__n") * test)).drop("__rank", "__n")


def random_split(df: DataFrame, key: Column, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test by a hash of key, without a shuffle."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(test * 1_000_000))


def ordered_split(df: DataFrame, order: str, by: list[str], test: float = 0.2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with is_test: the last rows of each series."""
    number, total = free_name("__number", df.columns), free_name("__total", df.columns)
    return numbered(df, by, [order], number, total, range_rows).withColumn("is_test", F.col(number) > F.floor(F.col(total) * (1 - test))).drop(number, total)


def with_folds(df: DataFrame, target: str | None, key: Column, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1, stratified by class; fewer folds where a class has fewer rows than k."""
    if target:
        least = class_counts(df, target).agg(F.min("n")).first()[0] or 2
        k = max(2, min(k, least))
        return with_rank(df, target, key, seed).withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank", "__n")
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(2, k))).cast("int"))


def stratified_cap(df: DataFrame, label: str, key: Column, most: int = 500, seed: int = 42) -> DataFrame:
    """At most most rows: each class's least share first, the rest at random."""
    counts = class_counts(df, label).agg(F.min("n"), F.count("*")).first()
    take = min(2, counts[0] or 0)
    if take * counts[1] > most:
        take = max(1, most // counts[1])
    ranked = with_rank(df, label, key, seed)
    return ranked.orderBy(F.col("__rank") > take, F.xxhash64(key, F.lit(seed)), key).limit(most).drop("__rank", "__n")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight): n / (k n_c)."""
    counts = class_counts(df, target)
    whole = counts.agg(F.sum("n").alias("__sum"), F.count("*").alias("__k"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("class", "n", (F.col("__sum") / (F.col("__k") * F.col("n"))).alias("weight"))


# --- metrics (over columns y and pred)


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(quoted(y).alias("y"), quoted(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(accuracy, precision, recall, f1), weighted by class; an empty denominator counts 0."""
    cells = confusion(df, y, pred)
    true = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("said"))
    p = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    r = F.col("hit") / F.col("support")
    by = true.join(said, "c", "left").select("support", "hit", F.coalesce(p, F.lit(0.0)).alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    w = lambda c: F.sum(F.col("support") * c) / F.sum("support")
    return by.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), w(F.col("p")).alias("precision"), w(F.col("r")).alias("recall"), w(f1).alias("f1"))


def auc(scores: DataFrame) -> DataFrame:
    """(class, y, score) -> (class, auc, n_positive): Mann-Whitney with tied scores sharing ranks; equal scores are summed before they are ranked."""
    levels = scores.groupBy("class", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.col("upto_neg") - F.col("neg")
    wins = running_sums(levels, "class", "score", ["neg"]).select("class", "pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("wins"))
    return wins.groupBy("class").agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("n_positive"))


def weighted_auc(scores: DataFrame) -> DataFrame:
    """One-vs-rest, weighted by prevalence."""
    return auc(scores).agg((F.sum(F.col("auc") * F.col("n_positive")) / F.sum("n_positive")).alias("roc_auc"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(r2, mae, rmse, mape): mape skips zeros."""
    e = F.col("y") - F.col("p")
    rows = df.select(number(y).alias("y"), number(pred).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    return rows.agg((1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y"))))).alias("mape"))


# --- models

_TREES = {"gradient_boosting": (50, 3, 0.1, 1.0)}
#: Presets of histogram boosting; trees limited by depth have as many leaves as that allows.
_BOOSTED = {
    "xgboost": {"trees": 60, "max_depth": 6, "learning_rate": 0.2, "min_samples_leaf": 1, "min_child_weight": 1.0, "reg_lambda": 1.0},
    "lightgbm": {"trees": 60, "num_leaves": 31, "min_samples_leaf": 20, "reg_lambda": 0.0},
    "hist_gradient_boosting": {"trees": 60, "num_leaves": 31, "min_samples_leaf": 20, "reg_lambda": 0.0},
    "catboost": {"trees": 60, "max_depth": 6, "learning_rate": 0.1, "min_samples_leaf": 1, "reg_lambda": 3.0},
}
#: Ranges of random search: (low, high, kind), or values to choose from (fixed values; a step of 50 for numbers of trees).
SPACES = {
    "logistic_regression": {"regParam": (1e-4, 10, "log")},
    "ridge": {"regParam": (1e-3, 100, "log")},
    "elastic_net": {"regParam": (1e-4, 10, "log"), "elasticNetParam": (0, 1, "real")},
    "random_forest": {"numTrees": (100, 500, "fifties"), "maxDepth": (3, 20, "int"), "minInstancesPerNode": (1, 10, "int"), "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "xgboost": {"trees": (100, 500, "fifties"), "max_depth": (3, 12, "int"), "learning_rate": (1e-3, 0.3, "log"), "subsample": (0.5, 1, "real"), "colsample": (0.5, 1, "real"), "min_child_weight": (1, 10, "int"), "reg_lambda": (1e-3, 10, "log")},
    "lightgbm": {"trees": (100, 500, "fifties"), "num_leaves": (15, 255, "int"), "max_depth": (-1, 16, "int"), "learning_rate": (1e-3, 0.3, "log"), "subsample": (0.5, 1, "real"), "colsample": (0.5, 1, "real"), "reg_lambda": (1e-3, 10, "log")},
    "gradient_boosting": {"maxIter": (100, 400, "fifties"), "maxDepth": (2, 8, "int"), "stepSize": (1e-3, 0.2, "log"), "subsamplingRate": (0.6, 1, "real")},
    "hist_gradient_boosting": {"trees": (100, 500, "fifties"), "max_depth": (3, 15, "int"), "learning_rate": (1e-3, 0.3, "log"), "min_samples_leaf": (10, 50, "int"), "reg_lambda": (1e-3, 10, "log")},
    "catboost": {"trees": (100, 500, "fifties"), "max_depth": (4, 10, "int"), "learning_rate": (1e-3, 0.3, "log"), "reg_lambda": (1e-3, 10, "log")},
    "svm": {"C": (1e-2, 100, "log"), "gamma": ["scale", "auto"], "kernel": ["rbf", "linear"]},
    "knn": {"k": (3, 25, "int"), "weighted": [False, True], "p": [1, 2]},
}


def estimator(name: str, task: str, n_classes: int = 2, seed: int = 42, features: str = "features", label: str = "label", weight: str | None = None, **params):
    """A Spark ML estimator by name; gradient_boosting and linear machines for several classes go one against the rest."""
    common = {"featuresCol": features, "labelCol": label}
    given = common | ({"weightCol": weight} if weight else {})
    if name in _TREES:
        trees, depth, step, rate = _TREES[name]
        how = {"maxIter": trees, "maxDepth": depth, "stepSize": step, "subsamplingRate": rate, "seed": seed} | params
        if task == "regression":
            return R.GBTRegressor(**given, **how)
        one = C.GBTClassifier(**given, **how)
        return one if n_classes <= 2 else C.OneVsRest(classifier=one, **common)
    if name in _BOOSTED:
        how = _BOOSTED[name] | params
        if "num_leaves" not in how:
            how["num_leaves"] = min(256, 1 << max(1, how["max_depth"]))
        return HistogramBoosting(task=task, n_classes=n_classes, seed=seed, weightCol=weight or "", **common, **how)
    if name == "random_forest":
        how = {"numTrees": 200, "seed": seed} | params
        return (C.RandomForestClassifier if task == "classification" else R.RandomForestRegressor)(**given, **how)
    if name == "logistic_regression":
        return C.LogisticRegression(**given, **({"maxIter": 100} | params))
    if name == "ridge":
        return R.LinearRegression(**given, **({"regParam": 1.0, "elasticNetParam": 0.0} | params))
    if name == "elastic_net":
        return R.LinearRegression(**given, **({"regParam": 1.0, "elasticNetParam": 0.5} | params))
    if name == "naive_bayes":
        return C.NaiveBayes(**given, modelType="multinomial", **params)
    if name == "linear_svc":  # of sparse vectors
        one = C.LinearSVC(**given, **params)
        return one if n_classes <= 2 else C.OneVsRest(classifier=one, **common)
    if name == "svm":
        return KernelSVM(task=task, n_classes=n_classes, seed=seed, **common, **params)
    if name == "knn":
        return KNN(task=task, n_classes=n_classes, **common, **params)
    raise ValueError(f"no model is called {name}")


_SPARK_TREES = (R.GBTRegressor, C.GBTClassifier, R.RandomForestRegressor, C.RandomForestClassifier)
#: Rows of a task while Spark fits trees, at most, about; it keeps some 250 bytes of each and reads them for every level.
TREE_ROWS = 1 << 18


def in_parts(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, dealt evenly by a shuffle where it has more rows than a task should hold: Spark's trees keep a table divided as it comes, which for a file is by its splits and row groups.

    Each part is ordered by a hash of its rows, as Spark draws the values that it may split at by a row's place in its part.
    """
    parts = -(-df.count() // (rows or TREE_ROWS))
    if parts <= 1:
        return df
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)).sortWithinPartitions(F.xxhash64(*map(quoted, df.columns)))


def fit_on(df: DataFrame, model):
    """The model fitted to df (features, label); Spark's trees get its rows in parts."""
    one = model.getClassifier() if isinstance(model, C.OneVsRest) else model
    if not isinstance(one, _SPARK_TREES):
        return model.fit(df)
    weight = [one.getWeightCol()] if one.isSet("weightCol") else []
    return model.fit(in_parts(df.select(*map(quoted, [one.getFeaturesCol(), one.getLabelCol(), *weight]))))


_FOR_BOTH = ["random_forest", "xgboost", "lightgbm", "gradient_boosting", "hist_gradient_boosting", "svm", "knn"]
CANDIDATES = {"classification": ["logistic_regression", *_FOR_BOTH], "regression": ["ridge", "elastic_net", *_FOR_BOTH]}


def cv_score(df: DataFrame, task: str, model, folds: int) -> float:
    """Mean score over the folds of df (features, label, fold): weighted F1 or R2."""
    judge = MulticlassClassificationEvaluator(metricName="f1") if task == "classification" else RegressionEvaluator(metricName="r2")
    return float(np.mean([judge.evaluate(fit_on(df.where(F.col("fold") != k), model).transform(df.where(F.col("fold") == k))) for k in range(folds)]))


def leaderboard(df: DataFrame, task: str, candidates: list[str] | None = None, folds: int = 5, n_classes: int = 2) -> DataFrame:
    """(model, score, error, rank) of df (features, label, fold); a model that Spark can't fit scores minus infinity and has its error told."""
    rows = []
    for name in candidates or CANDIDATES[task]:
        one = estimator(name, task, n_classes)
        try:
            rows.append((name, cv_score(df, task, one, folds), None))
        except FIT_ERRORS as e:
            log.exception("%s failed", name)
            rows.append((name, float("-inf"), str(e)[:500]))
    return rank_models(df.sparkSession.createDataFrame(rows, "model string, score double, error string"))


def best_on_holdout(train: DataFrame, held: DataFrame, candidates, n_classes: int, seed: int = 42, weight: str | None = None):
    """Fits each model on train (features, label) and judges it on held by weighted F1: (name of the best, the fitted model, (model, f1) of all)."""
    board, best = [], None
    for name in candidates:
        weighted = weight if name != "naive_bayes" and not (n_classes > 2 and name not in ("logistic_regression", "random_forest")) else None
        fitted = fit_on(train, estimator(name, "classification", n_classes, seed, weight=weighted))
        f1 = classification_metrics(fitted.transform(held), "label", "prediction").first()["f1"]
        board.append((name, round(f1, 4)))
        if best is None or f1 > best[0]:
            best = f1, name, fitted
    return best[1], best[2], board


def class_weight(counts: dict, n_classes: int) -> Column:
    """n / (k n_c) of a row's label, from the rows of each label."""
    n = sum(counts.values())
    return F.element_at(F.array(*[F.lit(n / (n_classes * max(1, counts.get(float(i), 0)))) for i in range(n_classes)]), F.col("label").cast("int") + 1)


def rank_models(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "model")))


def draw(space: dict, rng: np.random.Generator) -> dict:
    out = {}
    for name, given in space.items():
        if isinstance(given, list):
            out[name] = given[int(rng.integers(len(given)))]
            continue
        low, high, kind = given
        out[name] = 50 * int(rng.integers(low // 50, high // 50 + 1)) if kind == "fifties" else int(rng.integers(low, high + 1)) if kind == "int" else float(np.exp(rng.uniform(np.log(low), np.log(high)))) if kind == "log" else float(rng.uniform(low, high))
    return out


#: Trials drawn at random before proposals follow the history, the share of trials that are good, and candidates of a proposal.
STARTUP, GOOD, CANDIDATES_OF = 10, 0.15, 24


def _scaled(given, value: float) -> float:
    return float(np.log(value)) if given[2] == "log" else float(value)


def _kernels(seen: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths of a Parzen estimate on [low, high]: normal kernels at what was seen, as wide as the gaps beside them, and one over the whole range."""
    centres = np.sort(seen)
    gaps = np.diff(np.r_[low, centres, high])
    widths = np.clip(np.maximum(gaps[:-1], gaps[1:]), (high - low) / min(100, 1 + len(seen)), high - low)
    return np.r_[centres, (low + high) / 2], np.r_[widths, high - low]


def _density(x: np.ndarray, kernels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    centres, widths = kernels
    z = (x[:, None] - centres) / widths
    return (np.exp(-0.5 * z * z) / widths).mean(1) + 1e-300


def propose(space: dict, history: list[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """Parameters that are likelier among the good trials than among the others (Bergstra and others 2011): of some candidates drawn around the good ones, for each parameter by itself, the one of the greatest ratio."""
    ranked = sorted(history, key=lambda t: -t[1])
    n = max(1, int(np.ceil(GOOD * len(ranked))))
    out = {}
    for name, given in space.items():
        good, rest = ([t[0][name] for t in part if name in t[0]] for part in (ranked[:n], ranked[n:]))
        if isinstance(given, list):
            share = lambda seen: np.array([1.0 + sum(v == c for v in seen) for c in given]) / (len(given) + len(seen))
            candidates = rng.choice(len(given), CANDIDATES_OF, p=share(good))
            out[name] = given[int(candidates[np.argmax((share(good) / share(rest))[candidates])])]
            continue
        low, high, kind = given
        a, b = _scaled(given, low), _scaled(given, high)
        good, rest = (np.array([_scaled(given, v) for v in seen]) for seen in (good, rest))
        likely = _kernels(good, a, b)
        which = rng.integers(len(likely[0]), size=CANDIDATES_OF)
        candidates = np.clip(likely[0][which] + rng.standard_normal(CANDIDATES_OF) * likely[1][which], a, b)
        best = float(candidates[np.argmax(_density(candidates, likely) / _density(candidates, _kernels(rest, a, b)))])
        value = float(np.exp(best)) if kind == "log" else best
        out[name] = int(np.clip(50 * round(value / 50), low, high)) if kind == "fifties" else int(round(value)) if kind == "int" else min(max(value, low), high)
    return out


def tune(df: DataFrame, task: str, name: str, n_trials: int = 25, timeout: float | None = 600, seed: int = 42, folds: int = 5, n_classes: int = 2, at_once: int = 1) -> tuple[dict, float, DataFrame]:
    """Best parameters, their score, and the history (trial, params, score).

    The first trial has the defaults, those up to STARTUP are drawn at random, the others proposed from the history of the trials before; it ends between trials at
    the time limit. at_once trials are run side by side, each in a scheduler pool of its own, and proposed from the same history, so that a history depends on the seed and at_once only.
    """
    rng, began, rows = np.random.default_rng(seed), time.monotonic(), []
    space = SPACES.get(name, {})
    context = df.sparkSession.sparkContext

    def score(trial: int, params: dict) -> float:
        context.setLocalProperty("spark.scheduler.pool", f"trial-{trial % at_once}" if at_once > 1 else None)
        try:
            return cv_score(df, task, estimator(name, task, n_classes, **params), folds)
        except FIT_ERRORS:
            log.exception("trial %d of %s failed", trial, name)
            return float("-inf")

    while len(rows) < n_trials and not (rows and timeout and time.monotonic() - began > timeout):
        tried = [(r[3], r[2]) for r in rows]
        some = range(len(rows), min(len(rows) + at_once, n_trials))
        params = [{} if not t else draw(space, rng) if t < STARTUP else propose(space, tried, rng) for t in some]
        if at_once > 1:
            with ThreadPoolExecutor(at_once) as pool:
                found = list(pool.map(inheritable_thread_target(df.sparkSession)(score), some, params))
        else:
            found = [score(t, p) for t, p in zip(some, params)]
        rows += [(t, {k: str(v) for k, v in p.items()}, s, p) for t, p, s in zip(some, params, found)]
    best = max(rows, key=lambda r: r[2])
    return best[3], best[2], df.sparkSession.createDataFrame([r[:3] for r in rows], "trial int, params map<string,string>, score double")


def best_trial(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("score"), "trial").limit(1)


MAX_QUERIES = 10_000


def _at_most(df: DataFrame, most: int, what: str) -> None:
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} {what}")


def knn(train: DataFrame, queries: DataFrame, k: int = 5, p: int = 2, weighted: bool = False) -> DataFrame:
    """(id, v, label) and a small set of queries (id, v), at most MAX_QUERIES -> (id, pred): exact nearest neighbours, each task keeping its k best of every query before the shuffle."""
    _at_most(queries, MAX_QUERIES, "queries; knn_others takes any number")
    d = F.aggregate(F.zip_with("v", "w", lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x)
    pairs = train.join(F.broadcast(queries.select(F.col("id").alias("q"), F.col("v").alias("w"))), F.lit(True)).select("q", "id", "label", F.pow(d, F.lit(1.0 / p)).alias("d"))
    return _vote(pairs, k, weighted)


def voted(near: DataFrame, weighted: bool = False) -> DataFrame:
    """Neighbours (q, id, label, d) -> (id, pred): the label of most votes, the least of equal ones."""
    votes = near.groupBy("q", "label").agg(F.sum(1 / F.greatest("d", F.lit(1e-12)) if weighted else F.lit(1.0)).alias("votes"))
    return votes.groupBy("q").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("m")).select(F.col("q").alias("id"), F.col("m.label").alias("pred"))


def _vote(pairs: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k)
    return voted(near, weighted)


def knn_others(df: DataFrame, k: int = 5, query_rows: int = 16_384) -> DataFrame:
    """(id, v, label), ids unique -> (id, pred) for every row, from its k exact nearest other rows, found by a pivot index; query_rows: queries of a group that meets a slice.

    Rows without an id or with a vector that is null, not all finite, or of another length than the first, neither ask nor answer; a table of one row has no predictions.
    """
    rows = df.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), "label")
    first = rows.select(F.size("v")).first()
    rows = rows.where(sound(F.col("v"), first[0] if first else 0))
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], f"id long, pred {df.schema['label'].dataType.simpleString()}")
    index = Index.build(rows, 2, shared_path(df.sparkSession, "knn-index"))
    return voted(index.nearest(rows.select(F.col("id").alias("q"), "v"), k, group_rows=query_rows, others=True))


# --- end to end


class AutoMLResult:
    def __init__(self, task, model, labels, leaderboard, best, metrics, features):
        self.task, self.model, self.labels, self.leaderboard, self.best, self.metrics, self.features = task, model, labels, leaderboard, best, metrics, features

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(self.model, df, self.labels)


def predict(model: PipelineModel, df: DataFrame, labels: list[str]) -> DataFrame:
    """df with prediction, and probability (of the second class) where there are two."""
    keyed = df.withColumn("__key", F.monotonically_increasing_id())
    made = model.transform(keyed.withColumn("label", F.lit(0.0)))
    value = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1) if labels else F.col("prediction")
    out = [value.alias("prediction")]
    if len(labels) == 2 and "probability" in made.columns:
        out.append(vector_to_array("probability")[1].alias("probability"))
    return made.select(*[c for c in made.columns if c not in ("prediction", "probability", "rawPrediction", "features", "label", "__key")], *out)


def automl(df: DataFrame, target: str, key: str, task: str | None = None, candidates: list[str] | None = None, n_trials: int = 5, test: float = 0.2, folds: int = 3, seed: int = 42, drop_leaks: bool = True, snapshot: str | None = None) -> AutoMLResult:
    """Drops leaking columns, cleans, engineers and selects features, compares and tunes models on a train split, and evaluates on the rest.

    snapshot: a path for the raw train split, to hold later tables against for drift.
    """
    df = df.dropDuplicates().where(quoted(target).isNotNull())
    task = task or detect_task(df, target)
    if drop_leaks:
        leaks = leakage_summary(leakage(df.drop(key), target, task)).first()["drop"]
        df = df.drop(*[c for c in leaks if c not in (target, key)])
    labels: list[str] = []
    if task == "classification":
        validate_target(df, target)
        labels = class_labels(df, target)
        code = F.array_position(F.array(*[F.lit(x) for x in labels]), quoted(target).cast("string")) - 1
        data = df.withColumn("label", code.cast("double"))
    else:
        data = df.withColumn("label", number(target))
    split = stratified_split(data, "label", quoted(key), test, seed) if labels else random_split(data, quoted(key), test, seed)
    train = split.where(~F.col("is_test")).drop("is_test").persist()
    held = split.where("is_test").drop("is_test")
    plain = train.drop(target, key)
    if snapshot:
        train.drop("label").write.mode("overwrite").parquet(snapshot)
    cleaner = Cleaner(ignore=["label"]).fit(plain)
    numbers = [c for c, v in cleaner.fitted["fill"].items() if not isinstance(v, str)]
    fitted = [cleaner]
    for stage in (OutlierCap(columns=numbers), FeatureEngineer(labelCol="label"), FeatureSelector(labelCol="label", task=task)):
        current = PipelineModel(stages=fitted).transform(plain)
        fitted.append(stage.fit(current) if numbers or not isinstance(stage, OutlierCap) else OutlierCap(columns=["label"]).fit(current.limit(0)))
    features = fitted[-1].fitted["kept"]
    assemble = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features")]
    matrix_model = Pipeline(stages=[*fitted, *assemble]).fit(plain)
    matrix = with_folds(matrix_model.transform(plain).select("features", "label"), "label" if labels else None, F.xxhash64(vector_to_array("features")), folds, seed).persist()
    try:
        board = leaderboard(matrix, task, candidates, folds, max(2, len(labels)))
        best = board.orderBy("rank").first()["model"]
        params, _, _ = tune(matrix, task, best, n_trials, seed=seed, folds=folds, n_classes=max(2, len(labels)))
        model = PipelineModel(stages=[*matrix_model.stages, fit_on(matrix, estimator(best, task, max(2, len(labels)), **params))])
    finally:
        matrix.unpersist()
        train.unpersist()
    made = model.transform(held.drop(target, key))
    metrics = classification_metrics(made, "label", "prediction") if labels else regression_metrics(made, "label", "prediction")
    return AutoMLResult(task, model, labels, board, {"model": best, "params": params}, metrics, features)


# --- explanation


def shapley(score, rows: DataFrame, background: DataFrame, features: list[str], n_perm: int = 8, seed: int = 42) -> DataFrame:
    """(id, ...) rows and background, both small samples -> (id, feature, contribution): Monte-Carlo Shapley values (Strumbelj and Kononenko 2014).

    score: a column over the features, or a function of a DataFrame that adds a column score. Each row meets background
    rows and random orders of the features; a feature's contribution is the mean change as it goes from theirs to its own.
    """
    _at_most(background, MAX_QUERIES, "background rows; take a sample")
    _at_most(rows, MAX_QUERIES, "rows; contributions.tree_contributions explains whole tables")
    rng = np.random.default_rng(seed)
    orders = [[int(i) for i in rng.permutation(len(features))] for _ in range(n_perm)]
    spark = rows.sparkSession
    steps = spark.createDataFrame([(p, k, o.index(k), o) for p, o in enumerate(orders) for k in range(len(features))], "perm int, f int, place int, ord array<int>")
    other = background.select(F.struct(*[quoted(c) for c in features]).alias("z"), F.pmod(F.xxhash64(*[quoted(c) for c in features]), F.lit(n_perm)).cast("int").alias("perm"))
    base = rows.select("id", F.struct(*[quoted(c) for c in features]).alias("x"))
    cases = base.join(F.broadcast(other.join(F.broadcast(steps), "perm")), F.lit(True))  # samples of a stated size
    with_own = lambda upto: [F.when(F.array_position("ord", F.lit(i)) - 1 <= upto, F.col("x")[c]).otherwise(F.col("z")[c]).alias(c) for i, c in enumerate(features)]
    both = cases.select("id", "f", F.lit(1).alias("sign"), *with_own(F.col("place"))).unionByName(cases.select("id", "f", F.lit(-1).alias("sign"), *with_own(F.col("place") - 1)))
    scored = both.withColumn("score", score) if isinstance(score, Column) else score(both)
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("f") + 1)
    return scored.groupBy("id", name.alias("feature")).agg((2 * F.avg(F.col("sign") * F.col("score"))).alias("contribution"))


def importances(contributions: DataFrame) -> DataFrame:
    """(feature, importance, rank): mean absolute contribution."""
    mean = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def native_importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance, rank) of a fitted Spark ML model's own importances, else its coefficients' sizes, else zeros."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(0)
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        values = np.zeros(len(features))
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def uncertainty(df: DataFrame, probabilities: str, threshold: float = 0.55) -> DataFrame:
    """df with confidence, entropy and review."""
    p = quoted(probabilities)
    return df.withColumns({"confidence": F.array_max(p), "entropy": entropy(p)}).withColumn("review", F.col("confidence") < threshold)


def review_queue(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    return df.where("review").orderBy("confidence", key).limit(k)


def probability_map(labels: list[str], p: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.transform(p, lambda x: F.round(x, 4)))


def search_ranges(reference: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high): the 5th and 95th percentiles."""
    return quantiles(long_numbers(reference, columns), [0.05, 0.95]).select("column", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def counterfactuals(score, rows: DataFrame, ranges: DataFrame, columns: list[str], max_changes: int = 3, steps: int = 8, most: int | None = None) -> DataFrame:
    """(id, column, direction, step, from_value, to_value, rank): the least single changes that flip the score's class.

    score: a column over the columns that gives the class. Every row meets every feature (the first most of them, if given),
    direction and step, and the whole grid is scored at once.
    """
    tried = columns if most is None else columns[:most]
    grid = ranges.where(F.col("column").isin(tried)).select("column", ((F.col("high") - F.col("low")) / steps).alias("size"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("direction")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    base = rows.withColumn("__class", score)
    cases = base.join(F.broadcast(grid), F.lit(True))  # features x directions x steps rows
    old = F.coalesce(*[F.when(F.col("column") == c, number(c)) for c in tried])
    cases = cases.withColumn("from_value", old).withColumn("to_value", F.col("from_value") + F.col("direction") * F.col("step") * F.col("size"))
    moved = cases.select("id", "column", "direction", "step", "from_value", "to_value", F.col("__class").alias("was"), *[F.when(F.col("column") == c, F.col("to_value")).otherwise(number(c)).alias(c) for c in columns])
    flipped = moved.withColumn("now", score).where(F.col("now") != F.col("was"))
    first = flipped.groupBy("id", "column", "direction").agg(F.min(F.struct("step", "from_value", "to_value")).alias("m")).select("id", "column", "direction", "m.*")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("step", "column", "direction"))
    return first.withColumn("rank", rank).where(F.col("rank") <= max_changes)
