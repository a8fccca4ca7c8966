"""Review and comparison of runs, and what of past runs and tips applies to a dataset.

Runs are rows (job_id, dataset_id, target, task, model_name, metrics map<string, double>, ...), one for each run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jaccard

#: Words of technique that apply to any dataset (fixed values).
TECHNIQUE = (
    "accuracy auc baseline binary boosting categorical class classification cross dataset encoding ensemble feature features fold f1 gradient holdout "
    "hyperparameter impute imputation leaderboard log metric metrics missing model models numeric optuna pipeline precision predict recall regression "
    "regularization roc scale score scores shap sklearn split stratified target test train training trial trials tune tuning validation value values weight "
    "weighted mlflow overfitting underfitting cv"
).split()
#: Weights of the similarity of a run to a dataset, what makes them comparable, and the most that others get (fixed values).
BASE, TASK, TARGET, FEATURES, ROWS, DATASET, SIGNATURE = 0.05, 0.25, 0.30, 0.30, 0.10, 0.15, 0.2
COMPARABLE_TARGET, COMPARABLE_FEATURES, INCOMPARABLE = 0.5, 0.12, 0.22


def name_tokens(names: Column) -> Column:
    """The distinct runs of more than two letters or digits of a text, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(names), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def column_tokens(columns: Column) -> Column:
    """The same of an array of column names."""
    return name_tokens(F.array_join(columns, " "))


# --- review


def review_flags(runs: DataFrame, boards: DataFrame) -> DataFrame:
    """runs (job_id, task, metrics, n_train, n_removed features, leaks) and boards (job_id, model, score) -> a flag for each finding, the numbers of strengths and weaknesses, and a verdict.

    A run without a board has a winner's score of 0; what its metrics lack counts 0.
    """
    top = boards.where("score IS NOT NULL").groupBy("job_id").agg(F.max("score").alias("best"))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("score"), "model"))
    second = boards.where("score IS NOT NULL").withColumn("r", rank).where("r = 2").select("job_id", F.col("score").alias("second"))
    rows = runs.join(top, "job_id", "left").join(second, "job_id", "left")
    best = F.coalesce("best", F.lit(0.0))
    gap = F.when(F.col("second").isNotNull(), best - F.col("second")).otherwise(0.1)
    m = lambda name: F.coalesce(F.col("metrics")[name], F.lit(0.0))
    classes = F.col("task") == "classification"
    strong = {
        "clear_winner": gap >= 0.02,
        "strong_cv": best >= 0.85,
        "solid_f1": classes & (m("f1_weighted") >= 0.85),
        "high_auc": classes & (m("roc_auc") >= 0.9),
        "fewer_features": F.coalesce(F.col("n_removed"), F.lit(0)) > 0,
    }
    weak = {
        "close_race": (gap < 0.02) & F.col("second").isNotNull(),
        "weak_cv": best < 0.7,
        "majority_bias": classes & (m("accuracy") > 0.95) & (m("roc_auc") < 0.75),
        "small_sample": F.coalesce(F.col("n_train"), F.lit(0)) < 500,
        "leaks_found": F.coalesce(F.col("leaks"), F.lit(False)),
        "overfit": (m("train_score") != 0) & (m("test_score") != 0) & (m("train_score") - m("test_score") > 0.08),
    }
    n = lambda flags: reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags.values()])
    made = rows.select("job_id", *[F.coalesce(f, F.lit(False)).alias(k) for k, f in (strong | weak).items()], n(strong).alias("n_strengths"), n(weak).alias("n_weaknesses"))
    return made.withColumn("verdict", F.when(F.col("n_weaknesses") <= 1, "pass").otherwise("review"))


# --- comparison of stated pairs (a, b) of runs


def _both(runs: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """(a, b, name, x, y): the entries of the map column of both runs of each pair, null where one lacks it.

    Entries are far larger than Spark guesses from the columns that they are made of, so they are never broadcast.
    """
    entries = runs.select("job_id", F.explode(column).alias("name", "value"))
    sides = [pairs.join(entries.withColumnRenamed("job_id", own).hint("merge"), own).select("a", "b", "name", *[F.when(F.lit(own == s), F.col("value")).alias(v) for s, v in (("a", "x"), ("b", "y"))]) for own in ("a", "b")]
    return sides[0].unionByName(sides[1]).groupBy("a", "b", "name").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def compare_metrics(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, metric, run_a, run_b, delta, pct_change, winner) of the metrics that both have; the larger value wins."""
    rows = _both(runs, pairs, "metrics").where("x IS NOT NULL AND y IS NOT NULL")
    delta = F.col("y") - F.col("x")
    winner = F.when(delta > 0, F.col("b").cast("string")).when(delta < 0, F.col("a").cast("string")).otherwise("tie")
    return rows.select("a", "b", F.col("name").alias("metric"), F.round("x", 4).alias("run_a"), F.round("y", 4).alias("run_b"), F.round(delta, 4).alias("delta"), F.when(F.col("x") != 0, F.round(100 * delta / F.abs("x"), 2)).alias("pct_change"), winner.alias("winner"))


def compare_params(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, param, run_a, run_b) of the parameters (params map<string, string>) that differ; one that a run lacks is null there."""
    return _both(runs, pairs, "params").where(~F.col("x").eqNullSafe(F.col("y"))).select("a", "b", F.col("name").alias("param"), F.col("x").alias("run_a"), F.col("y").alias("run_b"))


def compare_importances(runs: DataFrame, pairs: DataFrame, first: int = 10) -> DataFrame:
    """(a, b, feature, importance_a, importance_b): of the first features of either run (importances map<string, double>) by name, those whose importance differs."""
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("name"))
    rows = _both(runs, pairs, "importances").withColumn("nth", nth).where(F.col("nth") <= first)
    return rows.where(~F.col("x").eqNullSafe(F.col("y"))).select("a", "b", F.col("name").alias("feature"), F.col("x").alias("importance_a"), F.col("y").alias("importance_b"))


def compare_setups(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, same_dataset, same_target, model_changed)"""
    facts = ("dataset_id", "target", "model_name")
    sides = [runs.select(F.col("job_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in facts]) for s in ("a", "b")]
    same = {c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in facts}
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", same["dataset_id"].alias("same_dataset"), same["target"].alias("same_target"), (~same["model_name"]).alias("model_changed"))


# --- relevance


def plain_name(name: Column) -> Column:
    """A name in lower case with single `_` for all else than letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def _name_similarity(x: Column, y: Column, x_words: Column, y_words: Column) -> Column:
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.75).otherwise(jaccard(x_words, y_words))


def target_similarity(a: Column, b: Column) -> Column:
    """1 for equal names (but for case and punctuation), 0.75 if one holds the other, else what their words share; 0 for empty ones."""
    x, y = plain_name(a), plain_name(b)
    return _name_similarity(x, y, name_tokens(x), name_tokens(y))


#: What a similarity depends on besides the ids: runs that agree in it are of one kind.
KIND = ("task", "row_bucket", "dataset", "signature", "target", "features")


def _similarity_of_kinds(kinds: DataFrame, contexts: DataFrame, most: int, keep: list[str]) -> DataFrame:
    """kinds (KIND and keep) x contexts (id and KIND) -> (keep, context_id, similarity), whatever the ids; names are taken apart once for each kind, not for each pair."""
    n = contexts.count()
    if n > most:
        raise ValueError(f"{n} contexts; at most {most} are held against all runs at once")
    none = F.array().cast("array<string>")

    def taken_apart(df: DataFrame, words: Column, kept: list[str]) -> DataFrame:
        name = plain_name(F.col("target"))
        return df.select(*kept, "task", "row_bucket", "dataset", "signature", name.alias("name"), name_tokens(name).alias("name_words"), column_tokens(words).alias("words"))

    features = F.coalesce("features", none)
    r = taken_apart(kinds, F.concat(features, F.split(F.coalesce("signature", F.lit("")), "\\|")), keep).alias("r")
    c = F.broadcast(taken_apart(contexts, features, ["id"])).alias("c")
    g = lambda s, name: F.col(f"{s}.{name}")
    same = lambda name: F.coalesce((g("r", name) == g("c", name)) & (g("c", name) != ""), F.lit(False))
    parts = {"name": _name_similarity(g("c", "name"), g("r", "name"), g("c", "name_words"), g("r", "name_words")), "shared": jaccard(g("c", "words"), g("r", "words"))}
    facts = r.join(c, F.lit(True)).select(*[g("r", k) for k in keep], g("c", "id").alias("context_id"), *[same(f).alias(f) for f in ("task", "row_bucket", "dataset", "signature")], *[v.alias(k) for k, v in parts.items()])
    yes = lambda fact, weight: weight * F.col(fact).cast("int")
    score = BASE + yes("task", TASK) + TARGET * F.col("name") + FEATURES * F.col("shared") + yes("row_bucket", ROWS) + yes("dataset", DATASET)
    score = F.when(F.col("signature"), F.least(F.lit(1.0), score + SIGNATURE)).otherwise(score)
    comparable = (F.col("name") >= COMPARABLE_TARGET) | (F.col("shared") >= COMPARABLE_FEATURES) | F.col("signature") | F.col("dataset")
    final = F.least(F.lit(1.0), F.when(comparable, score).otherwise(F.least(score, F.lit(INCOMPARABLE))))
    return facts.select(*keep, "context_id", final.alias("similarity"))


def run_similarity(runs: DataFrame, contexts: DataFrame, most: int = 10_000) -> DataFrame:
    """(run_id, context_id, similarity in 0..1) of all runs to a stated set of contexts, at most that many; both are (id, task, target, features array<string>, row_bucket, dataset, signature).

    A run isn't similar to itself: 0 where the ids are equal. A similarity is worked out once for each kind of run and joined with the runs of the kind.
    """
    kind = F.to_json(F.struct(*KIND))
    keyed = runs.select("id", *KIND, kind.alias("kind"))
    told = _similarity_of_kinds(keyed.drop("id").dropDuplicates(["kind"]), contexts, most, ["kind"])
    lists = told.groupBy("kind").agg(F.collect_list(F.struct("context_id", "similarity")).alias("told"))
    rows = keyed.select("id", "kind").join(lists, "kind").select(F.col("id").alias("run_id"), F.inline("told"))
    return rows.select("run_id", "context_id", F.when(F.col("run_id") == F.col("context_id"), 0.0).otherwise(F.col("similarity")).alias("similarity"))


def first_of_kinds(runs: DataFrame, k: int) -> DataFrame:
    """The runs (id and KIND) that may be among the k most similar to any context, where ties go to the smaller id.

    Of each kind the k + 1 smallest ids: runs of a kind are equally similar to a context, but for the one that is the context itself.
    """
    smallest = F.dense_rank().over(Window.partitionBy(*KIND).orderBy("id"))
    return runs.select("id", *KIND).withColumn("nth", smallest).where(F.col("nth") <= k + 1).drop("nth").distinct()


def relevant_runs(similarities: DataFrame, least: float = 0.32) -> DataFrame:
    """The runs similar enough to be looked at."""
    return similarities.where(F.col("similarity") >= least)


def comparable_runs(similarities: DataFrame, least: float = 0.48, k: int = 2) -> DataFrame:
    """(context_id, run_id, similarity, rank): the k most similar runs worth a comparison, each once; ties to the smaller id."""
    best = similarities.where(F.col("similarity") >= least).groupBy("context_id", "run_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("context_id").orderBy(F.desc("similarity"), "run_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def tip_relevance(tips: DataFrame, columns: list[str], least: float = 0.15) -> DataFrame:
    """(tip) -> (tip, relevance): the share of a tip's words that are technique or hold, or are held in, a word of the columns' names; each tip once, those of too little left out."""
    words = name_tokens(F.col("tip"))
    own = column_tokens(F.array(*[F.lit(c) for c in columns]).cast("array<string>"))
    technique = F.array(*[F.lit(t) for t in TECHNIQUE])
    fits = F.filter(words, lambda w: F.array_contains(technique, w) | F.exists(own, lambda c: F.contains(c, w) | F.contains(w, c)))
    made = tips.select("tip").distinct().select("tip", F.when(F.size(words) > 0, F.size(fits) / F.size(words)).otherwise(0.0).alias("relevance"))
    return made.where(F.col("relevance") >= least)
