"""Reports on runs: (job_id, dataset_id, created_at, model_name, metrics map<string, double>), one row for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metrics of which larger is better, in the order in which ties are decided.
SCORES = ("accuracy", "roc_auc", "r2", "f1_weighted")


def score(metrics: str = "metrics"):
    """The first of accuracy, ROC AUC and R2 that a run has, other than zero."""
    return F.coalesce(*[F.nullif(F.col(metrics)[m], F.lit(0.0)) for m in SCORES[:3]])


def dashboard(runs: DataFrame) -> DataFrame:
    """One row: numbers of runs and datasets, the best metric and its value (0 if none is positive), the latest run and its model."""
    value = F.greatest(*[F.coalesce(F.col("metrics")[m], F.lit(0.0)) for m in SCORES], F.lit(0.0))
    label = F.coalesce(*[F.when(F.col("metrics")[m] == value, m) for m in SCORES])
    newest = F.struct("created_at", "job_id", "model_name")
    best = F.struct(value.alias("value"), *[(-F.coalesce(F.array_position(F.array(*map(F.lit, SCORES)), label), F.lit(0))).alias("place")], label.alias("metric"))
    made = runs.agg(F.count("*").alias("runs"), F.count_distinct("dataset_id").alias("datasets"), F.max(best).alias("b"), F.max(newest).alias("n"))
    value, metric = F.coalesce("b.value", F.lit(0.0)), F.when(F.col("b.value") > 0, F.col("b.metric"))
    return made.select("runs", "datasets", value.alias("best_value"), metric.alias("best_metric"), F.col("n.job_id").alias("latest_job_id"), F.col("n.model_name").alias("latest_model"))


def recent(runs: DataFrame, k: int = 12) -> DataFrame:
    """The k latest runs with their scores, newest first; ties by job_id."""
    return runs.select("job_id", "dataset_id", "created_at", "model_name", F.round(score(), 4).alias("score")).orderBy(F.desc("created_at"), F.desc("job_id")).limit(k)


def leaderboard_gap(boards: DataFrame, by: str, close: float = 0.02) -> DataFrame:
    """(by, model_name, score) -> (by, winner, runner_up, gap, close): close if the winner is ahead by less than that; a lone model has no runner-up and isn't close."""
    first = boards.where("score IS NOT NULL").groupBy(by).agg(F.max(F.struct("score", "model_name")).alias("w"))
    rest = boards.where("score IS NOT NULL").join(first, by).where((F.col("score") != F.col("w.score")) | (F.col("model_name") != F.col("w.model_name")))
    second = rest.groupBy(by).agg(F.max(F.struct("score", "model_name")).alias("s"))
    gap = F.col("w.score") - F.col("s.score")
    return first.join(second, by, "left").select(by, F.col("w.model_name").alias("winner"), F.col("s.model_name").alias("runner_up"), gap.alias("gap"), F.coalesce(gap < close, F.lit(False)).alias("close"))


def trend(runs: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Each run with its score's change against the run before it of the same dataset (null for the first)."""
    w = Window.partitionBy(by).orderBy("created_at", "job_id")
    return runs.withColumn("score", score()).withColumn("change", F.col("score") - F.lag("score").over(w))
