"""Logs and tickets: what to do with them, themes of their messages, spikes of their volume."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quoted, shared_path
from .text import terms

MAX_CLASSES = 50


def route(df: DataFrame, target: str | None) -> str:
    """"classify" if the target has at most 50 values, else "cluster"."""
    if target is None or target not in df.columns:
        return "cluster"
    return "classify" if df.select(quoted(target)).na.drop().distinct().limit(MAX_CLASSES + 1).count() <= MAX_CLASSES else "cluster"


@dataclass
class Themes:
    members: DataFrame  # (key, theme)
    words: DataFrame  # (theme, place, term, weight)
    proxy: float  # themes for each row
    silhouette: float


def themes(docs: DataFrame, key: str, text: str, vocabulary: int = 5000, min_df: int = 2, starts: int = 10, most_words: int = 10, seed: int = 42) -> Themes:
    """Clusters of messages by TF-IDF and k-means (k = n / 50, 2 to 8), the best of several starts, and the weightiest terms of each centre.

    Null texts and texts without words are at the origin. The vocabulary and the centres (k x vocabulary numbers) are what the driver holds.
    """
    rows = docs.select(quoted(key), F.coalesce(terms(quoted(text)), F.expr("cast(array() as array<string>)")).alias("__terms"))
    counted = CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=vocabulary, minDF=min_df).fit(rows)
    tf = counted.transform(rows)
    idf = IDF(inputCol="__tf", outputCol="__w").fit(tf)
    steps = [ElementwiseProduct(scalingVec=idf.idf.toArray() + 1.0, inputCol="__tf", outputCol="__w"), Normalizer(inputCol="__w", outputCol="features")]
    made = Pipeline(stages=steps).fit(tf).transform(tf).select(quoted(key), "features").persist()
    n = made.count()
    k = min(8, max(2, n // 50))
    fits = [KMeans(k=k, seed=seed + i).fit(made) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    members = best.transform(made).select(quoted(key), "features", F.col("prediction").alias("theme"))
    heard = []
    for theme, centre in enumerate(best.clusterCenters()):
        for place, j in enumerate(np.argsort(-centre, kind="stable")[:most_words], 1):
            if centre[j] > 0:
                heard.append((theme, place, counted.vocabulary[j], float(centre[j])))
    silhouette = ClusteringEvaluator(predictionCol="theme").evaluate(members)
    path = shared_path(docs.sparkSession, "themes")
    members.drop("features").write.parquet(path)
    made.unpersist()
    return Themes(docs.sparkSession.read.parquet(path), docs.sparkSession.createDataFrame(heard, "theme int, place int, term string, weight double"), k / n, silhouette)


def masked(message: Column) -> Column:
    """A message's template: its numbers and hexadecimal words as #, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(message), r"\b(0x[0-9a-f]+|[0-9a-f]*[0-9][0-9a-f]*)\b", "#"), r"\s+", " "))


def volume(df: DataFrame, ts: str, by: str, unit: str = "day", window: int = 7, least: float = 3.0) -> DataFrame:
    """(by, start, n, z, spike): rows of each group and unit of time, against the mean and deviation of the group's window units before.

    z is null with fewer than two units before, or if they don't vary; only units that have rows count.
    """
    n = df.groupBy(quoted(by), F.date_trunc(unit, ts).alias("start")).agg(F.count("*").alias("n"))
    past = Window.partitionBy(by).orderBy("start").rowsBetween(-window, -1)
    spread = F.stddev_samp("n").over(past)
    z = F.when(spread > 0, (F.col("n") - F.avg("n").over(past)) / spread)
    return n.withColumn("z", z).withColumn("spike", F.coalesce(F.col("z") >= least, F.lit(False)))
