"""Text classification: the text column, TF-IDF models compared on held-out rows, and the words that speak for a class."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text, quoted
from .learn import best_on_holdout, class_labels, class_weight, classification_metrics, stratified_split, validate_target
from .text import terms

#: Columns that usually hold the text, in order (fixed values).
ALIASES = ["review_text", "text", "message", "content", "body", "review"]
MAX_TERMS, MIN_DF, MIN_LENGTH, KEYWORDS = 8000, 2, 30, 15
CANDIDATES = ("logistic_regression", "linear_svc", "naive_bayes")


def _strings(df: DataFrame, target: str | None = None) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c != target]


def text_column(df: DataFrame, target: str | None = None, least: float = MIN_LENGTH) -> str | None:
    """The first text column, other than the target, whose values have more than that many characters on average (a null has those of `nan`)."""
    columns = _strings(df, target)
    if not columns:
        return None
    means = df.agg(*[F.avg(F.length(F.coalesce(quoted(c), F.lit("nan")))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return next((c for c, m in zip(columns, means) if m is not None and m > least), None)


def text_of(df: DataFrame, column: str | None = None) -> Column:
    """The cleaned text of each row: of the column if df has it, else of the first usual one, else of the row's first text that isn't blank."""
    known = [c for c in [column, *ALIASES] if c and c in df.columns]
    if known:
        return clean_text(F.coalesce(quoted(known[0]).cast("string"), F.lit("")))
    blank = [F.when(F.trim(quoted(c)) != "", quoted(c)) for c in _strings(df)]
    return clean_text(F.coalesce(*blank, F.lit("")))


class TextClassifier:
    """A fitted model with its classes, text column, leaderboard, metrics and keywords."""

    def __init__(self, model: PipelineModel, name: str, labels: list[str], column: str, leaderboard: DataFrame, metrics: DataFrame, keywords: DataFrame):
        self.model, self.name, self.labels, self.column = model, name, labels, column
        self.leaderboard, self.metrics, self.keywords = leaderboard, metrics, keywords

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction."""
        made = self.model.transform(df.withColumn("__terms", terms(text_of(df, self.column))))
        said = F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.col("prediction").cast("int") + 1)
        return made.select(*[quoted(c) for c in df.columns if c != "prediction"], said.alias("prediction"))


def train_text(df: DataFrame, target: str, key: str, column: str | None = None, candidates: tuple[str, ...] = CANDIDATES, test: float = 0.2, seed: int = 42, max_terms: int = MAX_TERMS) -> TextClassifier:
    """Compares TF-IDF models (words and pairs of words) on held-out rows by weighted F1; the best is kept, with its metrics there and its classes' keywords."""
    column = column or text_column(df, target)
    if column is None or column not in df.columns:
        raise ValueError("there is no text column; name one")
    rows = df.where(quoted(column).isNotNull() & quoted(target).isNotNull())
    validate_target(rows, target)
    labels = class_labels(rows, target)
    code = F.array_position(F.array(*[F.lit(x) for x in labels]), quoted(target).cast("string")) - 1
    rows = rows.select(quoted(key).alias("__key"), terms(clean_text(quoted(column))).alias("__terms"), code.cast("double").alias("label"))
    split = stratified_split(rows, "label", F.col("__key"), test, seed).persist()
    try:
        train, held = split.where(~F.col("is_test")), split.where("is_test")
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        matrix = Pipeline(stages=[CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=max_terms, minDF=MIN_DF), IDF(inputCol="__tf", outputCol="features")]).fit(train)
        ready = matrix.transform(train).withColumn("__weight", class_weight(counts, len(labels))).select("features", "label", "__weight").persist()
        name, one, board = best_on_holdout(ready, matrix.transform(held), candidates, len(labels), seed, "__weight")
        fitted = PipelineModel(stages=[*matrix.stages, one])
        ready.unpersist()
        spark = df.sparkSession
        metrics = spark.createDataFrame([tuple(classification_metrics(fitted.transform(held), "label", "prediction").first())], "accuracy double, precision double, recall double, f1 double")
        words = keywords(one, matrix.stages[0].vocabulary, labels, spark)
        return TextClassifier(fitted, name, labels, column, spark.createDataFrame(board, "model string, f1 double"), metrics, words)
    finally:
        split.unpersist()


def _coefficients(model, n_classes: int) -> np.ndarray | None:
    """Classes x terms, or None for a model that has no coefficients."""
    if hasattr(model, "models"):
        return np.stack([m.coefficients.toArray() for m in model.models])
    if hasattr(model, "coefficientMatrix"):
        found = model.coefficientMatrix.toArray()
    elif hasattr(model, "coefficients"):
        found = model.coefficients.toArray()[None, :]
    elif hasattr(model, "theta"):
        return model.theta.toArray()
    else:
        return None
    return np.concatenate([-found, found]) if len(found) == 1 and n_classes == 2 else found


def keywords(model, vocabulary: list[str], labels: list[str], spark, k: int = KEYWORDS) -> DataFrame:
    """(class, term, weight, rank): the k terms of the largest coefficients of each class; none for a model without coefficients."""
    found = _coefficients(model, len(labels))
    rows = [] if found is None else [(label, vocabulary[j], float(w[j])) for label, w in zip(labels, found) for j in np.argsort(-w, kind="stable")[:k].tolist()]
    made = spark.createDataFrame(rows, "class string, term string, weight double")
    return made.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "term")))


def keywords_for(predictions: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """predictions (..., prediction) with keywords: the k first words of the predicted class (words: a table of at most KEYWORDS rows a class)."""
    top = words.where(F.col("rank") <= k).groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    return predictions.join(F.broadcast(top), F.col("prediction") == F.col("class"), "left").drop("class")
