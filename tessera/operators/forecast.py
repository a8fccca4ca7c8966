"""Forecasts of series from their lags: models compared on the last rows, and new rows scored with the history before them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import estimator, fit_on, ordered_split, regression_metrics
from .text import lag_features, series_matrix, series_rows

LAGS = (1, 2, 3, 7, 14)
FEATURES = [*[f"lag_{k}" for k in LAGS], "roll_mean", "roll_std", "hour", "dow", "month"]
CANDIDATES = ("ridge", "random_forest", "gradient_boosting")
#: Complete rows that training needs.
LEAST_ROWS = 30


class Forecaster:
    """A fitted model of a series' next value, with its leaderboard (RMSE with a minus sign) and metrics on the last rows."""

    def __init__(self, model: PipelineModel, name: str, value: str, by: list[str], order: list[str], leaderboard: DataFrame, metrics: DataFrame):
        self.model, self.name, self.value, self.by, self.order, self.leaderboard, self.metrics = model, name, value, by, order, leaderboard, metrics

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction, from lag columns that it has; ValueError without them."""
        gone = [c for c in FEATURES if c not in df.columns]
        if gone:
            raise ValueError(f"lag columns are missing: {gone[:5]}; predict_next makes them from a history")
        return self.model.transform(df.withColumn("label", F.lit(0.0))).drop("label", "features")

    def predict_next(self, history: DataFrame, new: DataFrame) -> DataFrame:
        """new rows with prediction, their lags made of the rows before them in history and new; rows whose history is too short are left out."""
        rows = history.select(*self.by, *self.order, self.value).withColumn("__new", F.lit(False)).unionByName(new.select(*self.by, *self.order, self.value).withColumn("__new", F.lit(True)))
        made = series_matrix(lag_features(rows, self.value, self.by, self.order)).where("__new")
        return self.predict(made).select(*self.by, *self.order, self.value, "prediction")


def train_series(df: DataFrame, value: str, by: list[str], order: list[str], candidates: tuple[str, ...] = CANDIDATES, test: float = 0.2) -> Forecaster:
    """Compares models of the value on lags, means of the rows before and the calendar, on the last rows of each series."""
    rows = series_matrix(lag_features(series_rows(df, order[0], value), value, by, order)).withColumn("label", F.col(value)).na.drop(subset=FEATURES)
    split = ordered_split(rows, order[0], by, test).persist()
    try:
        if split.count() < LEAST_ROWS:
            raise ValueError(f"fewer than {LEAST_ROWS} rows have a complete history")
        train, held = split.where(~F.col("is_test")), split.where("is_test")
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        board, best = [], None
        for name in candidates:
            fitted = PipelineModel(stages=[assemble, fit_on(assemble.transform(train), estimator(name, "regression"))])
            found = tuple(regression_metrics(fitted.transform(held), "label", "prediction").first())
            board.append((name, -round(found[2], 4)))
            if best is None or found[2] < best[0]:
                best = found[2], name, fitted, found
        spark = df.sparkSession
        return Forecaster(best[2], best[1], value, by, order, spark.createDataFrame(board, "model string, score double"), spark.createDataFrame([best[3]], "r2 double, mae double, rmse double, mape double"))
    finally:
        split.unpersist()
