"""Support vector machines with a radial kernel: random Fourier features (Rahimi and Recht 2007) under linear machines.

The kernel exp(-gamma |x - y|^2) is the mean of products of cosines; `size` random ones give features on which a linear
machine approximates the kernel's. Classes: Spark's linear SVM (hinge loss), one against the rest for more than two. Regression:
squared epsilon-insensitive loss, minimised by Newton steps whose sums of outer products are added up over the rows.

Defined cases: rows whose vector is null, of another length than the first's or not all finite, or whose label is null, take no part in
training; a null or unfit vector has null features and a null prediction.
"""

from __future__ import annotations


import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import free_name, quoted
from ..functions.blocks import collected, matrix, sound
from .clean import _Fitted, _Fitting

SIZE = 256
STEPS, CLOSE = 30, 1e-8


def as_array(df: DataFrame, column: str) -> Column:
    return vector_to_array(quoted(column)) if isinstance(df.schema[column].dataType, VectorUDT) else F.transform(quoted(column), lambda v: v.cast("double"))


def waves(seed: int, width: int, size: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """The random frequencies and phases, made anew from the seed wherever they are needed."""
    rng = np.random.default_rng([seed, width, size])
    return rng.standard_normal((width, size)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, size)


class FourierFeatures(_Fitting):
    """gamma: scale (1 over columns times their mean variance), auto (1 over columns), or a number."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=None, size=None, seed=None):  # noqa: N803
        super().__init__()
        self._init(inputCol="features", outputCol="waves", gamma="scale", size=SIZE, seed=42)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> FourierFeaturesModel:
        get = self.getOrDefault
        rows = df.select(as_array(df, get("inputCol")).alias("x")).where("x IS NOT NULL")
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("there are no rows to learn from")
        width, gamma = first[0], get("gamma")
        rows = rows.where(sound(F.col("x"), width))
        if gamma == "scale":

            def moments(batches):
                out = np.zeros((3, 1))
                for b in batches:
                    x = matrix(b, "x", width)
                    out[:, 0] += x.size, x.sum(), (x * x).sum()
                return out

            n, s, q = collected(rows, moments, 3, 1)[:, 0]
            variance = max(q / n - (s / n) ** 2, 0.0) if n else 0.0
            gamma = 1.0 / (width * variance) if variance > 0 else 1.0
        elif gamma == "auto":
            gamma = 1.0 / width
        return FourierFeaturesModel({"inputCol": get("inputCol"), "outputCol": get("outputCol"), "gamma": float(gamma), "size": get("size"), "seed": get("seed"), "width": width})


class FourierFeaturesModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        width, size = s["width"], s["size"]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def turned(x):
            import pandas as pd

            w, b = waves(s["seed"], width, size, s["gamma"])
            return pd.Series([None if v is None else np.sqrt(2 / size) * np.cos(v @ w + b) for v in x], dtype=object)

        x = as_array(df, s["inputCol"])
        to = s["outputCol"]
        return df.withColumn(to, turned(F.when(sound(x, width), x))).withColumn(to, F.when(quoted(to).isNotNull(), array_to_vector(quoted(to))))


class KernelSVM(_Fitting):
    """C weighs the losses against the size of the weights, as usual; kernel rbf or linear."""

    @keyword_only
    def __init__(self, task=None, featuresCol=None, labelCol=None, predictionCol=None, C=None, gamma=None, kernel=None, epsilon=None, size=None, n_classes=None, seed=None):  # noqa: N803
        super().__init__()
        self._init(task="classification", featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, gamma="scale", kernel="rbf", epsilon=0.1, size=SIZE, n_classes=2, seed=42)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        get = self.getOrDefault
        label, features = get("labelCol"), get("featuresCol")
        rows = df.where(quoted(label).isNotNull() & quoted(features).isNotNull())
        stages = []
        if get("kernel") == "rbf":
            stages.append(FourierFeatures(inputCol=features, outputCol=free_name("__waves", df.columns), gamma=get("gamma"), size=get("size"), seed=get("seed")).fit(rows))
            features = stages[0].fitted["outputCol"]
            rows = stages[0].transform(rows).where(quoted(features).isNotNull())
        if get("task") == "regression":
            stages.append(fit_regression(rows, features, label, get("predictionCol"), get("C"), get("epsilon")))
        else:
            n = rows.count()
            one = C.LinearSVC(featuresCol=features, labelCol=label, predictionCol=get("predictionCol"), regParam=1.0 / max(1e-12, get("C") * max(1, n)))
            stages.append((one if get("n_classes") <= 2 else C.OneVsRest(classifier=one, featuresCol=features, labelCol=label, predictionCol=get("predictionCol"))).fit(rows))
        return PipelineModel(stages=[*stages, _Without({"columns": [features] if get("kernel") == "rbf" else []})])


class _Without(_Fitted):
    """Drops the features made on the way."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.fitted["columns"])


def fit_regression(df: DataFrame, features: str, label: str, prediction: str, c: float = 1.0, epsilon: float = 0.1, steps: int = STEPS) -> LinearRegressor:
    """min |w|^2 / 2 + c sum max(0, |y - w x - b| - epsilon)^2: Newton steps over the rows outside the tube, halved where they don't help."""
    rows = df.select(as_array(df, features).alias("x"), quoted(label).cast("double").alias("y"))
    width = rows.select(F.size("x")).first()[0]
    rows = rows.where(sound(F.col("x"), width) & F.col("y").isNotNull())

    def evaluated(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss, its gradient and second derivative; the last entry of w is b, which has no penalty."""
        shared = df.sparkSession.sparkContext.broadcast(w)

        def work(batches):
            out = np.zeros((width + 3, width + 1))
            w = shared.value
            for batch in batches:
                x = np.column_stack([matrix(batch, "x", width), np.ones(batch.num_rows)])
                r = x @ w - batch.column("y").to_numpy(zero_copy_only=False)
                over = np.maximum(np.abs(r) - epsilon, 0)
                active = over > 0
                xa = x[active]
                out[: width + 1] += xa.T @ xa
                out[width + 1] += xa.T @ (np.sign(r) * over)[active]
                out[width + 2, 0] += (over**2).sum()
            return out

        found = collected(rows, work, width + 3, width + 1)
        penalty = np.r_[np.ones(width), 0.0]
        shared.unpersist()
        return float(c * found[width + 2, 0] + 0.5 * (penalty * w * w).sum()), penalty * w + 2 * c * found[width + 1], np.diag(penalty + 1e-9) + 2 * c * found[: width + 1]

    w = np.zeros(width + 1)
    loss, gradient, second = evaluated(w)
    for _ in range(steps):
        step = np.linalg.solve(second, gradient)
        size = 1.0
        while size > 1e-6:
            new = evaluated(w - size * step)
            if new[0] <= loss - 1e-4 * size * float(gradient @ step) or float(gradient @ step) < 1e-12:
                break
            size /= 2
        before, w = loss, w - size * step
        loss, gradient, second = new
        if before - loss <= CLOSE * max(1.0, abs(before)):
            break
    return LinearRegressor({"features": features, "prediction": prediction, "weights": w[:-1].tolist(), "intercept": float(w[-1])})


class LinearRegressor(_Fitted):
    """prediction = weights x + intercept; null for an unfit vector."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        x, w = as_array(df, s["features"]), F.array(*[F.lit(v) for v in s["weights"]])
        dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(s["intercept"]), lambda acc, v: acc + v)
        return df.withColumn(s["prediction"], F.when(sound(x, len(s["weights"])), dot))
