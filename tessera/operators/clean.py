"""Row cleanup, imputation and outliers: functions, and Estimators that replay what they fitted."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import categorical_columns, long_numbers, long_strings, number, numeric_columns, quoted
from ..functions.ranks import quantiles
from .profile import constant_columns, missing


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def align(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of schema, in its order: missing ones as null, others dropped."""
    return df.select(*[(quoted(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    return [c for c in reference.columns if c in set(current.columns)]


def to_number(c: Column) -> Column:
    """Text as double; what is no number is null."""
    return c.try_cast("double")


def to_timestamp(c: Column, *formats: str) -> Column:
    """Text as timestamp by the first form that fits; what fits none is null."""
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def medians(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """(column, fill): the median or mean of each column, 0 where it has no value."""
    rows = long_numbers(df, columns)
    found = quantiles(rows, [0.5]).select("column", F.col("q")[0].alias("fill")) if how == "median" else rows.groupBy("column").agg(F.avg("value").alias("fill"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("fill", F.lit(0.0)).alias("fill"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fill): the most frequent value of each column, the least on ties."""
    counts = long_strings(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).select("column", F.col("m.value").alias("fill"))


def fences(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """(column, low, high): Tukey's fences; infinite for a column without values."""
    inf = float("inf")
    columns = numeric_columns(df) if columns is None else columns
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    q = every.join(quantiles(long_numbers(df, columns), [0.25, 0.75]), "column", "left").select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    return q.select("column", F.coalesce(F.col("q1") - k * (F.col("q3") - F.col("q1")), F.lit(-inf)).alias("low"), F.coalesce(F.col("q3") + k * (F.col("q3") - F.col("q1")), F.lit(inf)).alias("high"))


def outlier_counts(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """(column, n_outliers): values strictly outside the fences."""
    values = long_numbers(df, columns)
    out = values.join(F.broadcast(fences(df, columns, k)), "column")  # one row a column
    return out.groupBy("column").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("n_outliers"))


def capped(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


class _Fitted(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose state is one JSON parameter, so that it is saved with Spark ML's own writer."""

    state = Param(Params._dummy(), "state", "what was fitted, as JSON")

    def __init__(self, state: dict | None = None):
        super().__init__()
        self._set(state=json.dumps(state or {}))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _Fitting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator with plain parameters."""

    def _init(self, **defaults):
        for name in defaults:
            setattr(self, name, Param(self, name, name))
        self._setDefault(**defaults)

    def _given(self, kwargs):
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class Cleaner(_Fitting):
    """Drops sparse and constant columns and fills what is missing."""

    @keyword_only
    def __init__(self, missing_drop_threshold=None, numeric_impute_strategy=None, categorical_impute_strategy=None, ignore=None):
        super().__init__()
        self._init(missing_drop_threshold=0.9, numeric_impute_strategy="median", categorical_impute_strategy="most_frequent", ignore=[])
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> CleanerModel:
        get = self.getOrDefault
        df = df.drop(*get("ignore"))
        sparse = [r["column"] for r in missing(df).where(F.col("missing_share") > get("missing_drop_threshold")).collect()]
        kept = df.drop(*sparse)
        constant = [r["column"] for r in constant_columns(kept).collect()] if kept.columns else []
        kept = kept.drop(*constant)
        fill: dict = {}
        if numbers := numeric_columns(kept):
            fill |= {r["column"]: r["fill"] for r in medians(kept, numbers, get("numeric_impute_strategy")).collect()}
        if texts := categorical_columns(kept):
            fill |= {c: "missing" for c in texts}
            if get("categorical_impute_strategy") == "most_frequent":
                fill |= {r["column"]: r["fill"] for r in modes(kept, texts).collect()}
        return CleanerModel({"dropped_sparse": sparse, "dropped_constant": constant, "fill": fill, "columns": kept.columns})


class CleanerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        out = df.drop(*s["dropped_sparse"], *s["dropped_constant"])
        fill = {c: F.coalesce(number(c) if not isinstance(v, str) else quoted(c).cast("string"), F.lit(v)).alias(c) for c, v in s["fill"].items() if c in out.columns}
        return out.select(*[fill.get(c, quoted(c)) for c in out.columns])

    def report(self, spark) -> DataFrame:
        """(step, column, value)"""
        s = self.fitted
        rows = [("dropped_sparse", c, None) for c in s["dropped_sparse"]] + [("dropped_constant", c, None) for c in s["dropped_constant"]] + [("filled", c, str(v)) for c, v in s["fill"].items()]
        return spark.createDataFrame(rows, "step string, column string, value string")


class OutlierCap(_Fitting):
    """Caps numeric columns at Tukey's fences (action cap) or drops rows outside them (action remove); method isolation_forest adds _anomaly_score."""

    @keyword_only
    def __init__(self, columns=None, method=None, iqr_multiplier=None, action=None, seed=None, trees=None):
        super().__init__()
        self._init(columns=[], method="iqr", iqr_multiplier=1.5, action="cap", seed=42, trees=200)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> OutlierCapModel:
        columns = self.getOrDefault("columns") or numeric_columns(df)
        found = {r["column"]: [r["low"], r["high"]] for r in fences(df, columns, self.getOrDefault("iqr_multiplier")).collect()}
        state = {"fences": found, "action": self.getOrDefault("action")}
        if self.getOrDefault("method") == "isolation_forest":
            state["forest"] = IsolationForest(columns=columns, trees=self.getOrDefault("trees"), seed=self.getOrDefault("seed")).fit(df).fitted
        return OutlierCapModel(state)


class OutlierCapModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        if "forest" in s:
            df = IsolationForestModel(s["forest"]).transform(df)
        use = {c: f for c, f in s["fences"].items() if c in df.columns}
        if s["action"] == "remove":
            for c, (low, high) in use.items():
                df = df.where(number(c).isNull() | number(c).between(low, high))
            return df
        return df.select(*[capped(number(c), *use[c]).alias(c) if c in use else quoted(c) for c in df.columns])


class IsolationForest(_Fitting):
    """Isolation forest (Liu, Ting, Zhou 2008): each tree isolates the rows of a small subsample by random cuts; rows that take few cuts to isolate are anomalous.

    A row's draw is a hash of the column `key`, or of all columns (equal rows are then drawn together), so that it doesn't depend on partitions.
    """

    @keyword_only
    def __init__(self, columns=None, trees=None, sample=None, seed=None, key=None):
        super().__init__()
        self._init(columns=[], trees=200, sample=256, seed=42, key="")
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> IsolationForestModel:
        columns = self.getOrDefault("columns") or numeric_columns(df)
        trees, size, seed = (self.getOrDefault(p) for p in ("trees", "sample", "seed"))
        fill = {r["column"]: r["fill"] for r in medians(df, columns).collect()}
        key = F.xxhash64(*[quoted(c) for c in ([self.getOrDefault("key")] if self.getOrDefault("key") else df.columns)])
        rows = df.select(key.alias("key"), F.array(*[F.coalesce(number(c), F.lit(fill[c])) for c in columns]).alias("x"))
        n = rows.count()
        # each tree's subsample: with a margin, by a hash of the row's key, tree and seed, then exactly size of them
        share = int(min(1.0, 4.0 * size / max(1, n)) * (1 << 40))
        of = lambda salt, tree: F.pmod(F.xxhash64("key", F.lit(seed + salt), tree), F.lit(1 << 40))
        drawn = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: of(0, t) < share)))
        picked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(of(1, F.col("tree")), "x"))).where(F.col("r") <= size)

        def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            tree = int(key[0])
            x = np.array(part["x"].to_list(), np.float64).reshape(len(part), -1)
            rng = np.random.default_rng([seed, tree])
            nodes: list[list] = []

            def build(i: np.ndarray, depth: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, float(len(i))])
                spread = np.flatnonzero(x[i].max(0) > x[i].min(0)) if len(i) > 1 else []
                if depth < limit and len(spread):
                    f = int(rng.choice(spread))
                    cut = rng.uniform(x[i, f].min(), x[i, f].max())
                    low = x[i, f] < cut
                    if low.any() and not low.all():
                        nodes[at][:2] = [f, cut]
                        nodes[at][2], nodes[at][3] = build(i[low], depth + 1), build(i[~low], depth + 1)
                return at

            limit = int(np.ceil(np.log2(max(2, len(x)))))
            build(np.arange(len(x)), 0)
            return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(nodes)], "n": [len(x)]})

        grown = picked.select("tree", "x").groupBy("tree").applyInPandas(grow, "tree int, nodes string, n int").orderBy("tree").collect()
        return IsolationForestModel({"columns": columns, "fill": fill, "trees": [json.loads(r["nodes"]) for r in grown], "sample": max([r["n"] for r in grown], default=1)})


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForestModel(_Fitted):
    """Adds _anomaly_score, in 0 to 1."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        columns, size = s["columns"], s["sample"]
        shared = df.sparkSession.sparkContext.broadcast([np.array(t, np.float64) for t in s["trees"]])

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            data = np.array(x.to_list(), np.float64).reshape(len(x), len(columns))
            depth = np.zeros(len(data))
            for tree in shared.value:
                at, level = np.zeros(len(data), np.int64), np.zeros(len(data))
                live = np.flatnonzero(tree[at, 0] >= 0)
                while len(live):
                    node = tree[at[live]]
                    left = data[live, node[:, 0].astype(np.int64)] < node[:, 1]
                    at[live] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
                    level[live] += 1
                    live = live[tree[at[live], 0] >= 0]
                depth += level + _average_path(tree[at, 4])
            return pd.Series(2.0 ** (-depth / max(1, len(shared.value)) / max(1e-9, float(_average_path(np.array(size))))))

        return df.withColumn("_anomaly_score", score(F.array(*[F.coalesce(number(c), F.lit(float(s["fill"][c]))) for c in columns])))
