"""Feature engineering and selection."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark import keyword_only
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import adjusted_skew, categorical_columns, datetime_columns, long_numbers, number, numeric_columns, quoted, shared_path
from ..functions.ranks import quantiles
from .clean import _Fitted, _Fitting
from .profile import distinct_over, pearson


def date_parts(c: Column, name: str) -> list[Column]:
    """year, month, day, dayofweek (Monday 0) and is_weekend (0 for null) of a date."""
    return [F.year(c).alias(f"{name}__year"), F.month(c).alias(f"{name}__month"), F.day(c).alias(f"{name}__day"), F.weekday(c).alias(f"{name}__dayofweek"), F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)).alias(f"{name}__is_weekend")]


def log_candidates(df: DataFrame, columns: list[str] | None = None, above: float = 1.0) -> DataFrame:
    """(column, skew): columns without negative values whose skew is over above in size."""
    stats = long_numbers(df, columns).groupBy("column").agg(F.min("value").alias("low"), adjusted_skew(F.col("value")).alias("skew"))
    return stats.where((F.col("low") >= 0) & (F.abs("skew") > above)).select("column", "skew")


def log1p(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def bin_edges(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    """(column, edges): distinct quantile edges."""
    return quantiles(long_numbers(df, columns), [i / bins for i in range(bins + 1)]).select("column", F.array_distinct("q").alias("edges"))


def bin_code(c: Column, edges: list[float]) -> Column:
    """Number of the interval (low, high] that holds the value, the first closed below; outside, or null, 0."""
    code = None
    for i, high in enumerate(edges[1:]):
        code = F.when((c >= edges[0]) & (c <= high), i) if code is None else code.when((c > edges[i]) & (c <= high), i)
    return F.lit(0) if code is None else code.otherwise(0)


def interaction_ranks(df: DataFrame, columns: list[str], target: Column, pair_score: str = "first", k: int = 3) -> DataFrame:
    """(a, b, score, rank): the k pairs of most correlation with the target, of the first column alone or of the product."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, score double, rank int")
    score = lambda a, b: F.coalesce(F.abs(pearson(number(a) if pair_score == "first" else number(a) * number(b), target)), F.lit(0.0))
    sums = df.agg(*[score(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, (a, b) in enumerate(pairs)])))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("a"), F.desc("b")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, freq): the share of rows of each value; null is a value."""
    counts = df.groupBy(quoted(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__sum")))).select("value", (F.col("n") / F.col("__sum")).alias("freq"))  # one row


#: Values of a column whose frequencies the model holds; those of columns with more are a table, written where spark.checkpoint.dir says, and saved with the model.
MAX_MAP = 1000
#: Bytes of values up to which such a table is broadcast; beyond, only values of at least one row in FREQUENT are.
BROADCAST_BYTES, FREQUENT = 32 << 20, 1000


def joined_frequency(df: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """df with name: the frequency of the column's value in table (value, freq), null where it isn't there; rows and their number stay.

    A table of few bytes is broadcast. Of a larger one the frequent values are (FREQUENT of them at most), and only rows of other
    values are shuffled by theirs; the rest are spread, so that no task gets all rows of a value or of null.
    """
    value, size = quoted(column).cast("string"), table.agg(F.sum(F.coalesce(F.length("value"), F.lit(0)) + 16)).first()[0] or 0
    side = lambda t, v, f: t.select(F.col("value").alias(v), F.col("freq").alias(f))
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(side(table, "__v", name)), value.eqNullSafe(F.col("__v")), "left").drop("__v")
    often = df.join(F.broadcast(side(table.where(F.col("freq") >= 1 / FREQUENT), "__v", "__often")), value.eqNullSafe(F.col("__v")), "left").drop("__v")
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(1 << 20)).cast("string"))
    keyed = often.withColumn("__key", F.when(F.col("__often").isNull() & value.isNotNull(), F.concat(F.lit("="), value)).otherwise(spread))
    rest = table.where(F.col("freq") < 1 / FREQUENT)
    # a rare null is a row of its own here
    null = rest.where("value IS NULL").select("freq").limit(1)
    rest = side(rest.where("value IS NOT NULL").withColumn("value", F.concat(F.lit("="), "value")), "__v", "__rare")
    found = keyed.join(rest, F.col("__key") == F.col("__v"), "left").join(F.broadcast(null.withColumnRenamed("freq", "__null")), F.lit(True), "left")
    return found.withColumn(name, F.coalesce("__often", "__rare", F.when(value.isNull(), F.col("__null")))).drop("__v", "__key", "__often", "__rare", "__null")


class FeatureEngineer(_Fitting):
    """Date parts, logs of skewed columns, quintile bins, products of pairs, one-hot and frequency codes; the result is all numeric, without nulls, with fixed columns."""

    @keyword_only
    def __init__(self, labelCol=None, datetime_columns=None, skew_threshold=None, onehot_max_cardinality=None, enable_interactions=None, max_interactions=None, enable_binning=None, binning_max_unique=None, pair_score=None):
        super().__init__()
        self._init(labelCol="", datetime_columns=[], skew_threshold=1.0, onehot_max_cardinality=10, enable_interactions=True, max_interactions=3, enable_binning=True, binning_max_unique=20, pair_score="first")
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> FeatureEngineerModel:
        get = self.getOrDefault
        label = get("labelCol")
        rest = df.drop(label) if label else df
        dates = [c for c in dict.fromkeys([*get("datetime_columns"), *datetime_columns(rest)]) if c in rest.columns]
        plain = rest.drop(*dates)
        numbers, texts = numeric_columns(plain), categorical_columns(plain)
        logged = [r["column"] for r in log_candidates(plain, numbers, get("skew_threshold")).collect()] if numbers else []
        many = distinct_over(plain, {c: get("binning_max_unique") for c in numbers if c not in logged} | {c: get("onehot_max_cardinality") for c in texts})
        edges: dict = {}
        wide = [c for c in numbers if many.get(c)]
        if get("enable_binning") and wide:
            edges = {r["column"]: r["edges"] for r in bin_edges(plain, wide).collect() if r["edges"] and len(r["edges"]) > 1}
        pairs = []
        if get("enable_interactions") and label and len(numbers) > 1:
            pairs = [[r["a"], r["b"]] for r in interaction_ranks(df, numbers, number(label), get("pair_score"), get("max_interactions")).orderBy("rank").collect()]
        onehot = {c: sorted(r[0] for r in plain.select(quoted(c).cast("string")).where(quoted(c).isNotNull()).distinct().collect()) for c in texts if not many[c]}
        freq, tables = {}, {}
        large = distinct_over(plain, {c: MAX_MAP for c in texts if c not in onehot})
        for c, is_large in large.items():
            if not is_large:
                freq[c] = {("" if r["value"] is None else "=" + r["value"]): r["freq"] for r in frequencies(plain, c).collect()}
            else:
                tables[c] = shared_path(df.sparkSession, "frequencies")
                frequencies(plain, c).write.parquet(tables[c])
        state = {"freq_tables": tables, "dates": dates, "numbers": numbers, "logged": logged, "edges": edges, "pairs": pairs, "onehot": onehot, "freq": freq, "label": label}
        model = FeatureEngineerModel(state)
        return FeatureEngineerModel(state | {"columns": model.transform(df.limit(0)).drop(*[label] if label else []).columns})


class _WithTables(DefaultParamsWriter):
    """Writes the tables of frequencies into the model's own folder."""

    def saveImpl(self, path: str) -> None:  # noqa: N802
        state, spark = self.instance.fitted, self.sparkSession
        for i, (c, table) in enumerate(state.get("freq_tables", {}).items()):
            spark.read.parquet(table).write.parquet(f"{path}/frequencies/{i}")
            state["freq_tables"][c] = f"frequencies/{i}"
        own = self.instance.copy()
        own._set(state=json.dumps(state))
        DefaultParamsWriter(own).saveImpl(path)


class _FromFolder(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        state = model.fitted
        state["freq_tables"] = {c: f"{path}/{table}" for c, table in state.get("freq_tables", {}).items()}
        model._set(state=json.dumps(state))
        return model


class FeatureEngineerModel(_Fitted):
    def transform_beside(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The result with the columns `keys` as they are."""
        s = self.fitted
        return FeatureEngineerModel({**s, "keep": keys}).transform(df)

    def write(self) -> DefaultParamsWriter:
        return _WithTables(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _FromFolder(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        value = {c: log1p(number(c)) if c in s["logged"] else number(c) for c in s["numbers"] if c in df.columns}
        out = [zero(v).alias(c) for c, v in value.items()]
        for c in s["dates"]:
            if c in df.columns:
                when = quoted(c) if dict(df.dtypes)[c] != "string" else F.try_to_timestamp(quoted(c))
                out += [F.coalesce(p.cast("double"), F.lit(0.0)).alias(n) for p, n in zip(date_parts(when, c), [f"{c}__{x}" for x in ("year", "month", "day", "dayofweek", "is_weekend")])]
        out += [bin_code(number(c), e).cast("double").alias(f"{c}__binned") for c, e in s["edges"].items() if c in df.columns]
        out += [zero(value[a] * value[b]).alias(f"{a}__x__{b}") for a, b in s["pairs"] if a in value and b in value]
        out += [F.coalesce((quoted(c).cast("string") == v).cast("double"), F.lit(0.0)).alias(f"{c}__{v}") for c, values in s["onehot"].items() if c in df.columns for v in values]
        for i, (c, freq) in enumerate([*s["freq"].items(), *s.get("freq_tables", {}).items()]):
            if c not in df.columns:
                continue
            if isinstance(freq, str):
                df = joined_frequency(df, c, df.sparkSession.read.parquet(freq), f"__f{i}")
            else:
                side = F.broadcast(df.sparkSession.createDataFrame([(None if k == "" else k[1:], f) for k, f in freq.items()], f"__v{i} string, __f{i} double"))
                df = df.join(side, quoted(c).cast("string").eqNullSafe(F.col(f"__v{i}")), "left")
            out.append(zero(F.col(f"__f{i}")).alias(f"{c}__freq"))
        label = [quoted(s["label"])] if s.get("label") and s["label"] in df.columns else []
        label = [*[quoted(c) for c in s.get("keep", [])], *label]
        made = df.select(*out, *label)
        if "columns" not in s:
            return made
        return made.select(*[quoted(c) if c in made.columns else F.lit(0.0).alias(c) for c in s["columns"]], *label)


def zero_variance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return long_numbers(df, columns).groupBy("column").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance")).where(F.col("variance") <= 0).select("column")


def keep_count(n_columns: int, k: int | None = None) -> int:
    return k or max(5, min(50, int(0.6 * n_columns)))


def anova_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): the one-way ANOVA F of each column over the target's classes, from counts, sums and squares."""
    values = long_numbers(df, columns, [quoted(target).cast("string").alias("y")]).where(F.col("value").isNotNull() & F.col("y").isNotNull())
    mean = values.groupBy("column").agg(F.avg("value").alias("mean"))
    centred = values.join(F.broadcast(mean), "column").withColumn("v", F.col("value") - F.col("mean"))  # one row a column
    groups = centred.groupBy("column", "y").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    total = groups.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return total.select("column", F.when((F.col("k") > 1) & (within > 0), between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).otherwise(0.0).alias("score"))


def regression_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): r^2 (n - 2) / (1 - r^2) of each column with the target."""
    both = long_numbers(df, columns, [number(target).alias("y")]).where(F.col("value").isNotNull() & F.col("y").isNotNull())
    r = both.groupBy("column").agg(pearson(F.col("value"), F.col("y")).alias("r"), F.count("*").alias("n"))
    return r.select("column", F.coalesce(F.col("r") * F.col("r") * (F.col("n") - 2) / (1 - F.col("r") * F.col("r")), F.lit(0.0)).alias("score"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10, target_bins: int | None = None) -> DataFrame:
    """(column, score): plug-in mutual information in nats of equal-width bins of each column and the target's classes (or equal-width bins)."""
    y = quoted(target).cast("string")
    if target_bins:
        low, high = df.agg(F.min(number(target)), F.max(number(target))).first()
        y = F.least(F.width_bucket(number(target), F.lit(low), F.lit(high if high > low else low + 1), F.lit(target_bins)), F.lit(target_bins)).cast("string")
    values = long_numbers(df, columns, [y.alias("y")]).where(F.col("value").isNotNull() & F.col("y").isNotNull())
    ends = values.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    spread = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    cells = values.join(F.broadcast(ends), "column").groupBy("column", spread.alias("bin"), "y").agg(F.count("*").alias("n"))  # one row a column
    of = lambda *c: F.sum("n").over(Window.partitionBy("column", *c))
    parts = cells.select("column", "n", of().alias("all"), of("bin").alias("nx"), of("y").alias("ny"))
    return parts.groupBy("column").agg(F.greatest(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("score"))


def scores(df: DataFrame, columns: list[str], target: str, task: str, method: str = "mutual_info") -> DataFrame:
    """(column, score) by mutual_info (equal-width bins, one pass), mutual_info_neighbours (by nearest neighbours), or f_test."""
    if method == "mutual_info_neighbours":
        from .information import neighbour_information  # which needs models of its own

        return neighbour_information(df, columns, target, task)
    if method == "mutual_info":
        return mutual_information(df, columns, target, target_bins=None if task == "classification" else 10)
    return anova_f(df, columns, target) if task == "classification" else regression_f(df, columns, target)


def selection_report(scored: DataFrame, n_columns: int, k: int | None = None) -> DataFrame:
    """(column, score, rank, kept): all are kept where k reaches the number of scored columns."""
    keep = keep_count(n_columns, k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "column"))
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    return scored.withColumn("rank", rank).withColumn("kept", (F.col("rank") <= keep) | (F.lit(keep) >= total))


class FeatureSelector(_Fitting):
    """Keeps the k columns of best score; all of them where k is as many as there are."""

    @keyword_only
    def __init__(self, labelCol=None, task=None, method=None, max_features=None, variance_threshold=None):
        super().__init__()
        self._init(labelCol="label", task="classification", method="mutual_info", max_features=0, variance_threshold=0.0)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> FeatureSelectorModel:
        get = self.getOrDefault
        label = get("labelCol")
        columns = [c for c in numeric_columns(df) if c != label]
        flat = {r["column"] for r in zero_variance(df, columns).collect()}
        varied = [c for c in columns if c not in flat]
        k = keep_count(len(columns), get("max_features") or None)
        if k >= len(varied):
            return FeatureSelectorModel({"kept": columns, "label": label, "scores": {}})
        ranked = selection_report(scores(df, varied, label, get("task"), get("method")), len(columns), k).orderBy("rank").collect()
        best = {r["column"] for r in ranked if r["kept"]}
        return FeatureSelectorModel({"kept": [c for c in columns if c in best], "label": label, "scores": {r["column"]: r["score"] for r in ranked[:20]}})


class FeatureSelectorModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        return df.select(*[quoted(c) for c in s["kept"]], *([quoted(s["label"])] if s["label"] in df.columns else []))
