"""Column statistics: shape, missing values, numeric and categorical summaries, correlations, signatures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import adjusted_skew, categorical_columns, datetime_columns, finite, long_numbers, long_strings, number, numeric_columns, quoted
from ..functions.blocks import STRIP, collected, columns_matrix, summed
from ..functions.ranks import quantiles


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, missing_share): null, or NaN in floating columns, to four places; one aggregate for all columns."""
    gone = [F.isnan(quoted(f.name)) | quoted(f.name).isNull() if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name).isNull() for f in df.schema]
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(g.cast("long")), F.lit(0)).alias(f"m{i}") for i, g in enumerate(gone)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(df.columns)])
    return sums.select("n", F.inline(rows)).select("column", "n_missing", F.when(F.col("n") > 0, F.round(F.col("n_missing") / F.col("n"), 4)).otherwise(0.0).alias("missing_share"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """(column, n, mean, std, min, q25, median, q75, max, skew); accuracy switches to approximate quantiles."""
    rows = long_numbers(df, columns)
    if accuracy is None:
        q = quantiles(rows, [0.25, 0.5, 0.75])
    else:
        q = rows.groupBy("column").agg(F.percentile_approx("value", F.array(*map(F.lit, (0.25, 0.5, 0.75))), accuracy).cast("array<double>").alias("q"))
    sums = rows.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(0.0).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), adjusted_skew(F.col("value")).alias("skew"),
    )
    return sums.join(q, "column", "left").select("column", "n", "mean", "std", "min", *[F.col("q")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))], "max", "skew")


def numeric_entry(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, std, min, max, skew, missing_share): what the exploration report says of a numeric column; 0 where there is no value or no finite one."""
    columns = numeric_columns(df) if columns is None else columns
    gone = missing(df.select(*[quoted(c) for c in columns])).select(F.col("column").alias("__c"), "missing_share")
    made = numeric_summary(df, columns).select("column", *[finite(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "skew")])
    return made.join(F.broadcast(gone), F.col("column") == F.col("__c")).drop("__c")  # a row a column


def categorical_top(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """(column, n_distinct, value, n, rank): the k most frequent values of each column, ties by value.

    Distinct values are counted by an aggregate and ranked by a window of which each task keeps its own k best, so that no task orders all values of a column.
    """
    counts = long_strings(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    many = counts.groupBy(F.col("column").alias("__column")).agg(F.count("*").alias("n_distinct"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    # one row a column
    return top.join(F.broadcast(many), F.col("column") == F.col("__column")).select("column", "n_distinct", "value", "n", "rank")


#: The relative standard deviation of the sketches of distinct values, and how many of these deviations settle a comparison.
SKETCH, SURE = 0.02, 6


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_distinct, has_null): exact. Each column is counted by itself, so that no row is repeated for every column."""
    columns = df.columns if columns is None else columns
    one = lambda c: df.select(quoted(c).alias("v")).groupBy("v").agg(F.lit(1).alias("one")).agg(F.lit(c).alias("column"), F.count("v").alias("n_distinct"), F.coalesce(F.bool_or(F.col("v").isNull()), F.lit(False)).alias("has_null"))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, has_null boolean")
    return reduce(DataFrame.unionByName, map(one, columns))


def distinct_sketches(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, bool]]:
    """column -> (least, most, has_null): bounds on the number of distinct values, from mergeable sketches of all columns in one pass without a shuffle of values."""
    sums = df.agg(*[F.approx_count_distinct(quoted(c), SKETCH).alias(f"d{i}") for i, c in enumerate(columns)], *[F.coalesce(F.bool_or(quoted(c).isNull()), F.lit(False)).alias(f"z{i}") for i, c in enumerate(columns)]).first()
    return {c: (int(sums[f"d{i}"] * (1 - SURE * SKETCH)), int(np.ceil(sums[f"d{i}"] * (1 + SURE * SKETCH))), sums[f"z{i}"]) for i, c in enumerate(columns)}


def distinct_over(df: DataFrame, limits: dict[str, float]) -> dict[str, bool]:
    """column -> whether it has more distinct values than its limit: by sketches where they are sure, else by an exact count of the column alone."""
    found = distinct_sketches(df, list(limits)) if limits else {}
    near = [c for c, limit in limits.items() if found[c][0] <= limit < found[c][1]]
    exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, near).collect()} if near else {}
    return {c: exact.get(c, found[c][0]) > limit for c, limit in limits.items()}


def constant_columns(df: DataFrame) -> DataFrame:
    """(column): columns of one value at most, null being one: their least value is their largest."""
    ends = [(F.min(quoted(c)), F.max(quoted(c))) for c in df.columns]
    same = [F.when(F.count(quoted(c)) == F.count("*"), a.eqNullSafe(b)).otherwise(F.count(quoted(c)) == 0).alias(f"c{i}") for i, (c, (a, b)) in enumerate(zip(df.columns, ends))]
    sums = df.agg(*same)
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("same")) for i, c in enumerate(df.columns)]))).where("same").select("column")


def high_cardinality(df: DataFrame, above: int = 50) -> DataFrame:
    """(column, n_distinct): categorical columns of more than `above` values; exact counts, of the columns that sketches don't rule out."""
    columns = categorical_columns(df)
    over = [c for c, (_, most, _) in distinct_sketches(df, columns).items() if most > above] if columns else []
    return distinct_counts(df, over).where(F.col("n_distinct") > above).select("column", "n_distinct")


def detected_datetimes(df: DataFrame, look_at: int = 30, least: float = 0.9) -> DataFrame:
    """(column): datetime columns by type, and string columns where over least of look_at values (the first by hash) parse."""
    found = [r.alias("column") for r in map(F.lit, datetime_columns(df))]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    rows = long_strings(df, strings).where(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.xxhash64("value"), "value"))
    parsed = rows.withColumn("r", rank).where(F.col("r") <= look_at).groupBy("column").agg(F.avg(F.try_to_timestamp("value").isNotNull().cast("double")).alias("p")).where(F.col("p") > least).select("column")
    return parsed.unionByName(df.sparkSession.range(1).select(F.explode(F.array(*found)).alias("column"))) if found else parsed


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair a < b by position, pairwise complete; null where either doesn't vary over the rows that have both.

    Each task multiplies blocks of rows with the columns, centred and with their masks, and the products (counts, sums, squares and cross products of every
    pair) are added up in strips: work of rows x columns^2, in plans whose size doesn't grow with the number of columns.
    A strip of pairs is one pass, as wide as STRIP_ENTRIES allows.
    """
    columns = numeric_columns(df) if columns is None else columns
    p = len(columns)
    if p < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    rows = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def totals(batches):
        out = np.zeros((2, p))
        for batch in batches:
            x = columns_matrix(batch)
            out += np.stack([np.where(np.isfinite(x), x, 0).sum(0), np.isfinite(x).sum(0)])
        return out

    s, n = collected(rows, totals, 2, p)
    shared = df.sparkSession.sparkContext.broadcast(s / np.maximum(n, 1))
    wide = max(1, STRIP_ENTRIES // (6 * p))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, name string")
    strips = []
    for first in range(0, p, wide):
        some = min(wide, p - first)

        def products(batches, first=first, some=some):
            out = np.zeros((6, some, p))
            for batch in batches:
                x = columns_matrix(batch) - shared.value
                m = (~np.isnan(x)).astype(float)
                x = np.where(np.isnan(x), 0.0, x)
                y, k = x[:, first : first + some], m[:, first : first + some]
                for i, (left, right) in enumerate(((k, m), (y, m), (k, x), (y * y, m), (k, x * x), (y, x))):
                    out[i] += left.T @ right
            return out.transpose(1, 0, 2).reshape(some, 6 * p)

        def told(batches, first=first, some=some, width=6 * p):
            for batch in batches:
                for k, data in zip(batch.column("strip").to_pylist(), batch.column("data")):
                    part = data.values.to_numpy(zero_copy_only=False).reshape(-1, 6, p)
                    at = first + k * max(1, STRIP // width)
                    for i, (n, sa, sb, qa, qb, c) in enumerate(part, at):
                        va, vb = qa * n - sa * sa, qb * n - sb * sb
                        varies = (va > FLAT * qa * n) & (vb > FLAT * qb * n)
                        with np.errstate(all="ignore"):
                            r = np.where(varies, (c * n - sa * sb) / np.sqrt(va * vb), np.nan)[i + 1 :]
                        r = np.clip(r, -1.0, 1.0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), i, np.int32)), pa.array(np.arange(i + 1, p, dtype=np.int32)), pa.array(r, mask=~np.isfinite(r))], ["i", "j", "r"])

        strips.append(summed(rows, products, some, 6 * p).mapInArrow(told, "i int, j int, r double"))
    pairs = reduce(DataFrame.unionByName, strips)
    a, b = names.select("i", F.col("name").alias("a")), names.select(F.col("i").alias("j"), F.col("name").alias("b"))
    # a row a column
    return pairs.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("a", "b", "r")


#: Sums of products that a task holds, and the share of its squares under which a variance is rounding.
STRIP_ENTRIES, FLAT = 1 << 23, 1e-12


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are there; null if either doesn't vary."""
    r = F.corr(x, y)
    return F.when(~F.isnan(r), r)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) of all ordered pairs, three places."""
    columns = numeric_columns(df) if columns is None else columns
    half = correlations(df, columns)
    same = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in columns])))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(same).select("a", "b", F.round("r", 3).alias("r"))


def strong_pairs(df: DataFrame, least: float = 0.85) -> DataFrame:
    return correlations(df).where(F.abs("r") >= least).select("a", "b", F.round("r", 3).alias("r"))


def size_bucket(n: Column) -> Column:
    return F.when(n < 500, "small").when(n < 10_000, "medium").when(n < 500_000, "large").otherwise("xlarge")


def signature(df: DataFrame, target: str | None = None) -> str:
    return "|".join(sorted(c.lower() for c in df.columns if c != target))


def context(df: DataFrame, target: str, task: str) -> DataFrame:
    """One row on a dataset: task, features, tokens of their names, size bucket, missing values, datetimes, imbalance."""
    features = [c for c in df.columns if c != target]
    names = F.array(*[F.lit(c) for c in features])
    tokens = F.array_distinct(F.flatten(F.transform(names, lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 2))))
    share = df.groupBy(quoted(target).alias("y")).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("top"))
    stats = df.agg(F.count("*").alias("n_rows"), F.max(F.greatest(*[quoted(c).isNull().cast("int") for c in df.columns], F.lit(0)) == 1).alias("has_missing"))
    return stats.crossJoin(share).select(F.lit(task).alias("task"), F.lit(target).alias("target"), names.alias("features"), tokens.alias("name_tokens"), "n_rows", size_bucket(F.col("n_rows")).alias("row_bucket"), "has_missing", F.lit(bool(datetime_columns(df))).alias("has_datetime"), (F.lit(task == "classification") & (F.col("top") > 0.7)).alias("imbalanced"), F.lit(signature(df, target)).alias("signature"))


@dataclass
class Profile:
    shape: DataFrame
    duplicates: DataFrame
    missing: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    constant: DataFrame
    high_cardinality: DataFrame
    correlations: DataFrame


def profile(df: DataFrame, accuracy: int | None = None) -> Profile:
    return Profile(shape(df), duplicate_rows(df), missing(df), numeric_summary(df, accuracy=accuracy), categorical_top(df), constant_columns(df), high_cardinality(df), correlation_matrix(df))
