"""Column expressions and small helpers that the operators are built of."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in a fresh local one where it is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many `_` appended as it takes to differ from all of taken, without regard to case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, DATES)]


def number(name: str) -> Column:
    """A numeric column as double, with NaN as null."""
    c = quoted(name).cast("double")
    return F.when(~F.isnan(c), c)


def adjusted_skew(value: Column) -> Column:
    """Bias-adjusted sample skewness (0 for fewer than three values or no spread), as an aggregate."""
    n = F.count(value)
    g1 = F.when(F.stddev_pop(value) > 0, F.skewness(value)).otherwise(0.0)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0)).otherwise(0.0)


def long_numbers(df: DataFrame, columns: list[str] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """(column, value): every value of the numeric columns, nulls included, as one explode in one pass."""
    columns = numeric_columns(df) if columns is None else columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns]) if columns else F.expr("cast(array() as array<struct<column:string,value:double>>)")
    return df.select(*(keep or []), F.inline(pairs))


def long_strings(df: DataFrame, columns: list[str] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """(column, value): every value of the categorical columns as text."""
    columns = categorical_columns(df) if columns is None else columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]) if columns else F.expr("cast(array() as array<struct<column:string,value:string>>)")
    return df.select(*(keep or []), F.inline(pairs))


def clean_text(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def finite(c: Column) -> Column:
    """Null, NaN and infinities as 0.0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def entropy(p: Column) -> Column:
    """Of an array of probabilities, in nats."""
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - x * F.log(x + 1e-12))
