"""Windows over series of any length: rows are dealt into ranges of time, each with the last rows before it.

A series of at most RANGE_ROWS rows is a window's partition. Where one is longer, all rows are sorted into ranges by series and time, so
that a long series spans several ranges; a range gets a copy of the last rows of its series from the ranges before (the
halo), and the number of rows of its series before it. Windows then go over (series, range). Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import free_name, quoted, shared_path

#: Rows of a series that one task takes, about.
RANGE_ROWS = 1_000_000


class Dealt:
    """rows: df with the columns part (range) and halo (whether a row is a copy from an earlier range); counts: (by.., part, before, total)."""

    def __init__(self, rows: DataFrame, counts: DataFrame, part: str, halo: str, by: list[str]):
        self.rows, self.counts, self.part, self.halo, self.by = rows, counts, part, halo, by


def longest_series(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*[quoted(c) for c in by]).count().agg(F.max("count")).first()[0] or 0


def _same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def deal(df: DataFrame, by: list[str], order: list[str], history: int, range_rows: int = RANGE_ROWS) -> Dealt:
    """Ranges of about range_rows rows; each has the last `history` rows of its series before it."""
    part, halo, place = (free_name(c, df.columns) for c in ("__part", "__halo", "__place"))
    path = shared_path(df.sparkSession, "series")
    n = max(1, -(-df.count() // range_rows))
    df.repartitionByRange(n, *[quoted(c) for c in (*by, *order)]).withColumn(part, F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    keys = [quoted(c) for c in by]
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    of_series = Window.partitionBy(*keys)
    ranges = of_series.orderBy(part)
    counts = counts.select(*keys, part, F.coalesce(F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(of_series).alias("__total"), F.row_number().over(ranges).alias("__index"), F.count("*").over(of_series).alias("__ranges"))
    # a series of several ranges ends or begins one: there are fewer rows of these than twice the ranges
    split = counts.where("__ranges > 1").select(*[quoted(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(part).alias("__p"), "__index", "__ranges")
    theirs = rows.join(F.broadcast(split), _same(keys, [F.col(f"__b{i}") for i in range(len(by))]) & (F.col(part) == F.col("__p")))
    last = theirs.withColumn(place, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*[quoted(c).desc() for c in order]))).where(F.col(place) <= history)
    # a range has a row at least, so that the history is within so many ranges
    ahead = last.withColumn("__to", F.explode(F.sequence(F.col("__index") + 1, F.least(F.col("__index") + history, F.col("__ranges")))) if history else F.explode(F.array().cast("array<int>"))).where(F.col("__to") > F.col("__index"))
    near = ahead.withColumn(place, F.row_number().over(Window.partitionBy(*keys, "__to").orderBy(F.desc("__index"), *[quoted(c).desc() for c in order]))).where(F.col(place) <= history)
    to = split.select(*[F.col(f"__b{i}").alias(f"__c{i}") for i in range(len(by))], F.col("__p").alias("__target"), F.col("__index").alias("__at"))
    copies = near.join(F.broadcast(to), _same(keys, [F.col(f"__c{i}") for i in range(len(by))]) & (F.col("__to") == F.col("__at")))
    copies = copies.select(*[quoted(c) for c in df.columns], F.col("__target").alias(part), F.lit(True).alias(halo))
    return Dealt(rows.withColumn(halo, F.lit(False)).unionByName(copies), counts, part, halo, by)


def over_series(df: DataFrame, by: list[str], order: list[str], history: int, columns, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with columns(window): a dict of window expressions over a series in order that look at most `history` rows back."""
    if longest_series(df, by) <= range_rows:
        return df.withColumns(columns(Window.partitionBy(*[quoted(c) for c in by]).orderBy(*[quoted(c) for c in order])))
    dealt = deal(df, by, order, history, range_rows)
    window = Window.partitionBy(*[quoted(c) for c in by], dealt.part).orderBy(*[quoted(c) for c in order])
    return dealt.rows.withColumns(columns(window)).where(~F.col(dealt.halo)).drop(dealt.part, dealt.halo)


def numbered(df: DataFrame, by: list[str], order: list[str], number: str, total: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the place of each row in its series (from 1) and the series' rows."""
    if longest_series(df, by) <= range_rows:
        whole = Window.partitionBy(*[quoted(c) for c in by])
        return df.withColumns({number: F.row_number().over(whole.orderBy(*[quoted(c) for c in order])), total: F.count("*").over(whole)})
    dealt = deal(df, by, order, 0, range_rows)
    counts = dealt.counts.select(*[quoted(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(dealt.part).alias("__p"), "__before", F.col("__total").alias(total))
    window = Window.partitionBy(*[quoted(c) for c in by], dealt.part).orderBy(*[quoted(c) for c in order])
    placed = dealt.rows.drop(dealt.halo).withColumn("__r", F.row_number().over(window))
    met = placed.join(counts, _same([quoted(c) for c in by], [F.col(f"__b{i}") for i in range(len(by))]) & (F.col(dealt.part) == F.col("__p")))
    return met.withColumn(number, (F.col("__r") + F.col("__before")).cast("int")).drop("__r", "__before", "__p", dealt.part, *[f"__b{i}" for i in range(len(by))])
