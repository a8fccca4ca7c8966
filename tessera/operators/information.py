"""Mutual information of numeric columns with a target, in nats, by nearest neighbours.

Classes (Ross 2014): psi(N) + mean psi(k) - mean psi(rows of the class) - mean psi(m), where m counts the values, of any class, that are
nearer than the k-th nearest of the same class (or equal, where that is at distance zero), the value itself among them. A number as target
(Kraskov, Stoegbauer, Grassberger 2004): psi(N) + psi(k) - mean psi(n_x) - mean psi(n_y), where n_x and n_y count the values nearer
than the k-th neighbour in the plane of both, in the larger of the two distances, each scaled by its deviation.

Columns are taken apart into their distinct values with counts, so that a value of a third of the rows is one row. Neighbours
within a class are found by windows over ranges with halos in both directions, and how many values lie up to a place by sums of
ranges: no task orders a whole column. Tables of values are small as files and large in memory, so that joins of two of them are
told to sort and not to broadcast. No noise is added to break ties.

Defined cases: rows without a value or target don't count; a class of one row doesn't count; a column or target without variance, or with
fewer than two rows left, has no information (0); what comes out below zero is zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import long_numbers, number, quoted, shared_path
from ..functions.ranks import running_sums
from .neighbours import Index
from .series import RANGE_ROWS, over_series

NEIGHBOURS = 3
#: What counts as equally near, as a part of a distance, and the rounding of a sum.
ROUNDING, EPS = 1e-12, 2.220446049250313e-16


def psi(x: Column) -> Column:
    """The digamma function of positive numbers: its asymptotic series six further on."""
    z = x + 6.0
    tail = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return tail - reduce(lambda a, b: a + b, [1 / (x + float(i)) for i in range(6)])


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def within(levels: DataFrame, asked: DataFrame, ranges: int = 32) -> DataFrame:
    """levels (column, value, n), asked (column, value, r) -> (column, value, r, inside): the sum of n over the values nearer than r (equal ones, where r is zero); what is as near as r within rounding isn't nearer.

    What is asked for is distinct; the places that begin and end it are put among the values, and sums up to each place are subtracted.
    """
    less = F.greatest(F.col("r") * (1 - ROUNDING) - 4 * EPS * (F.abs("value") + F.col("r")), F.lit(0.0))
    ends = asked.select("column", "value", "r", F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("value") + less).alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("value") - less).alias("at")))).alias("e")).select("column", "value", "r", "e.*")
    places = levels.select("column", F.col("value").alias("at"), "n").unionByName(ends.select("column", "at", F.lit(0).cast("long").alias("n"))).groupBy("column", "at").agg(F.sum("n").alias("n"))
    sums = running_sums(places, "column", "at", ["n"], ranges).select(F.col("column").alias("__c"), F.col("at").alias("__at"), F.col("n").alias("__n"), "upto_n")
    met = ends.join(sums.hint("merge"), (F.col("column") == F.col("__c")) & (F.col("at") == F.col("__at")))
    upto = F.when(F.col("sign") == 1, F.col("upto_n")).otherwise(F.col("__n") - F.col("upto_n"))
    return met.groupBy("column", "value", "r").agg(F.sum(upto).alias("inside"))


def class_information(df: DataFrame, columns: list[str], target: str, k: int = NEIGHBOURS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(column, score)"""
    values = long_numbers(df, columns, [quoted(target).cast("string").alias("y")]).where(F.col("value").isNotNull() & F.col("y").isNotNull())
    levels = _kept(values.groupBy("column", "y", "value").agg(F.count("*").alias("n")), "information-levels")
    classes = levels.groupBy(F.col("column").alias("__c"), F.col("y").alias("__y")).agg(F.sum("n").alias("of")).where("of > 1")
    # a row for each column and class
    levels = _kept(levels.join(F.broadcast(classes), (F.col("column") == F.col("__c")) & (F.col("y") == F.col("__y"))).drop("__c", "__y").withColumn("down", -F.col("value")), "information-classes")
    near = lambda side: lambda w: {f"{side}{j}": F.struct(F.abs(F.lag("value", j).over(w) - F.col("value")).alias("d"), F.lag("n", j).over(w).alias("n")) for j in range(1, k + 1)}
    both = over_series(over_series(levels, ["column", "y"], ["value"], k, near("a"), range_rows), ["column", "y"], ["down"], k, near("b"), range_rows)
    others = F.array_sort(F.filter(F.array(*[F.col(f"{s}{j}") for s in "ab" for j in range(1, k + 1)]), lambda x: x["d"].isNotNull()))
    wanted = F.least(F.lit(k).cast("long"), F.col("of") - 1)
    # others of the value's own come first, at distance zero
    start = F.struct((F.col("n") - 1).alias("met"), F.when(F.col("n") - 1 >= F.col("k"), F.lit(0.0)).alias("r"))
    reached = F.aggregate("others", start, lambda acc, x: F.struct((acc["met"] + x["n"]).alias("met"), F.coalesce(acc["r"], F.when(acc["met"] + x["n"] >= F.col("k"), x["d"])).alias("r")))
    radius = _kept(both.withColumns({"others": others, "k": wanted}).select("column", "y", "value", "n", "of", "k", reached["r"].alias("r")), "information-radius")
    inside = within(radius.groupBy("column", "value").agg(F.sum("n").alias("n")), radius.select("column", "value", "r").distinct())
    met = radius.join(inside.select(F.col("column").alias("__c"), F.col("value").alias("__v"), F.col("r").alias("__r"), "inside").hint("merge"), (F.col("column") == F.col("__c")) & (F.col("value") == F.col("__v")) & (F.col("r") == F.col("__r")))
    mean = lambda c: F.sum(F.col("n") * psi(c.cast("double"))) / F.sum("n")
    score = psi(F.sum("n").cast("double")) + mean(F.col("k")) - mean(F.col("of")) - mean(F.col("inside"))
    found = met.groupBy("column").agg(F.greatest(score, F.lit(0.0)).alias("score"), F.max("n"))
    return _all(df, columns, found)


def number_information(df: DataFrame, columns: list[str], target: str, k: int = NEIGHBOURS) -> DataFrame:
    """(column, score); one column at a time, with a metric index over the plane of its values and the target's."""
    spark, found = df.sparkSession, []
    for c in columns:
        plane = df.select(number(c).alias("a"), number(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        a, b, n = plane.agg(F.stddev_pop("a"), F.stddev_pop("b"), F.count("*")).first()
        if n < 2 or not a or not b:
            continue
        rows = _kept(plane.select(F.monotonically_increasing_id().alias("id"), F.array(F.col("a") / a, F.col("b") / b).alias("v"), F.lit(0.0).alias("label")), "information-plane")
        index = Index.build(rows, 0, shared_path(spark, "information-index"))
        near = index.nearest(rows.select(F.col("id").alias("q"), "v"), min(k, n - 1), others=True)
        radius = near.groupBy("q").agg(F.max("d").alias("r"))
        sides = _kept(rows.join(radius.hint("merge"), F.col("id") == F.col("q")).select("r", F.inline(F.array(*[F.struct(F.lit(s).alias("column"), F.col("v")[i].alias("value")) for i, s in enumerate("ab")]))).groupBy("column", "value", "r").agg(F.count("*").alias("n")), "information-sides")
        inside = within(sides.groupBy("column", "value").agg(F.sum("n").alias("n")), sides.select("column", "value", "r"))
        met = sides.join(inside.select(F.col("column").alias("__c"), F.col("value").alias("__v"), F.col("r").alias("__r"), "inside").hint("merge"), (F.col("column") == F.col("__c")) & (F.col("value") == F.col("__v")) & (F.col("r") == F.col("__r")))
        both = met.groupBy("column").agg((F.sum(F.col("n") * psi(F.col("inside").cast("double"))) / F.sum("n")).alias("m"))
        score = both.agg(F.greatest(psi(F.lit(float(n))) + psi(F.lit(float(min(k, n - 1)))) - F.sum("m"), F.lit(0.0)).alias("score"))
        found.append(score.select(F.lit(c).alias("column"), "score"))
    none = spark.createDataFrame([], "column string, score double")
    return _all(df, columns, reduce(DataFrame.unionByName, found, none))


def _all(df: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("score", F.lit(0.0)).alias("score"))


def neighbour_information(df: DataFrame, columns: list[str], target: str, task: str, k: int = NEIGHBOURS) -> DataFrame:
    return class_information(df, columns, target, k) if task == "classification" else number_information(df, columns, target, k)
