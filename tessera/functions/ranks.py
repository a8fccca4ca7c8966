"""Exact quantiles, running sums and ranks that no single task has to order a whole column for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Approximate quantiles by which values are dealt into ranges, and the sketch's accuracy.
GRID, ACCURACY = 1024, 10_240
#: Leading bits of a hash by which rows are dealt into ranges.
HASH_BITS = 12


def quantiles(rows: DataFrame, probabilities: list[float]) -> DataFrame:
    """(column, value) -> (column, q): the exact quantiles (interpolated) of each column that has a value, in the order asked for.

    A sketch brackets each quantile within about a thousandth of the rows; a second pass counts what lies below the
    brackets and orders the distinct values inside them only.
    """
    rows = rows.select("column", "value").where("value IS NOT NULL")
    at = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketch = rows.groupBy("column").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", at, ACCURACY).alias("grid"))
    asked = sketch.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("i", "p"))
    slack = 3.0 / ACCURACY + 2.0 / F.col("n")
    low, high = F.floor((F.col("p") - slack) * GRID).cast("int"), F.ceil((F.col("p") + slack) * GRID).cast("int")
    bracket = asked.select(
        F.col("column").alias("__column"), "i", (F.col("p") * (F.col("n") - 1)).alias("place"),
        F.when(low <= 0, F.col("least")).otherwise(F.get("grid", low)).alias("low"), F.when(high >= GRID, F.col("most")).otherwise(F.get("grid", high)).alias("high"),
    )
    # the brackets are a row for each column and quantile asked for
    inside = rows.join(F.broadcast(bracket), (F.col("column") == F.col("__column")) & (F.col("value") <= F.col("high")))
    counts = inside.groupBy("column", "i", "place", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column", "i").orderBy(F.asc_nulls_first("value")))
    first = lambda k: F.min(F.when(F.col("upto") > k, F.col("value")))
    # what lies below the bracket must end before the quantile's place, and what lies in it must reach it
    below = F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("upto"))), F.lit(0))
    ends = counts.withColumn("upto", upto).groupBy("column", "i", "place").agg(first(F.floor("place")).alias("a"), first(F.ceil("place")).alias("b"), below.alias("below"))
    held = (F.col("below") <= F.floor("place")) & F.col("b").isNotNull()
    ends = ends.withColumn("a", F.when(held, F.col("a")).otherwise(F.raise_error(F.lit("a quantile isn't in the bracket that its sketch gave")).cast("double")))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b"))
    pairs = F.array_sort(F.collect_list(F.struct("i", q.alias("q"))))
    return ends.groupBy("column").agg(F.transform(pairs, lambda x: x["q"]).alias("q"))


def running_sums(levels: DataFrame, by: str, order: str, sums: list[str], ranges: int = 32) -> DataFrame:
    """levels with upto_<c> for each of sums: the sum of c over the rows of the same by up to this one, in order, whose values are distinct there.

    Rows are dealt into ranges of order by approximate quantiles; each range is summed by itself and gets the totals of those before it.
    """
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = levels.groupBy(F.col(by).alias("__by")).agg(F.percentile_approx(order, at, 10 * ranges).alias("__edges"))
    dealt = levels.join(edges, F.col(by) == F.col("__by")).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col(order)))).drop("__edges", "__by")
    totals = dealt.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__r")).agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy("__by").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__t_{c}": F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)) for c in sums})
    within = Window.partitionBy(by, "__range").orderBy(order)
    joined = dealt.join(totals, (F.col(by) == F.col("__by")) & (F.col("__range") == F.col("__r")))
    return joined.withColumns({f"upto_{c}": F.sum(c).over(within) + F.col(f"__t_{c}") for c in sums}).drop("__range", "__by", "__r", *[f"__t_{c}" for c in sums])


def hash_ranks(df: DataFrame, by: Column, key: Column, seed: int) -> DataFrame:
    """df with __rank and __n: the place of each row among those of the same by, in a seeded order of key, and their number.

    Rows are dealt by the first bits of the hash that orders them, so that a class is ordered by many tasks.
    """
    keyed = df.withColumns({"__by": by, "__hash": F.xxhash64(key, F.lit(seed))}).withColumn("__part", F.shiftright("__hash", 64 - HASH_BITS))
    counts = keyed.groupBy(F.col("__by").alias("__b"), F.col("__part").alias("__p")).agg(F.count("*").alias("__m"))
    whole = Window.partitionBy("__b")
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__m").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__m").over(whole)})
    joined = keyed.join(counts, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__part") == F.col("__p")))
    within = F.row_number().over(Window.partitionBy("__by", "__part").orderBy("__hash", key))
    return joined.withColumn("__rank", within + F.col("__before")).drop("__by", "__hash", "__part", "__b", "__p", "__m", "__before")
