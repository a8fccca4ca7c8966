"""Drift of a stream against a fixed reference: counts of a column's bins in event-time windows, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import number, quoted
from ..functions.ranks import quantiles


def reference_bins(reference: DataFrame, column: str, bins: int = 4) -> tuple[list[float], list[float]]:
    """The inner edges of a column's quantile bins in the reference, and the shares of its rows in them: a few numbers, whatever the table's size."""
    probs = [i / bins for i in range(1, bins)]
    found = quantiles(reference.select(F.lit(column).alias("column"), number(column).alias("value")), probs).first()
    edges = sorted(set(found["q"])) if found else []
    row = reference.agg(*_counts(column, edges)).first()
    return edges, [n / max(sum(row), 1) for n in row]


def _counts(column: str, edges: list[float]) -> list:
    """Columns that count the non-null values in each bin; a value on an edge is in the bin above it."""
    c, low, high = quoted(column), [None, *edges], [*edges, None]
    inside = lambda a, b: F.coalesce((F.lit(True) if a is None else c >= a) & (F.lit(True) if b is None else c < b) & c.isNotNull(), F.lit(False))
    return [F.count_if(inside(a, b)).alias(f"bin{i}") for i, (a, b) in enumerate(zip(low, high))]


def windowed_psi(events: DataFrame, ts: str, column: str, edges: list[float], shares: list[float], window: str = "1 day", late: str = "1 day", floor: float = 1e-4) -> DataFrame:
    """(start, n, psi, level) of each window: the population stability index of the column's bins against the reference's shares.

    One stateful aggregation with a state row of a few counts for each open window; the same plan runs on a table. Windows without a value
    have a null index and the level "unknown".
    """
    held = events.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(*_counts(column, edges))
    n = sum((F.col(f"bin{i}") for i in range(len(shares))), F.lit(0))
    psi = F.lit(0.0)
    for i, q in enumerate(shares):
        p = F.greatest(F.col(f"bin{i}") / F.col("n"), F.lit(floor))
        psi = psi + (p - max(q, floor)) * F.log(p / max(q, floor))
    made = held.withColumn("n", n).withColumn("psi", F.when(F.col("n") > 0, psi))
    level = F.when(F.col("psi") >= 0.25, "high").when(F.col("psi") >= 0.1, "low").when(F.col("psi") < 0.1, "none").otherwise("unknown")
    return made.select(F.col("window.start").alias("start"), "n", "psi", level.alias("level"))
