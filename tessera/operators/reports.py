"""Reports on a table and its target: exploration, leakage, quality, drift."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import adjusted_skew, categorical_columns, datetime_columns, long_numbers, long_strings, number, numeric_columns, quoted
from ..functions.ranks import quantiles, running_sums
from .profile import correlations, distinct_counts, distinct_sketches, duplicate_rows, missing, numeric_summary, pearson
from .text import tokens


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(value, n, share, n_classes, majority_share, imbalanced): null is a value, but no class."""
    counts = df.groupBy(quoted(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("__sum"), (F.max("n") / F.sum("n")).alias("__top"), F.count("value").alias("n_classes"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("value", "n", F.round(F.col("n") / F.col("__sum"), 4).alias("share"), "n_classes", F.round("__top", 4).alias("majority_share"), (F.col("__top") > 0.7).alias("imbalanced"))


#: Classes of a target at most.
MAX_CLASSES = 100_000


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """(value, code): classes in order, from 0."""
    classes = df.select(quoted(target).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    if classes.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} values: no target of classes")
    return classes.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("double").alias("code"))


def with_code(df: DataFrame, target: str, name: str = "__code") -> DataFrame:
    """df with the class's code in order; null is -1."""
    codes = class_codes(df, target).select(F.col("value").alias("__v"), F.col("code").alias(name))
    # MAX_CLASSES at most; by a shuffle all rows of a class would meet in one task
    return df.join(F.broadcast(codes), quoted(target).cast("string") == F.col("__v"), "left").drop("__v").withColumn(name, F.coalesce(name, F.lit(-1.0)))


def encoded(df: DataFrame, column: str, classes: DataFrame, name: str) -> DataFrame:
    """df with the value's code in classes (value, code), as class_codes gives them for another table; a value unseen there, or null, is -1."""
    codes = classes.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    met = df.join(F.broadcast(codes), quoted(column).cast("string") == F.col("__v"), "left")  # MAX_CLASSES at most
    return met.withColumn(name, F.coalesce("__code", F.lit(-1.0))).drop("__v", "__code")


def decoded(code: Column, classes: list[str]) -> Column:
    """The class of a code; null for -1 and codes beyond."""
    return F.when((code >= 0) & (code < len(classes)), F.get(F.array(*[F.lit(c) for c in classes]), code.cast("int")))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; a column with one value gets half a unit to either side."""
    v = number(column)
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).select(F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    grid = ends.where("a IS NOT NULL").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = F.least(F.floor((v - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row of ends
    width = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def means_by_class(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, class, mean), four places."""
    return long_numbers(df, columns, [quoted(target).cast("string").alias("class")]).where("class IS NOT NULL").groupBy("column", "class").agg(F.round(F.avg("value"), 4).alias("mean"))


def target_correlations(df: DataFrame, target: str, columns: list[str], task: str, k: int = 15) -> DataFrame:
    """(column, r, rank): the k columns of most correlation with the target (its classes' codes)."""
    coded = with_code(df, target) if task == "classification" else df.withColumn("__code", number(target))
    rows = long_numbers(coded, columns, [F.col("__code").alias("y")])
    r = rows.groupBy("column").agg(pearson(F.col("value"), F.col("y")).alias("r")).where("r IS NOT NULL")
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "column"))
    return r.withColumn("rank", rank).where(F.col("rank") <= k).select("column", F.round("r", 4).alias("r"), "rank")


def target_rates(df: DataFrame, column: str, target: str) -> DataFrame:
    """(value, class, rate): each value's shares of the classes; null is the text nan."""
    counts = df.where(quoted(target).isNotNull()).groupBy(F.coalesce(quoted(column).cast("string"), F.lit("nan")).alias("value"), quoted(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    return counts.select("value", "class", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("value")), 4).alias("rate"))


def mean_target(df: DataFrame, column: str, target: str, k: int = 10) -> DataFrame:
    """(value, mean): of the first k values in order."""
    return df.groupBy(F.coalesce(quoted(column).cast("string"), F.lit("nan")).alias("value")).agg(F.round(F.avg(number(target)), 4).alias("mean")).orderBy("value").limit(k)


def positive_rate(rates: DataFrame) -> DataFrame:
    """(value, rate): in percent, of class yes, else 1, else the largest."""
    by = rates.groupBy("value").agg(F.max(F.when(F.col("class") == "yes", F.col("rate"))).alias("y"), F.max(F.when(F.col("class") == "1", F.col("rate"))).alias("one"), F.max("rate").alias("most"))
    return by.select("value", F.round(100 * F.coalesce("y", "one", "most"), 2).alias("rate"))


def scatter(df: DataFrame, x: str, y: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(x, y): the rows that have both numbers, or about that share of them."""
    rows = df.select(number(x).alias("x"), number(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows if share >= 1.0 else rows.sample(share, seed)


# --- leakage

#: Names of identifying columns and of columns that tell of the future (fixed values).
ID_NAME = re.compile(r"(^id$|_id$|^id_|customer.?id|user.?id|account.?id|record.?id)", re.I)
FUTURE_NAME = re.compile(r"(cancel|termination|end.?date|closed.?date|outcome|result|approved.?date|decision.?date)", re.I)
ISSUE = "column string, kind string, severity string, action string, detail double"


def id_columns(df: DataFrame, target: str | None = None, unique: float = 0.95, only_keys: bool = False, names: str | None = None) -> DataFrame:
    """Issues: columns named like ids (or as the pattern names says), or with nearly as many values as rows (only_keys: among integers and texts)."""
    more = re.compile(names, re.I) if names else ID_NAME
    columns = [c for c in df.columns if c != target]
    floats = {c for c, t in df.dtypes if t in ("float", "double") or t.startswith("decimal")}
    n = df.agg(F.count("*").alias("n_rows"))
    rows, sketched = n.first()[0], distinct_sketches(df, columns) if columns else {}
    # the others have too few values by far
    looked_at = [c for c in columns if ID_NAME.search(c) or more.search(c) or sketched[c][1] >= unique * rows]
    share = distinct_counts(df, looked_at).crossJoin(n).withColumn("share", F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).otherwise(0.0))  # one row
    named = F.col("column").isin([c for c in columns if ID_NAME.search(c) or more.search(c)] or [""])
    keys = ~F.col("column").isin([c for c in columns if c in floats] or [""]) if only_keys else F.lit(True)
    return share.where(named | ((F.col("share") >= unique) & keys)).select("column", F.lit("id").alias("kind"), F.lit("high").alias("severity"), F.lit("drop").alias("action"), F.round("share", 4).alias("detail"))


def target_leaks(df: DataFrame, target: str, task: str, least: float = 0.98) -> DataFrame:
    """Issues: numeric columns that are all but the target (for classes: of their codes, with nulls as medians)."""
    columns = [c for c in numeric_columns(df) if c != target]
    if task == "regression":
        rows = long_numbers(df, columns, [number(target).alias("y")])
    else:
        fill = {r["column"]: r["q"][0] for r in quantiles(long_numbers(df, columns), [0.5]).collect()}
        filled = with_code(df, target).select("__code", *[F.coalesce(number(c), F.lit(fill.get(c))).alias(c) for c in columns])
        rows = long_numbers(filled, columns, [F.col("__code").alias("y")])
    r = rows.groupBy("column").agg(pearson(F.col("value"), F.col("y")).alias("r"))
    return r.where(F.abs("r") >= least).select("column", F.lit("target_correlation").alias("kind"), F.lit("critical").alias("severity"), F.lit("drop").alias("action"), F.round("r", 4).alias("detail"))


def target_copies(df: DataFrame, target: str) -> DataFrame:
    """Issues: columns that equal the target in every row, as text, or are named as its copy."""
    columns = [c for c in df.columns if c != target]
    plain = lambda c: c.lower().replace("_", "")
    named = [c for c in columns if plain(c) == plain(target) + "copy"]
    same = df.agg(*[F.min(quoted(c).cast("string").eqNullSafe(quoted(target).cast("string"))).alias(f"e{i}") for i, c in enumerate(columns)])
    rows = same.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"e{i}"), F.lit(False)).alias("same")) for i, c in enumerate(columns)])))
    return rows.where(F.col("same") | F.col("column").isin(named or [""])).select("column", F.lit("target_copy").alias("kind"), F.lit("critical").alias("severity"), F.lit("drop").alias("action"), F.lit(1.0).alias("detail"))


def duplicate_features(df: DataFrame, target: str | None = None, least: float = 0.999) -> DataFrame:
    """Issues: the second of each pair of numeric columns that tell the same."""
    pairs = correlations(df, [c for c in numeric_columns(df) if c != target]).where(F.abs("r") >= least)
    return pairs.select(F.col("b").alias("column"), F.concat(F.lit("duplicate_of:"), "a").alias("kind"), F.lit("medium").alias("severity"), F.lit("review").alias("action"), F.round("r", 4).alias("detail"))


def future_columns(df: DataFrame, target: str | None = None, names: str | None = None) -> DataFrame:
    """Issues: columns whose name tells of the future (or is as the pattern names says), and dates."""
    more = re.compile(names, re.I) if names else FUTURE_NAME
    rows = [(c, "future_name", "high", "drop", None) for c in df.columns if c != target and (FUTURE_NAME.search(c) or more.search(c))] + [(c, "date", "medium", "review", None) for c in datetime_columns(df) if c != target]
    return df.sparkSession.createDataFrame(rows, ISSUE)


def leakage(df: DataFrame, target: str, task: str) -> DataFrame:
    """All issues."""
    parts = [id_columns(df, target), target_leaks(df, target, task), target_copies(df, target), duplicate_features(df, target), future_columns(df, target)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leakage_summary(issues: DataFrame) -> DataFrame:
    """(drop, detected, n_issues): the columns to drop, in order, and whether any issue is critical or high."""
    return issues.agg(F.array_sort(F.collect_set(F.when(F.col("action") == "drop", F.col("column")))).alias("drop"), F.coalesce(F.max(F.col("severity").isin("critical", "high")), F.lit(False)).alias("detected"), F.count("*").alias("n_issues"))


# --- quality


def grade(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Moderate").when(score >= 40, "Fair").otherwise("Poor")


def quality(df: DataFrame, target: str, task: str, compat: bool = False) -> DataFrame:
    """One row of part scores, their weighted sum and its grade. compat: imbalance as the older formula has it."""
    gone = missing(df).agg(F.avg("missing_share").alias("gone"))
    n = df.agg(F.count("*").alias("n_rows"))
    skew = numeric_summary(df, [c for c in numeric_columns(df) if c != target]).agg(F.coalesce(F.avg(F.abs("skew")), F.lit(0.0)).alias("skew"))
    leaks = leakage_summary(leakage(df, target, task)).select("detected", "n_issues")
    top = df.where(quoted(target).isNotNull()).groupBy(quoted(target).alias("y")).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("top"))
    facts = gone.crossJoin(n).crossJoin(duplicate_rows(df)).crossJoin(skew).crossJoin(leaks).crossJoin(top)  # one row each
    low = lambda c, at: F.greatest(c, F.lit(at))
    balance = F.when(F.lit(task == "classification") & (F.col("top") > 0.7), low(F.least(F.lit(100.0), 200 * (F.col("top") if compat else 1 - F.col("top"))), 30.0)).otherwise(95.0)
    parts = facts.select(
        low(100 - 200 * F.col("gone"), 0.0).alias("missing_score"),
        low(100 - 500 * F.col("duplicate_rows") / F.greatest("n_rows", F.lit(1)), 0.0).alias("duplicate_score"),
        low(100 - 12 * F.least("skew", F.lit(5.0)), 0.0).alias("outlier_score"),
        F.when(F.col("detected"), low(100 - 15.0 * F.col("n_issues"), 20.0)).otherwise(100.0).alias("leakage_score"),
        balance.alias("balance_score"), F.least(F.lit(100.0), 40 + F.col("n_rows") / 50).alias("size_score"),
    )
    score = F.col("missing_score") * 0.2 + F.col("duplicate_score") * 0.1 + F.col("outlier_score") * 0.15 + F.col("leakage_score") * 0.25 + F.col("balance_score") * 0.15 + F.col("size_score") * 0.15
    return parts.select(*[F.round(c, 4).alias(c) for c in parts.columns], F.round(score, 2).alias("score"), grade(score).alias("grade"))


def quality_suggestions(scores: DataFrame) -> DataFrame:
    tips = [("missing_score", 80, "Impute or drop columns with missing values"), ("duplicate_score", 90, "Remove duplicate rows"), ("outlier_score", 70, "Cap outliers or transform skewed columns"), ("leakage_score", 90, "Review leaking columns"), ("balance_score", 60, "Rebalance classes or weight them"), ("size_score", 60, "Collect more rows")]
    return scores.select(F.filter(F.array(*[F.when(F.col(c) < at, F.lit(t)) for c, at, t in tips]), lambda t: t.isNotNull()).alias("suggestions"))


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share, imbalanced)"""
    counts = df.groupBy(quoted(label).alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("__sum"), (F.max("n") / F.sum("n") > 0.7).alias("imbalanced"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("label", "n", F.round(F.col("n") / F.col("__sum"), 4).alias("share"), "imbalanced")


def label_quality(df: DataFrame, label: str) -> DataFrame:
    """Scores of a labelled collection for size, balance and coverage."""
    counts = df.groupBy(quoted(label).alias("y")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.max("n") / F.sum("n")).alias("top"))
    parts = counts.select(F.least(F.lit(100.0), 30 + 2.0 * F.col("n")).alias("size_score"), F.greatest(F.lit(30.0), 100 - 80 * F.col("top")).alias("balance_score"), F.least(F.lit(100.0), 25.0 * F.col("k")).alias("coverage_score"))
    score = (F.col("size_score") + F.col("balance_score") + F.col("coverage_score")) / 3
    return parts.select("size_score", F.round("balance_score", 4).alias("balance_score"), "coverage_score", F.round(score, 4).alias("score"), F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F").alias("grade"))


# --- drift


def _sides(reference: DataFrame, current: DataFrame, columns: list[str], long) -> DataFrame:
    return long(reference, columns).withColumn("side", F.lit(0)).unionByName(long(current, columns).withColumn("side", F.lit(1))).where(F.col("value").isNotNull())


def _quartile_cells(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_edges, bin, p, q): shares of both sides in the reference's quartile bins; what is outside is left out."""
    edges = quantiles(long_numbers(reference, columns), [i / 4 for i in range(5)]).select("column", F.array_distinct("q").alias("edges"))
    rows = _sides(reference, current, columns, long_numbers).join(F.broadcast(edges), "column")  # one row a column
    n = F.size("edges")
    below = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    inside = rows.where((F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1)))
    counts = inside.groupBy("column", n.alias("n_edges"), F.least(below, n - 1).alias("bin")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    of = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("column")), F.lit(0)), F.lit(0.0))
    return counts.select("column", "n_edges", "bin", of("a").alias("p"), of("b").alias("q"))


def numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): half the summed differences of shares in the reference's quartile bins."""
    cells = _quartile_cells(reference, current, columns)
    return cells.groupBy("column").agg(F.when(F.max("n_edges") < 2, 0.0).otherwise(F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("score"))


def categorical_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): total variation over all categories of either side."""
    counts = _sides(reference, current, columns, long_strings).groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sums = counts.groupBy("column").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    of = lambda c, s: F.coalesce(F.col(c) / F.nullif(F.col(s), F.lit(0)), F.lit(0.0))
    return counts.join(sums, "column").groupBy("column").agg((F.sum(F.abs(of("a", "sa") - of("b", "sb"))) / 2).alias("score"))


def vocabulary_drift(reference: DataFrame, current: DataFrame, text: str) -> DataFrame:
    """(column, score): total variation of the shares of words of two collections of texts."""
    words = lambda df: df.select(F.explode(tokens(quoted(text))).alias(text))
    return categorical_drift(words(reference), words(current), [text])


def feature_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, kind, score, level) of the columns that both have."""
    both = [c for c in reference.columns if c in set(current.columns)]
    numbers = [c for c in numeric_columns(reference) if c in both]
    texts = [c for c in categorical_columns(reference) if c in both]
    parts = numeric_drift(reference, current, numbers).withColumn("kind", F.lit("numeric")).unionByName(categorical_drift(reference, current, texts).withColumn("kind", F.lit("categorical")))
    level = F.when(F.col("score").isNull(), "unknown").when(F.col("score") >= 0.25, "high").when(F.col("score") >= 0.1, "low").otherwise("none")
    return parts.select("column", "kind", F.round("score", 4).alias("score"), level.alias("level"))


def drift_summary(features: DataFrame, share: float = 0.5) -> DataFrame:
    """(n_columns, n_drifted, drift_share, drift, retrain)"""
    drifted = F.col("score") >= 0.1
    one = features.agg(F.count("*").alias("n_columns"), F.count_if(drifted).alias("n_drifted"), F.round(F.coalesce(F.avg(drifted.cast("double")), F.lit(0.0)), 4).alias("drift_share"))
    return one.withColumn("drift", F.col("drift_share") >= share).withColumn("retrain", F.col("drift_share") >= share)


def psi(reference: DataFrame, current: DataFrame, columns: list[str], floor: float = 1e-4) -> DataFrame:
    """(column, psi): population stability index over the reference's quartile bins, shares floored."""
    cells = _quartile_cells(reference, current, columns)
    p, q = F.greatest("p", F.lit(floor)), F.greatest("q", F.lit(floor))
    return cells.groupBy("column").agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks): largest difference of the two distribution functions."""
    counts = _sides(reference, current, columns, long_numbers).groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    upto = running_sums(counts, "column", "value", ["a", "b"])
    sums = counts.groupBy(F.col("column").alias("c")).agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    gap = F.abs(F.col("upto_a") / F.col("all_a") - F.col("upto_b") / F.col("all_b"))
    return upto.join(sums, F.col("column") == F.col("c")).groupBy("column").agg(F.max(gap).alias("ks"))
