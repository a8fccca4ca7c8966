"""Queries on profiles, cleaning, features, reports and drift of the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import number
from ..operators import clean, features, learn, profile, reports

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict = {}
ORACLES: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's numbers and flags with nulls in every tenth order's quantity and every seventh's flag."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_shipdate")


HOLES = "h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus, l_shipdate FROM lineitem)"


def long_sql(columns: list[str], source: str = "h", keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS column, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)


LONG = f"{HOLES}, v AS ({long_sql(NUM)})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r"\bcolumn\b", '"column"', sql)  # a reserved word there
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- profile


@query("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def _(spark, d):
    return profile.shape(read(spark, d, "lineitem"))


@query("profile_duplicates", "WITH x AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM x")
def _(spark, d):
    return profile.duplicate_rows(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("profile_missing", f"WITH {HOLES} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 4) AS missing_share FROM h" for c in ["l_orderkey", "l_linenumber", *NUM, "l_returnflag", "l_linestatus", "l_shipdate"]))
def _(spark, d):
    return profile.missing(holes(spark, d))


SKEW = "CASE WHEN count(value) > 2 AND stddev_pop(value) > 0 THEN skewness(value) ELSE 0 END"
SUMMARY = f"SELECT column, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max, round({SKEW}, 4) AS skew FROM v GROUP BY column"


@query("profile_numeric", f"WITH {LONG} {SUMMARY}")
def _(spark, d):
    return rounded(profile.numeric_summary(holes(spark, d), NUM), "mean", "std", "q25", "median", "q75", "skew")


CATEGORIES = " UNION ALL ".join(f"SELECT '{c}' AS column, p_{c[2:]} AS value FROM part" for c in ("p_brand", "p_type", "p_name"))


def top_sql(k: int) -> str:
    return f"WITH v AS ({CATEGORIES}), c AS (SELECT column, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL) SELECT column, count(*) OVER (PARTITION BY column) AS n_distinct, value, n, CAST(row_number() OVER (PARTITION BY column ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= {k}"


@query("profile_categorical_topk", top_sql(5))
def _(spark, d):
    return profile.categorical_top(read(spark, d, "part"), 5, ["p_brand", "p_type", "p_name"])


@query("eda_categorical", top_sql(10))
def _(spark, d):
    return profile.categorical_top(read(spark, d, "part"), 10, ["p_brand", "p_type", "p_name"])


@query("profile_constant", "SELECT 'one' AS column UNION ALL SELECT 'none'")
def _(spark, d):
    return profile.constant_columns(read(spark, d, "orders").select("o_orderkey", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"), "o_orderstatus"))


@query("profile_high_cardinality", "SELECT 'p_name' AS column, count(DISTINCT p_name) AS n_distinct FROM part")
def _(spark, d):
    return profile.high_cardinality(read(spark, d, "part"))


@query("profile_datetime_cols")
def _(spark, d):
    return profile.detected_datetimes(read(spark, d, "orders").withColumn("as_text", F.date_format("o_orderdate", "yyyy-MM-dd")))


def pairs_sql(names: list[str], where: str = "", places: int = 3, ordered: bool = False) -> str:
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0' if a == b else f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))'}, {places}) AS r FROM h" + (" LIMIT 1" if a == b else "") for i, a in enumerate(names) for j, b in enumerate(names) if (i < j or ordered)]
    return f"WITH {HOLES} SELECT * FROM (" + " UNION ALL ".join(f"({p})" for p in parts) + f") {where}"


@query("profile_corr_matrix", pairs_sql(NUM, ordered=True))
def _(spark, d):
    return profile.correlation_matrix(holes(spark, d), NUM)


STRONG = "WITH h AS (SELECT l_quantity, l_extendedprice, 2 * l_quantity + l_tax AS twice FROM lineitem) SELECT * FROM ({}) WHERE abs(r) >= {}"
STRONG_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM h" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "twice"), ("l_extendedprice", "twice")))


@query("profile_strong_pairs", STRONG.format(STRONG_PAIRS, 0.85))
def _(spark, d):
    return profile.strong_pairs(read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (2 * F.col("l_quantity") + F.col("l_tax")).alias("twice")))


@query("size_bucket", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CASE WHEN count(*) < 500 THEN 'small' WHEN count(*) < 10000 THEN 'medium' WHEN count(*) < 500000 THEN 'large' ELSE 'xlarge' END AS bucket FROM {t}" for t in ("nation", "part", "lineitem")))
def _(spark, d):
    parts = [read(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).withColumn("bucket", profile.size_bucket(F.col("n"))) for t in ("nation", "part", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dataset_context")
def _(spark, d):
    return profile.context(holes(spark, d), "l_returnflag", "classification")


# --- rows and cleaning


@query("drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(spark, d):
    return clean.drop_duplicates(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("drop_null_target", f"WITH {HOLES} SELECT l_orderkey, l_linenumber, l_returnflag FROM h WHERE l_returnflag IS NOT NULL")
def _(spark, d):
    return clean.drop_null(holes(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("align_columns", "SELECT o_totalprice, CAST(NULL AS VARCHAR) AS absent, o_orderkey FROM orders")
def _(spark, d):
    return clean.align(read(spark, d, "orders"), {"o_totalprice": "double", "absent": "string", "o_orderkey": "bigint"})


@query("coerce_numeric", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS DOUBLE) AS x FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", clean.to_number(F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))).alias("x"))


@query("coerce_timestamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE date_trunc('day', o_orderdate) END AS ts FROM orders")
def _(spark, d):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "dd/MM/yyyy")).when(k == 2, F.date_format(t, "yyyyMMdd")).otherwise("junk")
    return read(spark, d, "orders").select("o_orderkey", clean.to_timestamp(text, "dd/MM/yyyy", "yyyyMMdd").cast("timestamp_ntz").alias("ts"))


@query("clean_drop_sparse", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS n_columns FROM lineitem")
def _(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_orderkey") % 20 == 0, 1).alias("sparse"), F.lit(3).alias("same"))
    out = clean.Cleaner().fit(df).transform(df)
    return out.agg(F.count("*").alias("n"), F.lit(len(out.columns)).cast("long").alias("n_columns"))


@query("clean_impute_numeric", f"WITH {HOLES} SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM h)) AS l_quantity FROM h")
def _(spark, d):
    df = holes(spark, d).select("l_orderkey", "l_linenumber", "l_quantity")
    fill = clean.medians(df, ["l_quantity"]).first()["fill"]
    return df.na.fill({"l_quantity": fill})


MODE = "(SELECT l_returnflag FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("clean_impute_mode", f"WITH {HOLES} SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, {MODE}) AS l_returnflag FROM h")
def _(spark, d):
    df = holes(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag")
    return df.na.fill({"l_returnflag": clean.modes(df, ["l_returnflag"]).first()["fill"]})


@query("clean_replay", f"WITH {HOLES}, t AS (SELECT * FROM h WHERE l_orderkey % 2 = 0) SELECT h.l_orderkey AS \"key\", coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity, coalesce(l_returnflag, (SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM h WHERE l_orderkey % 2 = 1")
def _(spark, d):
    df = holes(spark, d).select(F.col("l_orderkey").alias("key"), "l_quantity", "l_returnflag")
    return clean.Cleaner(ignore=["key"]).fit(df.where("key % 2 = 0")).transform(df.where("key % 2 = 1"))


FENCES = f"WITH {LONG}, q AS (SELECT column, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM v GROUP BY column), f AS (SELECT column, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q) "


@query("outlier_fences", FENCES + "SELECT column, round(low, 4) AS low, round(high, 4) AS high FROM f")
def _(spark, d):
    return rounded(clean.fences(holes(spark, d), NUM), "low", "high")


@query("outlier_counts", FENCES + "SELECT column, CAST(count_if(value < low OR value > high) AS BIGINT) AS n_outliers FROM v JOIN f USING (column) GROUP BY column")
def _(spark, d):
    return clean.outlier_counts(holes(spark, d), NUM)


CAP = "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders), f AS (SELECT a - 0.2 * (b - a) AS low, b + 0.2 * (b - a) AS high FROM q) "


@query("outlier_cap", CAP + "SELECT o_orderkey, round(CASE WHEN o_totalprice < low THEN low WHEN o_totalprice > high THEN high ELSE o_totalprice END, 4) AS o_totalprice FROM orders, f")
def _(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(clean.OutlierCap(columns=["o_totalprice"], iqr_multiplier=0.2).fit(df).transform(df), "o_totalprice")


@query("outlier_remove", CAP + "SELECT o_orderkey, o_totalprice FROM orders, f WHERE o_totalprice BETWEEN low AND high")
def _(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return clean.OutlierCap(columns=["o_totalprice"], iqr_multiplier=0.2, action="remove").fit(df).transform(df)


@query("anomaly_score")
def _(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"))
    return clean.IsolationForest(columns=["o_totalprice", "day"], trees=50).fit(df).transform(df)


# --- features


@query("fe_datetime", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o__year, CAST(month(o_orderdate) AS INTEGER) AS o__month, CAST(day(o_orderdate) AS INTEGER) AS o__day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o__dayofweek, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o__is_weekend FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", *features.date_parts(F.col("o_orderdate"), "o"))


PRICES = "v AS (" + long_sql(["l_extendedprice", "square", "below"], "(SELECT l_extendedprice, l_extendedprice * l_extendedprice * l_quantity AS square, l_extendedprice - 1000000 AS below FROM lineitem)") + ")"


@query("fe_log_candidates", f"WITH {PRICES} SELECT column, round({SKEW}, 4) AS skew FROM v GROUP BY column HAVING min(value) >= 0 AND abs({SKEW}) > 1")
def _(spark, d):
    p = F.col("l_extendedprice")
    return rounded(features.log_candidates(read(spark, d, "lineitem").select(p, (p * p * F.col("l_quantity")).alias("square"), (p - 1000000).alias("below"))), "skew")


@query("fe_log1p", f"WITH {HOLES} SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(l_quantity, 0)), 6) AS x FROM h WHERE l_quantity IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM h WHERE l_quantity IS NULL")
def _(spark, d):
    return holes(spark, d).select("l_orderkey", "l_linenumber", F.round(features.log1p(F.col("l_quantity")), 6).alias("x"))


@query("fe_bin_edges", "WITH e AS (SELECT unnest(quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edge FROM orders) SELECT DISTINCT round(edge, 4) AS edge FROM e")
def _(spark, d):
    return features.bin_edges(read(spark, d, "orders"), ["o_totalprice"]).select(F.explode("edges").alias("edge")).select(F.round("edge", 4).alias("edge"))


@query("fe_binned", "WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM orders) SELECT o_orderkey, CAST(CASE WHEN o_totalprice <= q[2] THEN 0 WHEN o_totalprice <= q[3] THEN 1 WHEN o_totalprice <= q[4] THEN 2 WHEN o_totalprice <= q[5] THEN 3 ELSE 4 END AS INTEGER) AS bin FROM orders, e")
def _(spark, d):
    df = read(spark, d, "orders")
    edges = features.bin_edges(df, ["o_totalprice"]).first()["edges"]
    return df.select("o_orderkey", features.bin_code(number("o_totalprice"), edges).cast("int").alias("bin"))


@query("fe_interaction_rank", "WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS q, abs(corr(l_discount, l_extendedprice)) AS i, abs(corr(l_tax, l_extendedprice)) AS t FROM lineitem), p AS (SELECT 'l_quantity' AS a, 'l_discount' AS b, q AS score FROM c UNION ALL SELECT 'l_quantity', 'l_tax', q FROM c UNION ALL SELECT 'l_discount', 'l_tax', i FROM c) SELECT a, b, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, a DESC, b DESC) AS INTEGER) AS rank FROM p")
def _(spark, d):
    return rounded(features.interaction_ranks(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], number("l_extendedprice")), "score")


@query("fe_onehot", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS c_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def _(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    made = features.FeatureEngineer(labelCol="c_custkey").fit(df).transform(df)
    return made.select("c_custkey", *[(F.col(f"c_mktsegment__{s}") if f"c_mktsegment__{s}" in made.columns else F.lit(0.0)).alias(f"c_{s}") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])


@query("fe_freq_encode", "WITH f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS freq FROM part GROUP BY 1) SELECT p_partkey, round(freq, 6) AS freq FROM part JOIN f USING (p_brand)")
def _(spark, d):
    df = read(spark, d, "part").select("p_partkey", "p_brand")
    return features.FeatureEngineer(labelCol="p_partkey").fit(df).transform(df).select("p_partkey", F.round("p_brand__freq", 6).alias("freq"))


@query("fs_variance", "SELECT 'same' AS column")
def _(spark, d):
    return features.zero_variance(read(spark, d, "lineitem").select("l_tax", F.lit(2.0).alias("same"))).select("column")


@query("fs_anova_f", f"WITH v AS ({long_sql(NUM, 'lineitem', 'l_returnflag AS y, ')}), m AS (SELECT column, avg(value) AS m, count(*) AS n FROM v GROUP BY 1), g AS (SELECT column, y, count(*) AS n, avg(value) AS a, sum((value - m) * (value - m)) AS q, m FROM v JOIN m USING (column) GROUP BY column, y, m), t AS (SELECT column, sum(g.n) AS n, count(*) AS k, sum(q) AS q, sum(g.n * (a - m) * (a - m)) AS b FROM g GROUP BY 1) SELECT column, round((b / (k - 1)) / ((q - b) / (n - k)), 4) AS score FROM t")
def _(spark, d):
    return rounded(features.anova_f(read(spark, d, "lineitem"), NUM, "l_returnflag"), "score")


@query("fs_f_regression", "WITH h AS (SELECT * FROM lineitem), r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, corr({c}, l_extendedprice) AS r, count(*) AS n FROM h" for c in ("l_quantity", "l_discount", "l_tax")) + ") SELECT column, round(r * r * (n - 2) / (1 - r * r), 3) AS score FROM r")
def _(spark, d):
    return rounded(features.regression_f(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "score", places=3)


MI = f"WITH v AS ({long_sql(NUM, 'lineitem', 'l_returnflag AS y, ')}), e AS (SELECT column, min(value) AS a, max(value) AS b FROM v GROUP BY 1), c AS (SELECT column, least(floor((value - a) / (b - a) * 10), 9) AS bin, y, count(*) AS n FROM v JOIN e USING (column) GROUP BY 1, 2, 3), p AS (SELECT column, n, sum(n) OVER (PARTITION BY column) AS t, sum(n) OVER (PARTITION BY column, bin) AS nx, sum(n) OVER (PARTITION BY column, y) AS ny FROM c), s AS (SELECT column, greatest(sum(CAST(n AS DOUBLE) / t * ln(CAST(n AS DOUBLE) * t / (CAST(nx AS DOUBLE) * ny))), 0) AS score FROM p GROUP BY 1) "


@query("fs_mutual_info", MI + "SELECT column, round(score, 6) AS score FROM s")
def _(spark, d):
    return rounded(features.mutual_information(read(spark, d, "lineitem"), NUM, "l_returnflag"), "score", places=6)


@query("fs_report", MI + "SELECT column, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, column) AS INTEGER) AS rank, rank <= 2 AS kept FROM s")
def _(spark, d):
    return rounded(features.selection_report(features.mutual_information(read(spark, d, "lineitem"), NUM, "l_returnflag"), 4, 2), "score", places=6)


# --- exploration


@query("eda_class_balance", f"WITH {HOLES}, c AS (SELECT l_returnflag AS value, count(*) AS n FROM h GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 4) AS share, count(value) OVER () AS n_classes, round(max(n) OVER () / sum(n) OVER (), 4) AS majority_share, max(n) OVER () / sum(n) OVER () > 0.7 AS imbalanced FROM c")
def _(spark, d):
    return reports.class_balance(holes(spark, d), "l_returnflag")


@query("eda_target_regression", f"WITH v AS ({long_sql(['o_totalprice'], 'orders')}) {SUMMARY}")
def _(spark, d):
    return rounded(profile.numeric_summary(read(spark, d, "orders"), ["o_totalprice"]), "mean", "std", "q25", "median", "q75", "skew")


@query("eda_histogram", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)), c AS (SELECT CAST(least(floor((l_quantity - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT bin, round(a + bin * (b - a) / 20, 4) AS low, round(a + (bin + 1) * (b - a) / 20, 4) AS high, coalesce(n, 0) AS n FROM g CROSS JOIN e LEFT JOIN c USING (bin)")
def _(spark, d):
    return rounded(reports.histogram(read(spark, d, "lineitem"), "l_quantity", 20), "low", "high")


@query("eda_mean_by_class", "WITH " + f"v AS ({long_sql(NUM, 'lineitem', 'l_returnflag AS class, ')}) SELECT column, class, round(avg(value), 4) AS mean FROM v GROUP BY ALL")
def _(spark, d):
    return reports.means_by_class(read(spark, d, "lineitem"), "l_returnflag", NUM)


@query("eda_target_corr", "WITH k AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)), h AS (SELECT * FROM lineitem JOIN k USING (l_returnflag)), r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, corr({c}, code) AS r FROM h" for c in NUM) + ") SELECT column, round(r, 4) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, column) AS INTEGER) AS rank FROM r")
def _(spark, d):
    return reports.target_correlations(read(spark, d, "lineitem"), "l_returnflag", NUM, "classification")


RATES = "WITH c AS (SELECT o_orderpriority AS value, o_orderstatus AS class, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT value, class, round(n / sum(n) OVER (PARTITION BY value), 4) AS rate FROM c) "


@query("eda_target_rate", RATES + "SELECT * FROM r")
def _(spark, d):
    return reports.target_rates(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("chart_positive_rate", RATES + "SELECT value, round(100 * max(rate), 2) AS rate FROM r GROUP BY value")
def _(spark, d):
    return reports.positive_rate(reports.target_rates(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@query("eda_mean_target", "SELECT p_brand AS value, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1 ORDER BY 1 LIMIT 10")
def _(spark, d):
    return reports.mean_target(read(spark, d, "part"), "p_brand", "p_retailprice")


@query("chart_top_categories", top_sql(8))
def _(spark, d):
    return profile.categorical_top(read(spark, d, "part"), 8, ["p_brand", "p_type", "p_name"])


# --- leakage and quality


@query("leak_id_columns", "SELECT 'c_custkey' AS column, 'id' AS kind, 'high' AS severity, 'drop' AS action, round(count(DISTINCT c_custkey) / count(*), 4) AS detail FROM customer UNION ALL SELECT 'c_name', 'id', 'high', 'drop', round(count(DISTINCT c_name) / count(*), 4) FROM customer")
def _(spark, d):
    return reports.id_columns(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_mktsegment")


@query("leak_target_corr", "SELECT 'twice' AS column, 'target_correlation' AS kind, 'critical' AS severity, 'drop' AS action, round(corr(2 * o_totalprice + o_custkey % 7, o_totalprice), 4) AS detail FROM orders")
def _(spark, d):
    return reports.target_leaks(read(spark, d, "orders").select("o_custkey", "o_totalprice", (2 * F.col("o_totalprice") + F.col("o_custkey") % 7).alias("twice")), "o_totalprice", "regression")


@query("leak_target_corr_cls", "WITH k AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)) SELECT 'hint' AS column, 'target_correlation' AS kind, 'critical' AS severity, 'drop' AS action, round(corr(code * 10 + l_linenumber % 2, code), 4) AS detail FROM lineitem JOIN k USING (l_returnflag)")
def _(spark, d):
    flag = F.col("l_returnflag")
    hint = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2) * 10 + F.col("l_linenumber") % 2
    return reports.target_leaks(read(spark, d, "lineitem").select("l_tax", "l_returnflag", hint.alias("hint")), "l_returnflag", "classification")


@query("leak_equal_target", "SELECT 'again' AS column, 'target_copy' AS kind, 'critical' AS severity, 'drop' AS action, CAST(1.0 AS DOUBLE) AS detail")
def _(spark, d):
    return reports.target_copies(read(spark, d, "orders").select("o_orderstatus", F.col("o_orderstatus").alias("again"), "o_orderpriority"), "o_orderstatus")


@query("leak_duplicate_features", f"WITH h AS (SELECT l_quantity, l_extendedprice, 2 * l_quantity + l_tax AS twice FROM lineitem), r AS ({STRONG_PAIRS}) SELECT b AS column, 'duplicate_of:' || a AS kind, 'medium' AS severity, 'review' AS action, (SELECT round(corr(l_quantity, twice), 4) FROM h) AS detail FROM r WHERE abs(r) >= 0.9995")
def _(spark, d):
    return reports.duplicate_features(read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (2 * F.col("l_quantity") + F.col("l_tax")).alias("twice")))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"]
_LEAKS = (
    "WITH c AS (SELECT *, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS code FROM orders), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) / count(*) AS share FROM orders" for c in _ORDERS) + "), "
    "ids AS (SELECT name FROM u WHERE share >= 0.95), r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, abs(corr({c}, code)) AS r FROM c" for c in ("o_orderkey", "o_custkey", "o_totalprice")) + "), "
    "leaks AS (SELECT name FROM r WHERE r >= 0.98), same AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, bool_and(CAST({c} AS VARCHAR) = o_orderstatus) AS same FROM orders" for c in _ORDERS) + "), copies AS (SELECT name FROM same WHERE same), "
    "twins AS (" + " UNION ALL ".join(f"SELECT abs(corr({a}, {b})) AS r FROM orders" for a, b in (("o_orderkey", "o_custkey"), ("o_orderkey", "o_totalprice"), ("o_custkey", "o_totalprice"))) + "), "
    "d AS (SELECT name FROM ids UNION SELECT name FROM leaks UNION SELECT name FROM copies) "
    "SELECT coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM d), '') AS dropped, (SELECT count(*) > 0 FROM d) AS detected, (SELECT count(*) FROM ids) + (SELECT count(*) FROM leaks) + (SELECT count(*) FROM copies) + (SELECT count(*) FROM twins WHERE r >= 0.999) + 1 AS n_issues"
)


@query("leak_report", _LEAKS)
def _(spark, d):
    """The order's date is an issue by itself."""
    found = reports.leakage_summary(reports.leakage(read(spark, d, "orders").select("o_orderstatus", *_ORDERS), "o_orderstatus", "classification"))
    return found.select(F.array_join("drop", ",").alias("dropped"), "detected", "n_issues")


_COLUMNS = ["l_orderkey", "l_linenumber", *NUM, "l_returnflag", "l_linestatus", "l_shipdate"]
_NUMBERS = _COLUMNS[:6]
_TEST = lambda x: f"CAST({x} AS INTEGER)"
QUALITY = (
    f"WITH {HOLES}, n AS (SELECT count(*) AS n FROM h), "
    f"gone AS (SELECT ({' + '.join(f'round(1 - count({c}) / count(*), 4)' for c in _COLUMNS)}) / {len(_COLUMNS)} AS gone FROM h), "
    "dup AS (SELECT (SELECT n FROM n) - count(*) AS dup FROM (SELECT DISTINCT * FROM h)), "
    f"sk AS (SELECT ({' + '.join(f'abs(coalesce(skewness({c}), 0))' for c in _NUMBERS)}) / {len(_NUMBERS)} AS skew FROM h), "
    "codes AS (SELECT l_returnflag AS f, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM h WHERE l_returnflag IS NOT NULL)), "
    f"med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _NUMBERS)} FROM h), "
    "c AS (SELECT h.*, coalesce(code, -1) AS code FROM h LEFT JOIN codes ON l_returnflag = f), "
    "issues AS (SELECT "
    + " + ".join(_TEST(f"count(DISTINCT {c}) / count(*) >= 0.95") for c in _COLUMNS if c != "l_returnflag") + " + "
    + " + ".join(_TEST(f"coalesce(abs(corr(coalesce({c}, m_{c}), code)) >= 0.98, false)") for c in _NUMBERS) + " + "
    + " + ".join(_TEST(f"bool_and(CAST({c} AS VARCHAR) IS NOT DISTINCT FROM l_returnflag)") for c in _COLUMNS if c != "l_returnflag")
    + " AS high, " + " + ".join(_TEST(f"coalesce(abs(corr({a}, {b})) >= 0.999, false)") for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]) + " + 1 AS others FROM c, med), "
    "top AS (SELECT max(k) / sum(k) AS top FROM (SELECT count(*) AS k FROM h WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag)), "
    "p AS (SELECT greatest(100 - 200 * gone, 0) AS a, greatest(100 - 500 * dup / greatest(n, 1), 0) AS b, greatest(100 - 12 * least(skew, 5), 0) AS o, CASE WHEN high > 0 THEN greatest(100 - 15.0 * (high + others), 20) ELSE 100 END AS l, CASE WHEN top > 0.7 THEN greatest(least(100, 200 * (1 - top)), 30) ELSE 95 END AS q, least(100, 40 + n / 50) AS z FROM gone, n, dup, sk, issues, top), "
    "s AS (SELECT *, a * 0.2 + b * 0.1 + o * 0.15 + l * 0.25 + q * 0.15 + z * 0.15 AS score FROM p) "
    "SELECT " + ", ".join(f"CAST(round({x}, 4) AS DOUBLE) AS {n}_score" for x, n in zip("abolqz", ("missing", "duplicate", "outlier", "leakage", "balance", "size"))) + ", CAST(round(score, 2) AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Moderate' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END AS grade FROM s"
)


@query("quality_score", QUALITY)
def _(spark, d):
    return reports.quality(holes(spark, d), "l_returnflag", "classification")


LABELS = "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) "


@query("label_profile", LABELS + "SELECT label, n, round(n / sum(n) OVER (), 4) AS share, max(n) OVER () / sum(n) OVER () > 0.7 AS imbalanced FROM c")
def _(spark, d):
    return reports.label_profile(read(spark, d, "embeddings"), "label")


@query("label_quality", LABELS + ", s AS (SELECT least(100.0, 30 + 2.0 * sum(n))::DOUBLE AS a, greatest(30.0, 100 - 80 * (max(n) / sum(n)))::DOUBLE AS b, least(100.0, 25.0 * count(*))::DOUBLE AS c FROM c) SELECT a AS size_score, round(b, 4) AS balance_score, c AS coverage_score, round((a + b + c) / 3, 4) AS score, CASE WHEN (a + b + c) / 3 >= 90 THEN 'A' WHEN (a + b + c) / 3 >= 75 THEN 'B' WHEN (a + b + c) / 3 >= 60 THEN 'C' WHEN (a + b + c) / 3 >= 40 THEN 'D' ELSE 'F' END AS grade FROM s")
def _(spark, d):
    return reports.label_quality(read(spark, d, "embeddings"), "label")


# --- drift: lineitem before and from 1996


def sides(spark, d):
    df = read(spark, d, "lineitem")
    when = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return df.where(when), df.where(~when)


SIDE = "s AS (SELECT *, CAST(l_shipdate >= TIMESTAMP '1996-01-01' AS INTEGER) AS side FROM lineitem)"
SHIFTED = ["l_quantity", "l_extendedprice", "l_tax"]
CELLS = f"{SIDE}, v AS ({long_sql(SHIFTED, 's', 'side, ')}), e AS (SELECT column, list_sort(list_distinct(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS q FROM v WHERE side = 0 GROUP BY 1), c AS (SELECT column, least(len(list_filter(q, lambda x: x <= value)), len(q) - 1) AS bin, count_if(side = 0) AS a, count_if(side = 1) AS b FROM v JOIN e USING (column) WHERE value BETWEEN q[1] AND q[-1] GROUP BY 1, 2), p AS (SELECT column, bin, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM c WINDOW w AS (PARTITION BY column)) "


@query("drift_numeric", f"WITH {CELLS} SELECT column, round(sum(abs(p - q)) / 2, 6) AS score FROM p GROUP BY 1")
def _(spark, d):
    return rounded(reports.numeric_drift(*sides(spark, d), SHIFTED), "score", places=6)


@query("drift_psi", f"WITH {CELLS} SELECT column, round(sum((greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4))), 6) AS psi FROM p GROUP BY 1")
def _(spark, d):
    return rounded(reports.psi(*sides(spark, d), SHIFTED), "psi", places=6)


@query("drift_ks", f"WITH {SIDE}, v AS ({long_sql(SHIFTED, 's', 'side, ')}), c AS (SELECT column, value, count_if(side = 0) AS a, count_if(side = 1) AS b FROM v GROUP BY 1, 2), g AS (SELECT column, abs(sum(a) OVER (PARTITION BY column ORDER BY value) / sum(a) OVER (PARTITION BY column) - sum(b) OVER (PARTITION BY column ORDER BY value) / sum(b) OVER (PARTITION BY column)) AS gap FROM c) SELECT column, round(max(gap), 6) AS ks FROM g GROUP BY 1")
def _(spark, d):
    return rounded(reports.ks(*sides(spark, d), SHIFTED), "ks", places=6)


TEXT_DRIFT = f"WITH {SIDE}, v AS (SELECT side, 'l_returnflag' AS column, l_returnflag AS value FROM s UNION ALL SELECT side, 'l_linestatus', l_linestatus FROM s), c AS (SELECT column, value, count_if(side = 0) AS a, count_if(side = 1) AS b FROM v GROUP BY 1, 2), p AS (SELECT column, a / sum(a) OVER (PARTITION BY column) AS p, b / sum(b) OVER (PARTITION BY column) AS q FROM c) "


@query("drift_categorical", TEXT_DRIFT + "SELECT column, round(sum(abs(p - q)) / 2, 6) AS score FROM p GROUP BY 1")
def _(spark, d):
    return rounded(reports.categorical_drift(*sides(spark, d), ["l_returnflag", "l_linestatus"]), "score", places=6)


@query("drift_features", TEXT_DRIFT + ", t AS (SELECT column, round(sum(abs(p - q)) / 2, 4) AS score, sum(abs(p - q)) / 2 AS x FROM p GROUP BY 1) SELECT column, 'categorical' AS kind, score, CASE WHEN x >= 0.25 THEN 'high' WHEN x >= 0.1 THEN 'low' ELSE 'none' END AS level FROM t")
def _(spark, d):
    a, b = sides(spark, d)
    return reports.feature_drift(a.select("l_returnflag", "l_linestatus"), b.select("l_returnflag", "l_linestatus"))


@query("drift_summary", TEXT_DRIFT + ", t AS (SELECT column, round(sum(abs(p - q)) / 2, 4) AS score FROM p GROUP BY 1) SELECT count(*) AS n_columns, CAST(count_if(score >= 0.1) AS BIGINT) AS n_drifted, round(avg(CAST(score >= 0.1 AS DOUBLE)), 4) AS drift_share, avg(CAST(score >= 0.1 AS DOUBLE)) >= 0.5 AS drift, avg(CAST(score >= 0.1 AS DOUBLE)) >= 0.5 AS retrain FROM t")
def _(spark, d):
    a, b = sides(spark, d)
    return reports.drift_summary(reports.feature_drift(a.select("l_returnflag", "l_linestatus"), b.select("l_returnflag", "l_linestatus")))


# --- splits and metrics


@query("detect_task_type", "SELECT 'l_returnflag' AS column, 'classification' AS task UNION ALL SELECT 'l_extendedprice', 'regression' UNION ALL SELECT 'l_linenumber', 'classification' UNION ALL SELECT 'l_orderkey', CASE WHEN count(DISTINCT l_orderkey) <= greatest(20, 0.05 * count(*)) THEN 'classification' ELSE 'regression' END FROM lineitem")
def _(spark, d):
    df = read(spark, d, "lineitem")
    return spark.createDataFrame([(c, learn.detect_task(df, c)) for c in ("l_returnflag", "l_extendedprice", "l_linenumber", "l_orderkey")], "column string, task string")


@query("label_encode", "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS code FROM lineitem")
def _(spark, d):
    return reports.with_code(read(spark, d, "lineitem"), "l_returnflag", "code").select("l_orderkey", "l_linenumber", "code")


COUNTS = "WITH c AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1) "


@query("min_class_count", COUNTS + "SELECT min(n) AS n FROM c")
def _(spark, d):
    return learn.class_counts(read(spark, d, "lineitem"), "l_returnflag").agg(F.min("n").alias("n"))


@query("can_stratify", COUNTS + "SELECT min(floor(n * 0.8)) >= 2 AS can_stratify FROM c")
def _(spark, d):
    return learn.can_stratify(learn.class_counts(read(spark, d, "lineitem"), "l_returnflag"))


@query("class_weights", COUNTS + "SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def _(spark, d):
    return rounded(learn.class_weights(read(spark, d, "lineitem"), "l_returnflag"), "weight", places=6)


@query("stratified_split_counts", "SELECT o_orderstatus AS class, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM orders GROUP BY 1")
def _(spark, d):
    return learn.stratified_split(read(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey")).groupBy(F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query("cv_folds", "SELECT o_orderstatus AS class, CAST(f.range AS INTEGER) AS fold, CAST(count(*) // 5 + CAST(f.range < count(*) % 5 AS BIGINT) AS BIGINT) AS n FROM orders, range(5) f GROUP BY o_orderstatus, f.range")
def _(spark, d):
    return learn.with_folds(read(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey")).groupBy(F.col("o_orderstatus").alias("class"), "fold").agg(F.count("*").alias("n"))


@query("stratified_cap", "SELECT least(count(*), 500) AS n FROM embeddings")
def _(spark, d):
    return learn.stratified_cap(read(spark, d, "embeddings"), "label", F.col("vec_id")).agg(F.count("*").alias("n"))


@query("ts_split", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > floor(count(*) OVER (PARTITION BY user_id) * 0.8) AS is_test FROM events")
def _(spark, d):
    df = read(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return learn.ordered_split(df, "o", ["user_id"]).select("event_id", "is_test")


PRED = "p AS (SELECT l_returnflag AS y, CASE WHEN l_orderkey % 5 = 0 THEN 'A' WHEN l_orderkey % 5 = 1 THEN 'R' ELSE l_returnflag END AS pred FROM lineitem)"


def predicted(spark, d):
    k = F.col("l_orderkey") % 5
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(k == 0, "A").when(k == 1, "R").otherwise(F.col("l_returnflag")).alias("pred"))


@query("confusion_matrix", f"WITH {PRED} SELECT y, pred, count(*) AS n FROM p GROUP BY ALL")
def _(spark, d):
    return learn.confusion(predicted(spark, d))


@query("metrics_classification", f"WITH {PRED}, k AS (SELECT y AS c, count(*) AS s, count_if(y = pred) AS hit FROM p GROUP BY 1), t AS (SELECT pred AS c, count(*) AS said FROM p GROUP BY 1), m AS (SELECT s, hit, coalesce(hit / said, 0) AS p, hit / s AS r FROM k LEFT JOIN t USING (c)) SELECT round(sum(hit) / sum(s), 6) AS accuracy, round(sum(s * p) / sum(s), 6) AS precision, round(sum(s * r) / sum(s), 6) AS recall, round(sum(s * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(s), 6) AS f1 FROM m")
def _(spark, d):
    return rounded(learn.classification_metrics(predicted(spark, d)), "accuracy", "precision", "recall", "f1", places=6)


@query("metrics_auc", "WITH s AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_orderkey % 97 AS DOUBLE) AS score FROM orders), l AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins FROM l) SELECT 'F' AS class, round(sum(wins) / (sum(pos) * sum(neg)), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_positive FROM w")
def _(spark, d):
    return rounded(learn.auc(read(spark, d, "orders").select(F.lit("F").alias("class"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 97).cast("double").alias("score"))), "auc", places=6)


@query("metrics_regression", "WITH p AS (SELECT o_totalprice AS y, o_totalprice + (o_orderkey % 11 - 5) * 1000 AS p FROM orders) SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 4) AS mape FROM p")
def _(spark, d):
    y = F.col("o_totalprice")
    made = learn.regression_metrics(read(spark, d, "orders").select(y.alias("y"), (y + (F.col("o_orderkey") % 11 - 5) * 1000).alias("pred")))
    return rounded(rounded(made, "mae", "rmse", "mape"), "r2", places=6)


@query("knn_predict_all")
def _(spark, d):
    return learn.knn_others(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label"))


PROBA = "p AS (SELECT o_orderkey, [(o_orderkey % 10 + 1) / 20.0, (o_orderkey % 7 + 1) / 20.0] AS x FROM orders), f AS (SELECT o_orderkey, CAST(x[1] AS DOUBLE) AS a, CAST(x[2] AS DOUBLE) AS b, 1 - CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE) AS c FROM p)"


def probabilities(spark, d):
    a, b = (F.col("o_orderkey") % 10 + 1) / 20.0, (F.col("o_orderkey") % 7 + 1) / 20.0
    return read(spark, d, "orders").select("o_orderkey", F.array(a, b, 1 - a - b).alias("p"))


@query("active_learning", f"WITH {PROBA} SELECT o_orderkey, round(greatest(a, b, c), 6) AS confidence, round(-(a * ln(a + 1e-12) + b * ln(b + 1e-12) + c * ln(c + 1e-12)), 6) AS entropy, greatest(a, b, c) < 0.55 AS review FROM f WHERE c > 1e-9")
def _(spark, d):
    return rounded(learn.uncertainty(probabilities(spark, d).where("p[2] > 1e-9"), "p"), "confidence", "entropy", places=6).drop("p")


@query("proba_map", f"WITH {PROBA} SELECT o_orderkey, round(a, 4) AS pa, round(b, 4) AS pb FROM f")
def _(spark, d):
    m = learn.probability_map(["a", "b", "c"], F.col("p"))
    return probabilities(spark, d).select("o_orderkey", m["a"].alias("pa"), m["b"].alias("pb"))


@query("cf_ranges", f"WITH v AS ({long_sql(NUM, 'lineitem')}) SELECT column, round(quantile_cont(value, 0.05), 4) AS low, round(quantile_cont(value, 0.95), 4) AS high FROM v GROUP BY 1")
def _(spark, d):
    return rounded(learn.search_ranges(read(spark, d, "lineitem"), NUM), "low", "high")


_FLIPS = (
    "WITH d AS (SELECT o_orderkey AS id, o_totalprice AS p, CAST(dayofyear(o_orderdate) AS DOUBLE) AS y FROM orders), q AS (SELECT (quantile_cont(p, 0.95) - quantile_cont(p, 0.05)) / 8 AS sp, (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 8 AS sy FROM d), "
    "g AS (SELECT d.*, s, k, sp, sy, p / 1000 + y > 300 AS was FROM d, q, (VALUES (-1), (1)) v(s), (SELECT unnest(range(1, 9)) AS k) r), "
    "m AS (SELECT id, 'o_totalprice' AS col, s, k, p AS a, p + s * k * sp AS b, was, (p + s * k * sp) / 1000 + y > 300 AS now FROM g UNION ALL SELECT id, 'day', s, k, y, y + s * k * sy, was, p / 1000 + (y + s * k * sy) > 300 FROM g), "
    "f AS (SELECT id, col, s, min(k) AS k, min(a) AS a, arg_min(b, k) AS b FROM m WHERE was <> now GROUP BY id, col, s), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, col, s) AS n FROM f) "
    "SELECT id, col AS column, CAST(s AS INTEGER) AS direction, CAST(k AS INTEGER) AS step, round(a, 4) AS from_value, round(b, 4) AS to_value, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3"
)


@query("counterfactual_grid", _FLIPS)
def _(spark, d):
    df = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"))
    rule = (F.col("o_totalprice") / 1000 + F.col("day") > 300).cast("int")
    return rounded(learn.counterfactuals(rule, df, learn.search_ranges(df, ["o_totalprice", "day"]), ["o_totalprice", "day"]), "from_value", "to_value")


@query("shapley_importance")
def _(spark, d):
    df = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax")
    rows, background = df.orderBy(F.xxhash64("id")).limit(50), df.orderBy(F.xxhash64("id", F.lit(1))).limit(100)
    made = learn.shapley(2 * F.col("l_quantity") - F.col("l_discount") * 50, rows, background, ["l_quantity", "l_discount", "l_tax"])
    return learn.importances(made)


@query("tuning_best")
def _(spark, d):
    df = read(spark, d, "lineitem").where("l_quantity IS NOT NULL").select((F.col("l_quantity") > 25).cast("double").alias("label"), "l_quantity", "l_discount", F.col("l_orderkey"), "l_linenumber")
    from pyspark.ml.feature import VectorAssembler

    matrix = learn.with_folds(VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(df), None, F.struct("l_orderkey", "l_linenumber"), 2).select("features", "label", "fold")
    return learn.best_trial(learn.tune(matrix, "classification", "logistic_regression", n_trials=2, folds=2)[2].drop("params"))


@query("csv_roundtrip", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    from ..functions import shared_path
    from ..sources.files import read_csv

    path = shared_path(spark, "orders-csv")
    read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").write.option("header", True).csv(path)
    back = read_csv(spark, path)
    return back.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query("profile_schema", "WITH v AS (SELECT l_quantity AS number, l_returnflag AS flag, l_shipdate AS day FROM lineitem) SELECT 'numeric' AS kind, 7 AS n_columns, CAST(sum((number IS NOT NULL)::INT) AS BIGINT) AS n_first FROM v UNION ALL SELECT 'categorical', 2, CAST(sum((flag IS NOT NULL)::INT) AS BIGINT) FROM v UNION ALL SELECT 'datetime', 1, CAST(sum((day IS NOT NULL)::INT) AS BIGINT) FROM v")
def _(spark, d):
    """How many columns of each kind a table has, and how many values the first of each."""
    from ..functions import categorical_columns, datetime_columns, numeric_columns

    df = read(spark, d, "lineitem").select("l_quantity", "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    kinds = {"numeric": numeric_columns(df), "categorical": categorical_columns(df), "datetime": datetime_columns(df)}
    counts = df.agg(*[F.count(F.col(c[0])).alias(k) for k, c in kinds.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(len(c)).alias("n_columns"), F.col(k).alias("n_first")) for k, c in kinds.items()])))
