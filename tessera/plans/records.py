"""Queries on retrieval for stated queries, runs, kinds of data, logs, and drift by windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, modality, retrieval, runs, text
from ..sources.files import preview
from ..streaming.drift import reference_bins, windowed_psi
from .tables import read
from .texts import TOKENS, WEIGHTS

QUERIES: dict = {}
ORACLES: dict = {}
ASKED = [retrieval.Query("a", "that other thing and the answer"), retrieval.Query("b", "where error here in eran"), retrieval.Query("c", "therin then this")]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


QS = "qs(query, text) AS (VALUES " + ", ".join(f"('{q.name}', '{q.text}')" for q in ASKED) + ")"
IN_QUERY = "list_distinct(list_filter(regexp_split_to_array(lower(qs.text), '[^a-z0-9_]+'), lambda t: length(t) > 2))"
HYBRID = (
    f"{WEIGHTS}, {QS}, qc AS (SELECT query, term, count(*) AS n FROM (SELECT query, unnest({TOKENS}) AS term FROM qs) GROUP BY ALL), "
    "qr AS (SELECT query, term, n * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM qc JOIN v USING (term)), qm AS (SELECT query, sqrt(sum(w * w)) AS norm FROM qr GROUP BY 1), "
    "cs AS (SELECT query, item_id, sum(w / norm * weight) AS cosine FROM qr JOIN qm USING (query) JOIN f USING (term) GROUP BY 1, 2), "
    f"b AS (SELECT query, item_id, 0.06 * len(list_filter({IN_QUERY}, lambda u: contains(lower(coalesce(benchmark.text, '')), u))) AS bonus FROM qs, benchmark), "
    "h AS (SELECT query, item_id, round(coalesce(cosine, 0) + bonus, 6) AS score FROM b LEFT JOIN cs USING (query, item_id))"
)
TOP = "best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) <= 5)"


def hybrid(spark, d):
    items = read(spark, d, "benchmark")
    counts = text.term_counts(items, "item_id", "text", text.tokens)
    n, vocabulary = items.count(), text.document_frequencies(counts)
    weights = text.tfidf(counts, "item_id", n, vocabulary)
    made = retrieval.hybrid(items, "item_id", "text", weights, ASKED, retrieval.query_weights(spark, ASKED, n, vocabulary))
    return made.withColumn("score", F.round("score", 6))


@query("retrieve_hybrid", f"WITH {HYBRID} SELECT * FROM h")
def _(spark, d):
    return hybrid(spark, d)


@query("retrieve_diverse")
def _(spark, d):
    pooled = retrieval.pool(hybrid(spark, d), "item_id", 5).join(read(spark, d, "benchmark").select("item_id", text.token_set(F.col("text")).alias("tokens")), "item_id")
    return retrieval.diverse(pooled, "item_id", "tokens", 5)


@query("retrieve_merged", f"WITH {HYBRID}, {TOP} SELECT arg_min(query, query) AS category, item_id, arg_min(score, query) AS score FROM best GROUP BY item_id ORDER BY score DESC, item_id LIMIT 12")
def _(spark, d):
    return retrieval.merged(text.top(hybrid(spark, d), "query", "item_id", 5), [q.name for q in ASKED], "item_id")


@query("weak_retrieval", f"WITH {HYBRID}, {TOP} SELECT query, round(avg(score), 5) AS mean_score, avg(score) < 0.3 AS weak FROM best GROUP BY query")
def _(spark, d):
    return retrieval.weak(text.top(hybrid(spark, d), "query", "item_id", 5), ASKED).withColumn("mean_score", F.round("mean_score", 5))


RUNS = "r AS (SELECT o_orderkey AS job_id, o_custkey AS dataset_id, o_orderdate AS created_at, o_orderpriority AS model_name, (o_orderkey % 1000) / 1000.0 AS acc, (o_custkey % 900) / 1000.0 AS r2 FROM orders)"
NEWEST = "FROM r ORDER BY created_at DESC, job_id DESC LIMIT 1"


def orders_as_runs(spark, d):
    """Each order as a run: its customer the dataset, its keys the metrics."""
    metrics = F.create_map(F.lit("accuracy"), F.col("o_orderkey") % 1000 / 1000.0, F.lit("r2"), F.col("o_custkey") % 900 / 1000.0)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("model_name"), metrics.alias("metrics"))


@query("runs_dashboard", f"WITH {RUNS} SELECT count(*) AS runs, count(DISTINCT dataset_id) AS datasets, CAST(max(greatest(acc, r2)) AS DOUBLE) AS best_value, CASE WHEN max(acc) >= max(r2) THEN 'accuracy' ELSE 'r2' END AS best_metric, (SELECT job_id {NEWEST}) AS latest_job_id, (SELECT model_name {NEWEST}) AS latest_model FROM r")
def _(spark, d):
    return runs.dashboard(orders_as_runs(spark, d))


SCORE = "CAST(round(CASE WHEN acc <> 0 THEN acc WHEN r2 <> 0 THEN r2 END, 4) AS DOUBLE)"


@query("runs_recent", f"WITH {RUNS} SELECT job_id, dataset_id, created_at, model_name, {SCORE} AS score FROM r ORDER BY created_at DESC, job_id DESC LIMIT 12")
def _(spark, d):
    return runs.recent(orders_as_runs(spark, d))


@query("runs_trend", f"WITH {RUNS} SELECT job_id, round({SCORE} - lag({SCORE}) OVER (PARTITION BY dataset_id ORDER BY created_at, job_id), 4) AS change FROM r")
def _(spark, d):
    return runs.trend(orders_as_runs(spark, d)).select("job_id", F.round("change", 4).alias("change"))


BOARD = "g AS (SELECT o_custkey, o_orderpriority AS model_name, max(o_totalprice) AS score FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, model_name DESC) AS n FROM g), w AS (SELECT * FROM k WHERE n = 1), s AS (SELECT * FROM k WHERE n = 2)"


@query("leaderboard_gap", f"WITH {BOARD} SELECT w.o_custkey, w.model_name AS winner, s.model_name AS runner_up, round(w.score - s.score, 2) AS gap, coalesce(w.score - s.score < 1000, false) AS close FROM w LEFT JOIN s USING (o_custkey)")
def _(spark, d):
    boards = read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("model_name")).agg(F.max("o_totalprice").alias("score"))
    return runs.leaderboard_gap(boards, "o_custkey", 1000).withColumn("gap", F.round("gap", 2))


@query("preview_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, d):
    return preview(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("modality_statistics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_valid, least(count(DISTINCT {c}), {modality.MANY}) AS n_distinct FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def _(spark, d):
    return modality.statistics(read(spark, d, "events")).select("column", "n_valid", F.least("n_distinct", F.lit(modality.MANY).cast("long")).alias("n_distinct"))


TABLES = "region nation customer supplier part orders lineitem events documents benchmark conversations".split()


@query("detect_modality")
def _(spark, d):
    rows = [(t, *(found := modality.detect(read(spark, d, t))).values()) for t in TABLES]
    return spark.createDataFrame(rows, "table string, modality string, text_column string, datetime_column string, value_columns array<string>, targets array<string>")


@query("log_volume", "WITH n AS (SELECT event_type, CAST(ts AS DATE) AS start, count(*) AS n FROM events GROUP BY 1, 2), z AS (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM n WINDOW w AS (PARTITION BY event_type ORDER BY start ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT event_type, start, n, round(CASE WHEN s > 0 THEN (n - m) / s END, 4) AS z FROM z")
def _(spark, d):
    return logs.volume(read(spark, d, "events"), "ts", "event_type").select("event_type", F.to_date("start").alias("start"), "n", F.round("z", 4).alias("z"))


@query("log_themes")
def _(spark, d):
    talks = read(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("message"), "text")
    return logs.themes(talks, "message", "text").words


DAYS = (
    "e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events), "
    "s AS (SELECT CAST(ts AS DATE) AS start, CASE WHEN value < a THEN 0 WHEN value < b THEN 1 WHEN value < c THEN 2 ELSE 3 END AS bin FROM events, e WHERE value IS NOT NULL), "
    "q AS (SELECT bin, greatest(count(*) / (SELECT count(*) FROM s), 1e-4) AS q FROM s GROUP BY 1), d AS (SELECT start, count(*) AS n FROM s GROUP BY 1), "
    "g AS (SELECT d.start, d.n, q.bin, q.q, greatest(count(s.bin) / d.n, 1e-4) AS p FROM d CROSS JOIN q LEFT JOIN s ON s.start = d.start AND s.bin = q.bin GROUP BY d.start, d.n, q.bin, q.q)"
)


@query("drift_windows", f"WITH {DAYS} SELECT start, n, round(sum((p - q) * ln(p / q)), 4) AS psi FROM g GROUP BY 1, 2")
def _(spark, d):
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    edges, shares = reference_bins(events, "value")
    return windowed_psi(events, "ts", "value", edges, shares).select(F.to_date("start").alias("start"), "n", F.round("psi", 4).alias("psi"))
