"""Queries on texts, documents, series and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, scan, search, text
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}
CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = f"list_filter(string_split({CLEAN}, ' '), lambda t: length(t) >= 2)"
COUNTS = f"t AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS n FROM t GROUP BY ALL)"
DF = "v AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1 HAVING count(*) >= 2)"
WEIGHTS = f"{COUNTS}, {DF}, r AS (SELECT item_id, term, n * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)), m AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1), f AS (SELECT item_id, term, w / norm AS weight FROM r JOIN m USING (item_id))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def weights(spark, d):
    items = read(spark, d, "benchmark")
    counts = text.term_counts(items, "item_id", "text", text.tokens)
    return text.tfidf(counts, "item_id", items.count(), text.document_frequencies(counts))


@query("text_clean", f"SELECT item_id, {CLEAN} AS clean FROM benchmark")
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.clean_text(F.col("text")).alias("clean"))


@query("text_ngrams", f"WITH t AS (SELECT item_id, {TOKENS} AS t FROM benchmark), b AS (SELECT item_id, unnest(t) AS term FROM t UNION ALL SELECT item_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) FROM t) SELECT item_id, term, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    return text.term_counts(read(spark, d, "benchmark"), "item_id", "text")


@query("text_doc_freq", f"WITH {COUNTS}, {DF} SELECT * FROM v")
def _(spark, d):
    return text.document_frequencies(text.term_counts(read(spark, d, "benchmark"), "item_id", "text", text.tokens))


@query("tfidf_weights", f"WITH {WEIGHTS} SELECT item_id, term, round(weight, 6) AS weight FROM f")
def _(spark, d):
    return weights(spark, d).select("item_id", "term", F.round("weight", 6).alias("weight"))


@query("retrieve_cosine", f"WITH {WEIGHTS}, s AS (SELECT a.item_id AS q, b.item_id AS item, sum(a.weight * b.weight) AS score FROM f a JOIN f b USING (term) WHERE a.item_id <> b.item_id GROUP BY 1, 2) SELECT q, item, round(score, 6) AS score FROM s")
def _(spark, d):
    w = weights(spark, d)
    made = text.cosine(w.withColumnRenamed("item_id", "q"), w.withColumnRenamed("item_id", "item"), "q", "item")
    return made.where("q <> item").select("q", "item", F.round("score", 6).alias("score"))


@query("token_sets", "SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 2))) AS n FROM benchmark")
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.size(text.token_set(F.col("text"))).cast("long").alias("n"))


@query("doc_chunks", "WITH c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '_' || k AS chunk_id, trim(substr(text, CAST(k AS BIGINT) + 1, 500)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS k FROM documents)) SELECT doc_id, chunk_id, md5(chunk) AS chunk_md5 FROM c WHERE chunk <> ''")
def _(spark, d):
    return text.chunks(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_id", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def documents_chunks(spark, d):
    """The chunks of documents, and how many there are at most."""
    docs = read(spark, d, "documents")
    return text.chunks(docs, "doc_id", "text").select("chunk_id", F.col("chunk").alias("text")), docs.agg(F.sum(F.ceil(F.length("text") / 500))).first()[0] or 0


STOPPED = "list_filter({x}, lambda t: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP) + "], t))"
GRAMS = "SELECT {k}, term, count(*) AS n FROM (SELECT {k}, unnest(t) AS term FROM {s} UNION ALL SELECT {k}, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) FROM {s}) GROUP BY ALL"


@query("search_chunks", "WITH ch AS (SELECT CAST(doc_id AS VARCHAR) || '_' || k AS chunk_id, trim(substr(text, CAST(k AS BIGINT) + 1, 500)) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS k FROM documents)), "
       f"ct AS (SELECT chunk_id, {STOPPED.format(x=TOKENS)} AS t FROM ch WHERE text <> ''), qt AS (SELECT item_id, {STOPPED.format(x=TOKENS)} AS t FROM benchmark), nn AS (SELECT count(*) AS n FROM ct), "
       f"c AS ({GRAMS.format(k='chunk_id', s='ct')}), q AS ({GRAMS.format(k='item_id', s='qt')}), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2), "
       "cw AS (SELECT chunk_id, term, c.n * (ln((1.0 + nn.n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), nn), qw AS (SELECT item_id, term, q.n * (ln((1.0 + nn.n) / (1 + df)) + 1) AS w FROM q JOIN v USING (term), nn), "
       "cm AS (SELECT chunk_id, sqrt(sum(w * w)) AS m FROM cw GROUP BY 1), qm AS (SELECT item_id, sqrt(sum(w * w)) AS m FROM qw GROUP BY 1), "
       "s AS (SELECT item_id, chunk_id, round(sum(qw.w / qm.m * (cw.w / cm.m)), 9) AS score FROM qw JOIN qm USING (item_id) JOIN cw USING (term) JOIN cm USING (chunk_id) GROUP BY 1, 2 HAVING sum(qw.w * cw.w) > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")  # fmt: skip
def _(spark, d):
    made, rows = documents_chunks(spark, d)
    asked = read(spark, d, "benchmark")
    if asked.count() > scan.MAX_QUERIES:
        found = search.TermIndex.build(made, "chunk_id", asked=asked).search(asked, "item_id")
    else:
        found = scan.nearest(made, "chunk_id", "text", asked, "item_id", rows=rows)
    return found.select("item_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


CHUNKS = f"ch AS (SELECT CAST(doc_id AS VARCHAR) || '_' || k AS chunk_id, trim(substr(text, CAST(k AS BIGINT) + 1, 500)) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS k FROM documents)), ct AS (SELECT chunk_id, {STOPPED.format(x=TOKENS)} AS t FROM ch WHERE text <> ''), qt AS (SELECT item_id, {STOPPED.format(x=TOKENS)} AS t FROM benchmark), nn AS (SELECT count(*) AS n FROM ct)"
COSINES = (
    f"c AS ({GRAMS.format(k='chunk_id', s='ct')}), q AS ({GRAMS.format(k='item_id', s='qt')}), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2), "
    "cw AS (SELECT chunk_id, term, c.n * (ln((1.0 + nn.n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), nn), qw AS (SELECT item_id, term, q.n * (ln((1.0 + nn.n) / (1 + df)) + 1) AS w FROM q JOIN v USING (term), nn), "
    "cm AS (SELECT chunk_id, sqrt(sum(w * w)) AS m FROM cw GROUP BY 1), qm AS (SELECT item_id, sqrt(sum(w * w)) AS m FROM qw GROUP BY 1), "
    "s AS (SELECT item_id, chunk_id, round(sum(qw.w / qm.m * (cw.w / cm.m)), 9) AS score FROM qw JOIN qm USING (item_id) JOIN cw USING (term) JOIN cm USING (chunk_id) GROUP BY 1, 2)"
)
SETS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 2))"


def chunk_pools(spark, d, keep_text: bool = False):
    """Of every item of benchmark, the 16 best chunks of documents by hybrid score."""
    made, rows = documents_chunks(spark, d)
    asked = [retrieval.Query(str(r["item_id"]), r["text"]) for r in read(spark, d, "benchmark").select("item_id", "text").orderBy("item_id").limit(retrieval.MAX_QUERIES + 1).collect()]
    return retrieval.hybrid_scan(made, "chunk_id", "text", asked, rows=rows, keep_text=keep_text)


@query("retrieve_chunks", f"WITH {CHUNKS}, {COSINES}, u AS (SELECT item_id, {SETS} AS u FROM benchmark), h AS (SELECT item_id, chunk_id, round(score + 0.06 * len(list_filter(u, lambda t: contains(lower(ch.text), t))), 6) AS score FROM s JOIN u USING (item_id) JOIN ch USING (chunk_id) WHERE score > 0) SELECT CAST(item_id AS VARCHAR) AS query, chunk_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 16")
def _(spark, d):
    return chunk_pools(spark, d)


@query("retrieve_chunks_diverse")
def _(spark, d):
    """Four chunks of every pool, by maximal marginal relevance."""
    pooled = chunk_pools(spark, d, keep_text=True)
    return retrieval.diverse(pooled.withColumn("tokens", text.token_set(F.col("text"))), "chunk_id", "tokens", 4)


SERIES = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


def series(spark, d):
    return text.lag_features(read(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])


@query("ts_lags", "SELECT event_id, " + ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 7, 14)) + f" FROM events {SERIES}")
def _(spark, d):
    return series(spark, d).select("event_id", *[f"lag_{k}" for k in (1, 2, 3, 7, 14)])


@query("ts_roll_mean", f"SELECT event_id, round(avg(value) {PAST}, 6) AS roll_mean FROM events")
def _(spark, d):
    return series(spark, d).select("event_id", F.round("roll_mean", 6).alias("roll_mean"))


@query("ts_roll_std", f"SELECT event_id, round(stddev_samp(value) {PAST}, 4) AS roll_std FROM events")
def _(spark, d):
    return series(spark, d).select("event_id", F.round("roll_std", 4).alias("roll_std"))


@query("ts_calendar", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month FROM events")
def _(spark, d):
    return series(spark, d).select("event_id", "hour", "dow", "month")


@query("ts_matrix", f"SELECT event_id, lag_14 FROM (SELECT event_id, lag(value, 14) OVER w AS lag_14 FROM events {SERIES}) WHERE lag_14 IS NOT NULL")
def _(spark, d):
    return text.series_matrix(series(spark, d)).select("event_id", "lag_14")


@query("runs_latest", "SELECT o_custkey AS job_id, max(o_orderdate) AS created_at FROM orders GROUP BY 1")
def _(spark, d):
    return text.latest_runs(read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("created_at")))
