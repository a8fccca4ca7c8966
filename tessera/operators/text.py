"""Texts, documents and their retrieval, time series, and records of past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text
from .series import RANGE_ROWS, over_series

#: English words that carry no meaning for retrieval: a short list of our own; pass another where it matters.
STOP = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()


def tokens(text: Column) -> Column:
    """Runs of at least two word characters of the cleaned text."""
    return F.filter(F.split(clean_text(text), " "), lambda t: F.length(t) >= 2)


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.length(t) > 2)))


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Unigrams and bigrams, of what is left without the stop words."""
    t = tokens(text)
    if stop:
        words = F.array(*[F.lit(w) for w in stop])
        t = F.filter(t, lambda x: ~F.array_contains(words, x))

    def grams(x: Column) -> Column:
        less = F.greatest(F.size(x) - 1, F.lit(0))
        return F.concat(x, F.zip_with(F.slice(x, 1, less), F.slice(x, 2, less), lambda a, b: F.concat(a, F.lit(" "), b)))

    # as an element of an array the words are made once, however often grams() names them
    return F.flatten(F.transform(F.array(t), grams))


def term_counts(docs: DataFrame, key: str, text: str, of=terms) -> DataFrame:
    """(key, term, n)"""
    return docs.select(key, F.explode(of(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def document_frequencies(counts: DataFrame, min_df: int = 2, most: int | None = None) -> DataFrame:
    """(term, df, total); the most frequent terms only, if most is given (ties by term)."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_df)
    return df if most is None else df.orderBy(F.desc("total"), "term").limit(most)


def tfidf(counts: DataFrame, key: str, n_docs: int, vocabulary: DataFrame) -> DataFrame:
    """(key, term, weight): n * (ln((1 + N) / (1 + df)) + 1), each document of length one."""
    raw = counts.join(vocabulary, "term").select(key, "term", (F.col("n") * (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def chunks(docs: DataFrame, key: str, text: str, size: int = 500) -> DataFrame:
    """(key, chunk_id, chunk): pieces of size characters, trimmed; blank ones are left out."""
    # one pass over a text: each substring would be looked for from the text's start
    pieces = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("at", "chunk"))
    made = pieces.select(key, F.concat(F.col(key).cast("string"), F.lit("_"), (F.col("at") * size).cast("string")).alias("chunk_id"), F.trim("chunk").alias("chunk"))
    return made.where(F.col("chunk") != "")


def cosine(queries: DataFrame, candidates: DataFrame, qkey: str, ckey: str) -> DataFrame:
    """Weights of both sides (key, term, weight) -> (qkey, ckey, score) of the pairs that share a term: a join on terms."""
    q = queries.select(qkey, "term", F.col("weight").alias("a"))
    return q.join(candidates.select(ckey, "term", F.col("weight").alias("b")), "term").groupBy(qkey, ckey).agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def top(scores: DataFrame, by: str, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


# --- series


def lag_features(df: DataFrame, value: str, by: list[str], order: list[str], lags: tuple[int, ...] = (1, 2, 3, 7, 14), window: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with lags, the mean and deviation of the previous rows, and calendar columns of the first order column."""
    t = F.col(order[0])

    def columns(w) -> dict:
        past = w.rowsBetween(-window, -1)
        return {f"lag_{k}": F.lag(value, k).over(w) for k in lags} | {"roll_mean": F.avg(value).over(past), "roll_std": F.stddev_samp(value).over(past)}

    made = over_series(df, by, order, max([window, *lags]), columns, range_rows)
    return made.withColumns({"hour": F.hour(t), "dow": F.weekday(t), "month": F.month(t)})


def series_matrix(df: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 7, 14)) -> DataFrame:
    """Rows whose history is complete."""
    return df.na.drop(subset=[f"lag_{k}" for k in lags])


def series_rows(df: DataFrame, time: str, value: str) -> DataFrame:
    """The rows whose time and value can be read, as timestamp and double."""
    when = F.col(time) if dict(df.dtypes)[time] != "string" else F.try_to_timestamp(F.col(time))
    made = df.withColumns({time: when.cast("timestamp"), value: F.col(value).try_cast("double")})
    return made.where(F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))


# --- runs


def latest_runs(runs: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("created_at")))
    return runs.withColumn("__r", rank).where("__r = 1").drop("__r")
