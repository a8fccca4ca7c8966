"""Ranking texts for a stated set of queries: hybrid scores, diverse selection, merged answers.

Queries are a short list held by the caller. Each text meets them as the elements of an array literal, so that no text is shuffled to meet a query;
only the TF-IDF part, which needs the terms' weights, is a join on terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from . import text as texts
from .search import TermIndex

#: Queries of one call at most: they become a literal of the plan.
MAX_QUERIES = 1000
PER_TOKEN, SAME_TASK, IMBALANCE = 0.06, 0.15, 0.12


@dataclass(frozen=True)
class Query:
    name: str
    text: str
    task: str | None = None
    imbalanced: bool = False


def _checked(queries: list[Query]) -> list[Query]:
    if not 0 < len(queries) <= MAX_QUERIES:
        raise ValueError(f"there must be 1 to {MAX_QUERIES} queries")
    return queries


def query_weights(spark, queries: list[Query], n_docs: int, vocabulary: DataFrame) -> DataFrame:
    """(query, term, weight) of the queries over the corpus's vocabulary."""
    rows = spark.createDataFrame([(q.name, q.text) for q in _checked(queries)], "query string, text string")
    return texts.tfidf(texts.term_counts(rows, "query", "text", texts.tokens), "query", n_docs, vocabulary)


def hybrid(corpus: DataFrame, key: str, text: str, weights: DataFrame, queries: list[Query], query_terms: DataFrame, task: str | None = None, tags: str | None = None) -> DataFrame:
    """(query, key, score) of every text for every query: the cosine of their TF-IDF weights, plus a bonus for each of the query's distinct tokens (over two characters) that the text contains.

    With the corpus's columns task (string) and tags (array), also for the query's task and for texts on imbalance. Null texts contain nothing.
    """
    asked = F.array(*[F.struct(F.lit(q.name).alias("query"), texts.token_set(F.lit(q.text)).alias("tokens"), F.lit(q.task).cast("string").alias("task"), F.lit(q.imbalanced).alias("imbalanced")) for q in _checked(queries)])
    met = corpus.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("__text"), *[F.col(c).alias(n) for c, n in ((task, "__task"), (tags, "__tags")) if c], F.explode(asked).alias("q"))
    bonus = PER_TOKEN * F.size(F.filter("q.tokens", lambda t: F.contains(F.col("__text"), t)))
    if task:
        bonus = bonus + F.when(F.col("q.task") == F.col("__task"), SAME_TASK).otherwise(0.0)
    if tags:
        bonus = bonus + F.when(F.col("q.imbalanced") & F.array_contains("__tags", "imbalance"), IMBALANCE).otherwise(0.0)
    scored = texts.cosine(query_terms, weights, "query", key).withColumnRenamed("score", "__cosine")
    return met.select("q.query", key, bonus.alias("__bonus")).join(scored, ["query", key], "left").select("query", key, (F.coalesce("__cosine", F.lit(0.0)) + F.col("__bonus")).alias("score"))


def hybrid_search(index: TermIndex, docs: DataFrame, text: str, queries: list[Query], k: int = 4, task: str | None = None, tags: str | None = None) -> DataFrame:
    """(query, key, score, rank): of each query, the pool of the best texts that share a term with it, by cosine and bonus, as hybrid() counts them.

    A text is shuffled once, with the queries that it shares a term with; these meet it there, never as pairs with copies of the text.
    """
    spark, key = docs.sparkSession, index.key
    asked = spark.createDataFrame([(q.name, q.text, q.task, q.imbalanced) for q in _checked(queries)], "query string, text string, task string, imbalanced boolean")
    told = asked.select(F.col("query").alias("__query"), texts.token_set(F.col("text")).alias("__tokens"), F.col("task").alias("__qtask"), "imbalanced")
    found = index.scores(index.weights(asked, "query"), "query").groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("query", "score")).alias("__found"))
    met = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("__text"), *[F.col(c).alias(n) for c, n in ((task, "__task"), (tags, "__tags")) if c]).dropDuplicates([key])
    met = met.join(found, F.col(key) == F.col("__key")).withColumn("f", F.explode("__found")).join(F.broadcast(told), F.col("f.query") == F.col("__query"))
    bonus = PER_TOKEN * F.size(F.filter("__tokens", lambda t: F.contains(F.col("__text"), t)))
    if task:
        bonus = bonus + F.when(F.col("__qtask") == F.col("__task"), SAME_TASK).otherwise(0.0)
    if tags:
        bonus = bonus + F.when(F.col("imbalanced") & F.array_contains("__tags", "imbalance"), IMBALANCE).otherwise(0.0)
    return pool(met.select(F.col("f.query").alias("query"), key, F.round(F.col("f.score") + bonus, 6).alias("score")), key, k)


def hybrid_scan(docs: DataFrame, key: str, text: str, queries: list[Query], k: int = 4, rows: int | None = None, keep_text: bool = False) -> DataFrame:
    """(query, key, score, rank): the pools of hybrid_search, without tasks and tags, by one scan of the texts. rows, keep_text: as scan.nearest has them."""
    asked = docs.sparkSession.createDataFrame([(q.name, q.text) for q in _checked(queries)], "query string, text string")
    return scan.nearest(docs, key, text, asked, "query", k=max(4 * k, 12), per_token=PER_TOKEN, rows=rows, keep_text=keep_text)


def pool(scores: DataFrame, key: str, k: int) -> DataFrame:
    """Of each query the max(4 k, 12) best texts; ties by key."""
    return texts.top(scores, "query", key, max(4 * k, 12))


def diverse(pooled: DataFrame, key: str, tokens: str, k: int, relevance: float = 0.7) -> DataFrame:
    """(query, key, score, tokens) of a pool -> (query, key, score, place): k texts of each query by maximal marginal relevance.

    Each step takes the text of the greatest relevance * score - (1 - relevance) * (largest Jaccard similarity to those taken). A group is a
    query's pool, of a bounded size, never a query's whole candidates.
    """
    kind = dict(pooled.dtypes)

    def select(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t if t is not None else ()) for t in p[tokens]]
        taken: list[int] = []
        while len(taken) < min(k, len(p)):
            rest = [i for i in range(len(p)) if i not in taken]
            like = {i: max((len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) or 1) for j in taken), default=0.0) for i in rest}
            taken.append(max(rest, key=lambda i: (relevance * p["score"][i] - (1 - relevance) * like[i], -i)))
        return p.loc[taken, ["query", key, "score"]].assign(place=range(1, len(taken) + 1))

    return pooled.select("query", key, "score", tokens).groupBy("query").applyInPandas(select, f"query string, `{key}` {kind[key]}, score double, place int")


def merged(answers: DataFrame, order: list[str], key: str, most: int = 12) -> DataFrame:
    """(query, key, score) -> (category, key, score): each text once, for the first query in order that found it, best first."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("query"))
    once = answers.groupBy(key).agg(F.min(F.struct(place.alias("place"), "query", "score")).alias("m"))
    return once.select(F.col("m.query").alias("category"), key, F.col("m.score").alias("score")).orderBy(F.desc("score"), key).limit(most)


def weak(answers: DataFrame, queries: list[Query], least: float = 0.3) -> DataFrame:
    """(query, mean_score, weak) of every query: weak if nothing was found or the mean score is below least."""
    asked = answers.sparkSession.createDataFrame([(q.name,) for q in queries], "query string")
    found = answers.groupBy("query").agg(F.avg("score").alias("mean_score"))
    return asked.join(found, "query", "left").withColumn("weak", F.coalesce(F.col("mean_score") < least, F.lit(True)))
