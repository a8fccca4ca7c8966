"""Exact top-k search by TF-IDF cosine over a block-maximum inverted index.

Documents are dealt into blocks of about block_docs. The index is two tables: postings (block, term, key, weight) and, for each
block and term, the largest weight there. No term is a key by itself: a term that every document has is one key for
each block. What a query can reach in a block is the sum of its weights times these maxima. Each query first meets
the blocks of its greatest bounds; the k-th score found there ends the search of every block whose bound is below it. What
is left is scored in full, so that results are those of scoring everything.

Where keys are unique, terms are counted row by row and none is shuffled for it; counts are made again from the texts where they are needed, and
not written. Of rare terms a document's weight is shuffled without the term. Built for stated queries, the index has the postings of their terms
only; frequencies and norms are always those of all terms of all documents.

Defined cases: null texts have no terms; queries that share no term with any document have no results; only documents with a positive score are
results; ties (scores are equal to nine places) go to the smaller key; rows of one key are one document.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shared_path
from .text import STOP, document_frequencies, term_counts, terms, tfidf, top

#: Documents of a block, about; blocks that a query meets first; places to which scores count.
BLOCK_DOCS, FIRST, PLACES = 64, 4, 9
#: Terms in at least one document of so many are joined by broadcast.
FREQUENT = 1000


def with_frequencies(counts: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """counts (.., term, ..) with df: an inner join, of which frequent terms (as many as FREQUENT times a document's terms, at most) are broadcast, so that no task gets all postings of a term."""
    often = vocabulary.where(F.col("df") >= n_docs / FREQUENT).select(F.col("term").alias("__t"), F.col("df").alias("__often"))
    rare = vocabulary.where(F.col("df") < n_docs / FREQUENT).select("term", "df")
    met = counts.join(F.broadcast(often), F.col("term") == F.col("__t"), "left").drop("__t")
    done = met.where("__often IS NOT NULL").withColumnRenamed("__often", "df")
    return done.unionByName(met.where("__often IS NULL").drop("__often").join(rare, "term").select(*done.columns))


def counted(docs: DataFrame, key: str, text: str, of) -> DataFrame:
    """(key, term, n) of a table whose keys are unique: a row's terms are counted where the row is."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts = [Counter(t) for t in part.column(1).to_pylist()]
                at = [j for j, c in enumerate(counts) for _ in c]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], [key, "term", "n"])

    rows = docs.select(key, of(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, n long")


def idf_weight(n_docs: int) -> Column:
    return F.col("n") * (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)


class TermIndex:
    """Written tables of postings and block maxima, the vocabulary with its document frequencies, and the number of documents."""

    def __init__(self, postings: DataFrame, blocks: DataFrame, vocabulary: DataFrame, n_docs: int, key: str, of):
        self.postings, self.blocks, self.vocabulary, self.n_docs, self.key, self.of = postings, blocks, vocabulary, n_docs, key, of

    @staticmethod
    def build(docs: DataFrame, key: str, text: str = "text", min_df: int = 2, stop: list[str] | None = STOP, block_docs: int = BLOCK_DOCS, asked: DataFrame | None = None, asked_text: str = "text") -> TermIndex:
        """asked: the queries that it is built for; the index then has the postings of their terms only."""
        spark = docs.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = shared_path(spark, name)
            df.write.parquet(path)
            return spark.read.parquet(path)

        of = lambda c: terms(c, stop)
        n = docs.select(key).distinct().count()
        unique = docs.where(F.col(key).isNotNull()).count() == n and docs.where(F.col(key).isNull()).isEmpty()
        counts = counted(docs, key, text, of) if unique else kept(term_counts(docs, key, text, of), "search-counts")
        vocabulary = kept(document_frequencies(counts, min_df), "search-vocabulary")
        norms = with_frequencies(counts, vocabulary, n).select(key, idf_weight(n).alias("w")).groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        mine = vocabulary
        if asked is not None:
            words = asked.select(F.explode(of(F.col(asked_text))).alias("term")).distinct()
            mine = kept(vocabulary.join(words, "term", "left_semi"), "search-asked")
        raw = with_frequencies(counts, mine, n).select(key, "term", idf_weight(n).alias("w"))
        block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // block_docs)))).cast("int").alias("block")
        postings = kept(raw.join(norms.hint("merge"), key).select(block, "term", key, (F.col("w") / F.col("norm")).alias("weight")), "search-postings")
        blocks = kept(postings.groupBy("block", "term").agg(F.max("weight").alias("most")), "search-blocks")
        return TermIndex(postings, blocks, vocabulary, n, key, of)

    def weights(self, queries: DataFrame, qkey: str, text: str = "text") -> DataFrame:
        """(qkey, term, weight) of the queries' terms that documents have, each query of length one."""
        return tfidf(term_counts(queries, qkey, text, self.of), qkey, self.n_docs, self.vocabulary)

    def scores(self, asked: DataFrame, qkey: str, visits: DataFrame | None = None) -> DataFrame:
        """(qkey, key, score): of all documents that share a term with a query, in the blocks (qkey, block) that it visits, or in all."""
        q = asked.select(qkey, "term", F.col("weight").alias("__q"))
        if visits is None:
            met = q.join(self.postings, "term")
        else:
            met = visits.join(q, qkey).join(self.postings, ["block", "term"])
        return met.groupBy(qkey, self.key).agg(F.round(F.sum(F.col("__q") * F.col("weight")), PLACES).alias("score")).where(F.col("score") > 0)

    def bounds(self, asked: DataFrame, qkey: str) -> DataFrame:
        """(qkey, block, bound): what a query can reach in each block that has one of its terms."""
        return asked.join(self.blocks, "term").groupBy(qkey, "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))

    def search(self, queries: DataFrame, qkey: str, k: int = 10, text: str = "text", first: int = FIRST) -> DataFrame:
        """(qkey, key, score, rank): the k documents nearest to each query."""
        spark = queries.sparkSession
        paths = [shared_path(spark, f"search-{name}") for name in ("asked", "bounds", "found")]
        self.weights(queries, qkey, text).write.parquet(paths[0])
        asked = spark.read.parquet(paths[0])
        place = F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("bound"), "block"))
        self.bounds(asked, qkey).withColumn("place", place).write.parquet(paths[1])
        bounds = spark.read.parquet(paths[1])
        top(self.scores(asked, qkey, bounds.where(F.col("place") <= first).select(qkey, "block")), qkey, self.key, k).write.parquet(paths[2])
        found = spark.read.parquet(paths[2])
        least = found.where(F.col("rank") == k).select(F.col(qkey).alias("__q"), F.col("score").alias("__least"))
        rest = bounds.where(F.col("place") > first).join(least, F.col(qkey) == F.col("__q"), "left").where(F.col("__least").isNull() | (F.col("bound") >= F.col("__least") - 10.0**-PLACES))
        more = self.scores(asked, qkey, rest.select(qkey, "block"))
        return top(found.drop("rank").unionByName(more), qkey, self.key, k)

    def visited(self, queries: DataFrame, qkey: str, k: int = 10, text: str = "text", first: int = FIRST) -> DataFrame:
        """(qkey, blocks, visited): in how many of the blocks that have its terms a query is scored."""
        asked = self.weights(queries, qkey, text)
        bounds = self.bounds(asked, qkey).withColumn("place", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("bound"), "block")))
        least = top(self.scores(asked, qkey, bounds.where(F.col("place") <= first).select(qkey, "block")), qkey, self.key, k).where(F.col("rank") == k).select(F.col(qkey).alias("__q"), F.col("score").alias("__least"))
        met = bounds.join(least, F.col(qkey) == F.col("__q"), "left")
        return met.groupBy(qkey).agg(F.count("*").alias("blocks"), F.count_if((F.col("place") <= first) | F.col("__least").isNull() | (F.col("bound") >= F.col("__least") - 10.0**-PLACES)).alias("visited"))
