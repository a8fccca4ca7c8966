"""Token counts as rollups that are maintained by deltas.

A rollup is a folder of committed batches. A batch is a set of events on documents: an insert adds one document and
its tokens to the totals of its source, language and tokenizer version, a delete takes them away, a revision
changes the tokens (and moves the document if its source or language changed). Events become signed additive rows, are
summed by key, and are written under the batch's name; Spark's commit of that write (its _SUCCESS file) is the
batch's commit. A batch whose name is committed is compared with what was committed and skipped, so replaying one, or
retrying after a failure, changes nothing, and another batch under its name is refused; one that failed half-way has no commit, is not read, and is overwritten by its retry. Totals are the sums
over committed batches.

Events: (kind 'insert' | 'delete' | 'revise', source, lang, tokenizer, n_tokens, old_source, old_lang, old_tokens).

Defined cases: null sources, languages and versions are keys of their own; a null count is 0; other kinds of event
are refused; keys whose documents and tokens are both zero are left out of the totals; an empty batch commits and adds
nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(events: DataFrame) -> DataFrame:
    """Events as signed rows (KEYS, n_docs, n_tokens)."""
    n, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "old_tokens"))
    now = lambda d, t: F.struct(F.col("source"), F.col("lang"), F.lit(d).cast("long").alias("n_docs"), t.alias("n_tokens"))
    then = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).cast("long").alias("n_docs"), (-old).alias("n_tokens"))
    kind = F.col("kind")
    refused = F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(kind, F.lit("null")))).cast("array<struct<source:string,lang:string,n_docs:bigint,n_tokens:bigint>>")
    rows = F.when(kind == "insert", F.array(now(1, n))).when(kind == "delete", F.array(now(-1, -n))).when(kind == "revise", F.array(now(1, n), then)).otherwise(refused)
    return events.select("tokenizer", F.explode(rows).alias("d")).select("d.source", "d.lang", "tokenizer", "d.n_docs", "d.n_tokens")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"a batch's name has letters, digits, - and _ only: {batch!r}")
        return f"{self.path}/deltas/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._exists(self._folder(batch) + "/_SUCCESS")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Adds a batch; False if it was there already. ValueError if a batch with other sums has that name."""
        sums = signed(events).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        if self.committed(batch):
            there = self.spark.read.schema(SCHEMA).parquet(self._folder(batch)).withColumn("side", F.lit(1))
            both = there.unionByName(sums.withColumn("side", F.lit(-1)))
            apart = both.groupBy(*KEYS).agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n_docs", "n_tokens")], F.sum("side").alias("side"))
            if not apart.where("n_docs <> 0 OR n_tokens <> 0 OR side <> 0").isEmpty():
                raise ValueError(f"another batch is committed under the name {batch!r}")
            return False
        sums.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def batches(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        if not self._exists(root.toString()):
            return []
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        return sorted(n for n in (s.getPath().getName().removeprefix("batch=") for s in found) if self.committed(n))

    def totals(self) -> DataFrame:
        """(KEYS, n_docs, n_tokens) over all committed batches."""
        done = self.batches()
        rows = self.spark.read.schema(SCHEMA).parquet(*(self._folder(b) for b in done)) if done else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
