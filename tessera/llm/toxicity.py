"""Toxicity by class-conditional Kneser-Ney models.

Each class has a Kneser-Ney model over the bytes of a text (A-Z lower-cased): absolute discounting of the
class's own counts of the highest order, and below it one backoff distribution that both classes share, built
from continuation counts of all labelled texts, so that what is rare in one class is smoothed by what either has
seen. A text's evidence is its log-likelihood under the toxic model less that under the ordinary one, normalised
by length: the mean over the whole text and the largest mean over any SPAN bytes, since an insult in a long text
is diluted in the former. A logistic curve over the two, fitted on labelled texts that the counts left out,
turns them into a score.

Counts, continuation counts and discounts are aggregated by Spark over all labelled texts. The finished ratio
table is broadcast if it has at most max_grams grams. A larger one stays distributed: documents are dealt into
blocks of bounded size, each block's distinct grams and contexts are joined with the table, and the block's own
small table goes to its documents. The model, and so every score, is the same either way.

Defined cases: a null or empty text has no evidence and gets the curve's value at zero; a label that is null, and
a document without a label, teach nothing; of several labels of one document the largest counts; without labels of
both classes every score is 0.0. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lookup, fold, in_batches, slices, utf8, written

ORDER = 5
SPAN = 12
DISCOUNT = 0.75
#: Largest number of labels that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_LABELS = 4_000_000
#: Largest number of grams whose ratios are broadcast (as a hash map of about 100 MB in each worker); more are joined by a shuffle.
MAX_GRAMS = 1 << 22
#: Bytes of text of a block (a longer document has one of its own).
BLOCK_BYTES = 4 << 20
#: Calibration texts at most (about).
MAX_CALIBRATION = 50_000
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order-gram that ends at each byte, as an integer (each document is preceded by order - 1 zero bytes), and the document's lengths."""
    pad, lens = order - 1, np.diff(offsets)
    n = len(lens)
    padded = np.zeros(len(data) + pad * n, np.int64)
    where = np.arange(len(data)) + pad * (np.repeat(np.arange(n), lens) + 1)
    padded[where] = _LOWER[data]
    code = np.zeros(len(data), np.int64)
    for k in range(order):
        code = (code << 8) | padded[where - (pad - k)]
    return code, lens


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _count(batches, order: int):
    held: dict[int, list] = {0: [], 1: []}
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for cls in (0, 1):
            data, off = utf8(batch.column("text").filter(pa.array(toxic == cls)))
            for i, j in slices(off):
                code, _ = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], order)
                if len(code):
                    held[cls].append(np.unique(code, return_counts=True))
            if len(held[cls]) > 16:
                held[cls] = [_merge(held[cls])]
    for cls, parts in held.items():
        if parts:
            keys, counts = _merge(parts)
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), cls, np.int32)), pa.array(counts[i : i + 50_000])], ["gram", "toxic", "n"])


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, toxic) -> (gram, c1, c0): counts in the toxic and in the ordinary class."""
    counted = labelled.select("text", "toxic").mapInArrow(lambda it: _count(it, order), "gram long, toxic int, n long")
    return counted.groupBy("gram").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"),
    )


def shared_backoff(counts: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(gram) of the given order -> (s, p): interpolated Kneser-Ney probabilities of all lower-order grams seen."""
    levels = [counts.select(F.col("gram").alias("s"))]
    for k in range(order - 1, 0, -1):
        levels.append(levels[-1].groupBy(F.col("s").bitwiseAND((1 << (8 * k)) - 1).alias("s")).agg(F.count("*").alias("types")))
    p = None
    for k, level in zip(range(1, order), reversed(levels[1:])):
        level = level.withColumn("h", F.shiftright("s", 8))
        ctx = level.groupBy("h").agg(F.sum("types").alias("total"), F.count("*").alias("kinds"))
        level = level.join(ctx, "h")
        if p is None:
            level = level.withColumn("low", F.lit(1 / 256))
        else:
            level = level.withColumn("t", F.col("s").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(p.select(F.col("s").alias("t"), F.col("p").alias("low")), "t")
        p = level.select("s", (F.greatest(F.col("types") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("low")).alias("p"))
    return p


def ratios(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, c1, c0) -> (key, llr): for a gram seen, log P1(byte | context) - log P0(byte | context); for a context seen (key = -1 - context), the same for bytes never seen after it, where the shared backoff cancels."""
    ctx = counts.withColumn("h", F.shiftright("gram", 8)).groupBy("h").agg(*[F.sum(f"c{c}").alias(f"t{c}") for c in (1, 0)], *[F.sum((F.col(f"c{c}") > 0).cast("int")).alias(f"k{c}") for c in (1, 0)])
    lam = {c: F.when(F.col(f"t{c}") > 0, discount * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(F.lit(1.0)) for c in (1, 0)}
    own = {c: F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"c{c}") - discount, F.lit(0.0)) / F.col(f"t{c}")).otherwise(F.lit(0.0)) for c in (1, 0)}
    seen = counts.withColumn("h", F.shiftright("gram", 8)).withColumn("s", F.col("gram").bitwiseAND((1 << (8 * (order - 1))) - 1))
    seen = seen.join(ctx, "h").join(shared_backoff(counts, order, discount), "s")
    llr = F.log(own[1] + lam[1] * F.col("p")) - F.log(own[0] + lam[0] * F.col("p"))
    return seen.select(F.col("gram").alias("key"), llr.cast("float").alias("llr")).unionByName(ctx.select((-1 - F.col("h")).alias("key"), (F.log(lam[1]) - F.log(lam[0])).cast("float").alias("llr")))


def evidence(data: np.ndarray, offsets: np.ndarray, seen: Lookup, context: Lookup, order: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the mean log-likelihood ratio a byte, and the largest mean over span bytes (zero if empty)."""
    n = len(offsets) - 1
    mean, peak = np.zeros(n), np.zeros(n)
    for i, j in slices(offsets):
        code, lens = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
        if not len(code):
            continue
        value, found = seen.get(code)
        miss = np.flatnonzero(~found)
        value[miss] = context.get(code[miss] >> 8)[0]
        total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        begin = offsets[i:j] - offsets[i]
        mean[i:j] = (total[begin + lens] - total[begin]) / np.maximum(lens, 1)
        at = np.arange(len(code))
        window = total[at + 1] - total[np.maximum(at + 1 - span, np.repeat(begin, lens))]
        full = np.flatnonzero(lens)
        peak[i + full] = np.maximum.reduceat(window, begin[full]) / span
    return mean, peak


def _in_blocks(batches, block_bytes: int):
    """The batches with the number of each row's block; an empty text counts too, so that blocks are bounded in rows."""
    from pyspark import TaskContext

    block, filled = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lens = np.diff(utf8(batch.column("text"))[1]) + 64
        number = np.empty(len(lens), np.int64)
        for i, n in enumerate(lens.tolist()):
            if filled and filled + n > block_bytes:
                block, filled = block + 1, 0
            number[i] = block
            filled += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], ["doc_id", "text", "block"])


def _block_keys(batches, order: int):
    """(block, key): the distinct grams and contexts of each block, as keys of the ratio table (some twice, where batches cut a block)."""
    for batch in batches:
        number = batch.column("block").to_numpy()
        ends = np.r_[np.flatnonzero(np.diff(number)) + 1, len(number)]
        for i, j in zip(np.r_[0, ends[:-1]], ends):
            if i < j:
                data, off = utf8(batch.column("text").slice(i, j - i))
                parts = [np.unique(grams(data[off[a] : off[b]], off[a : b + 1] - off[a], order)[0]) for a, b in slices(off)]
                found = np.unique(np.concatenate(parts))
                keys = np.r_[found, -1 - np.unique(found >> 8)]
                for k in range(0, len(keys), 50_000):
                    part = keys[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number[i])), pa.array(part)], ["block", "key"])


def evidence_by_blocks(docs: DataFrame, model: DataFrame, order: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) and the ratio table (key, llr), of any size -> (doc_id, mean_llr, peak_llr). A key occurs about once a block in the join, so none is hot."""
    blocks = written(docs.select("doc_id", "text").mapInArrow(lambda it: _in_blocks(it, block_bytes), "doc_id long, text string, block long"), "toxicity-blocks")
    values = blocks.mapInArrow(lambda it: _block_keys(it, order), "block long, key long").join(model, "key").select("block", "key", "llr")

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        key, llr = table.column("key").to_numpy(), table.column("llr").to_numpy()
        own = key >= 0
        mean, peak = evidence(*utf8(pa.concat_arrays(texts.column("text").chunks)), Lookup(key[own], llr[own]), Lookup(-1 - key[~own], llr[~own]), order)
        return pa.table({"doc_id": texts.column("doc_id"), "mean_llr": mean, "peak_llr": peak})

    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, "doc_id long, mean_llr double, peak_llr double")


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights on the raw features and the intercept of a ridge-penalised logistic curve (Newton's method)."""
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pen = ridge * np.r_[np.ones(len(w) - 1), 0]
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z / len(z) + np.diag(pen) + 1e-9 * np.eye(len(w)), z.T @ (y - p) / len(z) - pen * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mu / sd).sum())


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, order: int = ORDER, max_grams: int = MAX_GRAMS, max_broadcast_labels: int = MAX_BROADCAST_LABELS, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """(doc_id, text) and (doc_id, toxic) -> (doc_id, held_out, score, predicted, mean_llr, peak_llr).

    Labels are learned only from rows whose fold isn't held_out; of these, the next fold fits the curve and the others the counts.
    """
    spark = docs.sparkSession
    docs = in_batches(docs.select("doc_id", "text"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold(F.col("doc_id"), folds) != held_out)
    known = written(known, "toxicity-labels")
    n_known = known.count()
    by = F.broadcast(known) if n_known <= max_broadcast_labels else known
    tuning = (held_out + 1) % folds
    train = docs.join(by.where(fold(F.col("doc_id"), folds) != tuning), "doc_id").select("text", "toxic")
    counts = written(gram_counts(train, order), "toxicity-grams")
    have = counts.agg(F.sum("c1"), F.sum("c0")).first()
    if not have[0] or not have[1]:
        return docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("mean_llr"), F.lit(0.0).alias("peak_llr"))
    model = ratios(counts, order)
    if counts.count() > max_grams:
        found = evidence_by_blocks(docs, model, order)
    else:
        local = model.toPandas()
        seen = local["key"].to_numpy() >= 0
        shared = spark.sparkContext.broadcast((local["key"].to_numpy()[seen], local["llr"].to_numpy()[seen], -1 - local["key"].to_numpy()[~seen], local["llr"].to_numpy()[~seen]))

        def score(batches):
            k1, v1, k0, v0 = shared.value
            own, context = Lookup(k1, v1), Lookup(k0, v0)
            for batch in batches:
                mean, peak = evidence(*utf8(batch.column("text")), own, context, order)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(mean), pa.array(peak)], ["doc_id", "mean_llr", "peak_llr"])

        found = docs.mapInArrow(score, "doc_id long, mean_llr double, peak_llr double")
    scored = written(found, "toxicity-evidence")
    tune = known.where(fold(F.col("doc_id"), folds) == tuning)
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_calibration / max(1, n_known / max(1, folds - 1))))
    sample: pd.DataFrame = scored.join(tune.where(keep), "doc_id").select("mean_llr", "peak_llr", "toxic").toPandas()
    y = sample["toxic"].to_numpy(np.float64)
    w, b = calibrate(sample[["mean_llr", "peak_llr"]].to_numpy(), y) if 0 < y.sum() < len(y) else (np.array([0.0, SPAN]), -float(SPAN))
    score_col = 1 / (1 + F.exp(-(F.lit(float(w[0])) * F.col("mean_llr") + F.lit(float(w[1])) * F.col("peak_llr") + F.lit(b))))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), score_col.alias("score"), (score_col >= 0.5).cast("int").alias("predicted"), "mean_llr", "peak_llr")
