"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once (single longer documents are taken whole).
SLICE_BYTES = 1 << 20
#: Bytes of texts that Spark hands to Python at once (single longer documents are taken whole).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session set (if it isn't already) so that Python workers get at most BATCH_BYTES at once: 10,000 rows, Spark's usual limit, may be gigabytes of text."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in docs.sparkSession.conf.getAll:
        docs.sparkSession.conf.set(limit, str(BATCH_BYTES))
    return docs


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with its lineage cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many `_` appended as it takes to differ from all of taken (without regard to case, as Spark compares)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets; null is empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs [i, j) of documents of about limit bytes each; a longer document has a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Lookup:
    """A read-only hash map from non-negative int64 keys to float32 values, in flat arrays of a size fixed by the number of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        keys, values = keys.astype(np.int64), values.astype(np.float32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(keys), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            keys, values, at = keys[~take], values[~take], (at[~take] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        at = self._slot(keys)
        there = self.keys[at]
        found = there == keys
        out = np.where(found, self.values[at], np.float32(0))
        rest = np.flatnonzero(~found & (there >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            found[rest[hit]] = True
            go = ~hit & (there >= 0)
            rest, at = rest[go], at[go]
        return out, found
