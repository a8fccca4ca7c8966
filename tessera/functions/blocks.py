"""Sums of matrices over the rows of a table: each task adds up its own, their strips of rows are added by strip number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a matrix that may come to the driver.
MAX_ENTRIES = 1 << 26
#: Entries of a strip.
STRIP = 1 << 18


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """An array column of equal lengths as a matrix; nulls are NaN."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def columns_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of numbers as a matrix; nulls are NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def sound(column: Column, width: int) -> Column:
    """Whether an array has that length and finite numbers only."""
    return F.coalesce((F.size(column) == width) & F.forall(column, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], rows: int, width: int) -> DataFrame:
    """(strip, data): the sum over all tasks of the rows x width matrices that work makes of a task's batches, cut into strips of whole rows.

    The partitions of df are joined, without a shuffle, into as many tasks as the cluster runs at once, so that as many matrices are shuffled.
    """
    at_once = max(1, df.sparkSession.sparkContext.defaultParallelism)
    each = max(1, STRIP // max(1, width))

    def local(batches):
        from pyspark import TaskContext

        total = np.ascontiguousarray(work(batches), dtype=np.float64)
        part = TaskContext.get().partitionId()
        for k, i in enumerate(range(0, rows, each)):
            data = total[i : i + each].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.list_(pa.float64()))], ["strip", "part", "data"])

    def added(batches):
        now, total = None, None
        for batch in batches:
            data = batch.column("data")
            for i, k in enumerate(batch.column("strip").to_pylist()):
                mine = data[i].values.to_numpy(zero_copy_only=False)
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["strip", "data"])
                    now, total = k, mine.copy()
                else:
                    total += mine
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["strip", "data"])

    parts = df.coalesce(at_once).mapInArrow(local, "strip int, part int, data array<double>")
    return parts.repartition("strip").sortWithinPartitions("strip", "part").mapInArrow(added, "strip int, data array<double>")


def collected(df: DataFrame, work, rows: int, width: int, most: int = MAX_ENTRIES) -> np.ndarray:
    """The sum as one matrix in the driver, of at most `most` entries."""
    if rows * width > most:
        raise ValueError(f"a matrix of {rows} x {width} is more than {most} entries")
    strips = sorted(((r["strip"], r["data"]) for r in summed(df, work, rows, width).collect()), key=lambda s: s[0])
    return np.concatenate([np.asarray(d) for _, d in strips]).reshape(rows, width) if strips else np.zeros((rows, width))
