"""Principal components of wide arrays, by a randomised range finder (Halko, Martinsson, Tropp 2011)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quoted, shared_path
from ..functions.blocks import collected, matrix, sound

#: Directions beyond the components asked for, passes at most, and the relative change of the variances that ends them.
EXTRA, PASSES, CLOSE = 20, 12, 1e-9


class Components:
    """mean, directions (width x k) and the share of the whole variance that each direction has."""

    def __init__(self, mean: np.ndarray, directions: np.ndarray, shares: np.ndarray):
        self.mean, self.directions, self.shares = mean, directions, shares

    def project(self, df: DataFrame, column: str, to: str = "features") -> DataFrame:
        """df with `to`: the centred array on the directions; null for arrays that are null, of another width, or not all finite."""
        width, k = self.directions.shape
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.directions))
        clean = df.drop(to).withColumn("__x", F.when(sound(quoted(column), width), F.transform(quoted(column), lambda v: v.cast("double"))))

        def run(batches):
            mean, directions = shared.value
            for batch in batches:
                there = batch.column("__x").is_valid().to_numpy(zero_copy_only=False)
                made = (matrix(batch.filter(pa.array(there)), "__x", width) - mean) @ directions
                ends = np.r_[0, np.cumsum(np.where(there, k, 0))]
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.reshape(-1)), mask=pa.array(~there)) if batch.num_rows else pa.array([], pa.list_(pa.float64()))
                kept = [c for c in batch.schema.names if c != "__x"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], [*kept, to])

        schema = T.StructType([*df.drop(to).schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))])
        return clean.mapInArrow(run, schema)


def fit_components(df: DataFrame, column: str, most: int = 128, extra: int = EXTRA, passes: int = PASSES, close: float = CLOSE, seed: int = 42) -> Components:
    """The first min(most, width, rows - 1) principal components of an array column.

    A random subspace of a few more directions than components is turned by the data: each pass multiplies the centred rows, block by block, with the subspace
    and with the result again, and adds the blocks' width x directions matrices up; no matrix of width x width is made. It ends
    when the variances stand still, or after `passes`; where the subspace has all directions there are, one pass is exact.
    Arrays that are null, of another width than the widest, or not all finite take no part.
    """
    width = df.agg(F.max(F.size(quoted(column)))).first()[0] or 0
    rows = df.where(sound(quoted(column), width)).select(F.transform(quoted(column), lambda v: v.cast("double")).alias("x")) if width > 0 else df.limit(0)
    path = shared_path(df.sparkSession, "components")
    if width > 0:
        rows.write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
    n = rows.count()
    if n < 2 or width < 1:
        raise ValueError(f"{n} usable rows of {width} columns: at least two rows are needed")

    def total(batches):
        out = np.zeros((1, width))
        for b in batches:
            out += matrix(b, "x", width).sum(0)
        return out

    mean = collected(rows, total, 1, width)[0] / n
    k = min(most, width, n - 1)
    size = min(width, k + extra)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))
    before = None
    for _ in range(1 if size == width else passes):
        shared = df.sparkSession.sparkContext.broadcast((mean, basis))

        def turned(batches, shared=shared):
            # the products, the squares of the rows, and the rows' own square on the subspace
            mean, basis = shared.value
            out = np.zeros((width + 1, size))
            for b in batches:
                x = matrix(b, "x", width) - mean
                out[:width] += x.T @ (x @ basis)
                out[width, 0] += (x * x).sum()
            return out

        found = collected(rows, turned, width + 1, size)
        shared.unpersist()
        product, whole = found[:width], float(found[width, 0])
        # Rayleigh-Ritz on the subspace: its part of the covariance tells variances and directions
        value, vector = np.linalg.eigh(basis.T @ product)
        variance, directions = value[::-1][:k], (basis @ vector)[:, ::-1][:, :k]
        if size < width:
            basis, _ = np.linalg.qr(product)
        if before is not None and np.abs(variance - before).max() <= close * max(variance[0], 1e-300):
            break
        before = variance
    sign = np.sign(directions[np.abs(directions).argmax(0), np.arange(k)])
    return Components(mean, directions * np.where(sign == 0, 1, sign), np.maximum(variance, 0) / whole if whole > 0 else np.zeros(k))


def principal_components(df: DataFrame, column: str, most: int = 128, **how) -> tuple[DataFrame, list[float]]:
    """df with features, the centred array on its first min(most, width, rows - 1) principal components, and the share of variance of each."""
    fitted = fit_components(df, column, most, **how)
    return fitted.project(df, column), fitted.shares.tolist()


def variance_table(df: DataFrame, column: str, most: int = 128, **how) -> DataFrame:
    """(component, share, upto): the share of variance of each component, and of all up to it."""
    shares = fit_components(df, column, most, **how).shares
    return df.sparkSession.createDataFrame([(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(shares, np.cumsum(shares)))], "component int, share double, upto double")
