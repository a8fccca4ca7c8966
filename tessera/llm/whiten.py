"""Whitening of embeddings by a covariance that is weighted with the multiplicity of each vector.

An entry c becomes the whole number x = floor(scale * c) + shift, so that near copies that fall on one grid point become
the same vector. Identical x-vectors are grouped; their count (or one, with weights="one") is the weight of the
distinct vector in the fit. Sums of the weighted x are exact whole numbers; a second pass over the distinct vectors
multiplies the centred, weighted blocks, one d x d matrix for each task, whose rows are added up by row number, in the
order of the tasks. Only that d x d matrix comes to the driver (max_dim bounds d), where its eigenvectors are found.
Each distinct vector is whitened once and its result joined back to the rows that share it. Vectors that hold a
thousandth of the rows or more, of which there are a thousand at most, are joined by broadcast, so that no task
gets all the rows of a frequent vector.

Defined cases: a null vector, or one with null or non-finite entries, takes no part; nor does one of another dimension
than most (the smaller, where two are equally frequent). Repeated rows, and rows of a null vec_id, count and are
returned like others. A component without variance (an eigenvalue within rounding of zero) has a null whitened value and
doesn't count in identity_error. Empty vectors and empty tables have no rows. An entry whose x is no 64-bit whole number
raises an error. Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
MAX_DIM = 4096
#: Vectors that hold at least one in so many rows are joined by broadcast.
FREQUENT = 1000
_SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def on_grid(vectors: DataFrame, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, x: array<long>): the rows whose entries are all finite."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where("c IS NOT NULL")
    rows = rows.where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    # Spark may evaluate this before the filters, so that only finite values raise
    fits = lambda v: F.when(F.abs(v) < float(1 << 62), F.floor(v) + F.lit(shift)).when(F.abs(v) < F.lit(float("inf")), F.raise_error(F.lit("an entry is too large for a 64-bit whole number")).cast("long"))
    return rows.select("vec_id", F.transform("c", lambda v: fits(v * F.lit(float(scale)))).alias("x"))


def _block(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _whole_sums(batches, dim: int):
    """(x, weight) -> (i, s): the weighted sum of each dimension, exactly."""
    total = [0] * dim
    for batch in batches:
        x, w = _block(batch, "x", dim), batch.column("weight").to_numpy(zero_copy_only=False)
        largest = float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum())
        part = w @ x if largest < 2**62 else w.astype(object) @ x.astype(object)
        total = [a + int(b) for a, b in zip(total, part)]
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])


def _products(batches, value: str, dim: int, mean: np.ndarray | None):
    """-> (part, i, row): the rows of the sum of weight * outer(v, v) over the task's centred vectors."""
    from pyspark import TaskContext

    total = np.zeros((dim, dim))
    for batch in batches:
        v = _block(batch, value, dim).astype(float)
        if mean is not None:
            v = v - mean
        total += (v * batch.column("weight").to_numpy(zero_copy_only=False)[:, None]).T @ v
    part = TaskContext.get().partitionId()
    for i in range(dim):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([total[i]], pa.list_(pa.float64()))], ["part", "i", "row"])


def _added(batches):
    """(part, i, row), sorted -> (i, row): rows of one number added up."""
    total = {}
    for batch in batches:
        rows = batch.column("row")
        for k, i in enumerate(batch.column("i").to_pylist()):
            row = rows[k].values.to_numpy(zero_copy_only=False)
            total[i] = total[i] + row if i in total else row
    for i, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["i", "row"])


def weighted_products(distinct: DataFrame, value: str, dim: int, mean: np.ndarray | None = None) -> np.ndarray:
    """The sum of weight * outer(v - mean, v - mean) over the rows (value, weight)."""
    parts = distinct.select(value, "weight").mapInArrow(lambda it: _products(it, value, dim, mean), "part int, i int, row array<double>")
    rows = parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(_added, "i int, row array<double>").collect()
    out = np.zeros((dim, dim))
    for r in rows:
        out[r["i"]] = r["row"]
    return out


def _whitened(batches, dim: int, n: int, sums: list[int], turn: np.ndarray):
    """(x, weight, count) -> the same with deviation and w."""
    mean = np.array([s / n for s in sums])
    for batch in batches:
        x = _block(batch, "x", dim)
        largest = float(np.abs(n * x.astype(float) - np.array(sums, float)).max(initial=0)) + 1
        exact = np.int64 if largest**2 * dim < 2**62 and n * float(np.abs(x.astype(float)).max(initial=0)) < 2**62 else object
        d = x.astype(exact) * n - np.array(sums, exact)
        deviation = (d * d).sum(1)
        deviation = pa.array(deviation).cast(pa.decimal128(38, 0)) if exact is np.int64 else pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0))
        w = (x - mean) @ turn
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("weight"), batch.column("count"), deviation, lists], ["x", "weight", "count", "deviation", "w"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count", scale: float = SCALE, shift: int = SHIFT, max_dim: int = MAX_DIM) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    n: the fit's sum of weights; deviation: the sum over dimensions of (n x - S)^2, exact; whitened: x - S / n on the component, over the root of its
    eigenvalue; explained: the eigenvalue's share of the trace; identity_error: how far the covariance of the whitened fit list is from the identity.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights must be count or one")
    spark = vectors.sparkSession
    rows = on_grid(vectors, scale, shift)
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("count")), "whiten-distinct")
    sizes = distinct.groupBy(F.size("x").alias("dim")).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["dim"]:
        return spark.createDataFrame([], _SCHEMA)
    dim, n_rows = sizes["dim"], sizes["n"]
    if dim > max_dim:
        raise ValueError(f"vectors of {dim} dimensions; at most {max_dim} have a covariance that fits the driver")
    distinct = distinct.where(F.size("x") == dim).withColumn("weight", F.col("count") if weights == "count" else F.lit(1).cast("long"))
    n = distinct.agg(F.sum("weight")).first()[0]
    sums = {r["i"]: int(r["s"]) for r in distinct.select("x", "weight").mapInArrow(lambda it: _whole_sums(it, dim), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    sums = [sums[i] for i in range(dim)]
    value, vector = np.linalg.eigh(weighted_products(distinct, "x", dim, np.array([s / n for s in sums])) / n)
    value, vector = value[::-1], vector[:, ::-1]
    k, trace = min(components, dim), float(value.sum())
    varies = value[:k] > max(trace, 0.0) * dim * np.finfo(float).eps
    turn = vector[:, :k] / np.sqrt(np.where(varies, value[:k], 1.0)) * varies
    schema = "x array<long>, weight long, count long, deviation decimal(38,0), w array<double>"
    found = written(distinct.select("x", "weight", "count").mapInArrow(lambda it: _whitened(it, dim, n, sums, turn), schema), "whiten-distinct-whitened")
    identity = weighted_products(found, "w", k) / n - np.diag(varies.astype(float))
    error = float(np.abs(identity).max())
    frequent = F.col("count") >= n_rows / FREQUENT
    often = found.where(frequent).select("x", F.struct("deviation", "w").alias("often"))
    rare = found.where(~frequent).select("x", F.struct("deviation", "w").alias("rare"))
    rows = rows.where(F.size("x") == dim).join(F.broadcast(often), "x", "left")
    done = rows.where("often IS NOT NULL").select("vec_id", "often.*")
    rest = rows.where("often IS NULL").select("vec_id", "x").join(rare, "x").select("vec_id", "rare.*")
    both = done.unionByName(rest).select("vec_id", "deviation", F.posexplode("w").alias("component", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in value[:k]]), F.col("component") + 1)
    whitened = F.when(F.element_at(F.array(*[F.lit(bool(v)) for v in varies]), F.col("component") + 1), F.col("whitened"))
    return both.select("vec_id", (F.col("component") + 1).cast("int").alias("component"), F.lit(int(n)).cast("long").alias("n"), "deviation", whitened.alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))
