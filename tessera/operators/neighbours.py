"""Exact k nearest neighbours by pivots: a metric index over cells, as Spark ML estimators.

Training rows are dealt to the nearest of some pivots (a sample of them); a cell is the rows of a pivot, cut into slices of
slice_rows. A query meets its nearest cells first, as many as it takes for k rows; the k-th distance found bounds what is
nearer. By the triangle inequality no row of a cell is nearer than d(query, pivot) - radius, nor, as each row is nearer to its own
pivot than to others, than (d(query, pivot) - d(query, nearest pivot)) / 2 (a bound that holds for any metric); so the query
meets those other cells only whose bounds are within its k-th distance. Both rounds are joins by slice: a task holds one
slice and streams its queries, and sends k rows back for each. Queries of one slice are dealt into groups, so that a
cell that many queries ask for is met by many tasks.

In many dimensions most cells are met. There (p 2, PACKED components or more) small cells that are near each other are packed up to slice_rows
rows, and a query is sent once to a pack of which it meets a cell, so that queries are copied n / slice_rows times, and not once for each cell.

Distances are of Minkowski's order p: 1, 2, or 0 for the largest difference. Ties go to the smaller number of a training row, votes that are equal to the smaller label.

Defined cases: rows whose vector is null, of another length than most training rows' (the first's), or not all finite, take no part
in training and get a null prediction; training on no rows is an error; fewer rows than k are all neighbours.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quoted, shared_path
from ..functions.blocks import matrix, sound
from .clean import _Fitted, _Fitting

#: Rows of a slice, queries of a group, and pivots at most (about the root of the rows).
SLICE_ROWS, GROUP_ROWS, MAX_PIVOTS = 8192, 16_384, 2048
#: Components from which Euclidean distances are first taken by a product of matrices, and cells are packed.
PACKED = 8
#: What rounding may add to a distance, as a part of it.
ROUNDING = 1e-9
#: What a product of matrices may round, for each component, as a part of the largest squares.
SQUARES = 1e-15


def distances(a: np.ndarray, b: np.ndarray, p: int, block: int = 1 << 22) -> np.ndarray:
    """Of the rows of a (n x d) to those of b (m x d): n x m, each pair summed alike, wherever it stands."""
    out = np.empty((len(a), len(b)))
    step = max(1, block // max(1, b.size))
    for i in range(0, len(a), step):
        d = np.abs(a[i : i + step, None, :] - b[None, :, :])
        out[i : i + step] = np.sqrt((d * d).sum(2)) if p == 2 else d.sum(2) if p == 1 else d.max(2)
    return out


def near_pairs(q: np.ndarray, x: np.ndarray, k: int, p: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of x, d): all pairs that may be among the k nearest of a row of q, their distances as distances() has them.

    Euclidean ones are first taken as |q|^2 + |x|^2 - 2 q x, one product of matrices; what it rounds is less than SQUARES of the largest
    terms, so that only pairs within twice that of the k-th are computed exactly. same: pairs that don't count.
    """
    m = min(k, len(x))
    if p != 2 or q.shape[1] < PACKED:
        d = distances(q, x, p)
        if same is not None:
            d[same] = np.inf
        a, b = np.nonzero((d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m]) & np.isfinite(d))
        return a, b, d[a, b]
    of_q, of_x = (q * q).sum(1), (x * x).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        about = of_q[:, None] + of_x - 2 * (q @ x.T)
        error = SQUARES * q.shape[1] * (of_q + of_x.max())
    if not np.isfinite(about).all():
        error[:], about = np.inf, np.zeros_like(about)  # beyond double precision: every pair is computed exactly
    if same is not None:
        about[same] = np.inf
    kth = np.partition(about, m - 1, axis=1)[:, m - 1]
    a, b = np.nonzero((about <= (kth + 2 * error)[:, None]) & np.isfinite(about))
    d = np.empty(len(a))
    for i in range(0, len(a), 1 << 16):
        apart = np.abs(q[a[i : i + (1 << 16)]] - x[b[i : i + (1 << 16)]])
        d[i : i + (1 << 16)] = np.sqrt((apart * apart).sum(1))
    return a, b, d


def packs(pivots: np.ndarray, size: np.ndarray, p: int, slice_rows: int) -> np.ndarray:
    """The pack of each cell: cells in a chain of nearest pivots, as many as have slice_rows rows between them; in few dimensions each by itself."""
    if p != 2 or pivots.shape[1] < PACKED:
        return np.arange(len(pivots))
    out, pack, rows, at, left = np.zeros(len(pivots), int), 0, 0, 0, np.ones(len(pivots), bool)
    for _ in range(len(pivots)):
        if rows and rows + size[at] > slice_rows:
            pack, rows = pack + 1, 0
        out[at], rows, left[at] = pack, rows + size[at], False
        at = int(np.where(left, distances(pivots[at : at + 1], pivots, p)[0], np.inf).argmin())
    return out


def pieces(batches, rows: int = 1024):
    """The batches, in pieces of at most that many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class Index:
    """The dealt training rows: a written table (cell, slice, id, v, label), the pivots, and each cell's radius and rows."""

    def __init__(self, path: str, pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, p: int):
        self.path, self.pivots, self.radius, self.size, self.p = path, pivots, radius, size, p

    @staticmethod
    def build(rows: DataFrame, p: int, path: str, max_pivots: int = MAX_PIVOTS, slice_rows: int = SLICE_ROWS, seed: int = 42) -> Index:
        """rows: (id, v, label), vectors of one length."""
        spark = rows.sparkSession
        n = rows.count()
        if not n:
            raise ValueError("there are no rows to learn from")
        wanted = int(min(max_pivots, max(1, np.sqrt(n))))
        share = min(1.0, 4.0 * wanted / n)
        drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) <= int((1 << 30) * share)).select("v").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(wanted).toArrow()
        if not drawn.num_rows:
            drawn = rows.select("v").limit(1).toArrow()
        pivots = np.unique(np.array(drawn.column("v").to_pylist(), float), axis=0)
        shared = spark.sparkContext.broadcast(pivots)

        def deal(batches):
            width = shared.value.shape[1]
            for batch in pieces(batches):
                d = distances(matrix(batch, "v", width), shared.value, p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell]), *[batch.column(c) for c in ("id", "v", "label")]], ["cell", "far", "id", "v", "label"])

        dealt = rows.select("id", "v", "label").mapInArrow(deal, f"cell int, far double, id long, v array<double>, label {rows.schema['label'].dataType.simpleString()}")
        whole = shared_path(spark, "knn-dealt")
        dealt.write.parquet(whole)
        dealt = spark.read.parquet(whole)
        cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
        radius = np.array([cells[c]["radius"] if c in cells else 0.0 for c in range(len(pivots))])
        size = np.array([cells[c]["n"] if c in cells else 0 for c in range(len(pivots))])
        pack = packs(pivots, size, p, slice_rows)
        rows_of = np.bincount(pack, size)
        slices = spark.createDataFrame([(c, int(k), max(1, -(-int(rows_of[k]) // slice_rows))) for c, k in enumerate(pack)], "cell int, pack int, slices int")
        # a row a pivot
        sliced = dealt.join(F.broadcast(slices), "cell").withColumn("cell", F.col("pack")).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(7)), F.col("slices")).cast("int"))
        sliced.select("cell", "slice", "id", "v", "label").write.mode("overwrite").parquet(path)
        return Index(path, pivots, radius, size, p)

    def _cells(self, queries: DataFrame, k: int, first: bool, slice_rows: int) -> DataFrame:
        """queries (q, v[, within]) -> (q, v, cell): the packs of the nearest cells that have k rows between them; else those other packs with a cell whose bound is within."""
        shared = queries.sparkSession.sparkContext.broadcast((self.pivots, self.radius, self.size, packs(self.pivots, self.size, self.p, slice_rows)))
        p = self.p

        def run(batches):
            pivots, radius, size, pack = shared.value
            full = np.flatnonzero(size)
            for batch in pieces(batches):
                d = distances(matrix(batch, "v", pivots.shape[1]), pivots, p)[:, full]
                order = np.argsort(d, axis=1, kind="stable")
                sizes = np.cumsum(size[full][order], 1)
                # in order of distance: what is needed for k rows
                ahead = np.concatenate([np.zeros((len(d), 1)), sizes[:, :-1]], 1) < k
                met = np.zeros((len(d), pack.max() + 1), bool)
                row, place = np.nonzero(ahead)
                met[row, pack[full[order[row, place]]]] = True
                if not first:
                    near = np.take_along_axis(d, order, 1)
                    slack = ROUNDING * (near + radius[full][order])
                    bound = np.maximum(near - radius[full][order], (near - near[:, :1]) / 2) - slack
                    within = batch.column("within").to_numpy(zero_copy_only=False)
                    row, place = np.nonzero(bound <= within[:, None])
                    more = np.zeros_like(met)
                    more[row, pack[full[order[row, place]]]] = True
                    met = more & ~met
                row, to = np.nonzero(met)
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(to.astype(np.int32))], ["q", "v", "cell"])

        return queries.mapInArrow(run, "q long, v array<double>, cell int")

    def _meet(self, spark, asked: DataFrame, k: int, n_queries: int, slice_rows: int, group_rows: int, others: bool) -> DataFrame:
        """(q, v, cell) -> (q, id, label, d, compared): the k nearest rows of each slice that a query meets."""
        rows = spark.read.parquet(self.path)
        rows_of = np.bincount(packs(self.pivots, self.size, self.p, slice_rows), self.size)
        slices = spark.createDataFrame([(c, max(1, -(-int(n) // slice_rows))) for c, n in enumerate(rows_of)], "cell int, slices int")
        groups = max(1, -(-n_queries // group_rows))
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        label = rows.schema["label"].dataType.simpleString()
        left = rows.select("cell", "slice", each(F.lit(groups)).alias("g"), F.lit(0).alias("is_query"), "id", "v", "label")
        right = asked.join(F.broadcast(slices), "cell").select("cell", each(F.col("slices")).alias("slice"), F.pmod(F.xxhash64("q", F.lit(11)), F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("is_query"), F.col("q").alias("id"), "v", F.lit(None).cast(label).alias("label"))
        keys = ["cell", "slice", "g"]
        dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "is_query")
        width, p = self.pivots.shape[1], self.p

        def run(batches):
            now, ids, x, labels = None, [], [], []
            for batch in batches:
                table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "is_query")])
                cuts = np.r_[0, np.flatnonzero((table[:, 1:] != table[:, :-1]).any(0)) + 1, batch.num_rows]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    part = batch.slice(a, b - a)
                    if now != tuple(table[:3, a]):
                        now, ids, x, labels = tuple(table[:3, a]), [], [], []
                    if not table[3, a]:
                        ids.append(part.column("id").to_numpy())
                        x.append(matrix(part, "v", width))
                        labels.append(part.column("label"))
                        continue
                    if not ids:
                        continue
                    if len(ids) > 1:
                        ids, x, labels = [np.concatenate(ids)], [np.concatenate(x)], [pa.concat_arrays(labels)]
                    yield _best(part.column("id").to_numpy(), matrix(part, "v", width), ids[0], x[0], labels[0], k, p, others)

        return dealt.mapInArrow(run, f"q long, id long, label {label}, d double, compared long")

    def nearest(self, queries: DataFrame, k: int, slice_rows: int = SLICE_ROWS, group_rows: int = GROUP_ROWS, others: bool = False) -> DataFrame:
        """(q, v), q distinct -> (q, id, label, d, r, compared): the k nearest training rows of each, r from 1; compared: distances computed for the query.

        others: a training row whose id is q is none of its neighbours.
        """
        spark = queries.sparkSession
        path = shared_path(spark, "knn-queries")
        queries.select("q", "v").write.parquet(path)
        queries = spark.read.parquet(path)
        n, need = queries.count(), k + others
        ranked = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k)
        first, second = shared_path(spark, "knn-first"), shared_path(spark, "knn-second")
        self._meet(spark, self._cells(queries, need, True, slice_rows), k, n, slice_rows, group_rows, others).write.parquet(first)
        first = spark.read.parquet(first)
        bounds = first.groupBy("q").agg(F.count("*").alias("m"), F.sort_array(F.collect_list("d")).alias("ds")).select("q", F.when(F.col("m") >= k, F.element_at("ds", k)).otherwise(F.lit(float("inf"))).alias("within"))
        asked = queries.join(bounds.hint("merge"), "q", "left").select("q", "v", F.coalesce("within", F.lit(float("inf"))).alias("within"))
        self._meet(spark, self._cells(asked, need, False, slice_rows), k, n, slice_rows, group_rows, others).write.parquet(second)
        both = first.unionByName(spark.read.parquet(second))
        compared = both.groupBy(F.col("q").alias("__q")).agg(F.sum("compared").alias("of"))
        return ranked(both.drop("compared")).join(compared.hint("merge"), F.col("q") == F.col("__q")).select("q", "id", "label", "d", "r", F.col("of").alias("compared"))


def _best(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, labels: pa.Array, k: int, p: int, others: bool) -> pa.RecordBatch:
    """The k nearest rows of a slice for each query; `compared` counts the slice's rows on the first of them."""
    out = []
    for i in range(0, len(q), 256):
        a, b, d = near_pairs(q[i : i + 256], x, k, p, q_id[i : i + 256, None] == ids[None, :] if others else None)
        order = np.lexsort((ids[b], d, a))
        a, b, d = a[order], b[order], d[order]
        take = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, d = a[take], b[take], d[take]
        out.append((i + a, b, d, np.where(np.arange(len(a)) == np.searchsorted(a, a), len(ids), 0)))
    a, b, d, n = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(q_id[a]), pa.array(ids[b]), labels.take(pa.array(b)), pa.array(d), pa.array(n.astype(np.int64))], ["q", "id", "label", "d", "compared"])


def weights(near: DataFrame, weighted: bool) -> Column:
    """A neighbour's weight: one, or the inverse of its distance; where neighbours are at distance zero, only they count."""
    if not weighted:
        return F.lit(1.0)
    return F.when(F.min("d").over(Window.partitionBy("q")) == 0, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))


def _array(df: DataFrame, column: str) -> Column:
    return vector_to_array(quoted(column)) if isinstance(df.schema[column].dataType, VectorUDT) else F.transform(quoted(column), lambda v: v.cast("double"))


class KNN(_Fitting):
    """k nearest neighbours: a vote (task classification) or a mean, uniform or weighted by inverse distance, p 1 or 2."""

    @keyword_only
    def __init__(self, task=None, featuresCol=None, labelCol=None, predictionCol=None, k=None, weighted=None, p=None, n_classes=None):  # noqa: N803
        super().__init__()
        self._init(task="classification", featuresCol="features", labelCol="label", predictionCol="prediction", k=5, weighted=False, p=2, n_classes=2)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> KNNModel:
        get = self.getOrDefault
        rows = df.select(_array(df, get("featuresCol")).alias("v"), quoted(get("labelCol")).cast("double").alias("label")).where("label IS NOT NULL AND v IS NOT NULL")
        first = rows.select(F.size("v")).first()
        if first is None:
            raise ValueError("there are no rows to learn from")
        spark, numbered = df.sparkSession, shared_path(df.sparkSession, "knn-rows")
        rows.where(sound(F.col("v"), first[0])).withColumn("id", F.monotonically_increasing_id()).write.parquet(numbered)
        path = shared_path(spark, "knn-index")
        index = Index.build(spark.read.parquet(numbered), get("p"), path)
        return KNNModel({c: get(c) for c in ("task", "featuresCol", "labelCol", "predictionCol", "k", "weighted", "p", "n_classes")} | {"path": path, "pivots": index.pivots.tolist(), "radius": index.radius.tolist(), "size": index.size.tolist()})


class _IndexWriter(DefaultParamsWriter):
    """Writes the index into the model's own folder."""

    def saveImpl(self, path: str) -> None:  # noqa: N802
        state = self.instance.fitted
        self.sparkSession.read.parquet(state["path"]).write.parquet(f"{path}/index")
        own = self.instance.copy()
        own._set(state=json.dumps(state | {"path": "index"}))
        DefaultParamsWriter(own).saveImpl(path)


class _IndexReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model._set(state=json.dumps(model.fitted | {"path": f"{path}/index"}))
        return model


class KNNModel(_Fitted):
    """Adds prediction, and for classes probability (the neighbours' shares of the vote, by label 0, 1, ...)."""

    def write(self) -> DefaultParamsWriter:
        return _IndexWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _IndexReader(cls)

    @property
    def index(self) -> Index:
        s = self.fitted
        return Index(s["path"], np.array(s["pivots"]), np.array(s["radius"]), np.array(s["size"]), s["p"])

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """(q, v) -> the neighbours, as Index.nearest gives them."""
        return self.index.nearest(queries, self.fitted["k"])

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        to, path = s["predictionCol"], shared_path(df.sparkSession, "knn-asked")
        df.drop(to, "probability").withColumn("__q", F.monotonically_increasing_id()).write.parquet(path)
        asked = df.sparkSession.read.parquet(path)
        width = len(s["pivots"][0])
        near = self.neighbours(asked.select(F.col("__q").alias("q"), _array(asked, s["featuresCol"]).alias("v")).where(sound(F.col("v"), width)))
        near = near.withColumn("w", weights(near, s["weighted"]))
        if s["task"] == "regression":
            found = near.groupBy("q").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias(to))
            extra = []
        else:
            votes = near.groupBy("q", "label").agg(F.sum("w").alias("w"))
            shares = votes.groupBy("q").agg(F.min(F.struct((-F.col("w")).alias("less"), "label"))["label"].alias(to), F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "w"))).alias("__w"), F.sum("w").alias("__all"))
            share = F.transform(F.sequence(F.lit(0), F.lit(s["n_classes"] - 1)), lambda i: F.coalesce(F.try_element_at("__w", i), F.lit(0.0)) / F.col("__all"))
            found = shares.select("q", to, array_to_vector(share).alias("probability"))
            extra = ["probability"]
        return asked.join(found, F.col("__q") == F.col("q"), "left").select(*[quoted(c) for c in df.columns if c not in (to, "probability")], to, *extra)
