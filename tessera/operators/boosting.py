"""Second-order boosting: histogram trees grown leaf-wise, softmax for several classes in one model.

Columns are cut into bins at approximate quantiles once, and rows are written in blocks: the bins of a block's rows as bytes, column by column,
and their labels, weights and margins as numbers, so that a task takes a block at once and no row by itself. A round makes one tree for each class (one
for two classes or a number): the leaves of greatest gain are split first, up to num_leaves and max_depth. Gradients and second
derivatives are added up by leaf, column and bin in every task, and over the tasks by strips; of two children only the one with fewer
rows is counted, the other is what its parent has more. A job counts for all leaves that are split together, the better half of those
that can be; leaves that nothing can split any more have their values from their parent's sums and aren't counted. Margins are written with the rows every `written` rounds; in between, tasks add up the trees made since.

Gain and values have L2 penalty reg_lambda; rows are sampled for a tree by a hash, columns by a seeded draw.

Defined cases: rows whose vector is null, of another length than the first's or not all finite, or whose label is null, take no part in
training and get a null prediction; a label without variance, or columns without, give a model of a constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quoted, shared_path
from ..functions.blocks import collected, matrix, sound
from .clean import _Fitted, _Fitting
from .kernels import as_array

ACCURACY = 10_000
#: The least gain of a split, and rows and bins of a block at most.
LEAST, PIECE, BLOCK = 1e-10, 1 << 14, 1 << 22
#: Bytes of blocks that are sent to a task's Python at once, unless the session says otherwise.
AT_ONCE = 8 << 20


class Tree:
    """Nodes as arrays: the column and the last bin that goes left (-1: a leaf), the children, and a leaf's value."""

    def __init__(self):
        self.column, self.last, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, column: int, last: int) -> tuple[int, int]:
        self.column[node], self.last[node] = column, last
        for side in (self.left, self.right):
            side[node] = len(self.column)
            for values, new in ((self.column, -1), (self.last, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                values.append(new)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v) for v in (self.column, self.last, self.left, self.right, self.value))


def leaves(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The leaf of each row of bins, which are columns x rows."""
    column, last, left, right, _ = tree
    n = codes.shape[1]
    if len(column) <= 256:  # from the last node up, as children come after their parent: for each row, the leaf it would reach from there
        at: list = [np.uint8(node) for node in range(len(column))]
        for node in range(len(column) - 1, -1, -1):
            if column[node] >= 0:
                at[node] = np.where(codes[column[node]] <= int(last[node]), at[left[node]], at[right[node]])
                at[left[node]] = at[right[node]] = None
        return at[0] if column[0] >= 0 else np.zeros(n, np.uint8)
    at = np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        node = at[live]
        at[live] = np.where(codes[column[node], live] <= last[node], left[node], right[node])
        live = live[column[at[live]] >= 0]
    return at


def kept_rows(ids: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is taught with: a hash of their number, the tree and the seed."""
    if share >= 1:
        return np.ones(len(ids), bool)
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + tree + 1_000_003 * seed)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(share * 2**64) - 1 if share > 0 else 0)


def slopes(margin: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivative of the loss, a column for each tree of a round."""
    if loss == "squares":
        return margin - y[:, None], np.ones_like(margin)
    if loss == "two":
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-12)
    p = shares(margin)
    k = margin.shape[1]
    return p - (y[:, None] == np.arange(k)), np.maximum(p * (1 - p), 1e-12) * (k / (k - 1))


def shares(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class HistogramBoosting(_Fitting):
    """weightCol weighs rows; max_depth below one is no limit."""

    @keyword_only
    def __init__(self, task=None, featuresCol=None, labelCol=None, predictionCol=None, weightCol=None, n_classes=None, trees=None, learning_rate=None, num_leaves=None, max_depth=None, min_samples_leaf=None, min_child_weight=None, reg_lambda=None, subsample=None, colsample=None, bins=None, written=None, seed=None):  # noqa: N803
        super().__init__()
        self._init(task="classification", featuresCol="features", labelCol="label", predictionCol="prediction", weightCol="", n_classes=2, trees=100, learning_rate=0.1, num_leaves=31, max_depth=-1, min_samples_leaf=20, min_child_weight=1e-3, reg_lambda=1.0, subsample=1.0, colsample=1.0, bins=64, written=10, seed=42)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> HistogramBoostingModel:
        get = self.getOrDefault
        spark = df.sparkSession
        weight = quoted(get("weightCol")).cast("double") if get("weightCol") else F.lit(1.0)
        rows = df.select(as_array(df, get("featuresCol")).alias("x"), quoted(get("labelCol")).cast("double").alias("y"), weight.alias("w")).where("x IS NOT NULL AND y IS NOT NULL AND w > 0")
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("there are no rows to learn from")
        width = first[0]
        rows = rows.where(sound(F.col("x"), width))
        edges = bin_edges(rows, width, min(get("bins"), 255))
        loss = "squares" if get("task") == "regression" else "two" if get("n_classes") <= 2 else "many"
        each = get("n_classes") if loss == "many" else 1
        start = self._start(rows, loss, each)
        path = shared_path(spark, "boosting")
        binned(rows.withColumn("id", F.monotonically_increasing_id()), edges, start).write.parquet(path)
        table = blocks(spark, path)
        rng = np.random.default_rng(get("seed"))
        done: list[list[tuple]] = []
        since: list[list[tuple]] = []
        for t in range(get("trees")):
            columns = [np.sort(rng.permutation(width)[: max(1, round(get("colsample") * width))]) for _ in range(each)]
            made = self._grow(table, since, t, width, each, loss, [len(e) + 1 for e in edges], columns)
            done.append(made)
            since.append(made)
            if all(tree[0][0] < 0 for tree in made) and get("subsample") >= 1 and get("colsample") >= 1:
                break  # nothing is left to gain
            if len(since) == get("written"):
                path = shared_path(spark, "boosting")
                moved(table, since, width, each).write.parquet(path)
                table, since = blocks(spark, path), []
        state = {c: get(c) for c in ("task", "featuresCol", "predictionCol", "n_classes")}
        return HistogramBoostingModel(state | {"edges": [e.tolist() for e in edges], "start": start, "loss": loss, "trees": [[[v.tolist() for v in tree] for tree in made] for made in done]})

    def _start(self, rows: DataFrame, loss: str, each: int) -> list[float]:
        if loss != "many":
            mean = rows.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0] or 0.0
            return [float(mean)] if loss == "squares" else [float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))]
        counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("w").alias("n")).collect()}
        return [float(np.log(max(counts.get(float(k), 0.0), 1e-6) / sum(counts.values()))) for k in range(each)]

    def _grow(self, table: DataFrame, since: list, t: int, width: int, each: int, loss: str, bins: list[int], columns: list[np.ndarray]) -> list[tuple]:
        get = self.getOrDefault
        most = max(bins)
        trees = [Tree() for _ in range(each)]
        state = [{"leaves": 1, "open": {}} for _ in range(each)]  # open: node -> (gain, column, last, histogram, depth)
        wanted = [(k, 0) for k in range(each)]
        parents: dict = {}
        while wanted:
            found = self._histograms(table, since, t, trees, wanted, width, most, loss, each)
            for k, node in wanted:
                ready = {node: found[k, node]}
                if (k, node) in parents:
                    other, whole = parents.pop((k, node))
                    ready[other] = whole - found[k, node]
                for leaf, h in ready.items():
                    depth = self._depth(trees[k], leaf)
                    trees[k].value[leaf] = self._value(h[0].sum(0))
                    best = self._best(h, columns[k], bins) if get("max_depth") < 1 or depth < get("max_depth") else None
                    if best:
                        state[k]["open"][leaf] = (*best, h)
            wanted = []
            for k, s in enumerate(state):
                order = sorted(s["open"], key=lambda leaf: (-s["open"][leaf][0], leaf))
                for leaf in order[: max(1, (len(order) + 1) // 2)]:
                    if s["leaves"] >= get("num_leaves"):
                        break
                    _, column, last, h = s["open"].pop(leaf)
                    left, right = trees[k].split(leaf, column, last)
                    s["leaves"] += 1
                    sums = h[column, : last + 1].sum(0), h[column, last + 1 :].sum(0)
                    for child, of_child in zip((left, right), sums):
                        trees[k].value[child] = self._value(of_child)
                    small, large = (left, right) if sums[0][2] <= sums[1][2] else (right, left)
                    parents[k, small] = (large, h)
                    wanted.append((k, small))
            wanted = [(k, node) for k, node in wanted if state[k]["leaves"] < get("num_leaves")]  # the other trees are whole
        rate = get("learning_rate")
        for tree in trees:
            tree.value = [rate * v for v in tree.value]
        return [tree.arrays() for tree in trees]

    @staticmethod
    def _depth(tree: Tree, node: int) -> int:
        above = {c: p for p in range(len(tree.column)) if tree.column[p] >= 0 for c in (tree.left[p], tree.right[p])}
        depth = 0
        while node in above:
            node, depth = above[node], depth + 1
        return depth

    def _value(self, sums: np.ndarray) -> float:
        g, s, _ = sums
        return float(-g / (s + self.getOrDefault("reg_lambda") + 1e-12))

    def _best(self, h: np.ndarray, columns: np.ndarray, bins: list[int]) -> tuple[float, int, int] | None:
        """(gain, column, last bin to the left) of the best split, the first of equal ones."""
        get = self.getOrDefault
        penalty = get("reg_lambda") + 1e-12
        part = h[columns]
        left = np.cumsum(part, 1)[:, :-1]
        whole = part.sum(1)[:, None]
        right = whole - left
        score = lambda x: x[..., 0] ** 2 / (x[..., 1] + penalty)
        gain = score(left) + score(right) - score(whole)
        fits = (np.minimum(left[..., 2], right[..., 2]) >= max(1, get("min_samples_leaf"))) & (np.minimum(left[..., 1], right[..., 1]) >= get("min_child_weight"))
        gain = np.where(fits, gain, -np.inf)
        if not gain.size or gain.max() <= LEAST:
            return None
        i, last = np.unravel_index(int(gain.argmax()), gain.shape)
        return float(gain[i, last]), int(columns[i]), int(last)

    def _histograms(self, table: DataFrame, since: list, t: int, trees: list[Tree], wanted: list, width: int, most: int, loss: str, each: int) -> dict:
        """(tree, leaf) -> columns x bins x (gradient, second derivative, rows)."""
        seed, share = self.getOrDefault("seed"), self.getOrDefault("subsample")
        shared = table.sparkSession.sparkContext.broadcast((since, [tree.arrays() for tree in trees]))
        weighted, cells = bool(self.getOrDefault("weightCol")), width * most

        def work(batches):
            since, trees = shared.value
            out = np.zeros((3, width, len(wanted) * most))
            slots = {k: np.full(len(trees[k][0]), -1) for k, _ in wanted}
            for i, (k, leaf) in enumerate(wanted):
                slots[k][leaf] = i
            for block in blocks_of(batches, width, each):
                g, s = slopes(margins(block, since), block["y"], loss)
                sampled = kept_rows(block["id"], t, seed, share) if share < 1 else None
                for k, slot in slots.items():
                    at = slot[leaves(trees[k], block["codes"])]
                    of = np.flatnonzero(at >= 0 if sampled is None else (at >= 0) & sampled)
                    if not len(of):
                        continue
                    first = at[of] * most
                    gradient, second = g[of, k], s[of, k]
                    if weighted:
                        gradient, second = gradient * block["w"][of], second * block["w"][of]
                    for c in range(width):
                        cell = first + block["codes"][c, of]
                        for j, value in enumerate((gradient, second, None)):
                            out[j, c] += np.bincount(cell, value, len(wanted) * most)
            return out.reshape(3, width, len(wanted), most).transpose(2, 1, 3, 0).reshape(len(wanted), cells * 3)

        table = table.select("n", "codes", "y", "margin", *(["w"] if weighted else []), *(["id"] if share < 1 else []))
        found = collected(table, work, len(wanted), cells * 3)
        shared.unpersist()
        return {key: found[i].reshape(width, most, 3) for i, key in enumerate(wanted)}


#: The numbers of a block that are binary columns.
PARTS = {"id": np.int64, "y": np.float64, "w": np.float64, "margin": np.float64}
BLOCKS = "n int, id binary, codes binary, y binary, w binary, margin binary"


def blocks(spark, path: str) -> DataFrame:
    """Blocks that were written. 10,000 of them, as many as Spark sends at once if it counts rows only, are too much."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in spark.conf.getAll:
        spark.conf.set(limit, str(AT_ONCE))
    return spark.read.parquet(path)


def blocks_of(batches, width: int, each: int):
    """Of each block, its parts as arrays: codes as columns x rows, margins as rows x trees of a round."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            block = {c: np.frombuffer(row[c], kind) for c, kind in PARTS.items() if c in row}
            block["margin"] = block["margin"].reshape(n, each)
            block["codes"] = np.frombuffer(row["codes"], np.uint8).reshape(width, n)
            yield block


def margins(block: dict, since: list) -> np.ndarray:
    out = block["margin"].copy()
    for made in since:
        for k, tree in enumerate(made):
            out[:, k] += tree[4][leaves(tree, block["codes"])]
    return out


def packed(codes: np.ndarray, **parts: np.ndarray) -> pa.RecordBatch:
    """A block as a row."""
    row = {"n": codes.shape[1], "codes": np.ascontiguousarray(codes)} | {c: np.ascontiguousarray(parts[c], kind) for c, kind in PARTS.items()}
    names = ["n", "id", "codes", "y", "w", "margin"]
    return pa.RecordBatch.from_arrays([pa.array([row[c]], pa.int32()) if c == "n" else pa.array([row[c].tobytes()], pa.binary()) for c in names], names)


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Of each column, the distinct approximate quantiles below its largest value: a value's bin is how many of them are below it."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", at, ACCURACY).alias("q"), F.max("v").alias("most")).collect()
    edges = {r["i"]: np.unique([q for q in r["q"] if q < r["most"]]) for r in found}
    return [np.asarray(edges.get(i, []), float) for i in range(width)]


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bins of rows x columns, as columns x rows."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8) if edges else np.zeros((0, len(x)), np.uint8)


def binned(rows: DataFrame, edges: list[np.ndarray], start: list[float]) -> DataFrame:
    """(id, x, y, w) -> blocks, with the margins that all rows start from."""
    width = len(edges)
    most = max(1, min(PIECE, BLOCK // max(1, width)))

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, most):
                batch = whole.slice(i, most)
                parts = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "w")}
                yield packed(coded(matrix(batch, "x", width), edges), margin=np.tile(start, (batch.num_rows, 1)), **parts)

    return rows.select("id", "x", "y", "w").mapInArrow(run, BLOCKS)


def moved(table: DataFrame, since: list, width: int, each: int) -> DataFrame:
    """The blocks with the margins after the trees made since."""
    shared = table.sparkSession.sparkContext.broadcast(since)

    def run(batches):
        for block in blocks_of(batches, width, each):
            yield packed(**(block | {"margin": margins(block, shared.value)}))

    return table.mapInArrow(run, BLOCKS)


class HistogramBoostingModel(_Fitted):
    """Adds prediction, and for classes probability."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        width, each = len(s["edges"]), len(s["start"])
        shared = df.sparkSession.sparkContext.broadcast(([np.array(e, float) for e in s["edges"]], [[tuple(np.array(v) for v in tree) for tree in made] for made in s["trees"]]))
        start, loss = np.array(s["start"]), s["loss"]

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scored(x: pa.Array) -> pa.Array:
            edges, trees = shared.value
            there = x.is_valid().to_numpy(zero_copy_only=False)
            rows = x.drop_null()
            n = len(rows)
            values = rows.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            margin = np.tile(start, (n, 1))
            for i in range(0, n, PIECE):
                codes = coded(values[i : i + PIECE], edges)
                for made in trees:
                    for k, tree in enumerate(made):
                        margin[i : i + PIECE, k] += tree[4][leaves(tree, codes)]
            if loss == "two":
                p = 1 / (1 + np.exp(-margin))
                margin = np.column_stack([1 - p, p])
            elif loss == "many":
                margin = shares(margin)
            at = np.r_[0, np.cumsum(there) * margin.shape[1]]
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(margin.reshape(-1)), mask=pa.array(~there))

        x, to = as_array(df, s["featuresCol"]), s["predictionCol"]
        made = df.drop(to, "probability").withColumn(to, scored(F.when(sound(x, width), x)))
        value = quoted(to)
        if loss == "squares":
            return made.withColumn(to, value[0])
        best = (F.array_position(value, F.array_max(value)) - 1).cast("double")
        return made.withColumn("probability", F.when(value.isNotNull(), array_to_vector(value))).withColumn(to, best)
