"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Largest inner products become smallest angles: every vector gets one more component, which fills its length up to that
of the longest, and queries get a zero there. Codes are the signs of these vectors turned by several learned
rotations (iterative quantisation: each starts at a random rotation and alternates between signs and the orthogonal
Procrustes solution), fitted on a bounded sample of max_train vectors. A code is split into substrings of 16 bits, and
each block of vectors has, for every substring, a table from its value to the vectors that have it.

A query probes each table with all values that differ from its own substring in at most `reach` bits, for reach 0, 1,
2, ... By the pigeonhole principle this retrieves every code within the Hamming radius m * (reach + 1) - 1, for m
substrings; farther codes are retrieved as well where one of their substrings is near. The k-th best score so far bounds
the angle of the neighbours that are missing, and with it the distribution of their bits: the reach grows until a
neighbour at that angle would have been retrieved but with probability `miss`. Of the codes retrieved, those whose
whole code is no farther than that distribution's mean plus `spread` standard deviations are reranked by the inner
product of the original vectors in double precision. Beyond max_reach, where there are more values to probe than
vectors, the codes not yet retrieved are all compared; so nothing is out of reach.

Vectors are dealt into blocks of block_rows by a hash of their id, and the queries (a stated set, in groups of
query_rows) are shipped to every block: a task indexes its block once, and the queries stream past it. Each query
brings k rows back from each block.

Defined cases: vectors that are null, empty, zero, of another dimension than most, or that hold null or non-finite
components take no part; a null vec_id takes no part; repeated rows are candidates each (a row's own is any with its
vec_id); ties go to the smaller vec_id; with fewer candidates than k all are returned; extra columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
MAX_TRAIN = 20_000
#: Substrings of 16 bits each.
SUBSTRINGS = 32
BLOCK_ROWS = 16_384
QUERY_ROWS = 65_536
MISS = 0.1
SPREAD = 2.5
MAX_REACH = 4
_BITS = 16
_COUNT = np.bitwise_count(np.arange(1 << _BITS, dtype=np.uint16))
#: The 16-bit values of each number of bits.
_MASKS = [np.flatnonzero(_COUNT == r).astype(np.uint16) for r in range(_BITS + 1)]


def learn(sample: np.ndarray, bits: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """dim x bits projection: rotations fitted to the unit vectors of the sample, as many as the bits need."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    out = []
    for _ in range(-(-bits // dim)):
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(rounds if len(x) >= dim else 0):
            u, _, v = np.linalg.svd(x.T @ np.sign(x @ turn))
            turn = u @ v
        out.append(turn)
    return np.concatenate(out, 1)[:, :bits]


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more component, which makes each as long as the longest."""
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0.0))])


def codes(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The substrings of the codes, a row each."""
    return np.packbits(x @ turn > 0, axis=1).view(np.uint16)


def missed(angle: float, reach: int, substrings: int) -> float:
    """The probability that no substring of a neighbour at that angle (as a share of a half turn) differs in at most reach bits."""
    return (1.0 - sum(comb(_BITS, i) * angle**i * (1 - angle) ** (_BITS - i) for i in range(reach + 1))) ** substrings


class Index:
    """A block of vectors with a table for each substring."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.turn, self.longest = ids[order], x[order], turn, longest
        sub = codes(lengthened(self.x, longest), turn)
        self.m, n = sub.shape[1], len(ids)
        self.words = self._words(sub)
        self.rows = np.concatenate([np.argsort(sub[:, j], kind="stable") for j in range(self.m)]).astype(np.int32)
        size = np.stack([np.bincount(sub[:, j], minlength=1 << _BITS) for j in range(self.m)])
        first = np.concatenate([np.zeros((self.m, 1), np.int64), np.cumsum(size, 1)], 1)
        self.first = (first + n * np.arange(self.m)[:, None]).astype(np.int32).reshape(-1)
        self.table = ((1 << _BITS) + 1) * np.arange(self.m)[:, None]

    def _words(self, sub: np.ndarray) -> np.ndarray:
        return np.concatenate([sub, np.zeros((len(sub), -self.m % 4), np.uint16)], 1).view(np.uint64)

    def probe(self, sub: np.ndarray, reach: int) -> np.ndarray:
        """Which rows have a substring that differs from that of sub in exactly reach bits."""
        at = (self.table + (sub[:, None] ^ _MASKS[reach][None, :])).reshape(-1)
        low = self.first[at]
        n = self.first[at + 1] - low
        full = np.flatnonzero(n)
        low, n = low[full], n[full]
        hit = np.zeros(len(self.ids), bool)
        hit[self.rows[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        return hit

    def scores(self, rows: np.ndarray, q: np.ndarray, k: int, slack: float) -> np.ndarray:
        """The inner products of rows with q. A matrix product rounds a row by its place, so those that may be among the k largest are summed again, each row alike: equal vectors score the same."""
        out = self.x[rows] @ q
        close = np.flatnonzero(out >= np.partition(out, len(out) - k)[len(out) - k] - slack) if len(out) > k else np.arange(len(out))
        out[close] = (self.x[rows[close]] * q).sum(1)
        return out

    def search(self, query_id: int, q: np.ndarray, k: int = K, miss: float = MISS, spread: float = SPREAD, max_reach: int = MAX_REACH) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k nearest found, nearest first, ties to the smaller id; how many codes were retrieved."""
        sub = codes(np.append(q, 0.0)[None, :], self.turn)
        code, sub = self._words(sub), sub[0]
        bits, norm = _BITS * self.m, np.linalg.norm(q)
        slack = 4 * len(q) * np.finfo(float).eps * norm * self.longest
        open_rows = self.ids != query_id
        best, score = np.zeros(0, np.int64), np.zeros(0)
        radius, retrieved = bits, 0
        for reach in range(max_reach + 2):
            new = np.flatnonzero(open_rows & self.probe(sub, reach) if reach <= max_reach else open_rows)
            open_rows[new] = False
            retrieved += len(new)
            near = new[np.bitwise_count(self.words[new] ^ code).sum(1, dtype=np.int64) <= radius] if radius < bits else new
            best, score = np.concatenate([best, near]), np.concatenate([score, self.scores(near, q, k, slack)])
            if len(best) > k:
                top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                best, score = best[top], score[top]
            if len(best) >= k:
                angle = float(np.arccos(np.clip(score.min() / (norm * self.longest), -1, 1)) / np.pi)
                radius = min(bits, int(np.ceil(bits * angle + spread * np.sqrt(bits * angle * (1 - angle)) + 1)))
                if missed(angle, reach, self.m) <= miss:
                    break
        order = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best][order], score[order], retrieved


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v: array<double>): the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    df = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return df.where((F.size("v") > 0) & sound)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(batches, dim: int, turn: np.ndarray, longest: float, how: dict):
    """(vb, qg, is_query, vec_id, v), a block's vectors before its queries -> (query_id, vec_id, score, retrieved, of)."""
    key, index, held = None, None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vb", "qg", "is_query")])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = batch.slice(a, b - a)
            if key != tuple(keys[:2, a]):
                key, index, held = tuple(keys[:2, a]), None, []
            if not keys[2, a]:
                held.append((part.column("vec_id").to_numpy(), _vectors(part, dim)))
                continue
            if index is None and held:
                index, held = Index(*(np.concatenate(x) for x in zip(*held)), turn, longest), []
            if index is None:
                continue
            asked = part.column("vec_id").to_numpy()
            found = [index.search(q, v, **how) for q, v in zip(asked.tolist(), _vectors(part, dim))]
            n = [len(ids) for ids, _, _ in found]
            cols = [np.repeat(asked, n), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat([f[2] for f in found], n), np.repeat(len(index.ids), sum(n))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score", "retrieved", "of"])


def nearest(vectors: DataFrame, every: int = 20, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, max_train: int = MAX_TRAIN, substrings: int = SUBSTRINGS, miss: float = MISS, spread: float = SPREAD) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score, share): the k nearest of each row whose vec_id is divisible by every.

    share: of the codes of the blocks that these rows came from, the part that was retrieved for the query.
    """
    spark = vectors.sparkSession
    sound = written(usable(vectors), "ann-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    dims = sound.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("asked")).orderBy(F.desc("n"), "dim").first()
    if dims is None or not dims["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, share double")
    dim, longest = dims["dim"], dims["longest"]
    sound = sound.where(F.size("v") == dim)
    share = min(1.0, max_train / dims["n"])
    sample = sound.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * share)).select("v").toPandas()["v"]
    turn = learn(lengthened(np.stack(sample.to_list()), longest) if len(sample) else np.eye(dim + 1), _BITS * substrings)
    shared = spark.sparkContext.broadcast(turn)
    blocks, groups = -(-dims["n"] // block_rows), -(-dims["asked"] // query_rows)
    number = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = sound.select(number(1, blocks).alias("vb"), each(groups).alias("qg"), F.lit(0).alias("is_query"), "vec_id", "v")
    asked = sound.where(F.pmod("vec_id", F.lit(every)) == 0).select(each(blocks).alias("vb"), number(2, groups).alias("qg"), F.lit(1).alias("is_query"), "vec_id", "v")
    dealt = rows.unionByName(asked).repartition(2 * blocks * groups, "vb", "qg").sortWithinPartitions("vb", "qg", "is_query")
    how = {"k": k, "miss": miss, "spread": spread}
    found = dealt.mapInArrow(lambda it: _search(it, dim, shared.value, longest, how), "query_id long, vec_id long, score double, retrieved long, of long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", (F.col("retrieved") / F.col("of")).alias("share"))
