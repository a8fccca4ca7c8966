"""Near-duplicate documents by DartMinHash signatures, a banded join and an exact check.

A document is a set of elements (hashes of runs of SHINGLE words; a document of fewer words, but not none, is one
element) with weights: 1 each by default, so that similarity is the Jaccard similarity of the shingle sets, or the
number of occurrences, which gives the weighted Jaccard similarity.

DartMinHash (Christiani, 2020): imagine darts thrown, by a hash seeded with the element and nothing else, at the
plane of weight x rank of every element, one a unit of area on average. A document of total weight W looks at the
darts in the rectangles [0, weight) x [0, t / W) of its elements, about t of them whatever its size; each dart has
a coordinate of the signature, and the one of the lowest rank of each coordinate is kept. Two documents agree in a
coordinate with a probability equal to their weighted similarity. The darts of an element come from cells (a
weight interval and a rank interval, both doubling), each with a number of darts drawn from a Poisson law, so that
only cells that a document can see are ever filled. A coordinate that no dart reached (a document in e^-(t/k) of
them) is filled by looking twice as far.

Documents with the same run of words are one from the start. Bands of the signatures are joined on: the documents of a
bucket are held against the bucket's leader, which is the one that shares buckets with the most documents
(so that the original of many copies leads, not one of the copies). Buckets that then hold documents of one class
are done, so a group of copies isn't expanded into all its pairs. In those that hold several classes, LEADERS
leaders, and at last all documents, meet those of other classes. A pair is a candidate only if its signatures agree in about as many
coordinates as those of similar texts do, and is confirmed by the exact similarity of its elements. Classes are the connected
components of the confirmed links, found by propagating least ids with pointer jumping.

What the first round measures spares later ones much: each document then has a pivot, the most widespread of the
documents that it was held against, the weight it shares with the pivot, and a bitmap of the elements beyond that.
Two documents of one pivot share no more than the lesser of their shares with it and what their bitmaps have in
common (counting all that fell on a bit taken before). Where even that is too little for the similarity asked, the
pair is no link, and isn't made. So a group of copies that lie just under the threshold isn't expanded into its pairs.

Defined cases: a null text or one without words is like no other and forms a class of its own; copies of a text
share a class; the rows of one doc_id are one document (its links are those of any of its texts); a row with a null
doc_id takes no part (null class_id); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, in_batches, quoted, slices, utf8, written
from .decontam import Words

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
#: Ids, or pairs of them, that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Leaders of a bucket in the second round.
LEADERS = 64
#: 64-bit words of the bitmap of what a document has beyond its pivot.
BITMAP = 8
#: Rows of a block of a bucket in the last round, and of those that meet a group's rows at once.
BLOCK = 2048
#: Followers of a leader that one task may get, whatever part of all they are.
FOLLOWERS = 512
MEET_ROWS = 256
#: Standard deviations under the agreement of similar texts at which signatures still make a candidate: of pairs at the threshold itself, one in a hundred million is below.
SLACK = 6.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(words: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, occurrences) of each distinct element, sorted by document and element."""
    n = np.maximum(words.count - shingle + 1, np.minimum(words.count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + words.first[:-1][doc]
    left = np.minimum(words.count, shingle)[doc]
    code = np.zeros(len(doc), np.uint64)
    for k in range(shingle):
        there = k < left
        code = np.where(there, mix(code + words.hash[np.minimum(at + k, max(len(words.hash) - 1, 0))] + _MIX) if len(doc) else code, code)
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return doc[first], code[first], np.diff(np.r_[first, len(doc)])


#: Ranks are split at LOWEST * 2^r; a cell of the first weight and rank intervals has LOWEST darts on average.
LOWEST = 0.5


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    top = int(mean + 12 * np.sqrt(mean) + 12)
    k = np.arange(top)
    log = k * np.log(mean) - mean - np.cumsum(np.log(np.maximum(k, 1)))
    return np.searchsorted(np.cumsum(np.exp(log)), u, "right")


def darts(code: np.ndarray, weight: np.ndarray, reach: np.ndarray):
    """(element's index, rank, hash) of the darts in [0, weight) x [0, reach) of each element."""
    out = []
    tall = 0
    while True:  # weight intervals [0, 1), [1, 2), [2, 4), ...
        low_w, high_w = (0.0, 1.0) if tall == 0 else (2.0 ** (tall - 1), 2.0**tall)
        use_w = np.flatnonzero(weight > low_w)
        if not len(use_w):
            break
        level = 0
        while True:  # rank intervals [0, LOWEST), [LOWEST, 2 LOWEST), ...
            low_r, high_r = (0.0, LOWEST) if level == 0 else (LOWEST * 2.0 ** (level - 1), LOWEST * 2.0**level)
            use = use_w[reach[use_w] > low_r]
            if not len(use):
                break
            cell = mix(code[use] + np.uint64((tall * 64 + level + 1) * int(_MIX) % (1 << 64)))
            count = _poisson(unit(cell), (high_w - low_w) * (high_r - low_r))
            hit = np.flatnonzero(count)
            n = count[hit]
            who = np.repeat(hit, n)
            h = mix(cell[who] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64) * _MIX)
            rank = low_r + unit(h) * (high_r - low_r)
            h = mix(h + _MIX)
            inside = (rank < reach[use[who]]) & (low_w + unit(h) * (high_w - low_w) < weight[use[who]])
            out.append((use[who][inside], rank[inside], mix(h[inside] + _MIX)))
            level += 1
        tall += 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def signatures(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k signatures (hash of the dart of least rank of each coordinate); documents without elements have zeros."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weight, n_docs)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pick = np.isin(doc, todo) if len(todo) < n_docs else np.ones(len(doc), bool)
        d, c, w = doc[pick], code[pick], weight[pick]
        who, rank, h = darts(c, w.astype(np.float64), reach[d])
        slot = d[who] * k + (h % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, h = slot[order], h[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        got = np.zeros(n_docs * k, bool)
        got[slot[first]] = True
        out.reshape(-1)[slot[first]] = mix(h[first] ^ _MIX) | np.uint64(1)
        short = got.reshape(n_docs, k)[todo].sum(1) < k
        todo = todo[short]
        reach = reach * 2
    return out


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        h = mix(h + sig[:, r::rows][:, :bands] + _MIX)
    return mix(h + np.arange(1, bands + 1).astype(np.uint64) * _MIX)


def _weights(count: np.ndarray, weighting: str) -> np.ndarray:
    return count if weighting == "count" else np.ones_like(count)


def _sketch(batches, bands: int, rows: int, shingle: int, weighting: str):
    """(doc_id, text) -> (doc_id, h1, h2, bands, sig): a 128-bit hash of the text's run of words (null without words), the hashes of the bands, and four bits of each coordinate."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in slices(off):
            here = off[i : j + 1] - off[i]
            words = Words(data[off[i] : off[j]], here)
            full = np.flatnonzero(words.count)
            runs = np.zeros((2, j - i), np.uint64)
            band = np.zeros((j - i, bands), np.uint64)
            packed = np.zeros((j - i, -(-bands * rows // 16)), np.uint64)
            if len(full):
                at = (np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.count)).astype(np.uint64)
                for out, salt in zip(runs, (1, 2)):
                    out[full] = np.add.reduceat(mix(words.hash * _MIX + mix(at + np.uint64(salt << 40))), words.first[:-1][full])
                doc, code, count = elements(words, shingle)
                sig = signatures(doc, code, _weights(count, weighting), j - i, bands * rows)
                band = _bands(sig, bands, rows)
                for k in range(sig.shape[1]):
                    packed[:, k // 16] |= (sig[:, k] >> np.uint64(60)) << np.uint64(4 * (k % 16))
            none = words.count == 0
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).reshape(-1))) for x in (band, packed)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(r.view(np.int64), mask=none) for r in runs), *lists], ["doc_id", "h1", "h2", "bands", "sig"])


def _element_rows(batches, shingle: int, weighting: str):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in slices(off):
            doc, code, count = elements(Words(data[off[i] : off[j]], off[i : j + 1] - off[i]), shingle)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            values = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(code.view(np.int64)))
            weights = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(_weights(count, weighting).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), values, weights], ["rep", "codes", "weights"])


def _compared(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The common weight of two sorted sets of elements, and the elements that each has beyond the other."""
    at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
    hit = np.flatnonzero(x[at] == y) if len(x) else np.zeros(0, np.int64)
    shared = np.minimum(wx[at[hit]], wy[hit])
    left_x, left_y = wx.copy(), wy.copy()
    left_x[at[hit]] -= shared
    left_y[hit] -= shared
    return int(shared.sum()), x[left_x > 0], y[left_y > 0]


def _bits(codes: np.ndarray) -> np.ndarray:
    """The bitmap of elements."""
    out = np.zeros(BITMAP, np.uint64)
    np.bitwise_or.at(out, (codes >> np.uint64(6)).astype(np.int64) % BITMAP, np.uint64(1) << (codes & np.uint64(63)))
    return out


def _similar(batches, least: float, measure: bool):
    """(lead, slice, follow (null: the leader itself), codes, weights, fames), a leader's rows before those of its followers -> whether the exact weighted Jaccard similarity of each pair is at least least.

    To measure, also the weights, the common weight, and bitmaps of what each side has beyond the other.
    """
    now, held = None, []
    for batch in batches:
        lead, part, follow = batch.column("lead").to_numpy(), batch.column("slice").to_numpy(), batch.column("follow")
        own, follow = follow.is_null().to_numpy(zero_copy_only=False), follow.fill_null(0).to_numpy(zero_copy_only=False)
        codes, weights = batch.column("codes"), batch.column("weights")
        rows = []
        for r in range(batch.num_rows):
            if now != (lead[r], part[r]):
                now, held = (lead[r], part[r]), []
            y, wy = codes[r].values.to_numpy().view(np.uint64), weights[r].values.to_numpy().astype(np.int64)  # in order as unsigned numbers
            if own[r]:
                held.append((y.copy(), wy, int(wy.sum())))
                continue
            of = int(wy.sum())
            for x, wx, whole in held:
                common, only_x, only_y = _compared(x, wx, y, wy)
                rows.append((r, common >= least * (whole + of - common) - 1e-9, whole, of, common, _bits(only_x) if measure else None, _bits(only_y) if measure else None))
        if not rows:
            continue
        at, linked, size, of, common, bits, other = zip(*rows)
        at = np.array(at)
        low = lead[at] < follow[at]
        out = {"a": np.minimum(lead[at], follow[at]), "b": np.maximum(lead[at], follow[at]), "linked": np.array(linked)}
        if measure:
            fames = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("lead_fame", "follow_fame")]
            either = lambda x, y: (np.where(low, x, y), np.where(low, y, x))
            (out["a_fame"], out["b_fame"]), (out["a_size"], out["b_size"]), out["common"] = either(*fames), either(np.array(size), np.array(of)), np.array(common)
            bits, other = np.stack(bits).view(np.int64), np.stack(other).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * BITMAP, pa.int32()), pa.array(x.reshape(-1))) for x in (np.where(low[:, None], bits, other), np.where(low[:, None], other, bits))]
            yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in out.values()], *lists], [*out, "a_bits", "b_bits"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))


def _judged(pairs: DataFrame, sets: DataFrame, similarity: float, measure: bool, max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """(lead, follow, and to measure lead_fame, follow_fame) -> (a, b, linked, ..), a < b, a row for each two texts of a pair.

    Followers bring their elements to their leader's task, where its own come first and once. The followers of a leader that has more than FOLLOWERS, and at
    least a thousandth of all, are cut into slices, each with a copy of the leader's elements; there are a thousand such leaders at most.
    """
    pairs = written(pairs, "neardup-pairs")
    counts = pairs.groupBy("lead").agg(F.count("*").alias("n"))
    total = pairs.count()
    few = F.broadcast if total <= max_broadcast else (lambda df: df)  # then elements are shuffled to their leader only, not to the pairs first
    large = counts.where(F.col("n") > max(FOLLOWERS, total / 1000)).select(F.col("lead").alias("__lead"), F.ceil(F.col("n") / max(FOLLOWERS, total // 1000)).cast("int").alias("slices"))
    sliced = lambda df: df.join(F.broadcast(large), F.col("lead") == F.col("__lead"), "left").withColumn("slices", F.coalesce("slices", F.lit(1))).drop("__lead")
    fames = ["lead_fame", "follow_fame"] if measure else []
    followers = sliced(pairs).select("lead", F.pmod(F.xxhash64("follow", F.lit("slice")), F.col("slices")).cast("int").alias("slice"), "follow", *fames)
    followers = sets.join(few(followers), F.col("follow") == F.col("rep")).select("lead", "slice", "follow", "codes", "weights", *fames)
    leaders = sliced(counts.select("lead")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    leaders = sets.join(few(leaders), F.col("lead") == F.col("rep")).select("lead", "slice", F.lit(None).cast("long").alias("follow"), "codes", "weights", *[F.lit(0).cast("long").alias(c) for c in fames])
    dealt = leaders.unionByName(followers).repartition("lead", "slice").sortWithinPartitions("lead", "slice", F.col("follow").asc_nulls_first())
    more = ", a_fame long, b_fame long, a_size long, b_size long, common long, a_bits array<long>, b_bits array<long>" if measure else ""
    return dealt.mapInArrow(lambda it: _similar(it, similarity, measure), "a long, b long, linked boolean" + more)


def _agree(a, b, k: int, similarity: float, slack: float):
    """Whether so many of k coordinates agree (in four bits each) as those of texts of that similarity do, but for slack standard deviations."""
    p = similarity + (1 - similarity) / 16
    least = int(k * p - slack * np.sqrt(k * p * (1 - p)))
    differ = None
    for i in range(-(-k // 16)):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
        differ = n if differ is None else differ + n
    return differ <= k - least


def _pivots(measured: DataFrame, similarity: float) -> DataFrame:
    """(rep, PIVOT): of each rep the most widespread document that it was held against, or itself, and what they share.

    Documents of several texts (rows of one doc_id) have none.
    """
    rows = None
    for own, other in (("a", "b"), ("b", "a")):
        size, bits = F.col(f"{own}_size"), F.col(f"{own}_bits")
        held = measured.select(F.col(own).alias("rep"), F.col(f"{other}_fame").alias("fame"), F.col(other).alias("pivot"), size.alias("size"), "common", bits.alias("bits"))
        alone = measured.select(F.col(own).alias("rep"), F.col(f"{own}_fame").alias("fame"), F.col(own).alias("pivot"), size.alias("size"), size.alias("common"), F.array_repeat(F.lit(0).cast("long"), BITMAP).alias("bits"))
        rows = held.unionByName(alone) if rows is None else rows.unionByName(held).unionByName(alone)
    first = rows.groupBy("rep").agg(F.max(F.struct("fame", (-F.col("pivot")).alias("p"), "size", "common", "bits")).alias("m"))
    shown = sum((F.bit_count(F.col("m.bits")[i]) for i in range(BITMAP)), F.lit(0))
    return first.select("rep", (-F.col("m.p")).alias("pivot"), F.col("m.size") * (similarity / (1 + similarity)), "m.common", F.col("m.size") - F.col("m.common") - shown, *[F.col("m.bits")[i] for i in range(BITMAP)]).toDF("rep", *PIVOT)


#: Columns of a document's pivot: its id, the document's part of the common weight that a link needs, the weight in common, the weight beyond that the bitmap doesn't show, the bitmap.
PIVOT = ["pivot", "need", "common", "over", *[f"beyond{i}" for i in range(BITMAP)]]


def _with_pivots(rows: DataFrame, pivots: DataFrame | None) -> DataFrame:
    """rows with the columns of PIVOT; what has no pivot needs nothing, and so can be similar to all."""
    none = [F.lit(0).cast("long"), F.lit(-1e300), *[F.lit(0).cast("long")] * (2 + BITMAP)]
    if pivots is None:
        return rows.withColumns(dict(zip(PIVOT, none)))
    return rows.drop(*PIVOT).join(pivots, "rep", "left").withColumns({c: F.coalesce(c, v) for c, v in zip(PIVOT, none)})


def _possible():
    """Whether documents (of columns PIVOT, and those after a_) can be similar: false only if both have one pivot, and too little in common with it and beyond it."""
    beyond = sum((F.bit_count(F.col(f"beyond{i}").bitwiseAND(F.col(f"a_beyond{i}"))) for i in range(BITMAP)), F.lit(0))
    most = F.least("common", "a_common") + F.least("over", "a_over") + beyond
    return (F.col("pivot") != F.col("a_pivot")) | (most >= F.col("need") + F.col("a_need") - 1e-9)


def _meet(batches, k: int, similarity: float):
    """(band, i, j, block, rep, class, sig, PIVOT), sorted by band, i and j -> (a, b): the pairs of the blocks i and j of a band that can be similar, as _agree and _possible say."""
    p = similarity + (1 - similarity) / 16
    most_apart = k - int(k * p - SLACK * np.sqrt(k * p * (1 - p)))

    def pairs(t: pa.Table, first: np.ndarray):
        col = {c: t.column(c).to_numpy() for c in ("i", "j", "block", "rep", "class", *PIVOT)}
        sig = np.stack(t.column("sig").to_numpy()).view(np.uint64)
        beyond = np.stack([col[c] for c in PIVOT[4:]], 1).view(np.uint64)
        for s, e in zip(first[:-1], first[1:]):
            for low in range(s, e, MEET_ROWS):
                x, y = np.nonzero(col["class"][low : min(low + MEET_ROWS, e), None] != col["class"][None, s:e])
                x, y = x + low, y + s
                ok = col["rep"][x] < col["rep"][y]
                if col["i"][s] != col["j"][s]:  # the rows of a block meet in a group of its own
                    ok &= col["block"][x] != col["block"][y]
                x, y = x[ok], y[ok]
                most = np.minimum(col["common"][x], col["common"][y]) + np.minimum(col["over"][x], col["over"][y]) + np.bitwise_count(beyond[x] & beyond[y]).sum(1, dtype=np.int64)
                ok = (col["pivot"][x] != col["pivot"][y]) | (most >= col["need"][x] + col["need"][y] - 1e-9)
                x, y = x[ok], y[ok]
                apart = sig[x] ^ sig[y]
                apart |= apart >> np.uint64(1)
                apart |= apart >> np.uint64(2)
                ok = np.bitwise_count(apart & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64) <= most_apart
                yield col["rep"][x[ok]], col["rep"][y[ok]]

    def out(found):
        found = [f for f in found if len(f[0])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")])
        first = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1] if t.num_rows else np.zeros(1, np.int64)
        yield from out(pairs(t.slice(0, first[-1]), first) if len(first) > 1 else ())
        rest = t.slice(first[-1])  # its group may go on
    if rest is not None and rest.num_rows:
        yield from out(pairs(rest, np.array([0, rest.num_rows])))


def _met(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b), each once: the rows of each band meet by blocks of about BLOCK rows, each two blocks in a group of their own, so that large bands are dealt over tasks of bounded size."""
    size = rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(size, "band").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "class", "sig", *PIVOT)
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(lambda it: _meet(it, k, similarity), "a long, b long").distinct()


def _led(rows: DataFrame, leaders: int, k: int, similarity: float) -> DataFrame:
    """(lead, follow), each once: the rows of each band and its leaders, as far as they can be similar; for one leader also what both share buckets with (lead_fame, follow_fame)."""
    first = leaders == 1
    lead = rows.select("band", *[F.col(c).alias(f"a_{c}") for c in ("rep", "sig", "class", "fame", *PIVOT)])
    if first:
        lead = lead.groupBy("band").agg(F.min(F.struct((-F.col("a_fame")).alias("f"), "a_rep", "a_sig", "a_class", "a_fame")).alias("m")).select("band", "m.a_rep", "m.a_sig", "m.a_class", "m.a_fame")
    else:
        lead = lead.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("a_fame"), "a_rep"))).where(F.col("r") <= leaders).drop("r")
    lead = lead.withColumnRenamed("band", "a_band")
    near = F.col("class") != F.col("a_class")
    if not first:
        near = near & _possible()
    near = near & _agree(F.col("sig"), F.col("a_sig"), k, similarity, SLACK)
    same = F.col("band") == F.col("a_band")
    # bands of a thousandth of all rows, a thousand at most, get their leaders by broadcast, so that no task gets all rows of one
    sizes = rows.groupBy(F.col("band").alias("__band")).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > max(FOLLOWERS, rows.count() / 1000)).select("__band")
    known = rows.join(F.broadcast(large), F.col("band") == F.col("__band"), "left")
    theirs = lead.join(F.broadcast(large), F.col("a_band") == F.col("__band"), "left_semi")
    met = known.where("__band IS NOT NULL").join(F.broadcast(theirs), same & near).unionByName(known.where("__band IS NULL").join(lead, same & near))
    led = (F.col("a_fame") > F.col("fame")) | ((F.col("a_fame") == F.col("fame")) & (F.col("a_rep") < F.col("rep")))
    either = lambda x, y: F.when(led, F.col(x)).otherwise(F.col(y))
    fames = [either("a_fame", "fame").alias("lead_fame"), either("fame", "a_fame").alias("follow_fame")]
    return met.select(either("a_rep", "rep").alias("lead"), either("rep", "a_rep").alias("follow"), *(fames if first else [])).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node of each connected component. Least-neighbour propagation with pointer jumping; each round is a written table."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
    label = written(label, "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        # a node's root also takes what the node has seen, so that whole trees merge at once
        seen = label.join(near.select(F.col("a").alias("node"), "r"), "node").select("node", "root", F.least("root", "r").alias("new"))
        hook = seen.groupBy("root").agg(F.min("new").alias("up"))
        step = seen.join(hook, "root").select("node", F.col("root").alias("old"), F.least("new", "up").alias("mid"))
        jump = step.join(step.select(F.col("node").alias("mid"), F.col("mid").alias("far")), "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root"))
        done = written(jump, "labels")
        if done.where("old <> root").isEmpty():
            return done.select("node", "root")
        label = done.select("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", max_broadcast_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, class_id), a row for each row: class_id is the least doc_id of the class.

    Once two texts are known to be of one class they aren't held against each other any more, so links aren't counted.
    """
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = written(source.mapInArrow(lambda it: _sketch(it, bands, rows, shingle, weighting), "doc_id long, h1 long, h2 long, bands array<long>, sig array<long>"), "neardup-sketches")
    named = sketched.where(F.col("doc_id").isNotNull() & F.col("h1").isNotNull())
    groups = written(named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("least")).select("h1", "h2", F.col("least.doc_id").alias("rep"), "least.bands", "least.sig"), "neardup-groups")
    buckets = groups.select("rep", "sig", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    open_rows = written(buckets.join(sizes, "band"), "neardup-buckets")
    fame = open_rows.groupBy("rep").agg(F.sum("size").alias("fame"))
    open_rows = written(open_rows.drop("size").join(fame, "rep").withColumn("class", F.col("rep")), "neardup-buckets")
    involved = fame.select(F.col("rep").alias("doc_id"))
    few = fame.count() <= max_broadcast_ids
    texts = source.join(F.broadcast(involved) if few else involved, "doc_id", "left_semi")
    sets = written(texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(lambda it: _element_rows(it, shingle, weighting), "rep long, codes array<long>, weights array<int>"), "neardup-elements")
    tested: DataFrame | None = None
    open_rows = _with_pivots(open_rows, None)
    for leaders in (1, LEADERS, None):
        first = leaders == 1
        if leaders:
            pairs = _led(open_rows, leaders, bands * rows, similarity)
        else:
            pairs = _met(open_rows, bands * rows, similarity).select(F.col("a").alias("lead"), F.col("b").alias("follow"))
        if tested is not None:
            done = tested.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
            pairs = pairs.join(done, (F.least("lead", "follow") == F.col("__a")) & (F.greatest("lead", "follow") == F.col("__b")), "left_anti")
        judged = _judged(pairs, sets, similarity, first, max_broadcast_ids)
        found = F.max("linked").alias("linked")
        if first:
            measures = ["a_fame", "b_fame", "a_size", "b_size", "common", "a_bits", "b_bits"]
            measured = written(judged.groupBy("a", "b").agg(found, F.count("*").alias("texts"), *[F.first(c).alias(c) for c in measures]), "neardup-tested")
            tested = measured.select("a", "b", "linked")
        else:
            tested = written(tested.unionByName(judged.groupBy("a", "b").agg(found)), "neardup-tested")
        links = tested.where("linked").select("a", "b")
        classes = components(links).select(F.col("node").alias("rep"), "root")
        if not leaders:
            break
        # a bucket whose documents are of one class is done
        named_rows = open_rows.drop("class").join(classes, "rep", "left").withColumn("class", F.coalesce("root", "rep")).drop("root")
        mixed = named_rows.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band")
        still = named_rows.join(mixed, "band")
        if first:
            still = _with_pivots(still, _pivots(measured.where("texts = 1"), similarity))
        open_rows = written(still.select(*open_rows.columns), "neardup-buckets")
        if open_rows.isEmpty():
            break
    by_text = groups.select("h1", "h2", "rep").join(classes, "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("class_id"))
    out = sketched.select("doc_id", "h1", "h2").join(by_text, ["h1", "h2"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def without_near_duplicates(docs: DataFrame, max_broadcast_ids: int = MAX_BROADCAST_IDS, **how) -> DataFrame:
    """The rows of docs that represent their class: one for each class, of its least doc_id; rows without a doc_id all stay."""
    found = written(near_duplicates(docs, max_broadcast_ids=max_broadcast_ids, **how), "neardup-classes")
    gone = found.where("doc_id <> class_id").select("doc_id").distinct()
    few = gone.count() <= max_broadcast_ids
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    # some ids repeat: one row of each stays
    own = [F.col(quoted(c)) for c in docs.columns]
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*own))
    nth = free_name("__nth", docs.columns)
    return kept.withColumn(nth, F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(order))).where(F.col(nth) == 1).select(*own)
