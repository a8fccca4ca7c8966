"""Removal of repeated byte strings by run-length compressed Burrows-Wheeler indexes.

Every byte of a document that is covered by a LENGTH-byte string which starts anywhere else in the corpus, too, is
marked and removed. The corpus is too large for one index, so it is dealt by content. The start of a string
has a key: the least hash among the GRAM-byte grams of the LENGTH bytes there. Equal strings have equal keys, so a
key's strings can be judged without any other's. A text of over PIECE bytes is taken in pieces that overlap by LENGTH - 1 bytes, so
that every start is in one. Successive starts with one key make a segment (its bytes run from
the first start to the end of the last string), and
  1. a segment whose key occurs nowhere else, nor twice in it, holds no repeat and is dropped by a count;
  2. equal segments are counted together, so that thousands of copies are one row, marked as a whole;
  3. the different segments of a key go to one block with those of many other keys. A block's text is indexed: its
     suffixes are ordered, the Burrows-Wheeler transform is the bytes before them, and it is cut into runs of equal
     bytes. Only where a run begins or ends is the common prefix of two neighbouring suffixes compared (the sampled
     run ends); elsewhere it is one less than that of the position before it in the text. Streaming over the
     text from sample to sample gives each position's matching statistic, the longest match with any other position,
     and starts where it reaches LENGTH are repeated;
  4. the segments of a key that has too many for one block (a passage in very many documents) are dealt over several
     blocks. What a block leaves unmarked there is counted across blocks, by 128-bit hashes of the strings at every
     start left and of one copy of every string marked. This is the exact way for what a block can't hold.
Rows are (document, first start, starts), so marks go back to the documents by a join on the row's number.

Defined cases: a null text is empty; an empty or shorter text loses nothing (kept_sha256 is that of its bytes);
overlapping occurrences in one document count; repeated rows, and rows whose doc_id is null or repeated, are
documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices, utf8, written
from .neardup import mix

LENGTH = 400
GRAM = 16
#: Starts of a document that are hashed at once; a longer one is taken in pieces.
PIECE = 1 << 20
#: Bytes of segments for each block, about; half of it is the most that one key has in one block.
BLOCK_BYTES = 2 << 20
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def keys(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, key) of every length-byte string that lies within a document; the hashes of the grams."""
    n = len(data)
    lens = np.diff(offsets)
    fits = np.maximum(lens - length + 1, 0)
    if not fits.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    width, level = 1, 0
    while width < gram:  # the hash of 2w bytes from those of w bytes
        h = h[: len(h) - width] * _P[level % 4] + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width, level = 2 * width, level + 1
    h = mix(h)
    # least value of each window of w grams: the least of two pieces, of blocks of w cut at multiples of w
    w = length - width + 1
    pad = -len(h) % w
    grid = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, 1).reshape(-1)
    doc = np.repeat(np.arange(len(lens)), fits)
    start = np.arange(int(fits.sum())) - np.repeat(np.cumsum(fits) - fits, fits) + offsets[:-1][doc]
    return start, np.minimum(ahead[start], behind[start + w - 1]), h


def _pieces(off: np.ndarray, length: int, piece: int):
    """(i, j, first byte, last byte, whether it is a part of a document): documents i to j at once; of a document of over `piece` bytes, pieces of as many starts, with the bytes of the last string."""
    for i, j in slices(off, piece):
        if j - i > 1 or off[j] - off[i] <= piece + length - 1:
            yield i, j, off[i], off[j], False
            continue
        for a in range(int(off[i]), int(off[j]), piece):
            yield i, j, a, min(int(off[j]), a + piece + length - 1), True


def _segments(batches, length: int, piece: int):
    """(row, text) -> (row, at, starts, key, h1, h2, twice): the segments of each text, with a 128-bit hash of their bytes and whether the key's gram is in them twice."""
    span = length - GRAM
    for batch in batches:
        data, off = utf8(batch.column("text"))
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        for i, j, low, high, is_part in _pieces(off, length, piece):
            part = data[low:high]
            here = np.array([0, high - low]) if is_part else off[i : j + 1] - low
            start, key, grams = keys(part, here, length)
            if not len(start):
                continue
            new = np.ones(len(start), bool)
            new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.r_[first, len(start)])
            at = start[first]
            doc = np.searchsorted(here, at, "right") - 1
            view = memoryview(part)
            digest = b"".join(xxhash.xxh3_128_digest(view[a : a + m]) for a, m in zip(at.tolist(), (n + length - 1).tolist()))
            h = np.frombuffer(digest, np.int64).reshape(-1, 2)
            twice = np.fromiter((np.count_nonzero(grams[a : a + m + span] == k) > 1 for a, m, k in zip(at.tolist(), n.tolist(), key[first])), bool, len(at))
            yield pa.RecordBatch.from_arrays([pa.array(rows[i + doc]), pa.array((at - here[doc] + (low - off[i] if is_part else 0)).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key[first].view(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(twice)], ["row", "at", "starts", "key", "h1", "h2", "twice"])


def _cut(batches, length: int):
    """(text, wanted: array of (at, starts, key, h1, h2, hot, copies, block)) -> the same segments with their bytes."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        values = wanted.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        col = {f.name: values.field(f.name) for f in values.type}
        at = col["at"].to_numpy(zero_copy_only=False).astype(np.int64) + off[doc]
        end = at + col["starts"].to_numpy(zero_copy_only=False) + length - 1
        step = 2_000
        for k in range(0, len(at), step):
            text = pa.array([data[a:b].tobytes() for a, b in zip(at[k : k + step].tolist(), end[k : k + step].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(col[c].slice(k, step) for c in ("key", "h1", "h2", "starts", "hot", "copies", "block")), text], ["key", "h1", "h2", "starts", "hot", "copies", "block", "bytes"])


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of symbols of 16 or 32 bits that end in a unique one: ranks of doubled prefixes, sorted again only where they tie."""
    n = len(symbols)
    bits, at_once = 8 * symbols.itemsize, 8 // symbols.itemsize
    padded = np.concatenate([symbols, np.zeros(at_once, symbols.dtype)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for k in range(at_once):
        rank = (rank << np.uint64(bits)) | padded[k : k + n]
    order = np.argsort(rank)
    first = np.ones(n, bool)
    first[1:] = rank[order][1:] != rank[order][:-1]
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = at_once
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # slots whose prefix isn't the only one
        if not len(tied):
            return order
        pos = order[tied]
        key = place[pos] * (n + 1) + np.where(pos + width < n, place[np.minimum(pos + width, n - 1)] + 1, 0)
        again = np.argsort(key)
        pos, key = pos[again], key[again]
        order[tied] = pos
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        first[tied] = new
        place[pos] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        width *= 2


def matching_statistics(symbols: np.ndarray) -> np.ndarray:
    """For each position, the longest match of what starts there with what starts anywhere else."""
    n = len(symbols)
    order = suffix_order(symbols)
    before = np.where(order > 0, symbols[order - 1].astype(np.int64), -1)  # the transform
    head = np.flatnonzero(before[1:] != before[:-1]) + 1  # the slots where a run begins; the slot before each ends one
    common = _common_prefix(symbols, order[head - 1], order[head])
    longest = np.zeros(n, np.int64)
    for slots, lone in ((head, order[0]), (head - 1, order[-1])):  # with the suffix before, then with the one after
        reach = np.full(n, -1, np.int64)  # where the match of a sampled position ends
        reach[order[slots]] = order[slots] + common
        reach[lone] = lone
        last = np.maximum.accumulate(np.where(reach >= 0, np.arange(n), 0))
        longest = np.maximum(longest, reach[last] - np.arange(n))
    return longest


def _common_prefix(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, four symbols a step; unique symbols end them."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([symbols, np.zeros(8, symbols.dtype)]), 4)
    out = np.zeros(len(a), np.int64)
    live, x, y = np.arange(len(a)), a.copy(), b.copy()
    while len(live):
        same = words[x] == words[y]
        k = np.where(same.all(1), 4, same.argmin(1))
        out[live] += k
        on = (k == 4) & (np.maximum(x, y) + 4 < len(symbols))
        live, x, y = live[on], x[on] + 4, y[on] + 4
    return out


def _string_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each length-byte string: of pieces whose lengths are powers of two, each from its halves."""
    n = len(data) - length + 1
    piece = mix(data.astype(np.uint64) + np.uint64(seed) * _P[0])
    out, at, width = np.zeros(n, np.uint64), 0, 1
    while width <= length:
        if length & width:
            out = mix(out * _P[1] + piece[at : at + n])
            at += width
        if 2 * width <= length:
            piece = mix(piece[: len(piece) - width] * _P[2] + piece[width:])
        width *= 2
    return out


def _lists(count: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """Rows of structs as a list for each of so many."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


def _judge(block: pa.Table, length: int) -> pa.Table:
    """The different segments of a block -> the runs of their repeated starts; for those of keys dealt over several blocks also the strings left and one copy of each string marked."""
    raw, cut = utf8(pa.concat_arrays(block.column("bytes").chunks))
    lens, m = np.diff(cut), block.num_rows
    begin = cut[:-1] + np.arange(m)
    symbols = np.zeros(len(raw) + m, np.uint16 if 256 + m <= 1 << 16 else np.uint32)
    symbols[np.arange(len(raw)) + np.repeat(np.arange(m), lens)] = raw
    symbols[begin + lens] = 256 + np.arange(m)  # each segment ends in a symbol of its own
    longest = matching_statistics(symbols)
    copies, hot = (block.column(c).to_numpy() for c in ("copies", "hot"))
    starts = lens - (length - 1)
    of = np.repeat(np.arange(m), starts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    marked = (longest[begin[of] + k] >= length) | (copies > 1)[of]
    edge = of[1:] != of[:-1]
    rise = np.flatnonzero(marked & np.r_[True, edge | ~marked[:-1]])
    fall = np.flatnonzero(marked & np.r_[edge | ~marked[1:], True])
    runs = _lists(np.bincount(of[rise], minlength=m), {"a": k[rise].astype(np.int32), "b": (k[fall] + 1).astype(np.int32)})
    use = np.flatnonzero(hot[of])
    w1, w2 = (_string_hashes(raw, length, seed)[(cut[:-1][of] + k)[use]].view(np.int64) if len(use) else np.zeros(0, np.int64) for seed in (1, 2))
    left = ~marked[use]
    loose = _lists(np.bincount(of[use][left], minlength=m), {"at": k[use][left].astype(np.int32), "w1": w1[left], "w2": w2[left]})
    known = np.flatnonzero(~left)
    order = known[np.lexsort((known, w2[known], w1[known]))]
    new = np.ones(len(order), bool)
    new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
    once = np.sort(order[new])
    firm = _lists(np.bincount(of[use][once], minlength=m), {"w1": w1[once], "w2": w2[once]})
    return pa.table({c: block.column(c) for c in ("key", "h1", "h2")} | {"runs": runs, "loose": loose, "firm": firm})


def _remove(batches, length: int):
    """(row, doc_id, text, marks) -> what is left of each text."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        out = []
        for k, marks in enumerate(batch.column("marks")):
            text = data[off[k] : off[k + 1]]
            gone = np.zeros(len(text) + 1, np.int32)
            spans = marks.values
            if spans is not None and len(spans):
                np.add.at(gone, spans.field("a").to_numpy(), 1)
                np.add.at(gone, spans.field("b").to_numpy() + (length - 1), -1)
            removed = np.cumsum(gone[:-1]) > 0
            n = int(removed.sum())
            rises = int((removed & ~np.r_[False, removed[:-1]]).sum())
            out.append((len(text), n, rises, hashlib.sha256(text[~removed].tobytes() if n else text.tobytes()).hexdigest()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(source: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """(row, text) with a unique row -> (row, marks): the runs [a, b) of starts whose length-byte string also starts elsewhere; rows without any are absent."""
    spark = source.sparkSession
    segments = written(source.mapInArrow(lambda it: _segments(it, length, piece), "row long, at int, starts int, key long, h1 long, h2 long, twice boolean"), "repeats-segments")
    kinds = segments.groupBy("key", "h1", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("row", "at", "starts")).alias("place"), F.max("twice").alias("twice"))
    kinds = written(kinds.select("key", "h1", "h2", "copies", "place.row", "place.at", "place.starts", "twice"), "repeats-kinds")
    by_key = kinds.groupBy("key").agg(F.count("*").alias("n_kinds"), F.sum("copies").alias("n"), F.max("twice").alias("any_twice"), F.sum(F.col("starts") + (length - 1)).alias("n_bytes")).where("n > 1 OR any_twice")
    kept = written(kinds.join(by_key, "key"), "repeats-candidates")
    whole = kept.where("n_kinds = 1 AND copies > 1").select("key", "h1", "h2", F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b"))).alias("runs"))
    judge = kept.where("n_kinds > 1 OR copies = 1").withColumn("hot", F.col("n_bytes") > block_bytes // 2)
    size = judge.agg(F.sum(F.col("starts") + (length - 1))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    shares = F.when(F.col("hot"), F.ceil(F.col("n_bytes") / (block_bytes // 2))).otherwise(1)
    judge = judge.withColumn("block", F.pmod(F.xxhash64("key", F.pmod("h2", shares)), F.lit(blocks)).cast("int"))
    wanted = judge.groupBy("row").agg(F.collect_list(F.struct("at", "starts", "key", "h1", "h2", "hot", "copies", "block")).alias("wanted"))
    cut = source.join(wanted, "row").select("text", "wanted").mapInArrow(lambda it: _cut(it, length), "key long, h1 long, h2 long, starts int, hot boolean, copies long, block int, bytes binary")
    judged = written(cut.groupBy("block").applyInArrow(lambda t: _judge(t, length), "key long, h1 long, h2 long, runs array<struct<a:int,b:int>>, loose array<struct<at:int,w1:long,w2:long>>, firm array<struct<w1:long,w2:long>>"), "repeats-judged")
    loose = judged.select("key", "h1", "h2", F.explode("loose").alias("s")).select("key", "h1", "h2", "s.at", "s.w1", "s.w2")
    firm = judged.select(F.explode("firm").alias("s")).select("s.w1", "s.w2", F.lit(2).alias("n"))
    again = loose.select("w1", "w2", F.lit(1).alias("n")).unionByName(firm).groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    late = loose.join(again, ["w1", "w2"]).select("key", "h1", "h2", F.array(F.struct("at", (F.col("at") + 1).alias("b"))).alias("runs")).select("key", "h1", "h2", F.col("runs").cast("array<struct<a:int,b:int>>").alias("runs"))
    runs = whole.unionByName(judged.where("size(runs) > 0").select("key", "h1", "h2", "runs")).unionByName(late)
    marks = segments.join(runs, ["key", "h1", "h2"]).select("row", F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b"))).alias("runs"))
    return marks.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("marks"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row."""
    counts = in_batches(docs).agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    unique = counts[0] == counts[1] == counts[2]
    row = F.col("doc_id") if unique else F.monotonically_increasing_id()
    source = docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not unique:
        source = written(source, "repeats-rows")  # numbered once, so that a task that runs again finds the same numbers
    marks = repeated_spans(source.select("row", "text"), length, block_bytes, piece)
    joined = source.join(marks, "row", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(lambda it: _remove(it, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
