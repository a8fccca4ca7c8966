"""Spelling variants: words one inserted, deleted or replaced code point apart, and the frequent form of each.

Two words a and b, b no shorter, are one edit apart if the length of their common prefix plus that of their common suffix
reaches len(b) - 1 (and they differ, and len(b) - len(a) <= 1). To bring such words together, b's length is cut into
segments of two code points (into max_segments longer ones, for long words): the edit lies in one of them, and what is
before and behind it is the same in both. So each word has, for its own length and the one above, a key for every
segment: a hash of what lies outside of it. The words of a key form a group, which a task turns into a matrix of code
points, a row a word, padded by the one column by which lengths may differ; blocks of row pairs are compared at once by
the lengths of common prefixes and suffixes. A pair is counted under one key only: that of the segment with its first
difference. Each task sends, for a word of a group, only how many near words it has there and the best of them.

A group of two-code-point segments has at most as many words as the alphabet has letters, squared; groups of
longer segments that hold over tile words (or tile_bytes) are cut into tiles, and each pair of tiles is a group.

Forms: the near word of largest n, ties to the smallest in code-point order, if its n is at least ratio times the
word's. As n grows by that ratio at each step, a chain of forms has few links, and roots follow by pointer doubling.

Defined cases: a null or empty text has no words; a null doc_id is the empty string; rows of one doc_id are counted each;
letters are those of Latin-1, so that a code point is a byte here; an empty table has no words; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: One run in so many loses a code point.
NOISE = 31
MAX_SEGMENTS = 32
TILE = 4096
TILE_BYTES = 16 << 20
#: Entries of two matrices that are compared at once.
BLOCK_ENTRIES = 4 << 20


def runs(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, text) -> (word), a row for each run of letters of at least min_length that is left once one run in `noise` lost a code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    least = f"[A-Za-zÀ-ÿ]{{{min_length},}}"  # maximal all the same: a match begins where its run does
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(least), F.lit(0))).alias("run"))
    found = found.withColumn("run", F.translate("run", upper, lower))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")) if noise else F.col("run")
    return found.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_length)


def segments(length: Column, max_segments: int) -> Column:
    """How many segments a longer length is cut into."""
    return F.least(F.ceil(length / 2), F.lit(max_segments)).cast("int")


def keyed(words: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(word, n) -> (key, longer, segment, word, n): for the word's length and the one above, a key for each segment."""
    bounds = words.select("word", "n", F.length("word").alias("size")).select("*", F.explode(F.array("size", F.col("size") + 1)).alias("longer"))
    count = segments(F.col("longer"), max_segments)
    each = bounds.select("*", count.alias("of"), F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    first = F.floor(F.col("segment") * F.col("longer") / F.col("of")).cast("int")
    after = F.floor((F.col("segment") + 1) * F.col("longer") / F.col("of")).cast("int")
    behind = F.col("longer") - after
    key = F.xxhash64(F.substring("word", F.lit(1), first), F.substring("word", F.col("size") - behind + 1, behind), "longer", "segment")
    return each.select(key.alias("key"), "longer", "segment", "word", "n")


def matrix(words: list[bytes], longer: int) -> np.ndarray:
    """Code points, a row a word, padded with zeros."""
    return np.frombuffer(b"".join(w.ljust(longer, b"\0") for w in words), np.uint8).reshape(len(words), longer)


def near(left: np.ndarray, right: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: whether the words are one edit apart, and where they first differ. right is as long as the matrix is wide; left is short of it by 0 or 1."""
    longer = left.shape[1]
    same = left == right
    prefix = np.where(same.all(1), longer, same.argmin(1))
    # the suffixes are aligned at the ends: a word that is short moves one column to the right
    moved = np.concatenate([np.zeros((len(left), 1), np.uint8), left[:, :-1]], 1)
    back = np.where(short[:, None], moved, left)[:, ::-1] == right[:, ::-1]
    suffix = np.where(back.all(1), longer, back.argmin(1))
    return (prefix < longer) & (prefix + suffix >= longer - 1), prefix


def _pairs(sizes: np.ndarray, starts: np.ndarray, limit: int):
    """Blocks (i, j), i < j, of all pairs of rows within groups; about limit pairs a block."""
    row = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]) if len(sizes) else np.zeros(0, np.int64)
    end = np.repeat(starts + sizes, sizes)
    after = end - row - 1
    total = np.cumsum(after)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        n = after[a:b]
        i = np.repeat(row[a:b], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def compare(words: list[bytes], longer: int, segment: np.ndarray, starts: np.ndarray, sizes: np.ndarray, max_segments: int, across: np.ndarray | None = None):
    """The near words within groups of one longer length: arrays (row, other) in both directions.

    segment: that of each row's group; across: a row's side, if only pairs of different sides count (pairs of tiles).
    """
    m = matrix(words, longer)
    size = np.array([len(w) for w in words])
    of = min(-(-longer // 2), max_segments)
    out = []
    for i, j in _pairs(sizes, starts, max(1, BLOCK_ENTRIES // longer)):
        use = (size[i] == longer) | (size[j] == longer)
        if across is not None:
            use &= (across[i] != across[j]) | (across[i] == 0)
        i, j = i[use], j[use]
        swap = size[j] < longer
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        is_near, at = near(m[i], m[j], size[i] < longer)
        # the segment of a place: the last whose first place isn't behind it
        inside = ((np.minimum(at, longer - 1) + 1) * of - 1) // longer
        hit = np.flatnonzero(is_near & (inside == segment[i]))
        out += [(i[hit], j[hit]), (j[hit], i[hit])]
    row, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return row, other


_PARTIAL = "word string, n_near long, best_n long, best string"


def _compared(batches, max_segments: int):
    """(longer, segment, key, tile, side, word, n), sorted by the first four -> a word's near words within its group: their number and the best."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("longer", "segment", "key", "tile")])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1]
        held = batch.slice(int(cuts[-1]))
        yield from _groups(batch.slice(0, int(cuts[-1])), cuts, max_segments)
    if held is not None:
        yield from _groups(held, np.array([0, held.num_rows]), max_segments)


def _groups(batch: pa.RecordBatch, cuts: np.ndarray, max_segments: int):
    sizes = np.diff(cuts)
    starts = cuts[:-1]
    longers = batch.column("longer").to_numpy(zero_copy_only=False)
    segment = batch.column("segment").to_numpy(zero_copy_only=False)
    texts, n, side = batch.column("word"), batch.column("n").to_numpy(zero_copy_only=False), batch.column("side").to_numpy(zero_copy_only=False)
    keep = sizes > 1
    starts, sizes = starts[keep], sizes[keep]
    for longer in np.unique(longers[starts]).tolist() if len(starts) else []:
        of = longers[starts] == longer
        rows = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[of], sizes[of])])
        words = [w.encode("latin-1") for w in texts.take(pa.array(rows)).to_pylist()]
        at = np.cumsum(sizes[of]) - sizes[of]
        across = side[rows]
        row, other = compare(words, longer, segment[rows], at, sizes[of], max_segments, across if (across > 0).any() else None)
        if not len(row):
            continue
        count = n[rows]
        text = np.array(words, object)[other]
        order = sorted(range(len(row)), key=lambda k: (row[k], -count[other[k]], text[k]))
        row, other = row[order], other[order]
        first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1]
        near_count = np.diff(np.r_[first, len(row)])
        say = lambda ks: pa.array([words[k].decode("latin-1") for k in ks])
        yield pa.RecordBatch.from_arrays([say(row[first]), pa.array(near_count), pa.array(count[other[first]]), say(other[first])], ["word", "n_near", "best_n", "best"])


def _tiled(groups: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """Groups with their tile and side: (key, tile 0, side 0) where they are small; else one group for each tile, and one for each pair of tiles."""
    sizes = groups.groupBy("key", "longer", "segment").agg(F.count("*").alias("size"))
    tiles = F.greatest(F.ceil(F.col("size") / tile), F.ceil(F.col("size") * F.col("longer") / tile_bytes)).cast("int")
    large = sizes.withColumn("tiles", tiles).where("tiles > 1").select("key", "longer", "segment", "tiles")
    own = F.pmod(F.xxhash64("word", F.lit(5)), F.col("tiles")).cast("int")
    with_tiles = groups.join(large, ["key", "longer", "segment"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", own)
    # pairs (a, b), a <= b, number a * tiles + b; in a pair of different tiles only words of different sides are compared
    other = with_tiles.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    number = F.least("own", "with").cast("long") * F.col("tiles") + F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)
    return other.select("longer", "segment", "key", number.alias("tile"), side.alias("side"), "word", "n")


def near_words(words: DataFrame, max_segments: int = MAX_SEGMENTS, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(word, n) of distinct words of Latin-1 letters -> (word, n_near, best_n, best) of those with near words."""
    groups = keyed(words, max_segments)
    short = groups.where(F.col("longer") <= 2 * max_segments).select("longer", "segment", "key", F.lit(0).cast("long").alias("tile"), F.lit(0).alias("side"), "word", "n")
    long = _tiled(groups.where(F.col("longer") > 2 * max_segments), tile, tile_bytes)
    order = ["longer", "segment", "key", "tile"]
    parts = in_batches(short.unionByName(long)).repartition("key", "tile").sortWithinPartitions(*order).mapInArrow(lambda it: _compared(it, max_segments), _PARTIAL)
    # the largest n, then the smallest word: Latin-1 words compare by their UTF-8 bytes as by their code points
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, form) -> (word, root): the last of the chain of forms, by pointer doubling; a chain has at most `longest` links."""
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = written(ends.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return ends


def spelling_variants(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, max_segments: int = MAX_SEGMENTS, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(doc_id, text) -> (word, n, n_near, form, form_n, root): a row for each word of at least min_length code points and min_count occurrences."""
    words = written(runs(docs, noise, min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "spelling-words")
    found = near_words(words, max_segments, tile, tile_bytes)
    is_form = F.col("best_n") >= ratio * F.col("n")
    table = written(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    most = table.agg(F.max("n")).first()[0] or 1
    ends = roots(table.where("form IS NOT NULL").select("word", "form"), math.ceil(math.log(most, ratio)) + 1)
    return table.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
