"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item's windows are its runs of WINDOW consecutive words; an item of fewer words, but not none, is one
window. All windows of one length form a Wu-Manber searcher whose alphabet is words: a shift table over blocks of
words (the last block of the text under the search position) tells how far the position may move without passing
an occurrence; where it says zero, the hash of the suffix block selects a bucket of windows, and a direct
comparison of the words' bytes confirms an occurrence. All documents of a batch are searched in lock step, each
at a position of its own, so that the skipping works on arrays.

The searchers are broadcast. Items are dealt into groups so that each group's windows stay below max_pattern_bytes;
if there are several groups, the documents are searched once for each, and the spans found are united by document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; as every byte of a longer UTF-8
character is 0x80 or more, they are found on bytes.

Defined cases: a null text has no words (all counts 0, items_sha256 of the empty string, not contaminated); items
without words have no windows; equal windows of several items count for each of them; item_ids may be of any type, and
sort as strings; repeated rows are answered each; extra columns are ignored; null item_ids are left out of items_sha256,
as they have no name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_batches, quoted, slices, utf8, written

WINDOW = 13
#: Bytes of windows that are broadcast at once.
MAX_PATTERN_BYTES = 64 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


class Words:
    """The words of some documents: their bytes, where each starts and ends, a hash of each, and the number in each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IN_WORD[self.data]
        rise = inside[1:-1] & ~inside[:-2]
        fall = inside[1:-1] & ~inside[2:]
        begin = offsets[:-1][np.diff(offsets) > 0]  # words don't cross documents
        cut = begin[begin > 0]
        rise[cut] |= inside[1:-1][cut]
        fall[cut - 1] |= inside[1:-1][cut - 1]
        self.start, self.end = np.flatnonzero(rise), np.flatnonzero(fall) + 1
        self.first = np.searchsorted(self.start, offsets)  # first word of each document, and the number of all
        self.count = np.diff(self.first)
        if len(self.start):
            at = np.arange(len(data)) - np.repeat(self.start, np.diff(np.r_[self.start, len(data)])) if self.start[0] == 0 else np.r_[np.zeros(self.start[0], np.int64), np.arange(self.start[0], len(data)) - np.repeat(self.start, np.diff(np.r_[self.start, len(data)]))]
            value = (self.data.astype(np.uint64) + np.uint64(1)) * _POWER[at & 4095]
            value[~inside[1:-1]] = 0
            total = np.add.reduceat(value, self.start)
            self.hash = (total ^ (total >> np.uint64(29))) * _MIX
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of size words that ends at each word (from word size - 1 on)."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + hashes[k : k + n] if n > 0 else out
    return (out ^ (out >> np.uint64(31))) * _MIX


class WuManber:
    """Searcher for windows of one number of words. windows: the words' hashes, a row each; texts: their words, space-joined; items: of each window, the items that hold it."""

    def __init__(self, windows: np.ndarray, texts: list[bytes], items: list[tuple]):
        self.m = windows.shape[1]
        self.block = min(2, self.m)
        self.texts, self.items = texts, items
        self.bits = max(12, int(8 * windows.size).bit_length())
        shift = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, shift, np.uint8)
        for end in range(self.block, self.m + 1):  # later, and so smaller, shifts overwrite
            self.shift[self._slot(self._row_block(windows, end))] = self.m - end
        suffix = self._row_block(windows, self.m)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        # the prefix of a window, to select within a bucket
        self.whole = self._row_block(windows, self.m, self.m)[self.order]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _row_block(self, windows: np.ndarray, end: int, size: int | None = None) -> np.ndarray:
        size = size or self.block
        out = np.zeros(len(windows), np.uint64)
        for k in range(end - size, end):
            out = out * np.uint64(0x100000001B3) + windows[:, k]
        return (out ^ (out >> np.uint64(31))) * _MIX

    def find(self, words: Words):
        """(document, first word, window) of each occurrence."""
        blocks = _blocks(words.hash, self.block)  # blocks[i] ends at word i + block - 1
        docs = np.flatnonzero(words.count >= self.m)
        at = words.first[docs] + self.m - 1  # last word under the window
        stop = words.first[docs + 1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(docs):
            move = self.shift[self._slot(blocks[at - self.block + 1])].astype(np.int64)
            zero = np.flatnonzero(move == 0)
            if len(zero):
                found.append((docs[zero], at[zero]))
                move[zero] = 1
            at = at + move
            on = at < stop
            docs, at, stop = docs[on], at[on], stop[on]
        if not found:
            return
        docs, at = (np.concatenate(x) for x in zip(*found))
        key = blocks[at - self.block + 1]
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        hit = np.flatnonzero(high > low)
        docs, at, low, high = docs[hit], at[hit], low[hit], high[hit]
        n = high - low
        row = np.repeat(np.arange(len(docs)), n)
        bucket = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[row]
        whole = np.zeros(len(docs), np.uint64)
        for k in range(self.m):
            whole = whole * np.uint64(0x100000001B3) + words.hash[at - self.m + 1 + k]
        whole = (whole ^ (whole >> np.uint64(31))) * _MIX
        same = np.flatnonzero(whole[row] == self.whole[bucket])
        for r, b in zip(row[same].tolist(), bucket[same].tolist()):
            begin, window = int(at[r]) - self.m + 1, int(self.order[b])
            if words.text(begin, begin + self.m) == self.texts[window]:
                yield int(docs[r]), begin, window


def searchers(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each number of words among the windows of (item_id, text)."""
    held: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        n = len(words.start)
        m = min(n, window)
        for i in range(n - m + 1 if n else 0):
            held.setdefault(m, {}).setdefault(words.text(i, i + m), (words.hash[i : i + m], set()))[1].add(item_id)
    return [WuManber(np.array([h for h, _ in by.values()], np.uint64).reshape(len(by), m), list(by), [tuple(i for i in ids) for _, ids in by.values()]) for m, by in sorted(held.items())]


def _search(batches, groups, column: int, names: list[str]):
    """Appends to each batch the number of words, the hit spans of words (starts and ends) and the items found. names: of all columns."""
    for batch in batches:
        data, off = utf8(batch.column(column))
        n_words, spans, items = [], [], []
        for i, j in slices(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n_words.append(words.count)
            here: dict[int, list[tuple[int, int]]] = {}
            who: dict[int, set] = {}
            for searcher in groups:
                for doc, begin, window in searcher.find(words):
                    here.setdefault(doc, []).append((begin - int(words.first[doc]), begin - int(words.first[doc]) + searcher.m))
                    who.setdefault(doc, set()).update(searcher.items[window])
            for d in range(j - i):
                spans.append(_union(here.get(d, [])))
                items.append(sorted((x for x in who.get(d, ())), key=lambda x: (x is None, x)))
        n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pairs), pa.array(items, pa.list_(pa.string()))], names)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def result_names(keep: list[str]) -> list[str]:
    """The names of find_contamination's results beside columns keep: n_words, spans and items, with `_` appended where keep has that name."""
    return [free_name(n, keep) for n in ("n_words", "spans", "items")]


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """docs' columns keep (default doc_id) with n_words, spans (array of words [a, b) that are hit) and items (ids of the items found, as strings), see result_names."""
    spark = in_batches(docs).sparkSession
    keep = keep or ["doc_id"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-int(size) * window // max_pattern_bytes))
    results = result_names(keep)
    text, row = ("text" if "text" in keep else free_name("__text", keep)), free_name("__row", keep)
    kept = [F.col(quoted(c)) for c in keep]
    source = docs.select(*kept) if "text" in keep else docs.select(*kept, F.col("text").alias(text))

    def one(source: DataFrame, part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        built: list = []
        names = [*source.columns, *results]
        column = source.columns.index(text)

        def run(batches):
            built.extend([] if built else [searchers(shared.value, window)])
            return _search(batches, built[0], column, names)

        none = [F.lit(None).cast(t).alias(n) for n, t in zip(results, ("long", "array<struct<a:long,b:long>>", "array<string>"))]
        return source.mapInArrow(run, source.select("*", *none).schema)

    if groups == 1:
        found = one(source, items)
        return found if "text" in keep else found.drop(text)
    numbered = written(source.withColumn(row, F.struct(F.monotonically_increasing_id().alias("i"), F.xxhash64(*kept).alias("h"))), "decontamination-rows")
    n_words, spans, found_items = results
    found = None
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        got = one(numbered.select(row, text), part).drop(text)
        found = got if found is None else found.unionByName(got)
    merged = found.groupBy(row).agg(F.max(n_words).alias(n_words), F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(found_items))).alias(found_items))
    joined = numbered.join(merged.withColumn(spans, _united(F.col(spans))), row)
    return joined.select(*kept, *results)


def _united(spans):
    """Spans that touch or overlap, as one each."""
    start = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def contamination_report(found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """find_contamination's result (with the columns keep given there) with n_hit, n_items, items_sha256 and contaminated: a twentieth of the words, and one at least, are hit. Names that keep has get `_` appended."""
    keep = keep or ["doc_id"]
    n_words, spans, items = (F.col(n) for n in result_names(keep))
    names = F.array_sort(F.filter(items, lambda i: i.isNotNull()))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    results = {"n_hit": n_hit, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.concat_ws(",", names), 256), "contaminated": (n_hit > 0) & (20 * n_hit >= n_words)}
    return found.select("*", *[c.alias(free_name(n, keep)) for n, c in results.items()])


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256), straight from the definition; for tests."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    windows = []
    for item, text in benchmark:
        w = split(text)
        m = min(len(w), window)
        windows += [(item, tuple(w[i : i + m])) for i in range(len(w) - m + 1 if w else 0)]
    out = {}
    for doc_id, text in docs:
        w = split(text)
        hit, items = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    items.add(item)
        digest = hashlib.sha256(",".join(sorted(str(i) for i in items if i is not None)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(items), digest)
    return out
