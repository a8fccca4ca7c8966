"""Exact top-k search by TF-IDF cosine for a stated list of queries: one scan of all texts, no index.

Documents are dealt into groups by a hash of their key. A group numbers its words and terms by itself and sends each term that it has, once, to the
bucket of the term's hash, with the number of its documents that have it. A bucket adds these up and answers every group in the order of what it
sent; only a group's distinct terms travel, never a document's. With the answers a group has the document frequencies of all its terms,
and so its norms, and the scores of all its documents for every query; of these the k best of each query leave it.

Within a group words are told apart by 64 bits of hash, across groups terms by 80. Words are the bytes a-z and 0-9 of the lower-case text, as text.terms()
has them; the two other characters that have such letters in lower case (U+0130 and U+212A) are put in their place first.

Defined cases are those of search.TermIndex: null texts have no terms, only documents with a positive score are results, ties go to the smaller key,
rows of one key are one document, also those without a key, which is counted and never a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import STOP, token_set, top

#: Documents of a group, about, and as many buckets of terms as groups; places to which cosines count; bytes of a matrix of tokens and documents.
GROUP_DOCS, PLACES, MATRIX = 16_384, 9, 1 << 24
#: Queries of one call at most: each task has them all.
MAX_QUERIES = 1000
#: Characters that a token's code has room for, by its base.
BASE, EXACT = 38, 12

_U = np.uint64
LOWER, TOKEN = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    LOWER[_c] = TOKEN[_c] = _c
    LOWER[ord(chr(_c).upper())] = TOKEN[ord(chr(_c).upper())] = _c
TOKEN[ord("_")] = ord("_")
DIGIT = np.zeros(256, np.uint64)
DIGIT[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = np.arange(1, 38)


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def drawn(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


LETTERS = [drawn(256, 11), drawn(256, 12)]
for _t in LETTERS:
    _t[0] = 0
_places = [drawn(1 << 12, 21) | _U(1), drawn(1 << 12, 22) | _U(1)]


def places(kind: int, n: int) -> np.ndarray:
    """At least n odd factors, one for each place of a word."""
    if len(_places[kind]) < n:
        _places[kind] = drawn(2 * n, 21 + kind) | _U(1)
    return _places[kind]


def hashed(letters: np.ndarray, starts: np.ndarray, kind: int) -> np.ndarray:
    """The hash of each word; letters that are 0 count nothing, and each word goes on to the next one's start."""
    place = np.arange(len(letters)) - np.repeat(starts, np.diff(starts, append=len(letters)))
    return mixed(np.add.reduceat(LETTERS[kind][letters] * places(kind, int(place.max()) + 1)[place], starts))


@dataclass
class Words:
    """Words of two or more letters: the row and the number of each, in order; by number two hashes, and the letters of all one after the other."""

    row: np.ndarray
    number: np.ndarray
    hashes: list[np.ndarray]
    letters: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def words(texts: pa.Array, kinds: np.ndarray, rows: int = 2048) -> Words:
    for c, like in (("\u0130", "i "), ("\u212a", "k")):
        if pc.any(pc.match_substring(texts, c)).as_py():
            texts = pc.replace_substring(texts, c, like)
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    letters = kinds[raw]
    found = []
    for i in range(0, len(texts), rows):
        ends = at[i : i + rows + 1]
        b = letters[ends[0] : ends[-1]]
        own = ends[:-1][ends[:-1] < ends[-1]] - ends[0]
        if not len(b):
            continue
        there = b != 0
        first, last = there.copy(), there.copy()
        first[1:] &= ~there[:-1]
        first[own] = there[own]
        last[:-1] &= ~there[1:]
        last[own[1:] - 1] = there[own[1:] - 1]
        s = np.flatnonzero(first)
        length = np.flatnonzero(last) + 1 - s
        b[s[length < 2]] = 0
        s, length = s[length >= 2], length[length >= 2]
        if len(s):
            found.append((np.searchsorted(ends - ends[0], s, "right") - 1 + i, hashed(b[s[0] :], s - s[0], 0), s + ends[0], length))
    none = np.zeros(0, np.int64)
    row, h, s, length = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none.astype(np.uint64), none, none)
    number, unique = pd.factorize(h)
    one = np.zeros(len(unique), np.int64)
    one[number[::-1]] = np.arange(len(number))[::-1]
    s, length = s[one], length[one]
    starts = np.cumsum(length) - length
    own = letters[spread(s, length)]
    return Words(row, number, [unique, hashed(own, starts, 1) if len(own) else none.astype(np.uint64)], own, starts, length)


def term_hashes(hashes: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits for each term: a word, where second is -1, or two."""
    out = []
    for h in hashes:
        one, two = h[first] * _U(0xD6E8FEB86659FD93), h[np.maximum(second, 0)] * _U(0xA0761D6478BD642F)
        out.append(mixed(np.where(second < 0, one, one + two + _U(0x589965CC75374CC3))))
    return out[0], (out[1] & _U(0xFFFF)).astype(np.uint16)


def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order by a and b, where equal a are rare."""
    order = np.argsort(a, kind="stable")
    return np.lexsort((b, a)) if (a[order][1:] == a[order][:-1]).any() else order


@dataclass
class Terms:
    """Distinct terms by their hashes, in order; of each term and document that has it, by term and document: both, and the number of times."""

    high: np.ndarray
    low: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    times: np.ndarray


def terms_of(found: Words, doc: np.ndarray, n: int, stop: list[str] | None) -> Terms:
    """doc: of each row, below n."""
    row, number = found.row, found.number
    if stop:
        left = words(pa.array(stop, pa.string()), LOWER)
        keep = ~np.isin(found.hashes[0], left.hashes[0])[number]
        row, number = row[keep], number[keep]
    pair = row[1:] == row[:-1]
    v = len(found.hashes[0])
    coded, unique = pd.factorize(np.concatenate([number, (number[:-1] * v + number[1:])[pair] + v]))
    of = doc[np.concatenate([row, row[1:][pair]])]
    high, low = term_hashes(found.hashes, np.where(unique < v, unique, (unique - v) // max(1, v)), np.where(unique < v, -1, (unique - v) % max(1, v)))
    order = ordered(high, low)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    both, times = np.unique(place[coded] * n + of, return_counts=True)
    term = both // max(1, n)
    return Terms(high[order], low[order], term, both - term * n, times)


def planes(values: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on, which shrink better."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def cuts(high: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ordered hashes, and the end."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(high, edges), len(high))


def documents(table: pa.Table, key: str) -> tuple[pa.Array, np.ndarray, int]:
    """The keys, of each row the document, and the number of documents; rows without a key are one, the last."""
    coded = table.column(key).combine_chunks().dictionary_encode()
    n = len(coded.dictionary)
    return coded.dictionary, coded.indices.fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64), n + (coded.indices.null_count > 0)


@dataclass
class Asked:
    """Queries by number: names, terms (in order of their hashes) with the number of times, and tokens."""

    names: pa.Array
    high: np.ndarray
    low: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]
    tokens: list[bytes]
    of: list[np.ndarray]

    @staticmethod
    def read(queries: DataFrame, name: str, text: str, stop: list[str] | None) -> Asked:
        told = queries.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(text).alias("text"), token_set(F.col(text)).alias("tokens")).limit(MAX_QUERIES + 1).toArrow()
        if told.num_rows > MAX_QUERIES:
            raise ValueError(f"there must be {MAX_QUERIES} queries at most")
        names, query, n = documents(told, "name")
        found = terms_of(words(told.column("text").combine_chunks(), LOWER), query, n, stop)
        by = np.argsort(found.doc, kind="stable")
        ends = np.searchsorted(found.doc[by], np.arange(n + 1))
        have = [set() for _ in range(n)]
        for q, tokens in zip(query.tolist(), told.column("tokens").to_pylist(), strict=True):
            have[q].update(t.encode() for t in tokens or ())
        every = sorted(set().union(*have))
        at = {t: i for i, t in enumerate(every)}
        return Asked(names, found.high, found.low, [found.term[by[a:b]] for a, b in zip(ends, ends[1:], strict=False)], [found.times[by[a:b]] for a, b in zip(ends, ends[1:], strict=False)], every, [np.array(sorted(at[t] for t in h), np.int64) for h in have])


def spread(low: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1 and so on, more of them, of each, one after the other."""
    return np.repeat(low - (np.cumsum(more) - more), more) + np.arange(more.sum())


def contained(found: Words, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, token): which of the tokens, of letters, digits and _, each word has in it."""
    codes: list[dict[int, list[int]]] = [{} for _ in range(min(EXACT, max(map(len, tokens), default=0)))]
    for i, t in enumerate(tokens):
        code, whole = 0, []
        for c, of in zip(t, codes, strict=False):
            code = code * BASE + int(DIGIT[c])
            whole = of.setdefault(code, [])
        whole.append(i)
    at = np.arange(len(found.letters))
    word = np.repeat(np.arange(len(found.lengths)), found.lengths)
    left = np.repeat(found.starts + found.lengths, found.lengths) - at
    code = np.zeros(len(at), np.uint64)
    pairs = [np.zeros((2, 0), np.int64)]
    for size, of in enumerate(codes, 1):
        on = left >= size
        at, left, word = at[on], left[on], word[on]
        code = code[on] * _U(BASE) + DIGIT[found.letters[at + size - 1]]
        known = np.array(sorted(of), np.uint64)
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        on = known[place] == code
        at, left, word, code, place = at[on], left[on], word[on], code[on], place[on]
        ends = [(i, t) for i, c in enumerate(known.tolist()) for t in of[c]]
        if ends:
            which, token = np.array(ends, np.int64).T
            low = np.searchsorted(which, place)
            more = np.searchsorted(which, place, "right") - low
            each, t = np.repeat(np.arange(len(place)), more), token[spread(low, more)]
            if size == EXACT:
                ok = np.array([found.letters[at[e] : at[e] + min(left[e], len(tokens[k]))].tobytes() == tokens[k] for e, k in zip(each.tolist(), t.tolist(), strict=True)], bool)
                each, t = each[ok], t[ok]
            pairs.append(np.stack([word[each], t]))
    both = np.unique(np.concatenate([p[0] * max(1, len(tokens)) + p[1] for p in pairs]))
    return both // max(1, len(tokens)), both % max(1, len(tokens))


def token_counts(found: Words, doc: np.ndarray, n: int, asked: Asked) -> np.ndarray:
    """Of each query and document, how many of the query's tokens the document has in it."""
    word, token = contained(found, asked.tokens)
    first = np.searchsorted(word, np.arange(len(found.lengths) + 1))
    more = np.diff(first)
    out = np.zeros((len(asked.of), n), np.uint32)
    of, number = doc[found.row], found.number
    for a in range(0, n, step := max(1, MATRIX // max(1, len(asked.tokens)))):
        size = min(step, n - a)
        here, w = (of, number) if size == n else ((of - a)[on := (of >= a) & (of < a + size)], number[on])
        each = more[w]
        t = token[spread(first[w], each)]
        has = np.zeros((len(asked.tokens), size), np.uint8)
        has.reshape(-1)[t * size + np.repeat(here, each)] = 1
        for q, own in enumerate(asked.of):
            for i in range(0, len(own), 255):
                out[q, a : a + size] += np.add.reduce(has[own[i : i + 255]], axis=0, dtype=np.uint8)
    return out


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves go up, as SQL rounds doubles."""
    y = x * 10.0**places
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 10.0**places


def weight(times: np.ndarray, df: np.ndarray, n: int, min_df: int) -> np.ndarray:
    return np.where(df >= min_df, times * (np.log((1.0 + n) / (1 + df)) + 1), 0.0)


def nearest(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, qtext: str = "text", k: int = 10, per_token: float | None = None, min_df: int = 2, stop: list[str] | None = STOP, rows: int | None = None, keep_text: bool = False) -> DataFrame:
    """(qkey, key, score, rank): the k documents nearest to each query, of those that share a term with it.

    per_token: scores are cosines plus that for each of the query's distinct tokens (over two characters) that the text contains, to six places. rows: about how many docs has;
    they are counted where it is None. keep_text: with the texts of the results.
    """
    asked = Asked.read(queries, qkey, qtext, stop)
    groups = max(1, -(-(docs.count() if rows is None else rows) // GROUP_DOCS))
    # rows without a key, which are never a result, are dealt by their texts into groups of their own, below 0
    group = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64(text), F.lit(groups)))
    dealt = docs.select(group.cast("int").alias("group"), F.col(key).alias("key"), F.col(text).alias("text"))
    bounds = cuts(asked.high, groups)

    def send(table):
        _, doc, n = documents(table, "key")
        mine = terms_of(words(table.column("text").combine_chunks(), LOWER), doc, n, stop)
        here = np.bincount(mine.term, minlength=len(mine.high)).astype(np.uint32)
        at = cuts(mine.high, groups)
        parts = [slice(a, b) for a, b in zip(at, at[1:], strict=False)]
        return pa.table({
            "bucket": pa.array(range(groups), pa.int32()), "group": pa.array([table.column("group")[0].as_py()] * groups, pa.int32()), "n": pa.array([n] * groups, pa.int64()),
            "high": pa.array([planes(mine.high[p]) for p in parts], pa.binary()), "low": pa.array([mine.low[p].tobytes() for p in parts], pa.binary()), "here": pa.array([planes(here[p]) for p in parts], pa.binary()),
        })

    def add(table):
        at = [unplaned(x.as_buffer(), np.uint64) for x in table.column("high")]
        high, low, here = np.concatenate(at), np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("low")]), np.concatenate([unplaned(x.as_buffer(), np.uint32) for x in table.column("here")])
        order = ordered(high, low)
        h, w = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        number = np.cumsum(new) - 1
        ends = np.cumsum([0, *map(len, at)])
        keyless = np.array([g < 0 for g in table.column("group").to_pylist()])
        none = np.repeat(keyless, np.diff(ends))[order]
        # all rows without a key are one document
        total = (np.bincount(number, np.where(none, 0, here[order])) + (np.bincount(number, none) > 0)).astype(np.uint32)
        df = np.empty(len(h), np.uint32)
        df[order] = total[number]
        n = sum(x for x, none in zip(table.column("n").to_pylist(), keyless, strict=True) if not none) + int(keyless.any())
        b = table.column("bucket")[0].as_py()
        of = slice(bounds[b], bounds[b + 1])
        theirs = located(h[new], w[new], asked.high[of], asked.low[of])
        count = np.where(theirs >= 0, total[theirs] if len(total) else 0, 0).astype(np.uint32)
        return pa.table({
            "group": table.column("group"), "bucket": table.column("bucket"), "n": pa.array([n] * len(at), pa.int64()),
            "df": pa.array([planes(df[a:z]) for a, z in zip(ends, ends[1:], strict=False)], pa.binary()), "asked": pa.array([count.tobytes()] * len(at), pa.binary()),
        })

    made = pa.schema([("query", pa.int32()), ("key", pa.null()), ("score", pa.float64()), *([("text", pa.string())] if keep_text else [])])

    def score(table, told):
        kind = table.schema.field("key").type
        schema = made.set(1, pa.field("key", kind))
        if not table.num_rows or table.column("group")[0].as_py() < 0:
            return schema.empty_table()
        keys, doc, n = documents(table, "key")
        texts = table.column("text").combine_chunks()
        found = words(texts, LOWER)
        mine = terms_of(found, doc, n, stop)
        told = told.sort_by("bucket")
        df = np.concatenate([unplaned(x.as_buffer(), np.uint32) for x in told.column("df")]).astype(np.float64)
        whole = told.column("n")[0].as_py()
        theirs = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in told.column("asked")]).astype(np.float64)
        if len(df) != len(mine.high) or len(theirs) != len(asked.high):
            raise ValueError("a group's answers aren't for the terms that it has")
        w = mine.times * weight(1.0, df, whole, min_df)[mine.term]
        norm = np.sqrt(np.bincount(mine.doc, w * w, n))
        w /= np.where(norm > 0, norm, 1.0)[mine.doc]
        ends = np.searchsorted(mine.term, np.arange(len(mine.high) + 1))
        local = located(mine.high, mine.low, asked.high, asked.low)
        order = np.empty(len(keys), np.int64)
        order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        if per_token is not None:
            in_text = token_counts(found if not pc.any(pc.match_substring(texts, "_")).as_py() else words(texts, TOKEN), doc, n, asked)
        results = []
        for q, (of, times) in enumerate(zip(asked.terms, asked.times, strict=True)):
            own = weight(times, theirs[of], whole, min_df)
            size = np.sqrt((own * own).sum())
            at = [(slice(ends[t], ends[t + 1]), x / size) for t, x in zip(local[of].tolist(), own.tolist(), strict=True) if t >= 0 and x > 0]
            if not at:
                continue
            scores = rounded(np.bincount(np.concatenate([mine.doc[s] for s, _ in at]), np.concatenate([w[s] * x for s, x in at]), n), PLACES)
            d = np.flatnonzero(scores[: len(keys)] > 0)
            scores = scores[d]
            if per_token is not None:
                scores = rounded(scores + rounded(per_token * in_text[q, d], PLACES), 6)
            if len(d) > k:
                best = scores >= np.partition(scores, len(d) - k)[len(d) - k]
                d, scores = d[best], scores[best]
            best = np.lexsort((order[d], -scores))[:k]
            results.append((np.full(len(best), q, np.int32), d[best], scores[best]))
        if not results:
            return schema.empty_table()
        q, d, scores = (np.concatenate(x) for x in zip(*results, strict=True))
        columns = [pa.array(q), keys.take(pa.array(d)), pa.array(scores)]
        if keep_text:
            one = np.zeros(n, np.int64)
            one[doc[::-1]] = np.arange(len(doc))[::-1]
            columns.append(texts.take(pa.array(one[d])))
        return pa.Table.from_arrays(columns, schema=schema)

    sent = dealt.groupBy("group").applyInArrow(send, "bucket int, group int, n long, high binary, low binary, here binary")
    answers = sent.groupBy("bucket").applyInArrow(add, "group int, bucket int, n long, df binary, asked binary")
    kind = docs.schema[key].dataType.simpleString()
    found = dealt.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(score, f"query int, key {kind}, score double" + ", text string" * keep_text)
    best = top(found, "query", "key", k)
    names = queries.sparkSession.createDataFrame(pa.table({"__query": pa.array(range(len(asked.names)), pa.int32()), "__name": asked.names}))
    texts = [F.col("text").alias(text)] if keep_text else []
    return best.join(F.broadcast(names), F.col("query") == F.col("__query")).select(F.col("__name").alias(qkey), F.col("key").alias(key), "score", "rank", *texts)


def located(high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each (a, b) is among the ordered (high, low), or -1."""
    at = np.searchsorted(high, a)
    out = np.full(len(a), -1, np.int64)
    for i in np.flatnonzero(at < len(high)).tolist():
        j = at[i]
        while j < len(high) and high[j] == a[i]:
            if low[j] == b[i]:
                out[i] = j
                break
            j += 1
    return out
