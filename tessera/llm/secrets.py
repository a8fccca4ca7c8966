"""Secrets in texts: stated patterns, and strings near sensitive words that a primed compressor can't foresee.

Patterns (base spans, whole matches, leftmost and non-overlapping for each kind): assignments to names of secrets,
access keys and long hexadecimal runs.

Novelty: candidates are runs of letters, digits and +/_.=~- of at least min_length code points, with letters and digits
or both cases, that begin at most `reach` code points behind a sensitive word of the same text and touch no base span. A
candidate's novelty is the number of bytes that it adds to what surrounds it: the zstandard size of context and
candidate less that of the context alone, where the context is `around` code points on either side without further
copies of the candidate, and the compressor is primed with a dictionary of identifiers. These are the runs of letters and
underscores, but for two digits at the end, in the surroundings of the candidates of all texts, counted by texts; the most
frequent, up to dict_bytes, make the dictionary, the most frequent last, where a match costs least. Strings with digits or signs
inside aren't identifiers, so that a secret copied into many texts doesn't get there. A candidate of at least min_novel bytes, and min_rate of its length, is
reported as kind novel.

One pass over the texts finds base spans and candidates with their contexts, which are written; identifiers are counted
and novelty is measured on these.

Defined cases: a null or empty text has no spans; rows of one doc_id, or of none, are scanned and returned each; texts are
taken whole, whatever their length; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: Runs of 24 or more: the same as all runs less the short ones.
HEX = re.compile("[0-9a-f]{24,}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?:orization)?|bearer|signature", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]+")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_+/=])[A-Za-z_]{3,40}(?=[0-9]{0,2}(?![A-Za-z0-9_+/=]))")
MIN_LENGTH = 12
REACH = 64
AROUND = 256
DICT_BYTES = 32 << 10
MIN_NOVEL = 10
MIN_RATE = 0.75
#: Distinct identifiers that a task counts before it passes them on.
COUNTED = 100_000
_SPAN = "kind string, start int, stop int"
_FOUND = f"doc_id long, base array<struct<{_SPAN}>>, candidates array<struct<start: int, text: string, before: string, after: string>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _mixed(s: str) -> bool:
    """Letters and digits, or both cases."""
    letter = any(c.isalpha() for c in s)
    return letter and (any(c.isdigit() for c in s) or (s != s.lower() and s != s.upper()))


def candidates(text: str, base: list[tuple[str, int, int]], min_length: int = MIN_LENGTH, reach: int = REACH, around: int = AROUND) -> list[tuple[int, str, str, str]]:
    """(start, string, context before, context after)"""
    out, done = [], 0
    starts, reached = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    # base is sorted by start: does one that begins before b end after a?
    touches = lambda a, b: (k := bisect_left(starts, b)) > 0 and reached[k - 1] > a
    for word in SENSITIVE.finditer(text):
        # what begins in the reach of an earlier word has been looked at
        for m in CANDIDATE.finditer(text, max(word.end(), done)):
            if m.start() > word.end() + reach:
                break
            done = m.end()
            start, s = m.start(), m[0].rstrip(".=-")
            if len(s) < min_length or not _mixed(s) or touches(start, start + len(s)):
                continue
            out.append((start, s, text[max(0, start - around) : start], text[start + len(s) : start + len(s) + around]))
    return out


def _scan(batches, how: dict):
    """(doc_id, text) -> (doc_id, base, candidates)"""
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))), ("candidates", pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("before", pa.string()), ("after", pa.string())])))])
    for batch in batches:
        base, found = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "stop"), s)) for s in spans])
            found.append([dict(zip(("start", "text", "before", "after"), c)) for c in candidates(text, spans, **how)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, schema.field(1).type), pa.array(found, schema.field(2).type)], schema=schema)


def _identifiers(batches):
    """candidates -> (identifier, n): in how many of these texts an identifier is near a candidate."""
    count = Counter()
    made = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["identifier", "n"])
    for batch in batches:
        for found in batch.column("candidates").to_pylist():
            count.update({w for c in found for w in IDENTIFIER.findall(c["before"]) + IDENTIFIER.findall(c["after"])})
            if len(count) > COUNTED:
                yield made()
                count.clear()
    yield made()


def identifier_dictionary(found: DataFrame, dict_bytes: int = DICT_BYTES) -> bytes:
    """The most frequent identifiers near candidates, the most frequent last; dict_bytes bounds what reaches the driver."""
    counted = found.where(F.size("candidates") > 0).select("candidates").mapInArrow(_identifiers, "identifier string, n long").groupBy("identifier").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "identifier").limit(dict_bytes // 4).collect()
    out, size = [], 0
    for r in top:
        size += len(r["identifier"]) + 1
        if size > dict_bytes:
            break
        out.append(r["identifier"])
    return " ".join(reversed(out)).encode()


class Novelty:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        primed = {}
        if len(dictionary) >= 8:
            primed["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed["dict_data"].precompute_compress(level=3)
        self._compressor = zstandard.ZstdCompressor(**({"level": 3} if not primed else {}), **primed, write_content_size=False, write_checksum=False)

    def size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode("utf-8", "surrogatepass")))

    def added(self, text: str, before: str, after: str) -> int:
        """The bytes that text adds to its context, which stands before it and has no copy of it."""
        context = (before + "\n" + after + "\n").replace(text, "")
        return self.size(context + text) - self.size(context)


def _measured(batches, dictionary: bytes, min_novel: int, min_rate: float):
    """-> (doc_id, spans): base spans, and novel candidates with their bytes."""
    novelty = Novelty(dictionary)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("novel_bytes", pa.int32())])))])
    for batch in batches:
        out = []
        for base, found in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
            spans = {(s["kind"], s["start"], s["stop"]): None for s in base}
            for c in found:
                n = novelty.added(c["text"], c["before"], c["after"])
                if n >= min_novel and n >= min_rate * len(c["text"]):
                    spans["novel", c["start"], c["start"] + len(c["text"])] = n
            out.append([{"kind": s[0], "start": s[1], "stop": s[2], "novel_bytes": spans[s]} for s in in_order(list(spans))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, schema.field(1).type)], schema=schema)


def find_secrets(docs: DataFrame, min_length: int = MIN_LENGTH, reach: int = REACH, around: int = AROUND, dict_bytes: int = DICT_BYTES, min_novel: int = MIN_NOVEL, min_rate: float = MIN_RATE) -> DataFrame:
    """(doc_id, text) -> (doc_id, spans: array of (kind, start, stop, novel_bytes)) by start, then kind; code points, stop exclusive; a row for each row."""
    how = {"min_length": min_length, "reach": reach, "around": around}
    texts = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = written(texts.mapInArrow(lambda it: _scan(it, how), _FOUND), "secrets-found")
    dictionary = identifier_dictionary(found, dict_bytes)
    return found.mapInArrow(lambda it: _measured(it, dictionary, min_novel, min_rate), f"doc_id long, spans array<struct<{_SPAN}, novel_bytes int>>")


def digest(found: DataFrame) -> DataFrame:
    """find_secrets' rows -> (doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans as text)."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
