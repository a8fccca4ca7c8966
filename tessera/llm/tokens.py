"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

A corpus is a folder of parts. Part k has
  part-k.bin  the ids of its documents end to end, little-endian, unsigned, 16 or 32 bits as the vocabulary needs,
  part-k.idx  n + 1 little-endian signed 64-bit offsets: ids of all documents of the corpus before each one,
  part-k.doc  the n document ids, little-endian signed 64-bit,
and manifest.json names the width and, for each part, its documents, how many of the first of them have no id (null
sorts first), its ids and its base: the ids in all parts before it.

Documents are range-partitioned and sorted by doc_id (ties by a hash of the text, so that the rows of one id, or of
none, are several parts; equal rows by the partition that they come from); each task encodes one partition and writes
its .bin and .doc files under a name of its own, then renames them, so that a task that runs twice leaves one part
with the same bytes. The parts' sizes come back as a small table; their prefix sums are the bases, and a second job
writes the .idx files with them. Readers map the files into memory where the store is a local or mounted folder.

A word's ids don't depend on the words around it where the tokenizer's pre-tokenizer splits at white space and
drops it, so each worker encodes a distinct white-space-separated word once and then looks it up; the set of words
remembered is bounded. Other tokenizers encode whole texts.

Defined cases: a null or empty text has no ids but the end id; a document with a null doc_id is written, read and
reported like others; an empty table has no parts; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, scratch, written

END_ID = 2
REMEMBERED = 300_000
#: Bytes of text for each part, about.
PART_BYTES = 48 << 20
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_STOP = re.compile(r"(?<=[a-z0-9ß-öø-ÿ])([.,])(?=[ \t\n\r]|\Z)")
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: Schemes by which Spark names stores that Arrow knows under another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _fs(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")


def _put(uri: str, name: str, data) -> None:
    """Writes a file under another name and then renames it."""
    store, root = _fs(uri)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{root}/{name}")


def _read(uri: str, name: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    store, root = _fs(uri)
    path = f"{root}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class Encoder:
    """Ids of many texts with a tokenizer of the tokenizers library."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.by_word = _drops_space(json.loads(tokenizer_json))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.ids = np.zeros(1 << 20, np.uint32)

    def _learn(self, words: list[str]) -> None:
        encoded = self._encode_words(words)
        n = np.array([len(e) for e in encoded], np.int64)
        base = len(self.index)
        while base + len(words) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + n.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[base : base + len(words)] = self.used + np.cumsum(n) - n
        self.count[base : base + len(words)] = n
        self.ids[self.used : self.used + int(n.sum())] = np.fromiter((i for e in encoded for i in e), np.uint32, int(n.sum()))
        self.used += int(n.sum())
        self.index.update(zip(words, range(base, base + len(words))))

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words of lower-case Latin letters are neither normalised nor split further, so the library's BPE model takes them as they are; others go through its whole pipeline."""
        model = self.tokenizer.model
        plain = [bool(_PLAIN.fullmatch(w)) for w in words]
        rest = iter(self.tokenizer.encode_batch([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        return [[t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LEVEL))] if p else next(rest).ids for w, p in zip(words, plain)]

    def _split(self, text: str) -> list[str]:
        """The white-space-separated words; a comma or full stop after a letter or digit at a word's end is a word of its own, as no token joins the two."""
        if "<|" in text or _ODD_SPACE.search(text):
            return _SPACE.split(text)
        return _STOP.sub(r" \1", text.encode().lower().decode()).split()

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each followed by end_id; number of ids of each)"""
        if not self.by_word:
            encoded = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            lens = np.array([len(e) + 1 for e in encoded], np.int64)
            return np.fromiter((i for e in encoded for i in (*e, end_id)), np.uint32, int(lens.sum())), lens
        if len(self.index) > REMEMBERED:
            self._forget()
        split = [self._split(t) for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        words = [w for x in split for w in x]
        flat = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(flat < 0)
        if len(miss):
            absent = [words[i] for i in miss.tolist()]
            self._learn(list(dict.fromkeys(absent)))
            flat[miss] = np.fromiter(map(self.index.__getitem__, absent), np.int64, len(absent))
        n = self.count[flat]
        total = int(n.sum())
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), n_words), n, len(texts)).astype(np.int64))
        ids = self.ids[np.repeat(self.start[flat] - (np.cumsum(n) - n), n) + np.arange(total)]
        return np.insert(ids, ends, end_id), np.diff(np.r_[0, ends]) + 1


def _drops_space(spec: dict) -> bool:
    """Whether text is split at white space, which is dropped, before anything else can join it."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = parts[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    normal = [n["type"] for n in ((spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {"type": "none"}])]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and pattern.endswith("[^\\s\\p{L}\\p{N}]+") and pattern.count("\\s") == 1 and set(normal) <= {"NFC", "Lowercase", "Replace", "none"}


def write_corpus(docs: DataFrame, tokenizer_json: str, uri: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> dict:
    """Encodes (doc_id, text) into a folder in ascending doc_id order; returns the manifest."""
    spark = docs.sparkSession
    docs = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    store, root = _fs(uri)
    store.create_dir(root, recursive=True)
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(tokenizer_json)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-int(size) // part_bytes))

    def write(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(shared.value)
        name = f"part-{TaskContext.get().partitionId():06d}"
        store, root = _fs(uri)
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        ids, lens, nulls, total = [], [], 0, 0
        out = None
        for batch in batches:
            out = out or store.open_output_stream(f"{own}.bin")
            column = batch.column("doc_id")
            nulls += column.null_count
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 200):
                tokens, n = encoder.encode([t.as_py() or "" for t in texts.slice(i, 200)], end_id)
                out.write(tokens.astype(width).tobytes())
                lens.append(n)
                total += len(tokens)
        if out is None:
            return
        out.close()
        _put(uri, f"{name}.doc", np.concatenate(ids).astype("<i8").tobytes())
        _put(uri, f"{name}.len", np.concatenate(lens).astype("<i8").tobytes())
        store.move(f"{own}.bin", f"{root}/{name}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(map(len, ids))], pa.int64()), pa.array([nulls], pa.int64()), pa.array([total], pa.int64())], ["name", "n_docs", "n_null", "n_ids"])

    ranks = docs.withColumns({"hash": F.xxhash64("text"), "piece": F.spark_partition_id()})
    dealt = ranks.repartitionByRange(parts, "doc_id", "hash", "piece").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    rows = sorted(map(tuple, written(dealt.mapInArrow(write, "name string, n_docs long, n_null long, n_ids long"), "token-parts").collect()))
    base, listed = 0, []
    for name, n_docs, n_null, n_ids in rows:  # prefix sums over the parts
        listed.append({"name": name, "n_docs": n_docs, "n_null": n_null, "n_ids": n_ids, "base": base})
        base += n_ids
    manifest = {"dtype": width, "end_id": end_id, "n_ids": base, "parts": listed}

    def index(batches):
        for batch in batches:
            for part in batch.to_pylist():
                lens = _read(uri, part["name"] + ".len", "<i8")
                _put(uri, part["name"] + ".idx", (part["base"] + np.r_[np.int64(0), np.cumsum(lens)]).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part["name"]])], ["name"])

    if listed:
        _parts(spark, manifest).mapInArrow(index, "name string").count()
    _put(uri, "manifest.json", json.dumps(manifest).encode())
    return manifest


def _parts(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(p["name"], p["n_docs"], p["n_null"], p["base"]) for p in manifest["parts"]]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "name string, n_docs long, n_null long, base long")


def read_corpus(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a folder: one task for each part."""
    store, root = _fs(uri)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())

    def read(batches):
        for batch in batches:
            for part in batch.to_pylist():
                name, base = part["name"], part["base"]
                ids, offsets, docs = _read(uri, name + ".bin", manifest["dtype"]), _read(uri, name + ".idx", "<i8"), _read(uri, name + ".doc", "<i8")
                step = 5_000
                for i in range(0, len(docs), step):
                    off = np.asarray(offsets[i : i + step + 1])
                    wide = ids[off[0] - base : off[-1] - base].astype("<u4")
                    local = (off - off[0]).tolist()
                    view = memoryview(wide).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(local, local[1:])]
                    n = len(off) - 1
                    null = np.arange(i, i + n) < part["n_null"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs[i : i + n]), pa.int64(), mask=null), pa.array(off[:-1], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _parts(spark, manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the corpus of docs into a new shared folder and reads it back."""
    spark = docs.sparkSession
    uri = scratch(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        write_corpus(docs, f.read(), uri, end_id)
    return read_corpus(spark, uri)
