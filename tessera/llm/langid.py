"""Language identification by unigrams marginalised over segmentations.

The vocabulary is a fixed public one (the pieces of a SentencePiece model, as byte strings; the word-start mark is
a space). Each language has a probability for every piece, and the likelihood of a word is the sum over all ways
to cut it into pieces of the product of the pieces' probabilities, computed by a forward algorithm. The piece
probabilities maximise that likelihood (expectation maximisation; the expected counts come from forward and
backward sums). No piece crosses a word's start, so a text's log-likelihood is the sum over its words. Words
are maximal runs of letters of the lower-cased text, of any length; the work is done on distinct words, many at a
time, and the forward sums of a word are held for as many places as the longest piece has bytes only. Training takes
runs of over TAUGHT letters, as scripts without spaces have them, in parts of that many, all of them.

The languages are those of all labelled documents that have a letter. Training takes a bounded sample of each language
(all of its documents up to max_train_docs, else about that many, chosen by a hash of doc_id and text); its words are
counted by Spark, and each round of expectation maximisation is one Spark job over these counts. The driver holds only
a table of languages x pieces, and a row for each language.

Defined cases: a null text, or one without a letter, is `und` with score 0.0; so is every text where there is
nothing to learn from. A tie goes to the language that sorts first. Repeated rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name, in_batches, quoted, written

UND = "und"
#: Letters of a word that training takes at once.
TAUGHT = 48
#: Training documents of each language at most (about).
MAX_TRAIN_DOCS = 5_000
ROUNDS = 2
#: Distinct words whose likelihoods a worker remembers.
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W\d_]+")
#: Number signs that aren't decimal digits (½, ², Ⅷ), which _WORD takes as well; there are none behind this range.
_NUMBERS = frozenset(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Nl", "No"))
#: What words() finds one of, for Spark: characters of category L.
_HAS_WORD = r"\p{L}"


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a SentencePiece model that can occur in lower-cased words (letters, after a space or not), as byte strings, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            text = model.id_to_piece(i)
            raw = text.replace("▁", " ").encode()
            if text == text.lower() and _WORD.fullmatch(text.removeprefix("▁") or "a") and _NUMBERS.isdisjoint(text):
                found.add(raw)
    return sorted(found)


class Trie:
    """The vocabulary as a dense transition table over the bytes that occur in it."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        nodes: dict[bytes, int] = {b"": 1}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes) + 1)
        follow = sorted({p[k] for p in pieces for k in range(1, len(p))})
        self.symbol = np.zeros(256, np.int32)
        self.symbol[follow] = np.arange(1, len(follow) + 1)
        self.next = np.zeros((len(nodes) + 1, len(follow) + 1), np.int32)
        self.first = np.zeros(256, np.int32)
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        for s, node in nodes.items():
            if len(s) == 1:
                self.first[s[0]] = node
            elif len(s) > 1:
                self.next[nodes[s[:-1]], self.symbol[s[-1]]] = node
        for i, p in enumerate(pieces):
            self.piece[nodes[p]] = i

    def edges(self, words: np.ndarray, lens: np.ndarray, chunk: int = 1 << 14):
        """For each start and piece length: (start, end, rows, pieces) of the pieces found there. words: one word a row, padded. The pieces of some starts at a time are looked up together."""
        n, width = words.shape
        step = max(1, chunk // n)
        for begin in range(0, width, step):
            row, start = (x.reshape(-1) for x in np.meshgrid(np.arange(n), np.arange(begin, min(begin + step, width)), indexing="ij"))
            on = lens[row] > start
            row, start = row[on], start[on]
            node = self.first[words[row, start]]
            found, j = [], 1
            while len(row):
                piece = self.piece[node]
                hit = np.flatnonzero(piece >= 0)
                found.append((start[hit], np.full(len(hit), j), row[hit], piece[hit]))
                on = np.flatnonzero(lens[row] > start + j)
                row, start, node = row[on], start[on], node[on]
                node = self.next[node, self.symbol[words[row, start + j]]]
                on = np.flatnonzero(node)
                row, start, node = row[on], start[on], node[on]
                j += 1
            if not found:
                continue
            start, size, row, piece = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((size, start))
            start, size, row, piece = start[order], size[order], row[order], piece[order]
            cuts = np.r_[0, np.flatnonzero((start[1:] != start[:-1]) | (size[1:] != size[:-1])) + 1, len(start)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield int(start[a]), int(start[a] + size[a]), row[a:b], piece[a:b]


def _groups(words: list[bytes], limit: int = 1 << 16):
    """Words of like length as padded rows: (index, matrix, lengths)."""
    lens = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lens, kind="stable")
    i = 0
    while i < len(order):
        top = max(8, 1 << int(lens[order[i]] - 1).bit_length())
        j = min(int(np.searchsorted(lens[order], top, "right")), i + max(1, limit // top))
        take = order[i:j]
        width = int(lens[take].max())
        matrix = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in take), np.uint8).reshape(len(take), width)
        yield take, matrix, lens[take]
        i = j


def forward(trie: Trie, prob: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log-likelihood of each word under each language. prob: pieces x languages."""
    out = np.zeros((len(words), prob.shape[1]))
    ring = trie.longest + 1
    for take, matrix, lens in _groups(words):
        n = len(matrix)
        alpha = np.zeros((ring, n, prob.shape[1]))  # the sums up to the places ahead, by place modulo ring
        alpha[0], at = 1.0, 0
        log_scale, whole = np.zeros((2, n, prob.shape[1]))
        for i, j, rows, pieces in trie.edges(matrix, lens):
            while at < i:  # what ends there is done, and its row is free
                ends = lens == at
                whole[ends] = alpha[at % ring, ends]
                alpha[at % ring] = 0.0
                at += 1
                if at % 16 == 0:  # what is pending is scaled, so that long words don't underflow
                    live = np.flatnonzero(lens >= at)
                    top = np.maximum(alpha[:, live].max(0), 1e-300)
                    alpha[:, live] /= top
                    log_scale[live] += np.log(top)
            alpha[j % ring, rows] += alpha[i % ring, rows] * prob[pieces]
        for k in range(at, at + ring):
            ends = lens == k
            whole[ends] = alpha[k % ring, ends]
        out[take] = np.log(np.maximum(whole, 1e-300)) + log_scale
    return out


def expected_counts(trie: Trie, prob: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Expected number of times each language uses each piece. weight: words x languages. Words have at most TAUGHT letters, so that nothing underflows."""
    total = np.zeros_like(prob)
    for take, matrix, lens in _groups(words, 1 << 15):
        own = weight[take]
        n, width = matrix.shape
        found = list(trie.edges(matrix, lens))
        alpha, beta = np.zeros((2, width + 1, n, prob.shape[1]))
        alpha[0], beta[lens, np.arange(n)] = 1.0, 1.0
        for i, j, rows, pieces in found:
            alpha[j, rows] += alpha[i, rows] * prob[pieces]
        for i, j, rows, pieces in reversed(found):
            beta[i, rows] += beta[j, rows] * prob[pieces]
        scale = own / np.maximum(beta[0], 1e-300)
        for i, j, rows, pieces in found:
            use = alpha[i, rows] * prob[pieces] * beta[j, rows] * scale[rows]
            for lang in range(prob.shape[1]):
                total[:, lang] += np.bincount(pieces, use[:, lang], len(prob))
    return total


def _words(text: str) -> list[str]:
    """Runs of letters, that is of characters of category L, in lower case."""
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join(" " if c in _NUMBERS else c for c in text)
    return _WORD.findall(text)


def _taught(text: str):
    """The words of a text as training takes them: each after a space, and the further parts of long ones without."""
    for word in _words(text):
        yield " " + word[:TAUGHT]
        for k in range(TAUGHT, len(word), TAUGHT):
            yield word[k : k + TAUGHT]


def _count_words(batches):
    for batch in batches:
        held: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            held.setdefault(lang, Counter()).update(_taught(text.as_py()))
        for lang, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])


def training_sample(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, lang) -> (text, lang): of each language all documents with a letter, or about max_train_docs of them if it has more; one at least."""
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    docs = docs.select(*key, "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(_HAS_WORD)).withColumn("__at", F.pmod(F.xxhash64(*key), F.lit(1 << 31)))
    bound = docs.groupBy("lang").agg(F.greatest(F.min("__at").cast("double"), (1 << 31) * (F.lit(float(max_train_docs)) / F.count("*"))).alias("__bound"))
    return docs.join(F.broadcast(bound), "lang").where(F.col("__at") <= F.col("__bound")).select("text", "lang")


def train(docs: DataFrame, model_path: str, max_train_docs: int = MAX_TRAIN_DOCS, rounds: int = ROUNDS) -> tuple[list[str], list[bytes], np.ndarray]:
    """(doc_id, text, lang) -> languages, pieces, probabilities (pieces x languages)."""
    spark = docs.sparkSession
    sample = training_sample(docs, max_train_docs)
    counted = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_word = counted.repartition(spark.sparkContext.defaultParallelism, "word").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    words = written(by_word, "langid-words")
    langs = sorted(r[0] for r in words.select(F.explode(F.map_keys("by_lang")).alias("lang")).distinct().collect())
    pieces = vocabulary(model_path)
    if not langs:
        return [], pieces, np.zeros((len(pieces), 0))
    prob = np.repeat(np.array([[np.exp(-2.0 - len(p))] for p in pieces]), len(langs), 1)
    prob /= prob.sum(0)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, prob))

        def expect(batches, shared=shared):
            pieces, prob = shared.value
            trie, total = Trie(pieces), np.zeros_like(prob)
            for batch in batches:
                own = [w.encode() for w in batch.column("word").to_pylist()]
                weight = np.zeros((len(own), len(langs)))
                for k, counts in enumerate(batch.column("by_lang").to_pylist()):
                    for lang, n in counts:
                        weight[k, langs.index(lang)] = n
                total += expected_counts(trie, prob, own, weight)
            at = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], ["piece", "lang", "n"])

        got = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        count = np.zeros_like(prob)
        count[got["piece"], got["lang"]] = got["n"]
        shared_by_all = count.sum(1, keepdims=True) / max(1e-9, count.sum())  # what one language never used
        count += 0.5 * len(pieces) * (0.9 * shared_by_all + 0.1 / len(pieces))
        prob = count / count.sum(0)
    return langs, pieces, prob


def identify(docs: DataFrame, learn_from: DataFrame, model_path: str, max_train_docs: int = MAX_TRAIN_DOCS, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred under equal priors); keep: the columns that stay (default doc_id; a result whose name is among them gets `_` appended)."""
    spark = in_batches(docs).sparkSession
    keep = keep or ["doc_id"]
    results = [free_name(n, keep) for n in ("lang_pred", "score")]
    langs, pieces, prob = train(learn_from, model_path, max_train_docs, rounds)
    kept_columns = [F.col(quoted(c)) for c in keep]
    if not langs:
        return docs.select(*kept_columns, F.lit(UND).alias(results[0]), F.lit(0.0).alias(results[1]))
    shared = spark.sparkContext.broadcast((pieces, prob))
    names = np.array(langs)
    kept = docs.select(*kept_columns) if "text" in keep else docs.select(*kept_columns, F.col("text").alias("__text"))
    at = keep.index("text") if "text" in keep else len(keep)
    schema = docs.select(*kept_columns, F.lit(UND).alias(results[0]), F.lit(0.0).alias(results[1])).schema

    def predict(batches):
        pieces, prob = shared.value
        trie = Trie(pieces)
        index: dict[str, int] = {}
        loglik = np.zeros((0, len(langs)))
        for batch in batches:
            n = batch.num_rows
            total, count = np.zeros((n, len(langs))), np.zeros(n, np.int64)
            texts = batch.column(at)
            for i in range(0, n, 500):
                part = [_words(t) if (t := x.as_py()) else [] for x in texts.slice(i, 500)]
                count[i : i + len(part)] = lens = np.array([len(x) for x in part])
                if not lens.sum():
                    continue
                new = list({w for words in part for w in words if w not in index})
                if len(index) + len(new) > REMEMBERED:
                    index, loglik = {}, loglik[:0]
                    new = list({w for words in part for w in words})
                index.update(zip(new, range(len(index), len(index) + len(new))))
                if new:
                    loglik = np.concatenate([loglik, forward(trie, prob, [b" " + w.encode() for w in new])])
                flat = np.fromiter((index[w] for words in part for w in words), np.int64, int(lens.sum()))
                full = np.flatnonzero(lens)
                total[i + full] = np.add.reduceat(loglik[flat], np.cumsum(np.r_[0, lens[full][:-1]]))
            post = np.exp(total - total.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            best = total.argmax(1)
            pred = np.where(count > 0, names[best], UND)
            score = np.where(count > 0, post[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred.tolist(), pa.string()), pa.array(score)], [*keep, *results])

    return kept.mapInArrow(predict, schema)


def held_out_langid(docs: DataFrame, model_path: str, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score), learned from the documents of the other folds."""
    out = identify(docs, docs.where(F.col("doc_id").isNull() | (fold(F.col("doc_id"), folds) != held_out)), model_path)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
