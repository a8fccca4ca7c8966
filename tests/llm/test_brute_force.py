"""Operators that SQL can't express, against versions written straight from their definitions."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")

from tessera.llm import langid, neardup, rollup, toxicity  # noqa: E402


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def kneser_ney(texts, order, discount):
    """(text, class) -> a function of (context and byte) to the log-likelihood ratio of its last byte."""
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    count = {0: Counter(), 1: Counter()}
    for t, c in texts:
        b = bytes(order - 1) + lower(t)
        count[c].update(b[i : i + order] for i in range(len(b) - order + 1))
    seen = set(count[0]) | set(count[1])
    types, level = {}, seen
    for k in range(order - 1, 0, -1):
        types[k] = Counter(s[1:] for s in level)
        level = set(types[k])

    def backoff(s):
        n = types[len(s)]
        same = [x for x in n if x[:-1] == s[:-1]]
        total = sum(n[x] for x in same)
        low = backoff(s[1:]) if len(s) > 1 else 1 / 256
        return max(n[s] - discount, 0) / total + discount * len(same) / total * low

    ratio = {}
    for g in seen:
        p = backoff(g[1:])
        value = []
        for c in (1, 0):
            same = {x: n for x, n in count[c].items() if x[:-1] == g[:-1]}
            total = sum(same.values())
            value.append((max(count[c][g] - discount, 0) / total + discount * len(same) / total * p) if total else p)
        ratio[g] = math.log(value[0] / value[1])
    context = {}
    for h in {g[:-1] for g in seen}:
        value = []
        for c in (1, 0):
            same = {x: n for x, n in count[c].items() if x[:-1] == h}
            total = sum(same.values())
            value.append(discount * len(same) / total if total else 1.0)
        context[h] = math.log(value[0] / value[1])

    def evidence(text):
        b = bytes(order - 1) + lower(text or "")
        v = [ratio.get(b[i : i + order], context.get(b[i : i + order - 1], 0.0)) for i in range(len(b) - order + 1)]
        if not v:
            return 0.0, 0.0
        total = np.r_[0, np.cumsum(v)]
        return total[-1] / len(v), max(total[i + 1] - total[max(i + 1 - toxicity.SPAN, 0)] for i in range(len(v))) / toxicity.SPAN

    return evidence


def test_toxicity_evidence(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("Ab", "c", "deé", "fa", "bad" if i % 3 else "ugh")) for _ in range(rng.randrange(9)))) for i in range(90)] + [(90, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(80)]
    made = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), order=3).collect()
    train = [(rows[i][1], y) for i, y in labels if fold(i, 5) not in (0, 1)]
    evidence = kneser_ney(train, 3, toxicity.DISCOUNT)
    text = dict(rows)
    for r in made:
        assert (r["mean_llr"], r["peak_llr"]) == pytest.approx(evidence(text[r["doc_id"]]), abs=1e-5)
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5)


def segmentations(word, pieces):
    if not word:
        yield ()
    for p in pieces:
        if word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield (p, *rest)


def test_language_sums_and_expected_counts():
    rng = np.random.default_rng(1)
    pieces = sorted([b"a", b"b", b" ", b" a", b"ab", b"ba", b"bab", b"abba"])
    prob = rng.random((len(pieces), 3))
    trie = langid.Trie(pieces)
    words = [b" " + bytes(rng.choice(list(b"ab"), rng.integers(1, 9)).tolist()) for _ in range(40)]
    weight = rng.integers(0, 4, (40, 3)).astype(float)
    want, counts = np.zeros((40, 3)), np.zeros_like(prob)
    for k, w in enumerate(words):
        every = [[pieces.index(p) for p in s] for s in segmentations(w, pieces)]
        share = np.array([np.prod(prob[s], axis=0) for s in every])
        want[k] = share.sum(0)
        for s, x in zip(every, share):
            for i in s:
                counts[i] += weight[k] * x / share.sum(0)
    assert np.allclose(langid.forward(trie, prob, words), np.log(want))
    assert np.allclose(langid.expected_counts(trie, prob, words, weight), counts)


def test_long_words_keep_their_sums():
    """Words of any length, more letters than fit a double's range; the sums up to each place follow by recursion."""
    pieces = [b"a", b"b", b"ab", b"aab"]
    prob = np.array([[1e-3, 2e-5], [1e-4, 1e-6], [1e-2, 3e-5], [1e-5, 1e-3]])
    word = bytes(random.Random(3).choice(b"ab") for _ in range(3000))
    logs = np.full((len(word) + 1, 2), -np.inf)
    logs[0] = 0
    for i in range(len(word)):
        for p, q in zip(pieces, prob):
            if word.startswith(p, i):
                logs[i + len(p)] = np.logaddexp(logs[i + len(p)], logs[i] + np.log(q))
    assert np.allclose(langid.forward(langid.Trie(pieces), prob, [word, b"ab"])[0], logs[-1], rtol=1e-9)


def test_scripts_without_spaces_are_learned(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    one, two = "去年今日此门中人面桃花相映红", "人面不知何处去桃花依旧笑春风"
    docs = [(i, (one if i % 2 else two)[i % 7 :] * 9, "x" if i % 2 else "y") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = langid.held_out_langid(df, path).where("held_out").collect()
    assert got and all(r["lang_pred"] == ("x" if r["doc_id"] % 2 else "y") for r in got)


def test_near_duplicate_classes(spark):
    rng = random.Random(6)
    docs = []
    for c in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
            docs.append((rng.randrange(10**6), " ".join(words)))
    docs += [(10**6 + i, " ".join(f"u{rng.randrange(9)}" for _ in range(i % 7))) for i in range(40)] + [(10**7, None)]
    docs = list(dict(docs).items())
    sets = {i: ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None) for i, t in docs for w in [(t or "").split()]}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in ids}
    shuffled = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), max_broadcast_ids=0)
    assert {r["doc_id"]: r["class_id"] for r in shuffled.collect()} == got


def test_another_batch_under_a_name_is_refused(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokens long, batch int"
    event = lambda *rows: spark.createDataFrame([(*r, None, None, None, 1) for r in rows], schema)
    kept = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert kept.commit("one", event(("insert", "a", "en", "v", 5), ("insert", "a", "en", "v", 5)))
    assert not kept.commit("one", event(("insert", "a", "en", "v", 4), ("insert", "a", "en", "v", 6)))
    for other in (event(("insert", "a", "en", "v", 5)), event(("insert", "b", "en", "v", 10)), event()):
        with pytest.raises(ValueError):
            kept.commit("one", other)
    with pytest.raises(Exception, match="unknown kind"):
        kept.commit("two", event((None, "a", "en", "v", 5)))
    assert [tuple(r) for r in kept.totals().collect()] == [("a", "en", "v", 2, 10)]
