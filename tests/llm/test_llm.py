"""Each operator against a brute-force version, and the defined edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

tessera_llm = pytest.importorskip("tessera.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import ann, decontam, html, langid, mixing, neardup, repeats, rollup, tokens, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, class string"
ODD = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s1", 0, "x", None), (3, "one two three four five six", "en", "s1", 1, None, "y"), (3, "one two three four five six", "en", "s1", 1, None, "y"), (4, "one two three four five six", "fr", None, 1, "x", "y"), (None, "ein zwei drei vier", "de", "s2", 1, "x", "y"), (5, "long " * 5000, "en", "s1", 9, "x", "y"), (6, "... 12 !?", "en", "s1", 9, "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score_toxicity(odd.limit(0), labels.limit(0)).count() == 0


def test_toxicity_learns(spark):
    rng = random.Random(1)
    docs = [(i, words(rng, 60) + (" idiot scum" if i % 3 == 0 else ""), ) for i in range(400)]
    labels = [(i, int(i % 3 == 0)) for i in range(400)]
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert len(got) > 40 and np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got]) > 0.95


def test_repeats_against_brute_force(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcd ") for _ in range(90))
    docs = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(150))) + (shared[rng.randrange(20) :] if i % 3 else "") + ("xyz" * 40 if i % 7 == 0 else "")) for i in range(60)] + [(60, None), (61, "")]
    length = 50
    count = Counter(b[k : k + length] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    want = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        want[i] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block, piece in ((1 << 20, 1 << 20), (1 << 11, 1 << 20), (1 << 20, 37)):
        assert {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df, length, block, piece).collect()} == want
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_long_and_periodic_texts():
    """Pieces have every start once; a text of one letter is many equal segments of bounded length."""
    text = "".join(random.Random(4).choice("abcd") for _ in range(50_000)) + "x" * 30_000
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([text, "short " * 90])], ["row", "text"])
    whole, cut = (pa.Table.from_batches(list(repeats._segments(iter([batch]), 400, piece))).to_pylist() for piece in (1 << 20, 1000))
    starts = lambda found: sorted((s["row"], s["at"] + k, s["key"]) for s in found for k in range(s["starts"]))
    assert starts(whole) == starts(cut)
    assert max(s["starts"] for s in cut) <= 1000 < max(s["starts"] for s in whole)


def test_more_segments_than_16_bits_tell_apart():
    m = 66_000
    bytes_ = [b"%06d" % (k % 65_990) for k in range(m)]
    block = pa.table({"key": pa.array(range(m)), "h1": pa.array(range(m)), "h2": pa.array(range(m)), "copies": pa.array([1] * m), "hot": pa.array([False] * m), "bytes": pa.array(bytes_, pa.binary())})
    marked = [bool(r) for r in repeats._judge(block, 6).column("runs").to_pylist()]
    assert marked == [k < 10 or k >= 65_990 for k in range(m)]


def test_repeats_edges(odd):
    assert odd.count() == repeats.remove_repeats(odd).count()


def test_langid(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = langid.held_out_langid(odd, path).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6)} == {"und"}
    assert langid.held_out_langid(odd.limit(0), path).count() == 0
    pieces = [b"a", b"b", b"ab", b"ba"]
    prob = np.array([[0.4], [0.3], [0.2], [0.1]])
    # aba: a b a, ab a, a ba
    assert np.isclose(np.exp(langid.forward(langid.Trie(pieces), prob, [b"aba"]))[0, 0], 0.4 * 0.3 * 0.4 + 0.2 * 0.4 + 0.4 * 0.1)


def test_decontamination_against_brute_force(spark, odd):
    rng = random.Random(3)
    bench = [(i, words(rng, n, 6)) for i, n in enumerate((0, 1, 3, 12, 13, 14, 30))] + [(7, None)]
    docs = [(i, words(rng, 80, 6) + " " + bench[rng.randrange(7)][1]) for i in range(40)] + [(40, None), (41, "")]
    made = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.contamination_report(made).collect()}
    want = decontam.brute_force(docs, bench)
    assert got == want
    several = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), max_pattern_bytes=600)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.contamination_report(several).collect()} == want
    assert decontam.find_contamination(odd, spark.createDataFrame([], "item_id long, text string"), keep=odd.columns).count() == len(ODD)


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='sidebar'><p>Buy now, really.</p></div><article><h1>A &amp; B</h1><p>One\n two<br>three.<p>Four <b>five</b>, six.</article><div id=comments><p>First comment, hello.</p></div><footer>&copy; me</footer></body>"
    assert html.main_text(page) == "A & B\nOne two three.\nFour five, six."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.minimum_cut(2, [3.0, 0.0], [0.0, 1.0], {(0, 1): 2.0}) == [True, True]
    assert html.minimum_cut(2, [3.0, 0.0], [0.0, 3.0], {(0, 1): 2.0}) == [True, False]


def test_mixing(spark, odd):
    docs = spark.createDataFrame([(i, "a b", "x" if i < 90 else "y", "s") for i in range(100)], "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    half = [F.lit(1.0), F.lit(1.0)]
    got = {r["lang"]: r["n"] for r in mixing.mix(docs, levels, half, total=100).groupBy("lang").agg(F.sum("mix_tokens").alias("n")).collect()}
    assert got == {"y": 40, "x": 60}  # y has 20 tokens, read twice; the rest goes to its sibling
    assert mixing.mix(odd, levels, half).columns[: len(odd.columns)] == odd.columns
    assert mixing.mix(odd.limit(0), levels, half).count() == 0
    slots = mixing.mix(docs, levels, half, total=100, slot_rows=3)
    assert sorted(map(tuple, slots.select("doc_id", "mix_epoch").collect())) == sorted(map(tuple, mixing.mix(docs, levels, half, total=100).select("doc_id", "mix_epoch").collect()))


def test_near_duplicates(spark, odd):
    rng = random.Random(5)
    base = words(rng, 120, 5000).split()
    docs = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:60], "new", *base[61:]])), (3, words(rng, 120, 5000)), (4, words(rng, 3)), (5, None)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6]


def test_dart_signatures_estimate_weighted_similarity():
    code = neardup.mix(np.arange(1, 301, dtype=np.uint64))
    a, b = np.arange(0, 200), np.arange(50, 250)
    doc = np.r_[np.zeros(200, int), np.ones(200, int)]
    weight = np.ones(400)
    sig = neardup.signatures(doc, np.r_[code[a], code[b]], weight, 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.06
    weight[:200] = 3.0  # sums of minima and maxima: 150, 600 + 50
    sig = neardup.signatures(doc, np.r_[code[a], code[b]], weight, 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 150 / 650) < 0.06


def test_rollup_is_idempotent(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokens long"
    kept = rollup.Rollup(spark, f"file://{tmp_path}")
    first = spark.createDataFrame([("insert", "a", "en", "v1", 5, None, None, None), ("insert", None, "en", "v1", None, None, None, None)], schema)
    assert kept.commit("one", first) and not kept.commit("one", first)
    assert kept.commit("two", spark.createDataFrame([("revise", "b", "en", "v1", 7, "a", "en", 5)], schema))
    assert kept.commit("three", spark.createDataFrame([], schema))
    assert sorted(map(str, map(tuple, kept.totals().collect()))) == ["('b', 'en', 'v1', 1, 7)", "(None, 'en', 'v1', 1, 0)"]


def test_token_files(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "", "Don't STOP, été!! x.y 3.14, <|endoftext|> a\x1cb naïve Œuvre İ ﬁ", "a,b. c!, d., é f g", *(r[1] for r in ODD[2:])]
    got = sorted(map(tuple, tokens.token_output(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()))
    at = 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    assert tokens.token_output(odd, path).count() == len(ODD)
    assert tokens.token_output(odd.limit(0), path).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(301, None), (302, []), (303, [0.0] * 16), (304, [float("nan")] * 16), (None, [1.0] * 16), (305, [None] + [1.0] * 15)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, block_rows=100, query_rows=4).toPandas()
    hits = []
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(part["vec_id"]) & set(np.argsort(-s)[:5])) / 5)
    assert len(hits) == 15 and np.mean(hits) >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_nearest_ties_copies_and_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 8)) * rng.uniform(0.2, 3.0, (40, 1))
    x[1:30] = x[30]  # ties
    rows = [(i, [float(v) for v in x[i]], "e", 1.0) for i in range(40)] + [(30, [float(v) for v in x[0]], "again", 2.0)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, retrieved double"), k=25, miss=0.0).orderBy("query_id", "rank").collect()
    every = np.r_[x, x[:1]]
    for q in (0, 20):
        want = sorted((-float(every[i] @ x[q]), v[0]) for i, v in enumerate(rows) if v[0] != q)[:25]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in mine] == list(range(1, 26))
        assert np.allclose([r["score"] for r in mine], [-s for s, _ in want])
        assert [r["vec_id"] for r in mine] == [v for _, v in sorted(zip(np.round([s for s, _ in want], 9), [v for _, v in want]))]


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((60, 16)), 10, 0) + 0.3 * rng.standard_normal((600, 16))
    index = ann.Index(np.arange(600), x, ann.learn(ann.lengthened(x, 9.0), 16 * 8), 9.0)
    sub = ann.codes(np.append(x[0], 0.0)[None, :], index.turn)
    apart = np.bitwise_count(index.words ^ index._words(sub)).sum(1, dtype=np.int64)
    found = np.zeros(600, bool)
    for reach in range(3):
        found |= index.probe(sub[0], reach)
        assert found[apart <= index.m * (reach + 1) - 1].all()
    assert found.sum() < 300


def test_nearest_equal_vectors_score_the_same(spark):
    """300 rows of 37 vectors: equal vectors have one score, and ties go to the smaller id."""
    rng = np.random.default_rng(11)
    kinds = rng.standard_normal((37, 64)).astype(np.float32)
    which = rng.integers(0, 37, 300)
    df = spark.createDataFrame([(i, kinds[k].tolist()) for i, k in enumerate(which.tolist())], "vec_id long, embedding array<float>")
    for block in (16_384, 64):
        got = {}
        for r in ann.nearest(df, block_rows=block).collect():
            got.setdefault(r["query_id"], []).append(r)
        assert len(got) == 15
        for q, found in got.items():
            found.sort(key=lambda r: r["rank"])
            assert [(r["score"], -r["vec_id"]) for r in found] == sorted(((r["score"], -r["vec_id"]) for r in found), reverse=True)
            assert len({(which[r["vec_id"]], r["score"]) for r in found}) == len({which[r["vec_id"]] for r in found})
            exact = {k: (kinds[k].astype(float) * kinds[which[q]].astype(float)).sum() for k in range(37)}
            assert [r["vec_id"] for r in found] == sorted((i for i in range(300) if i != q), key=lambda i: (-exact[which[i]], i))[:20]


def test_language_of_texts_without_letters(spark):
    docs = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog with this", "en"), ("le chat et les chiens avec", "fr"))]
    signs = [(1000, "½ ²", "en"), (1001, "Ⅷ ⅔", "fr"), (1002, "12 _ ٣", None), (1003, "½ the", None)]
    df = spark.createDataFrame([(2 * i + k, *d[1:]) for i, d in enumerate(docs) for k in (0,)] + signs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.held_out_langid(df, tessera_llm._public("piece_bpe_32k.model")).collect()}
    assert [got[i] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003] in ("en", "fr")
