"""The pipeline and its stages against brute force, and on odd tables; no operator minds columns of any name."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tessera.llm import ann, decontam, html, langid, neardup, queries, repeats, stages, tokens, toxicity  # noqa: E402

from .test_mixing import dealt, n_tokens  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the and of with house garden river little people always water under letter night other".split()
FR = "le la et dans maison jardin rivière petite toujours peuple eau lettre nuit avec autre".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [(i, prose(rng, [f"{w}q" for w in EN], 30)) for i in range(4)] + [(9, "short test item here"), (10, None)]
    docs = []
    for i in range(60):
        words = EN if i % 2 else FR
        docs.append((i, prose(rng, words, rng.randrange(25, 80)), "en" if i % 2 else "fr", f"src{i % 7}"))
    docs += [(100 + i, docs[i][1], docs[i][2], "src8") for i in range(6)]  # copies
    docs += [(120 + i, docs[20 + i][1] + " river", "en" if i % 2 else "fr", "src3") for i in range(6)]  # near copies
    docs += [(140 + i, prose(rng, EN, 20) + " " + bench[i][1], "en", "src1") for i in range(4)]  # benchmark passages
    docs += [(160, "12 34 ... !", "en", "src1"), (161, None, "fr", "src2"), (162, "", None, None), (163, prose(rng, EN, 40), None, None)]
    rng.shuffle(docs)
    docs = [(*d, len(d[1] or "")) for d in docs]
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bench


def languages(spark, docs):
    """Which documents stay, by scoring every word's segmentations one by one with the trained probabilities."""
    path = queries._public("piece_bpe_32k.model")
    names, pieces, prob = langid.train(spark.createDataFrame(docs, SCHEMA), path)
    at = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))

    def loglik(word):
        sums = np.zeros((len(word) + 1, len(names)))
        sums[0] = 1
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + longest) + 1):
                if word[i:j] in at:
                    sums[j] += sums[i] * prob[at[word[i:j]]]
        return np.log(sums[-1])

    kept = []
    for d in docs:
        words = re.findall(r"[^\W\d_]+", (d[1] or "").lower())
        if words:
            total = sum(loglik(b" " + w.encode()) for w in words)
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                kept.append(d)
    return kept


def near_duplicates(docs):
    sets = {d[0]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None for d in docs for w in [(d[1] or "").split()]}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return [d for d in docs if root[d[0]] == d[0]]


def decontaminated(docs, bench):
    found = decontam.brute_force([d[:2] for d in docs], bench)
    return [d for d in docs if not (found[d[0]][1] > 0 and 20 * found[d[0]][1] >= found[d[0]][0])]


def mixed(docs, epochs=2):
    import hashlib

    weights = [{"web": 0.5, "books": 0.3, "forums": 0.2}.get, lambda x: {"en": 0.5, "fr": 0.2, "de": 0.2}.get(x, 0.1), lambda _: 1.0]
    domain = lambda s: "web" if s and s[-1] in "0123" else "books" if s and s[-1] in "456" else "forums"
    rows = [(d, (domain(d[3]), d[2], d[3]), n_tokens(d[1])) for d in docs if n_tokens(d[1])]
    out = []

    def deal(rows, depth, budget):
        if depth == 3:
            have = sum(n for _, _, n in rows)
            for e in range(epochs):
                room = min(have, int(budget + 1e-6) - e * have)
                for d, _, n in sorted(rows, key=lambda r: (hashlib.md5(f"mix-1:{e}:{r[0][0]}".encode()).hexdigest(), r[2])):
                    if room <= 0:
                        break
                    out.append(d)
                    room -= n
            return
        kids = sorted({p[depth] for _, p, _ in rows}, key=str)
        parts = [[r for r in rows if r[1][depth] == k] for k in kids]
        for part, share in zip(parts, dealt(budget, [(weights[depth](k), epochs * sum(r[2] for r in p)) for k, p in zip(kids, parts)])):
            deal(part, depth + 1, share)

    deal(rows, 0, sum(n for _, _, n in rows))
    return out


def written_tokens(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries._public("word_bpe_49k.json"))
    out, at = [], 0
    for d in sorted(docs, key=lambda d: d[0]):
        ids = [*plain.encode(d[1] or "", add_special_tokens=False).ids, 2]
        out.append((d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_run_and_stages_against_brute_force(spark, tables):
    folder, docs, bench = tables
    want = [languages(spark, docs)]
    want.append(near_duplicates(want[-1]))
    want.append(decontaminated(want[-1], bench))
    want.append(mixed(want[-1]))
    assert [len(docs) > len(w) for w in want[:3]] == [True] * 3 and len(want[0]) > len(want[1]) > len(want[2])
    before = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        made = stage(spark, spark.createDataFrame(before, SCHEMA), folder)
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, made.collect()), key=str) == sorted(rows, key=str), name
        before = rows
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == written_tokens(want[-1])


CLASHES = "lang_pred score n_words spans items n_hit n_items items_sha256 contaminated mix_leaf mix_epoch mix_tokens class_id n_confirmed Row row __text __row __nth toxic held_out predicted n_bytes n_removed marks key vb retrieved query_id rank start n_tokens h1".split()
CLASHES = list({c.lower(): c for c in CLASHES}.values())


@pytest.fixture(scope="module")
def clashing(spark, tables):
    _, docs, _ = tables
    rows = [*docs[:12], docs[0], (None, "the house of the river", None, None, None), (None, None, None, None, None), (400, "wörd" * 5000, "en", "src1", 1)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


def test_stages_keep_columns_of_any_name(spark, tables, clashing):
    folder = tables[0]
    own = {tuple(r) for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, clashing, folder)
        assert made.columns == clashing.columns, name
        assert {tuple(r) for r in made.collect()} <= own, name
        assert stage(spark, clashing.limit(0), folder).count() == 0, name
    assert stages.write_tokens(spark, clashing, folder).count() == clashing.count()
    assert stages.write_tokens(spark, clashing.limit(0), folder).count() == 0


def test_operators_do_not_mind_columns_of_any_name(spark, tables, clashing):
    folder, _, bench = tables
    n = clashing.count()
    path = queries._public("piece_bpe_32k.model")
    labels = clashing.select("doc_id", F.lit(1).alias("toxic"), F.lit(0).alias("text"), F.lit(0.5).alias("score"))
    assert toxicity.score_toxicity(clashing.drop("toxic"), labels).count() == n
    assert repeats.remove_repeats(clashing).count() == n
    assert langid.held_out_langid(clashing, path).count() == n
    assert neardup.near_duplicates(clashing).count() == n
    items = spark.createDataFrame([(f"item-{i}", t, "x") for i, t in bench], "item_id string, text string, spans string")
    found = decontam.contamination_report(decontam.find_contamination(clashing, items, keep=clashing.columns), clashing.columns)
    assert found.count() == n and found.columns[: len(clashing.columns)] == clashing.columns
    assert tokens.token_output(clashing, queries._public("word_bpe_49k.json")).count() == n
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), *CLASHES)
    assert html.extract(pages).count() == n
    vectors = clashing.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id") + 1.0, F.lit(1.0)).alias("embedding"), *CLASHES)
    assert ann.nearest(vectors, every=1, k=1).count() > 0


def test_items_of_any_kind(spark, tables):
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([("b", "beta"), ("a", "ALPHA beta"), ("c", "delta"), (None, "gamma")], "item_id string, text string")
    (row,) = decontam.find_contamination(docs, items).collect()
    assert row["items"] == [None, "a", "b"] or sorted(filter(None, row["items"])) == ["a", "b"]
