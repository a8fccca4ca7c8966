"""The block-maximum index against scoring everything, and windows over ranges against windows over whole series."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import learn, retrieval, search, series, text


def grams(t):
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split() if len(w) >= 2 and w not in text.STOP]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_cosines(docs, queries, min_df=2):
    counts = {k: Counter(grams(t)) for k, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    n = len(docs)

    def weights(c):
        w = {t: x * (math.log((1 + n) / (1 + df[t])) + 1) for t, x in c.items() if df[t] >= min_df}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()} if size else {}

    vectors = {k: weights(c) for k, c in counts.items()}
    out = {}
    for q, t in queries:
        mine = weights(Counter(grams(t)))
        out[q] = {k: round(s, 9) for k, v in vectors.items() if (s := sum(w * v.get(x, 0) for x, w in mine.items())) > 0}
    return out


def corpus(rng):
    docs = [(f"d{i:03}", " ".join(rng.choice(("common", "word", f"w{rng.randrange(60)}", f"w{int(rng.expovariate(0.3))}")) for _ in range(rng.randrange(3, 40)))) for i in range(300)]
    docs += [("copy1", docs[5][1]), ("copy2", docs[5][1]), ("none", None), ("empty", "")]
    return docs, [("q1", docs[5][1]), ("q2", "common word"), ("q3", "w1 w2 w3 common"), ("q4", "unknown here"), ("q5", None), ("q6", docs[9][1][:60])]


def test_search_equals_scoring_everything(spark):
    docs, queries = corpus(random.Random(1))
    df, asked = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(queries, "q string, text string")
    index = search.TermIndex.build(df, "id", block_docs=8)
    want = brute_cosines(docs, queries)
    got = {}
    for r in index.search(asked, "q", 7).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    for q, _ in queries:
        best = sorted(want[q].items(), key=lambda x: (-x[1], x[0]))[:7]
        mine = sorted(got.get(q, []))
        assert [m[1] for m in mine] == [b[0] for b in best], q
        assert [m[2] for m in mine] == pytest.approx([b[1] for b in best], abs=1e-8)
    assert got["q1"][0][2] == pytest.approx(1.0) and not {"q4", "q5"} & set(got)
    # blocks whose bound is too low aren't scored
    looked = {r["q"]: (r["blocks"], r["visited"]) for r in index.visited(asked, "q", 3).collect()}
    assert looked["q1"][1] < looked["q1"][0] and all(v <= b for b, v in looked.values())
    assert search.TermIndex.build(df.limit(0), "id").search(asked, "q").count() == 0


def test_frequent_terms_are_no_key(spark, monkeypatch):
    monkeypatch.setattr(search, "FREQUENT", 2)
    counts = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 1)], "id string, term string, n int")
    vocabulary = spark.createDataFrame([("x", 9), ("y", 1)], "term string, df long")
    assert sorted(map(tuple, search.with_frequencies(counts, vocabulary, 10).collect())) == [("a", "x", 1, 9), ("b", "x", 2, 9), ("b", "y", 1, 1)]


def test_hybrid_search_against_brute_force(spark):
    docs, queries = corpus(random.Random(2))
    df = spark.createDataFrame([(k, t, "regression" if i % 2 else "classification", ["imbalance"] if i % 3 == 0 else []) for i, (k, t) in enumerate(docs)], "id string, text string, task string, tags array<string>")
    asked = [retrieval.Query(q, t, "regression", q == "q2") for q, t in queries if t]
    got = {(r["query"], r["id"]): r["score"] for r in retrieval.hybrid_search(search.TermIndex.build(df, "id"), df, "text", asked, 4, "task", "tags").collect()}
    cosines = brute_cosines(docs, queries)
    for q in asked:
        tokens = {t for t in "".join(c if c.isalnum() or c == "_" else " " for c in q.text.lower()).split() if len(t) > 2}
        full = {k: round(cosines[q.name][k] + 0.06 * sum(t in (text_ or "").lower() for t in tokens) + 0.15 * (i % 2 == 1) + 0.12 * (q.imbalanced and i % 3 == 0), 6) for i, (k, text_) in enumerate(docs) if k in cosines[q.name]}
        best = sorted(full.items(), key=lambda x: (-x[1], x[0]))[:16]
        assert {k: s for (n, k), s in got.items() if n == q.name} == pytest.approx(dict(best), abs=2e-6)


def test_diverse_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("q", f"d{i}", round(rng.random(), 3), [f"t{rng.randrange(6)}" for _ in range(4)]) for i in range(16)]
    pooled = spark.createDataFrame(rows, "query string, id string, score double, tokens array<string>")
    left, taken = sorted(rows, key=lambda r: (-r[2], r[1])), []
    while len(taken) < 4:
        like = lambda r: max((len(set(r[3]) & set(t[3])) / len(set(r[3]) | set(t[3])) for t in taken), default=0.0)
        best = max(left, key=lambda r: 0.7 * r[2] - 0.3 * like(r))
        left.remove(best)
        taken.append(best)
    assert [r["id"] for r in retrieval.diverse(pooled, "id", "tokens", 4).orderBy("place").collect()] == [t[1] for t in taken]


def test_windows_over_ranges(spark):
    """One series of most rows, a short one, one of a null name, and one of a single row."""
    df = spark.range(1000).select(F.when(F.col("id") < 900, "long").when(F.col("id") < 990, "short").when(F.col("id") < 999, None).otherwise("one").alias("s"), F.timestamp_seconds(F.col("id") * 7919 % 1009 * 3600).alias("t"), "id", F.sin("id").alias("v"), F.lit(1).alias("__part"))
    whole = text.lag_features(df, "v", ["s"], ["t", "id"])
    for rows in (40, 5, 333):
        dealt = text.lag_features(df, "v", ["s"], ["t", "id"], range_rows=rows)
        assert dealt.columns == whole.columns
        want, got = ({r["id"]: r.asDict() for r in x.collect()} for x in (whole, dealt))
        assert set(got) == set(want) and dealt.count() == 1000
        for i, w in want.items():
            for c, v in w.items():
                assert got[i][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (rows, i, c)
    # no range holds the long series
    dealt = series.deal(df, ["s"], ["t", "id"], 14, 40)
    assert dealt.rows.groupBy("s", dealt.part).count().agg(F.max("count")).first()[0] < 200
    plan = text.lag_features(df, "v", ["s"], ["t", "id"], range_rows=40)._jdf.queryExecution().toString()
    assert "lag(v" in plan and dealt.part in plan


def test_ordered_split_over_ranges(spark):
    df = spark.range(500).select((F.col("id") % 500 > 20).alias("s"), (F.col("id") * 37 % 499).alias("o"), "id")
    want = {r["id"]: r["is_test"] for r in learn.ordered_split(df, "o", ["s"]).collect()}
    assert {r["id"]: r["is_test"] for r in learn.ordered_split(df, "o", ["s"], range_rows=30).collect()} == want and sum(want.values()) == 101


def test_one_series_without_a_key(spark):
    df = spark.range(120).select("id", F.col("id").cast("double").alias("v"), F.timestamp_seconds("id").alias("t"))
    got = {r["id"]: r["lag_14"] for r in text.lag_features(df, "v", [], ["t"], range_rows=10).collect()}
    assert got == {i: float(i - 14) if i >= 14 else None for i in range(120)}
