"""Nothing is left out as the table grows: rare languages, repeated texts, large models."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")

from tessera.llm import langid, toxicity  # noqa: E402


def test_rare_languages_and_copies_are_learned(spark):
    import public_tokenizers

    docs = [(i, f"the house of number {chr(97 + i % 26)} and the garden", "en") for i in range(3000)] + [(i, "one text that is copied often", "cp") for i in range(3000, 4000)]
    docs += [(5000, "das ganze haus", "de"), (5001, "la maison entière", "fr"), (5002, "... 12 !?", "none"), (5003, None, "null"), (5004, "no label", None)]
    docs += [(6000, "the same row", "same")] * 1000
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    n = Counter(r["lang"] for r in langid.training_sample(df, 100).collect())
    assert 50 < n["en"] < 200 and 50 < n["cp"] < 200 and n["de"] == n["fr"] == 1 and n["same"] > 0
    assert set(n) == {"cp", "de", "en", "fr", "same"}
    assert langid.training_sample(df, 10_000).count() == 5002
    langs, _, prob = langid.train(df, public_tokenizers.path("piece_bpe_32k.model"), 5, 1)
    assert langs == ["cp", "de", "en", "fr", "same"] and prob.shape[1] == 5


def test_toxicity_is_the_same_when_the_table_is_too_large_to_broadcast(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60)) + (" idiot scum" if i % 3 == 0 else "")) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "no id"), (7, rows[7][1]), (402, "ünïcödé 日本語 " * 400), (403, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    want, got = (sorted(toxicity.score_toxicity(docs, labels, max_grams=n).collect(), key=key) for n in (1 << 24, 10))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want] and len(got) == len(rows)
    for name in ("score", "mean_llr", "peak_llr"):
        assert np.allclose([r[name] for r in got], [r[name] for r in want], atol=1e-9)
    assert toxicity.score_toxicity(docs.limit(0), labels, max_grams=10).count() == 0


def test_toxicity_by_many_blocks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(200)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.ratios(toxicity.gram_counts(docs.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))))
    one, many = (sorted(map(tuple, toxicity.evidence_by_blocks(docs, model, toxicity.ORDER, n).collect())) for n in (4 << 20, 300))
    assert np.allclose(one, many, atol=1e-9) and len(many) == 200
