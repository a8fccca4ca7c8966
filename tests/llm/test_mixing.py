"""Budgets and prefixes of the mix against a straightforward version, and its defined cases."""

import hashlib
import random

import pytest

pytest.importorskip("tessera.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def n_tokens(text):
    bare = (text or "").replace(" ", "").replace("\n", "")
    return len(text) - len(bare) + 1 if bare else 0


def dealt(budget, kids):
    """kids: (weight, capacity) -> shares: full children leave, the rest is dealt again by weight."""
    share, live = [0.0] * len(kids), {i for i, (w, _) in enumerate(kids) if w > 0}
    while live:
        level = budget / sum(kids[i][0] for i in live)
        full = {i for i in live if kids[i][1] <= level * kids[i][0]}
        if not full:
            for i in live:
                share[i] = level * kids[i][0]
            break
        for i in full:
            share[i] = kids[i][1]
            budget -= kids[i][1]
        live -= full
    return share


def brute_force(docs, weight, total=None, epochs=2, seed=mixing.SEED):
    rows = [(i, t, la, s, n_tokens(t)) for i, t, la, s in docs if n_tokens(t)]
    total = sum(r[4] for r in rows) if total is None else total
    langs = sorted({r[2] for r in rows}, key=str)
    size = lambda la, s=None: epochs * sum(r[4] for r in rows if r[2] == la and (s is None or r[3] == s[0]))
    out = []
    for la, share in zip(langs, dealt(total, [(weight(la), size(la)) for la in langs])):
        sources = sorted({r[3] for r in rows if r[2] == la}, key=str)
        for s, budget in zip(sources, dealt(share, [(1.0, size(la, (x,))) for x in sources])):
            leaf = [r for r in rows if r[2:4] == (la, s)]
            have = sum(r[4] for r in leaf)
            for e in range(epochs):
                room = min(have, int(budget + 1e-6) - e * have)
                for r in sorted(leaf, key=lambda r: (hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest(), r[4])):
                    if room <= 0:
                        break
                    out.append((r[0], la, s, e, r[4]))
                    room -= r[4]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "mix_leaf.lang", "mix_leaf.source", "mix_epoch", "mix_tokens").collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    return [(i, " ".join("ab" for _ in range(rng.randrange(12))), rng.choice(["x"] * 6 + ["y", None]), rng.choice(["s", "t", "u", None])) for i in range(400)]


@pytest.mark.parametrize("total", [None, 0, 1, 137, 700, 10**6])
def test_against_brute_force(spark, docs, total):
    weight = F.when(F.col("lang") == "y", 5.0).when(F.col("lang") == "x", 1.0).otherwise(0.25)
    made = mixing.mix(spark.createDataFrame(docs, SCHEMA), levels(), [weight, F.lit(1.0)], total=total, slot_rows=5)
    assert got(made) == brute_force(docs, {"y": 5.0, "x": 1.0, None: 0.25}.get, total)


def test_shares_of_zero_weights(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    assert mixing.mix(df, levels(), [F.lit(0.0), F.lit(1.0)], total=8).count() == 0
    only = mixing.mix(df, levels(), [F.when(F.col("lang") == "y", 1.0).otherwise(0.0), F.lit(1.0)], total=20)
    assert {r["mix_leaf"]["lang"] for r in only.collect()} == {"y"}
    assert got(only) == brute_force(docs, lambda la: float(la == "y"), 20)


def test_one_id_or_none_for_many_rows(spark):
    """Rows without ids, or of one id, are split by their texts: the leaf gets its budget or less than one text more."""
    rows = [(None if i % 2 else 7, "a " * (i % 5) + f"w{i}", "x", "s") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    for slot_rows in (4, 4096):
        taken = got(mixing.mix(df, levels(), [F.lit(1.0)] * 2, total=500, slot_rows=slot_rows))
        assert 500 <= sum(r[4] for r in taken) < 506
    same = spark.createDataFrame([(1, "a b", "x", "s")] * 50 + [(2, "c d", "x", "s")] * 50, SCHEMA)
    assert {len(got(mixing.mix(same, levels(), [F.lit(1.0)] * 2, total=20, slot_rows=4)))} <= {50}


def test_document_columns_stay(spark):
    rows = [(1, "a b", "x", "s", 5, "leaf", 9, "k"), (2, "c", "x", None, 6, None, 8, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", mix_epoch int, MIX_LEAF string, mix_tokens int, `odd.name` string")
    made = mixing.mix(df, levels(), [F.lit(1.0)] * 2, total=100, max_epochs=1)
    assert made.columns == [*df.columns, "mix_leaf_", "mix_epoch_", "mix_tokens_"]
    assert sorted(tuple(r)[:8] for r in made.collect()) == sorted(rows)
    assert mixing.mix(df.limit(0), levels(), [F.lit(1.0)] * 2).count() == 0
