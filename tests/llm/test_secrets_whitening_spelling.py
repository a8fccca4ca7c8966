"""Secret scans, whitening and spelling variants against versions written straight from their definitions, and the edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")

from tessera.llm import secrets, spelling, whiten  # noqa: E402

# Spelling variants


def brute_words(docs, noise=31, min_length=7):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                count[run] += 1
    return count


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count, ratio=10, min_count=2):
    n = {w: c for w, c in count.items() if c >= min_count}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], [ord(c) for c in v]))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def spelled(df, **how):
    got = spelling.spelling_variants(df, **how).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len({r["word"] for r in got})
    return {r[0]: tuple(r)[1:] for r in got}


def test_spelling_against_brute_force(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abÀéÿ×") for _ in range(rng.randrange(6, 12))) for _ in range(25)]

    def word():
        w = rng.choice(stems[: rng.randrange(1, 26)])
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "Z" + w[i + 1 :]))
        return w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.1 else w

    docs = [(i, " ".join(word() for _ in range(60))) for i in range(120)] + [(None, stems[0] + "1" + stems[1]), (7, stems[0]), (7, stems[0]), (500, None), (501, ""), (502, "a" * 300 + " " + "a" * 300 + " " + "a" * 301 + " " + "a" * 301 + "-" + "a" * 150 + "b" + "a" * 149 + " " + "a" * 150 + "b" + "a" * 149)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_variants(brute_words(docs))
    assert len(want) > 150 and sum(v[2] is not None for v in want.values()) > 20 and len({len(w) for w in want}) > 5
    assert spelled(df) == want
    # few segments make all groups long ones; small tiles cut them
    assert spelled(df, max_segments=2, tile=5, tile_bytes=1000) == want
    # a chain of forms
    chain = [(1000 + i, w) for w, n in (("abcdefgh", 2), ("abcdefghi", 40), ("abcdefghij", 900)) for i in range(n)]
    assert spelled(spark.createDataFrame(chain, "doc_id long, text string"), noise=0)["abcdefgh"] == (2, 1, "abcdefghi", 40, "abcdefghij")
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS word", "2 AS n", "3 AS key", "4 AS root", "5 AS run", "6 AS h", "7 AS id")
    assert spelled(clash) == want


def test_one_edit_by_prefix_and_suffix():
    words = sorted({"".join(w) for n in (3, 4) for w in __import__("itertools").product("ab", repeat=n)})
    for a in words:
        for b in words:
            if a != b and len(a) <= len(b) == 4:
                m = spelling.matrix([a.encode(), b.encode()], 4)
                assert spelling.near(m[:1], m[1:], np.array([len(a) < 4]))[0][0] == one_edit(a, b), (a, b)


# Whitening


def brute_whiten(rows, weights="count"):
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64) + 100_000) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    fit = x if weights == "count" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(8, x.shape[1])
    return kept, n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_against_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(200)] + [(500 + i, rows[6][1]) for i in range(3)]
    odd = [(600, None), (601, [None] + [0.0] * 11), (602, [float("nan")] + [0.0] * 11), (603, [float("inf")] + [0.0] * 11)]
    more = [(5, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame(rows + odd + more, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS x", "3 AS component", "4 AS w", "5 AS weight")
    kept, n, deviation, w, explained = brute_whiten(rows + more, weights)
    got = whiten.whiten(df, weights=weights).collect()
    assert len(got) == len(kept) * 8 and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    want = Counter((i, int(d)) for (i, _), d in zip(kept, deviation))
    assert {k: len(v[1]) for k, v in by.items()} == dict(want)
    signs = np.zeros(8)
    for (i, _), d, values in zip(kept, deviation, w):
        for k in range(8):
            for r in by[i, int(d)][k + 1]:
                if not signs[k]:
                    signs[k] = np.sign(r["whitened"] * values[k])
                assert r["whitened"] == pytest.approx(signs[k] * values[k], rel=1e-7, abs=1e-9)
                assert r["explained"] == pytest.approx(explained[k], rel=1e-9) and 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten.whiten(make([]).limit(0)).count() == 0 and whiten.whiten(make([(1, None), (2, [])])).count() == 0
    # no variance in the second component; a shorter vector takes no part
    got = {(r["vec_id"], r["component"]): r for r in whiten.whiten(make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0])])).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert abs(got[1, 1]["whitened"]) == pytest.approx(1) and got[1, 2]["whitened"] is None and got[1, 1]["explained"] == pytest.approx(1) and got[1, 1]["identity_error"] < 1e-12
    assert int(got[1, 1]["deviation"]) == 1024**2
    # whole numbers beyond 64 bits stay exact
    large = whiten.whiten(make([(1, [3e12]), (2, [-3e12]), (3, [0.0])])).where("vec_id = 1").first()
    assert int(large["deviation"]) == (3 * int(1024 * np.float64(np.float32(3e12)))) ** 2
    with pytest.raises(ValueError):
        whiten.whiten(make([(1, [1.0, 2.0])]), max_dim=1)
    with pytest.raises(Exception, match="too large"):
        whiten.whiten(make([(1, [-1e30])])).collect()


# Secret scans


def brute_base(text):
    spans = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        for m in re.finditer(pattern, text or ""):
            if len(m[0]) >= least:
                spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


KEY = "AKIA" + "Q7" * 9
HEXED = "".join(random.Random(1).choices("0123456789abcdef", k=40))
#: Built from parts so that no scanner takes them for secrets.
RANDOM = "".join(random.Random(9).choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=32))


def scanned(df):
    return secrets.digest(secrets.find_secrets(df)).collect()


def test_secrets_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["token", "TOKEN", "api_key", "apikey", "password", "passwd", "ſecret", "secret", '"', "'", " ", "  ", "\n", ":", "=", "=abc", "abcdef", "x1y2z3_-", KEY, KEY[:19], HEXED, HEXED[:23], HEXED.upper(), "é", "😀", "K"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(400)] + [(400, None), (401, ""), (7, "token = abcdef"), (None, f"secret: '{RANDOM}'"), (402, ("a" * 99 + " ") * 20_000 + "password=hunter22")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS base", "3 AS candidates", "4 AS kind")
    got = scanned(df)
    want = Counter((i, ",".join(brute_base(t))) for i, t in docs)
    have = Counter((r["doc_id"], ",".join(s for s in r["spans"].split(",") if s and not s.startswith("novel"))) for r in got)
    assert have == want
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("novel")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert scanned(df.limit(0)) == []


def test_secrets_novelty(spark):
    common = "The credential of the OrganizationAccount2 is rotated by OrganizationAccount2 daily. "
    docs = [(i, common * 3) for i in range(60)]
    docs += [(100 + i, f"def connect():\n    # credential for the store\n    use({RANDOM!r})\n") for i in range(40)]
    docs += [(200, f"a checksum of the build is {RANDOM}"), (201, "the bearer token was lost, tokens are not here, authorization required"), (202, f"bearer {RANDOM}..."), (203, "bearer " + "aB1" * 12)]
    got = {r["doc_id"]: r["spans"] for r in scanned(spark.createDataFrame(docs, "doc_id long, text string"))}
    at = docs[60][1].index(RANDOM)
    assert all(got[100 + i] == f"novel:{at}:{at + len(RANDOM)}" for i in range(40))  # many copies of one leak are all found
    assert got[202] == f"novel:7:{7 + len(RANDOM)}"
    assert all(not got[i] for i in (*range(60), 200, 201, 203))


def test_many_secrets_in_one_text_take_linear_time():
    def seconds(n):
        begun = time.process_time()
        text = "token=abcdef12 x token: 9f8e7d6c5b4a3f2e1d0c " * n
        secrets.candidates(text, secrets.base_spans(text))
        return time.process_time() - begun

    seconds(200)
    assert seconds(16_000) < 20 * max(seconds(2000), 0.02)
    text = f"password = hunter22, secret {RANDOM} token: abcdefgh1"
    assert [c[:2] for c in secrets.candidates(text, secrets.base_spans(text))] == [(text.index(RANDOM), RANDOM)]
