"""Mutual information by neighbours against a plain version of its formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features, information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def brute_classes(x, y, k=3):
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    parts = []
    for i in range(len(x)):
        same = np.sort(np.abs(np.delete(x[y == y[i]] - x[i], np.flatnonzero(np.flatnonzero(y == y[i]) == i))))
        kk = min(k, len(same))
        r = same[kk - 1]
        m = (np.abs(x - x[i]) < r).sum() if r > 0 else (x == x[i]).sum()
        parts.append(psi(kk) - psi(len(same) + 1) - psi(m))
    return max(0.0, psi(len(x)) + np.mean(parts))


def brute_numbers(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    total = 0.0
    for i in range(len(x)):
        d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
        r = np.sort(np.delete(d, i))[k - 1]
        total += sum(psi((np.abs(v - v[i]) < r).sum() if r > 0 else (v == v[i]).sum()) for v in (x, y))
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


def test_psi(spark):
    got = spark.range(1, 60).select("id", information.psi(F.col("id").cast("double")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-10) for r in got)


def test_classes(spark):
    rng = np.random.default_rng(1)
    y = np.array([f"c{i % 3}" for i in range(240)] + ["alone"])
    a = rng.standard_normal(241) + np.array([ord(c[1]) - 48 if c != "alone" else 0 for c in y]) * 1.5
    b = rng.standard_normal(241)
    ties = np.round(a)
    rows = [(float(p), float(q), float(t), 7.0, c) for p, q, t, c in zip(a, b, ties, y)] + [(None, 1.0, None, 7.0, "c1"), (1.0, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, ties double, same double, y string")
    got = {r["column"]: r["score"] for r in information.class_information(df, ["a", "b", "ties", "same"], "y").collect()}
    b_, yb = np.append(b, 1.0), np.append(y, "c1")
    assert got["a"] == pytest.approx(brute_classes(a, y), abs=1e-9) and got["b"] == pytest.approx(brute_classes(b_, yb), abs=1e-9) and got["ties"] == pytest.approx(brute_classes(ties, y), abs=1e-9)
    assert got["same"] == pytest.approx(0.0, abs=1e-9) and got["a"] > 0.3 > got["b"]
    ranged = {r["column"]: r["score"] for r in information.class_information(df, ["a", "ties"], "y", range_rows=20).collect()}
    assert ranged == pytest.approx({c: got[c] for c in ("a", "ties")})
    assert {r["score"] for r in information.class_information(df.limit(0), ["a"], "y").collect()} == {0.0}


def test_numbers(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(200), rng.standard_normal(200)
    y = a**2 + 0.1 * rng.standard_normal(200)
    df = spark.createDataFrame([(float(p), float(q), 1.0, float(t)) for p, q, t in zip(a, b, y)] + [(None, None, 1.0, 2.0)], "a double, b double, same double, y double")
    got = {r["column"]: r["score"] for r in features.scores(df, ["a", "b", "same"], "y", "regression", "mutual_info_neighbours").collect()}
    assert got["a"] == pytest.approx(brute_numbers(a, y), abs=1e-9) and got["b"] == pytest.approx(brute_numbers(b, y), abs=1e-9) and got["same"] == 0.0
    assert got["a"] > 0.5
