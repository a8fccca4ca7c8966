"""Wide tables and arrays: components, correlations, distinct values, tables of frequencies, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import components, features, images, profile, reports


def svd_shares(x):
    x = x - x.mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    return s**2 / (s**2).sum()


def test_components_equal_svd(spark):
    x = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = [r["share"] for r in components.variance_table(table, "embedding").orderBy("component").collect()]
    assert np.allclose(got, svd_shares(x), atol=1e-6, rtol=0)
    # fewer directions than the array is wide: the range finder's passes
    rng = np.random.default_rng(1)
    wide = rng.standard_normal((200, 30)) @ np.diag(0.8 ** np.arange(30)) @ rng.standard_normal((30, 400)) + rng.standard_normal((200, 400)) * 1e-3 + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)] + [(200, None), (201, [1.0]), (202, [float("nan")] * 400)], "id long, x array<double>")
    fitted = components.fit_components(df.repartition(3), "x", 10)
    assert np.allclose(fitted.shares, svd_shares(wide)[:10], atol=1e-6)
    made = {r["id"]: r["features"] for r in fitted.project(df, "x").collect()}
    _, _, v = np.linalg.svd(wide - wide.mean(0), full_matrices=False)
    want = (wide - wide.mean(0)) @ v[:10].T
    got = np.array([made[i] for i in range(200)])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4) and made[200] is None and made[201] is None and made[202] is None
    with pytest.raises(ValueError):
        components.fit_components(df.where("id = 1"), "x")
    with pytest.raises(ValueError):
        components.fit_components(df.limit(0), "x")


def test_images_of_full_size_train(spark):
    """64 x 64 pixels in RGB, as pixels() makes them."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        picture = rng.integers(0, 60, (20, 20, 3)).astype(np.uint8)
        picture[:, :10, i % 2 * 2] += 150
        rows.append((f"p/{'cat' if i % 2 else 'dog'}/{i}.png", 20, 20, 3, bytearray(picture.tobytes())))
    pixels = images.pixels(spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary"))
    assert pixels.select(F.size("pixels")).first()[0] == 64 * 64 * 3
    df = pixels.withColumn("label", images.path_label(F.col("path")))
    name, model, labels, board, metrics = images.train_images(df, "path", candidates=("logistic_regression",), components=8)
    assert labels == ["cat", "dog"] and metrics["accuracy"] == 1.0


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 7)) * [1, 10, 1e-3, 1, 1, 1, 1] + [0, 1e6, 0, 5, 0, 0, 0]
    x[:, 3] = 2 * x[:, 0] + 1
    x[:, 5] = 7.25
    x[rng.random(x.shape) < 0.2] = np.nan
    x[~np.isnan(x[:, 5]), 5] = 7.25
    x[3:, 6] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(7))).repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df).collect()}
    assert len(got) == 21
    for i in range(7):
        for j in range(i + 1, 7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = np.corrcoef(a, b)[0, 1] if both.sum() > 1 and a.std() > 0 and b.std() > 0 else None
            assert got[f"c{i}", f"c{j}"] == (None if want is None or np.isnan(want) else pytest.approx(want, abs=1e-9)), (i, j)
    assert profile.correlations(df.select("c0")).count() == 0


def test_many_columns(spark):
    """Two thousand columns: the plan doesn't grow with the pairs, and strips of pairs fit together."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 2000))
    x[:, 1999] = x[:, 0] * 3
    x[:, 1500] = -x[:, 700]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(2000)]))
    assert {(r["a"], r["b"], round(r["r"], 9)) for r in profile.correlations(df).where("abs(r) > 0.999").collect()} == {("c0", "c1999", 1.0), ("c700", "c1500", -1.0)}


def test_distinct_values_by_sketch_and_count(spark):
    df = spark.range(3000).select(F.lit("x").alias("same"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") > 0, 1).alias("one_or_null"), (F.col("id") % 51).cast("string").alias("near"), (F.col("id") % 50).cast("string").alias("at"), F.col("id").cast("string").alias("all"), (F.col("id") % 3).cast("string").alias("few"))
    assert {r[0] for r in profile.constant_columns(df).collect()} == {"same", "none"}
    assert {tuple(r) for r in profile.high_cardinality(df).collect()} == {("near", 51), ("all", 3000)}
    assert profile.distinct_over(df, {"near": 50, "at": 50, "all": 50, "few": 50}) == {"near": True, "at": False, "all": True, "few": False}
    assert {(r["column"], r["n_distinct"], r["has_null"]) for r in profile.distinct_counts(df, ["one_or_null", "none"]).collect()} == {("one_or_null", 1, True), ("none", 0, True)}
    assert {r["column"] for r in reports.id_columns(df).collect()} == {"all"}
    assert {r[0] for r in profile.constant_columns(df.limit(0)).collect()} == set(df.columns)
    plan = profile.constant_columns(df)._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_top_values_have_a_group_limit(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    top = profile.categorical_top(df, 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert {tuple(r) for r in top.collect()} == {("a", 7, "0", 72, 1), ("a", 7, "1", 72, 2), ("b", 500, "0", 1, 1), ("b", 500, "1", 1, 2)}


def test_model_keeps_its_frequencies(spark, tmp_path):
    """A saved model has its tables in its own folder."""
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("wide"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("skewed"), F.col("id").cast("double").alias("v"), (F.col("id") % 2).cast("double").alias("label"))
    model = Pipeline(stages=[features.FeatureEngineer(labelCol="label")]).fit(df)
    tables = model.stages[0].fitted["freq_tables"]
    assert set(tables) == {"wide", "skewed"} - ({"skewed"} if "skewed" not in tables else set())
    want = sorted(map(tuple, model.transform(df).collect()))
    model.write().overwrite().save(f"file://{tmp_path}/model")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for t in tables.values():
        path = hadoop.Path(t)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    assert sorted(map(tuple, loaded.transform(df).collect())) == want
    loaded.write().overwrite().save(f"file://{tmp_path}/again")
    assert sorted(map(tuple, PipelineModel.load(f"file://{tmp_path}/again").transform(df).collect())) == want


def test_frequencies_of_skewed_values(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"v{i}") for i in range(3000)] + [(-1, "unseen")]
    df = spark.createDataFrame(rows, "id long, c string")
    table = features.frequencies(df.where("id >= 0"), "c")
    small = sorted(map(tuple, features.joined_frequency(df, "c", table, "f").collect()), key=str)
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, features.joined_frequency(df, "c", table, "f").collect()), key=str) == small
    got = {r["id"]: r["f"] for r in features.joined_frequency(df, "c", table, "f").collect()}
    assert got[1] == pytest.approx(2 / 3) and got[3] == pytest.approx(1 / 6) and got[6] == pytest.approx(1 / 3000) and got[-1] is None and len(got) == 3001
    # a null too rare to be among the frequent values
    rare = spark.createDataFrame([(i, f"v{i}") for i in range(3000)] + [(3000, None)], "id long, c string")
    assert all(r["f"] == pytest.approx(1 / 3001) for r in features.joined_frequency(rare, "c", features.frequencies(rare, "c"), "f").collect())
