"""Text and series models, image labels and pixels, exact quantiles and ranks, dropped leaks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranks import hash_ranks, quantiles, running_sums
from tessera.operators import advice, forecast, images, knowledge, learn, reports, text, textmodels


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.lognormal(0, 4, 5000), "b": np.round(rng.normal(size=3000), 1), "c": np.array([7.0]), "d": np.r_[np.zeros(4000), rng.random(5)], "e": np.arange(6.0)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("none", None)], "column string, value double")
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["column"]: r["q"] for r in quantiles(rows, probabilities).collect()}
    want = {r["column"]: r["q"] for r in rows.where("value IS NOT NULL").groupBy("column").agg(F.percentile("value", F.array(*map(F.lit, probabilities))).alias("q")).collect()}
    assert set(got) == set(data)
    for k in data:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_running_sums_and_ranks(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"), (F.col("id") % 5).alias("n"))
    got = {(r["g"], r["v"]): r["upto_n"] for r in running_sums(rows, "g", "v", ["n"], 16).collect()}
    for g in "012":
        part = sorted((r["v"], r["n"]) for r in rows.where(F.col("g") == g).collect())
        assert [got[g, v] for v, _ in part] == np.cumsum([n for _, n in part]).tolist()
    ranked = hash_ranks(rows, F.col("g"), F.col("v"), 1).collect()
    for g in "012":
        assert sorted(r["__rank"] for r in ranked if r["g"] == g) == list(range(1, 1001)) and {r["__n"] for r in ranked} == {1000}


def test_split_takes_the_same_rows_as_one_order(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 < 3, "b").alias("y"))
    made = {(r["y"], r["t"]): r["n"] for r in learn.stratified_split(df, "y", F.col("id")).groupBy("y", F.col("is_test").alias("t")).agg(F.count("*").alias("n")).collect()}
    assert made == {("a", True): 25, ("a", False): 100, ("b", True): 50, ("b", False): 200, (None, True): 25, (None, False): 100}


def test_text_classifier(spark):
    rows = spark.range(160).select("id", F.concat(F.when(F.col("id") % 2 == 0, "good fine lovely day in the warm sun number ").otherwise("bad awful rainy night in the cold fog number "), (F.col("id") % 20).cast("string")).alias("review"), F.when(F.col("id") % 2 == 0, "pos").otherwise("neg").alias("kind"), F.lit("x").alias("short"))
    assert textmodels.text_column(rows, "kind") == "review" and textmodels.text_column(rows.drop("review")) is None
    found = textmodels.train_text(rows, "kind", "id")
    assert found.metrics.first()["accuracy"] == 1.0 and found.leaderboard.count() == 3
    words = {(r["class"], r["term"]) for r in found.keywords.where("rank <= 10").collect()}
    assert ("pos", "good") in words and ("neg", "bad") in words and found.keywords.where("rank > 15").isEmpty()
    said = textmodels.keywords_for(found.predict(rows.limit(4)), found.keywords).collect()
    assert all(r["prediction"] == r["kind"] and len(r["keywords"]) == 10 for r in said)
    plain = spark.createDataFrame([(" ", "A b!"), (None, None), ("x", "y")], "p string, q string")
    assert [r[0] for r in plain.select(textmodels.text_of(plain)).collect()] == ["a b", "", "x"]
    with pytest.raises(ValueError):
        textmodels.train_text(rows.drop("review"), "kind", "id")


def test_series(spark):
    rows = spark.range(120).select((F.col("id") % 2).alias("s"), F.timestamp_seconds(F.col("id") * 3600).cast("string").alias("t"), (F.col("id") % 2 * 100 + F.col("id") * 2).cast("string").alias("v"))
    assert text.series_rows(rows.union(spark.createDataFrame([(0, "no time", "1"), (0, "1970-01-01", "no number")], "s long, t string, v string")), "t", "v").count() == 120
    clean = text.series_rows(rows, "t", "v")
    found = forecast.train_series(clean, "v", ["s"], ["t"], ("ridge",))
    assert found.metrics.first()["rmse"] < 20
    new = spark.createDataFrame([(0, "1970-01-06 00:00:00", 240.0)], "s long, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert abs(found.predict_next(clean, new).first()["prediction"] - 240) < 30
    with pytest.raises(ValueError):
        found.predict(new)
    with pytest.raises(ValueError):
        forecast.train_series(clean.limit(20), "v", ["s"], ["t"])


def test_image_labels(spark):
    cases = {"train/dog/1.jpg": "dog", "n02099601-Shiba Inu/images/a.png": "shiba_inu", "data/7/a.jpg": "7", "7/val/a_3.jpg": "a", "cat.12.jpg": "cat", "images/train_4.jpg": "train_4", "pets/golden retriever_12.jpg": "golden_retriever"}
    files = spark.createDataFrame([(p,) for p in cases] + [("__MACOSX/dog/1.jpg",), ("dog/.hidden.jpg",), ("dog/notes.txt",)], "path string")
    assert {r[0]: r[1] for r in files.where(images.is_image(F.col("path"))).select("path", images.path_label(F.col("path"))).collect()} == cases
    many = spark.range(40).select(F.concat(F.lit("train/"), F.when(F.col("id") % 2 == 0, "cat").otherwise("dog"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"))
    assert {r["label"] for r in images.labelled(many, "path").collect()} == {"cat", "dog"}
    for bad in (many.where("path LIKE '%cat%'"), many.select(F.concat(F.lit("images/"), F.element_at(F.split("path", "/"), -1)).alias("path")), many.limit(0)):
        with pytest.raises(ValueError):
            images.labelled(bad, "path")


def test_pixels_and_components(spark):
    rows = [("a", 2, 1, 3, bytearray([1, 2, 255, 0, 0, 0])), ("b", 1, 1, 1, bytearray([51])), ("c", 1, 2, 4, bytearray([9, 9, 9, 0, 3, 2, 1, 0])), ("broken", 5, 5, 3, bytearray([1]))]
    got = {r["path"]: r["pixels"] for r in images.pixels(spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary"), 2).collect()}
    assert got["a"] == pytest.approx([1.0, 2 / 255, 1 / 255] * 2 + [0.0] * 6) and got["b"] == pytest.approx([0.2] * 12) and set(got) == {"a", "b", "c"}
    df = spark.range(50).select(F.array(F.col("id").cast("double"), 2.0 * F.col("id"), F.sin(F.col("id").cast("double"))).alias("v"))
    made, shares = images.principal_components(df, "v", 2)
    assert len(made.first()["features"]) == 2 and shares[0] > 0.99
    with pytest.raises(ValueError):
        images.principal_components(df.limit(1), "v")


def test_sections_and_tags(spark):
    notes = spark.createDataFrame([("my_notes.md", "intro\n\n## Drift\nmonitor it\n### How\n### Why\nbecause r2 falls\n## Empty\n## Last\nend\n#### deep\nmore"), ("none", None), ("plain", "x")], "key string, text string")
    got = [(r["key"], r["title"], r["content"], r["tags"]) for r in knowledge.sections(notes, "key", "text").orderBy("key", "section").collect()]
    assert got == [("my_notes.md", "My Notes", "intro", []), ("my_notes.md", "Drift", "monitor it", ["drift"]), ("my_notes.md", "Drift — How — Why", "because r2 falls", ["drift", "regression"]), ("my_notes.md", "Last", "end\n#### deep\nmore", []), ("plain", "Plain", "x", [])]


def test_relevance(spark):
    fields = "id long, task string, target string, features array<string>, row_bucket string, dataset string, signature string"
    past = spark.createDataFrame([(1, "classification", "churn", ["tenure", "monthly_charges"], "medium", "d1", "s1"), (2, "regression", "price", ["rooms"], "small", "d2", "s2"), (3, None, None, None, None, None, None)], fields)
    asked = spark.createDataFrame([(9, "classification", "customer_churn", ["tenure", "contract"], "medium", "", "s9"), (1, "classification", "churn", [], "medium", "d1", "s1")], fields)
    got = {(r["run_id"], r["context_id"]): r["similarity"] for r in advice.run_similarity(past, asked).collect()}
    assert got[1, 1] == 0 and got[1, 9] == pytest.approx(0.05 + 0.25 + 0.3 * 0.75 + 0.3 * 1 / 4 + 0.1) and got[2, 9] == pytest.approx(0.05) and got[3, 9] == pytest.approx(0.05)
    tips = spark.createDataFrame([("Impute missing tenure",), ("Impute missing tenure",), ("buy gold now",)], "tip string")
    assert {(r["tip"], r["relevance"]) for r in advice.tip_relevance(tips, ["tenure_months"]).collect()} == {("Impute missing tenure", 1.0)}


def test_leaks_by_the_fixed_names(spark):
    df = spark.createDataFrame([(1.5, "2020", 2, 3, 4)], "approved_date double, termination string, next_value int, uuid int, account_id int")
    assert {r["column"] for r in reports.future_columns(df).collect()} == {"approved_date", "termination"}
    assert {r["column"] for r in reports.future_columns(df, names="^next_").collect()} == {"approved_date", "termination", "next_value"}


def test_automl_drops_leaks_and_keeps_a_snapshot(spark, tmp_path):
    df = spark.range(240).select("id", (F.col("id") % 50).cast("double").alias("age"), F.rand(1).alias("noise"), F.when(F.col("id") % 50 > 25, "yes").otherwise("no").alias("y")).withColumn("outcome_code", (F.col("y") == "yes").cast("int"))
    found = learn.automl(df, "y", "id", candidates=["logistic_regression"], n_trials=1, folds=2, snapshot=f"file://{tmp_path}/train")
    assert not [f for f in found.features if "outcome" in f] and spark.read.parquet(f"file://{tmp_path}/train").count() > 150


def test_images_are_classified(spark):
    df = spark.range(120).select("id", F.array(*[F.when(F.col("id") % 2 == i % 2, 0.9).otherwise(0.1) + F.rand(i) / 10 for i in range(6)]).alias("pixels"), F.when(F.col("id") % 2 == 0, "cat").otherwise("dog").alias("label"))
    name, _, labels, board, metrics = images.train_images(df, "id", candidates=("logistic_regression", "random_forest"))
    assert labels == ["cat", "dog"] and metrics["accuracy"] == 1.0 and board.count() == 2 and name in ("logistic_regression", "random_forest")
