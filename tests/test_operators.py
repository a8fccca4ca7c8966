import pytest
from pyspark.sql import functions as F

from tessera.operators import clean, features, learn, profile, reports


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(300).withColumn("age", (F.col("id") % 50 + 20).cast("double")).withColumn("income", F.when(F.col("id") % 20 != 0, F.when(F.col("id") == 7, 5e6).otherwise(1000.0 + F.col("id") * 7 % 900)))
    return df.withColumn("city", F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int"))).withColumn("signup", F.expr("date_add(date'2023-01-01', cast(id as int))")).withColumn("churned", F.when(F.col("age") > 50, "yes").otherwise("no"))


def test_profile(frame):
    assert tuple(profile.shape(frame).first()) == (300, 6)
    assert {r["column"]: r["n_missing"] for r in profile.missing(frame).collect()}["income"] == 15
    assert [r[0] for r in profile.detected_datetimes(frame).collect()] == ["signup"]


def test_cleaner_fills_and_replays(frame):
    model = clean.Cleaner(ignore=["id"]).fit(frame.where("id < 200"))
    made = model.transform(frame.where("id >= 200"))
    assert made.count() == 100 and made.where("income IS NULL").isEmpty()


def test_cap_is_idempotent(frame):
    model = clean.OutlierCap(columns=["income"]).fit(frame)
    once = model.transform(frame)
    assert once.agg(F.max("income")).first()[0] < 5e6 and once.count() == 300
    assert once.exceptAll(model.transform(once)).isEmpty()


def test_drift_of_a_table_with_itself_is_none(frame):
    assert {r["score"] for r in reports.feature_drift(frame, frame).collect()} == {0.0}


def test_leaks_and_quality(frame):
    issues = reports.leakage(frame.withColumn("again", F.col("churned")), "churned", "classification")
    kinds = {(r["column"], r["kind"]) for r in issues.collect()}
    assert ("id", "id") in kinds and ("again", "target_copy") in kinds
    assert 0 <= reports.quality(frame, "churned", "classification").first()["score"] <= 100


def test_targets_are_validated(spark, frame):
    with pytest.raises(ValueError):
        learn.validate_target(frame, "id")
    with pytest.raises(ValueError):
        learn.validate_target(spark.createDataFrame([("a",)] * 10 + [("b",)], "y string"), "y")
    learn.validate_target(frame, "churned")


def test_features_are_numeric_and_complete(frame):
    model = features.FeatureEngineer(labelCol="label").fit(frame.withColumn("label", (F.col("churned") == "yes").cast("double")).drop("churned"))
    made = model.transform(frame.limit(10))
    assert set(t for _, t in made.dtypes) == {"double"} and made.na.drop().count() == 10
    assert model.transform(frame.drop("city")).columns == made.columns


def test_anomalies_rank_outliers_first(frame):
    made = clean.IsolationForest(columns=["income"], trees=40).fit(frame).transform(frame)
    assert made.orderBy(F.desc("_anomaly_score")).first()["id"] == 7


def test_automl(frame):
    result = learn.automl(frame, "churned", "id", candidates=["logistic_regression", "random_forest"], n_trials=1, folds=2)
    assert result.metrics.first()["accuracy"] > 0.9
    assert {"prediction", "probability"} <= set(result.predict(frame.limit(5)).columns)


def test_codes_of_classes_seen_and_unseen(spark):
    seen = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    new = spark.createDataFrame([(1, "a"), (2, "z"), (3, None), (4, "b")], "id int, c string")
    made = {r["id"]: r["code"] for r in reports.encoded(new, "c", reports.class_codes(seen, "c"), "code").collect()}
    assert made == {1: 0.0, 2: -1.0, 3: -1.0, 4: 1.0}
    back = reports.encoded(new, "c", reports.class_codes(seen, "c"), "code").select("id", reports.decoded(F.col("code"), ["a", "b"]).alias("d")).collect()
    assert {r["id"]: r["d"] for r in back} == {1: "a", 2: None, 3: None, 4: "b"}


def test_forest_doesn_t_depend_on_partitions(spark):
    df = spark.range(400).select("id", F.sin("id").alias("v"), (F.col("id") % 9).cast("double").alias("w"))
    fitted = [clean.IsolationForest(columns=["v", "w"], trees=7, sample=64, key="id").fit(df.repartition(n)).fitted for n in (1, 5)]
    assert fitted[0] == fitted[1] and fitted[0]["sample"] == 64 and len(fitted[0]["trees"]) == 7
