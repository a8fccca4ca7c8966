"""What the findings of FINDINGS_r03.md from F8 on mended: each test failed before."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import advice, boosting, learn, modality, reports


def walked(tree, codes):
    out = []
    for row in codes.T:
        node = 0
        while tree.column[node] >= 0:
            node = tree.left[node] if row[tree.column[node]] <= tree.last[node] else tree.right[node]
        out.append(node)
    return out


def test_boosting_takes_blocks_of_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (700, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0] > 4), 1.0) for i, v in enumerate(x)], "id long, x array<double>, y double, w double").coalesce(1)
    edges = [np.arange(8.0)] * 3
    table = boosting.binned(rows, edges, [0.5])
    assert table.count() == 1
    block = next(boosting.blocks_of(table.toArrow().to_batches(), 3, 1))
    assert (block["codes"] == x.T).all() and (block["y"] == (x[:, 0] > 4)).all() and (block["margin"] == 0.5).all() and (block["id"] == np.arange(700)).all()
    for splits in (0, 20, 200):  # as bytes, and by rows where a tree has more nodes
        tree = boosting.Tree()
        for _ in range(splits):
            tree.split(int(rng.choice([i for i, c in enumerate(tree.column) if c < 0])), int(rng.integers(3)), int(rng.integers(8)))
        assert boosting.leaves(tree.arrays(), block["codes"]).tolist() == walked(tree, block["codes"])


def test_a_whole_tree_is_not_counted_again(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 2))
    df = spark.createDataFrame([(v.tolist(), float(v.sum() > 0)) for v in x], "features array<double>, label double")
    asked = []
    real = boosting.HistogramBoosting._histograms
    monkeypatch.setattr(boosting.HistogramBoosting, "_histograms", lambda self, table, since, t, trees, wanted, *rest: asked.append(list(wanted)) or real(self, table, since, t, trees, wanted, *rest))
    model = boosting.HistogramBoosting(trees=1, num_leaves=2, min_samples_leaf=5).fit(df)
    assert asked == [[(0, 0)]]
    column, _, left, right, value = map(np.array, model.fitted["trees"][0][0])
    assert column[0] >= 0 and value[left[0]] * value[right[0]] < 0
    assert model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.7


def test_similarities_are_worked_out_once_for_a_kind(spark):
    kinds = [("F", "5-LOW", ["unit_price"], "small", "1", "sig1|col"), ("F", "5-LOW", ["unit_price"], "small", "1", None), ("O", "x", None, "large", None, "")]
    schema = "id long, task string, target string, features array<string>, row_bucket string, dataset string, signature string"
    runs = spark.createDataFrame([(i, *kinds[i % 3]) for i in range(60)] + [(3, *kinds[0]), (None, *kinds[2])], schema)
    asked = spark.createDataFrame([(0, *kinds[0]), (-1, "F", "low", ["price"], "small", "2", "sig1|col"), (2, *kinds[2])], schema)
    whole = advice.run_similarity(runs, asked)
    got = {(r["run_id"], r["context_id"]): r["similarity"] for r in whole.collect()}
    assert whole.count() == 62 * 3 and len(got) == 61 * 3 and got[0, 0] == 0.0 and got[3, 0] == got[57, 0] > 0.9 and got[2, 2] == 0.0 < got[None, 2]
    least = advice.first_of_kinds(runs, 2)
    assert least.count() == 9
    key = lambda r: str(tuple(r))
    want, some = (sorted(advice.comparable_runs(advice.run_similarity(df, asked), 0.05).collect(), key=key) for df in (runs, least))
    assert some == want and len(want) == 6


def test_only_what_the_rules_ask_for_is_looked_at(spark, monkeypatch):
    seen = []
    real = modality.statistics
    monkeypatch.setattr(modality, "statistics", lambda df, *a: seen.append(a) or real(df, *a))
    df = spark.range(40).select((F.col("id") * 1.5).alias("price"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))").alias("day"), (F.col("id") % 2).cast("string").alias("kind"))
    found = modality.detect(df)
    assert (found["modality"], found["datetime_column"], found["value_columns"]) == ("timeseries", "day", ["price"])
    assert seen[0] == (["kind"], ["day"])
    rows = {r["column"]: r for r in real(df, ["kind"], ["day"]).collect()}
    assert rows["price"]["n_times"] is None and rows["price"]["mean_length"] is None and rows["price"]["n_distinct"] == 40
    assert rows["day"]["n_times"] == 40 and rows["day"]["max_year"] == 2024 and rows["kind"]["mean_length"] == 1.0


def test_rows_of_a_class_stay_where_they_are(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is large by its statistics
    try:
        _rows_of_a_class_stay_where_they_are(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _rows_of_a_class_stay_where_they_are(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 3 == 0, "b").otherwise("a")).alias("kind"))
    coded = reports.with_code(df, "kind")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert {(r["kind"], r["__code"]) for r in coded.collect()} == {("a", 0.0), ("b", 1.0), (None, -1.0)} and coded.count() == 60


def test_trees_get_their_rows_in_parts(spark, monkeypatch):
    from pyspark.ml import regression as R

    rows = spark.range(900).coalesce(1).select(F.col("id").cast("double").alias("a"), (F.col("id") % 5 * 1.0).alias("label"), (F.col("id") % 2).alias("fold"))
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    monkeypatch.setattr(learn, "TREE_ROWS", 100)
    seen = []
    for kind in (R.GBTRegressor, R.LinearRegression):
        real = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, data, *a, real=real: seen.append(data.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()) or real(self, data, *a))
    learn.cv_score(df, "regression", R.GBTRegressor(maxIter=1, maxDepth=1), 2)
    assert len(seen) == 2 and all(sum(r["count"] for r in parts) == 450 and max(r["count"] for r in parts) <= 110 for parts in seen)
    parts = learn.in_parts(df.select("features", "label")).select(F.spark_partition_id().alias("p"), F.xxhash64("features", "label").alias("h")).collect()
    assert len(parts) == 900 and parts == sorted(parts)  # the order is the data's own
    model = learn.fit_on(df.where("a < 90"), R.GBTRegressor(maxIter=1, maxDepth=1))  # few rows stay as they are
    learn.fit_on(df, R.LinearRegression())
    assert model.getNumTrees == 1 and [len(parts) for parts in seen[2:]] == [1, 1]
