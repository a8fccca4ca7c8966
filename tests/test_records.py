import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import advice, logs, modality, retrieval, runs
from tessera.plans import records
from tessera.sources import files
from tessera.streaming.drift import reference_bins, windowed_psi

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(records.ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    mine, theirs = records.QUERIES[name](spark, DATA).toPandas(), con.execute(records.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    rows = lambda p: [tuple(None if v != v or v is None else float(v) if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in p[sorted(p.columns)].itertuples(index=False)]
    key = lambda r: tuple(str(v) for v in r)
    a, b = sorted(rows(mine) if len(mine) else [], key=key), sorted(rows(theirs) if len(theirs) else [], key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, float) for v in x) else all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-4 for p, q in zip(x, y)), (x, y)


def test_csv_of_either_encoding(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "latin-1")):
        (tmp_path / name).write_bytes("name,n\ncafé,1\nthé,\n".encode(encoding))
        found = files.read_csv(spark, f"file://{tmp_path}/{name}")
        assert {tuple(r) for r in found.collect()} == {("café", 1), ("thé", None)}


def test_tsv_json_and_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tb c\n")
    assert tuple(files.read_tsv(spark, f"file://{tmp_path}/a.tsv").first()) == (1, "b c")
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n{"text": null, "y": 2}\n')
    assert files.read_json(spark, f"file://{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    (tmp_path / "t/b.txt").write_text(" \n")
    assert [(r["text"], r["label"]) for r in files.read_text(spark, f"file://{tmp_path}/t").collect()] == [("one\ntwo", "document")]


def test_jdbc_round_trip(spark):
    url, driver = "jdbc:derby:memory:records;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(5).write.format("jdbc").option("url", url).option("dbtable", "t").options(**driver).mode("overwrite").save()
    assert files.read_jdbc(spark, url, table="t", limit=3, **driver).count() == 3
    with pytest.raises(ValueError):
        files.read_jdbc(spark, url, query='SELECT * FROM t WHERE "id" > 9', **driver)


def test_images(spark, tmp_path):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\xff\0\0\0\xff\0")) + chunk(b"IEND", b"")
    for d in ("cat", "__MACOSX"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.png").write_bytes(png)
    (tmp_path / "cat/broken.png").write_bytes(b"no image")
    found = files.read_images(spark, f"file://{tmp_path}").collect()
    assert [(r["height"], r["width"], r["channels"], bytes(r["data"])) for r in found] == [(1, 2, 3, b"\0\0\xff\0\xff\0")]


def test_stream_and_table_agree(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 1000).alias("ts"), (F.col("id") % 37).cast("double").alias("v"))
    edges, shares = reference_bins(rows, "v")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    last = spark.createDataFrame([("1971-01-01 00:00:00", 1.0)], "ts string, v double").select(F.col("ts").cast("timestamp").alias("ts"), "v")
    last.write.mode("append").parquet(f"{tmp_path}/in")
    stream = windowed_psi(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "v", edges, shares)
    stream.writeStream.format("memory").queryName("drifted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    table = windowed_psi(rows, "ts", "v", edges, shares)
    assert spark.table("drifted").exceptAll(table).isEmpty() and spark.table("drifted").count() == table.count()


def test_modalities(spark):
    frame = lambda cols, rows: spark.createDataFrame(rows, cols)
    assert modality.by_extension("a.PNG") == "image" and modality.by_extension("a") is None
    assert modality.detect(frame("message string, severity string", [("disk full", "low"), (None, "high")]))["modality"] == "logs"
    assert modality.detect(frame("tweet_id long, text string, sentiment string", [(i, "words " * 9 + str(i), "pn"[i % 2]) for i in range(20)])) | {"value_columns": []} == {"modality": "text", "text_column": "text", "datetime_column": None, "value_columns": [], "targets": ["tweet_id", "sentiment"]}
    series = frame("date string, sales double", [(f"2024-01-{i:02}", float(i)) for i in range(1, 29)])
    assert modality.detect(series)["modality"] == "timeseries"
    people = frame("customer_id long, signup_date string, spend double, churned string", [(i, f"2024-01-{i:02}", float(i), "yn"[i % 2]) for i in range(1, 29)])
    assert modality.detect(people)["modality"] == "tabular"
    assert modality.detect(people.where("false"))["modality"] == "tabular"


def test_diverse_takes_unlike_texts(spark):
    pooled = spark.createDataFrame([("q", 1, 1.0, ["a", "b"]), ("q", 2, 0.99, ["a", "b"]), ("q", 3, 0.8, ["c"]), ("r", 4, 0.1, None)], "query string, id long, score double, tokens array<string>")
    made = {(r["query"], r["place"]): r["id"] for r in retrieval.diverse(pooled, "id", "tokens", 2).collect()}
    assert made == {("q", 1): 1, ("q", 2): 3, ("r", 1): 4}


def test_log_routes_and_themes(spark):
    docs = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, "disk full on node").otherwise("login failed for user").alias("text"), (F.col("id") % 3).alias("kind"))
    assert logs.route(docs, "kind") == "classify" and logs.route(docs, "id") == "cluster" and logs.route(docs, None) == "cluster"
    found = logs.themes(docs.union(spark.createDataFrame([(99, None, 0)], "id long, text string, kind long")), "id", "text")
    by = {r["theme"]: r["n"] for r in found.members.where("id <> 99").groupBy("theme").agg(F.count("*").alias("n")).collect()}
    assert sorted(by.values()) == [30, 30] and found.silhouette > 0.8


def test_runs(spark):
    made = spark.createDataFrame([("a", {"lr": "1", "k": "3"}), ("b", {"lr": "2", "k": "3", "x": "0"})], "job_id string, params map<string,string>")
    assert {tuple(r)[2:] for r in advice.compare_params(made, spark.createDataFrame([("a", "b")], "a string, b string")).collect()} == {("lr", "1", "2"), ("x", None, "0")}
    none = spark.createDataFrame([], "job_id string, dataset_id string, created_at timestamp, model_name string, metrics map<string,double>")
    assert tuple(runs.dashboard(none).first()) == (0, 0, 0.0, None, None, None)
