"""Reading datasets and writing reports; paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quoted

#: What Spark puts where bytes aren't UTF-8.
BROKEN = "�"


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV file with a header, as UTF-8, or as Latin-1 if any text in it isn't UTF-8. Types are inferred (a pass over the data) unless a schema is given."""

    def read(encoding: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", False)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)

    found = read("UTF-8")
    strings = [n for n, kind in found.dtypes if kind == "string"]
    headers = any(BROKEN in n for n in found.columns)
    if headers or strings and not found.where(F.exists(F.array(*[F.coalesce(quoted(n), F.lit("")) for n in strings]), lambda v: F.contains(v, F.lit(BROKEN)))).isEmpty():
        return read("ISO-8859-1")
    return found


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, "\t", schema)


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: str | None = None) -> DataFrame:
    """A JSON file: a record a line, or one array."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_text(spark: SparkSession, path: str, label: str = "document") -> DataFrame:
    """(path, text, label): a row for each file, its whole text; files of white space only are left out."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("label", F.lit(label))


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, schema: str | None = None, limit: int | None = None, **options: str) -> DataFrame:
    """A table (all of it, or as many rows as limit says, in no order), or a whole query's result; an empty result is an error.

    options are those of Spark's reader (driver, partitionColumn, lowerBound, upperBound, numPartitions, ...).
    """
    if (table is None) == (query is None):
        raise ValueError("either a table or a query must be given")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query is not None:
        found = reader.option("query", query).load()
    else:
        found = reader.option("dbtable", f"{schema}.{table}" if schema else table).load()
        found = found if limit is None else found.limit(limit)
    if found.isEmpty():
        raise ValueError("the table or query has no rows")
    return found


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, mode, data) of the images below a folder; hidden files, resource forks and what isn't an image are left out."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")
    return found.where(~F.col("path").rlike(r"/(__MACOSX|\.[^/]*)(/|$)"))


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as JSON, a record a line."""
    report.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_predictions(scored: DataFrame, columns: list[str], path: str, probability: str | None = None) -> DataFrame:
    """Writes the input's columns with the prediction (and, of two classes, the second's probability) and reads them back."""
    p = [F.col(probability)[1].alias("probability")] if probability else []
    scored.select(*[quoted(c) for c in columns], "prediction", *p).write.mode("overwrite").parquet(path)
    return scored.sparkSession.read.parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds records of runs; a run's latest record is the one that counts (latest_runs)."""
    runs.write.mode("append").parquet(path)


def preview(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The first k rows by key: a top-k, not a sort of everything."""
    return df.orderBy(key).limit(k)
