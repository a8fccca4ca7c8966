"""A corpus pipeline of the training-data operators, run over the documents of a folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import table, written

STAGES = [
    ("language identification", stages.identify_language),
    ("near-duplicate removal", stages.remove_near_duplicates),
    ("benchmark decontamination", stages.decontaminate),
    ("mixing to target weights", stages.mix),
    ("token output", stages.write_tokens),
]

#: DartMinHash and the language model have no SQL form; tests/llm/test_pipeline.py holds run() and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
