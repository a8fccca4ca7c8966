"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, neardup, tokens
from .common import free_name, quoted, table
from .queries import _public, mixed


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a language at least as likely as all others together stay."""
    found = langid.identify(docs, docs, _public("piece_bpe_32k.model"), keep=docs.columns)
    lang, score = (F.col(free_name(n, docs.columns)) for n in ("lang_pred", "score"))
    return _same_columns(found.where((lang != langid.UND) & (score >= 0.5)), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id, stays."""
    return neardup.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth are in benchmark windows stay."""
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    report = decontam.contamination_report(found, docs.columns)
    return _same_columns(report.where(~F.col(free_name("contaminated", docs.columns))), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by weight over domains, languages and sources; short leaves are read twice at most."""
    return _same_columns(mixed(docs), docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token ids and returns, for each, its place in the files."""
    return tokens.token_output(docs, _public("word_bpe_49k.json"))
