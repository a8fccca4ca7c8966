"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html, langid, mixing, neardup, repeats, rollup, secrets, spelling, tokens, toxicity, whiten
from .common import scratch, table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return made.withColumn("repeated", F.col("n_removed") > 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_langid(table(spark, sf_dir, "documents"), _public("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination_report(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def mix_levels() -> dict:
    """The tree of the mix: domains by the last digit of the source's name, then languages, then sources."""
    return {"domain": F.expr("CASE WHEN substr(source, -1, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN substr(source, -1, 1) IN ('4', '5', '6') THEN 'books' ELSE 'forums' END"), "lang": F.col("lang"), "source": F.col("source")}


def mix_weights() -> list:
    return [F.expr("CASE domain WHEN 'web' THEN 0.5D WHEN 'books' THEN 0.3D ELSE 0.2D END"), F.expr("CASE lang WHEN 'en' THEN 0.5D WHEN 'fr' THEN 0.2D WHEN 'de' THEN 0.2D ELSE 0.1D END"), F.lit(1.0)]


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(), mix_weights())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "mix_leaf.domain", "mix_leaf.lang", "mix_leaf.source", "mix_epoch", "mix_tokens")


_TOKENS_SQL = "CASE WHEN length(replace(replace(text, ' ', ''), chr(10), '')) > 0 THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END"


def _family_sql(level: str, above: list[str], weight: str) -> str:
    """DuckDB: the shares of the children of each node, as a table share_<level> from node_<parent>."""
    path = ", ".join([*above, level])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    budget = f"share_{above[-1]}.share" if above else "(SELECT sum(tokens) FROM leaf)::DOUBLE"
    source = f"leaf LEFT JOIN share_{above[-1]} USING ({', '.join(above)})" if above else "leaf"
    return f"""
    kids_{level} AS (SELECT {path}, sum(2 * tokens)::DOUBLE AS c, max({budget}) AS b, max({weight})::DOUBLE AS w FROM {source} GROUP BY {path}),
    cum_{level} AS (SELECT *, coalesce(sum(c) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
        sum(w) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM kids_{level}),
    lam_{level} AS (SELECT *, greatest(b - f, 0) / r AS lam FROM cum_{level}),
    lev_{level} AS (SELECT *, first_value(CASE WHEN c / w > lam THEN lam END) OVER ({part} ORDER BY CASE WHEN c / w > lam THEN 0 ELSE 1 END, c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM lam_{level}),
    share_{level} AS (SELECT {path}, CASE WHEN lev IS NULL THEN c ELSE least(c, lev * w) END AS share FROM lev_{level})"""


OP6_SQL = f"""
WITH docs AS (SELECT doc_id, text, lang, source, CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN right(source, 1) IN ('4', '5', '6') THEN 'books' ELSE 'forums' END AS domain,
        CAST({_TOKENS_SQL} AS BIGINT) AS tokens FROM documents),
    leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs WHERE tokens > 0 GROUP BY ALL),
    {_family_sql("domain", [], "CASE domain WHEN 'web' THEN 0.5 WHEN 'books' THEN 0.3 ELSE 0.2 END")},
    {_family_sql("lang", ["domain"], "CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.2 ELSE 0.1 END")},
    {_family_sql("source", ["domain", "lang"], "1.0")},
    room AS (SELECT leaf.*, e AS mix_epoch, least(tokens, floor(share + 1e-6)::BIGINT - e * tokens) AS room FROM leaf JOIN share_source USING (domain, lang, source), (VALUES (0), (1)) v(e)),
    placed AS (SELECT docs.doc_id, domain, lang, source, mix_epoch, docs.tokens AS mix_tokens, room,
        coalesce(sum(docs.tokens) OVER (PARTITION BY domain, lang, source, mix_epoch ORDER BY md5('mix-1:' || mix_epoch || ':' || doc_id), docs.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM docs JOIN room USING (domain, lang, source) WHERE docs.tokens > 0 AND room > 0)
SELECT doc_id, domain, lang, source, mix_epoch, mix_tokens FROM placed WHERE before < room"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: inserts of two tokenizer versions, revisions of every seventh document, deletes of every eleventh, and the first batch again."""
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(F.map_from_arrays(F.array(F.lit("space-1"), F.lit("quad-1")), F.array(mixing.count_tokens(F.col("text")), F.coalesce(F.ceil(F.length("text") / 4), F.lit(0))))).alias("tokenizer", "n"))
    event = lambda df, kind, n, old: df.select(F.lit(kind).alias("kind"), "source", "lang", "tokenizer", n.alias("n_tokens"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), old.alias("old_tokens"))
    n = F.col("n")
    kept = rollup.Rollup(spark, scratch(spark, "rollup"))
    inserts = event(counted, "insert", n, F.lit(None).cast("long"))
    kept.commit("inserts", inserts)
    kept.commit("revisions", event(counted.where("doc_id % 7 = 0"), "revise", 2 * n, n))
    kept.commit("deletes", event(counted.where("doc_id % 11 = 0"), "delete", F.when(F.col("doc_id") % 7 == 0, 2 * n).otherwise(n), F.lit(None).cast("long")))
    kept.commit("inserts", inserts)
    return kept.totals()


OP8_SQL = f"""
WITH counted AS (
    SELECT doc_id, source, lang, 'space-1' AS tokenizer, CAST({_TOKENS_SQL} AS BIGINT) AS n FROM documents
    UNION ALL SELECT doc_id, source, lang, 'quad-1', CAST(coalesce(ceil(length(text) / 4.0), 0) AS BIGINT) FROM documents)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 2 * n ELSE n END) AS BIGINT) AS n_tokens
FROM counted WHERE doc_id % 11 <> 0 GROUP BY source, lang, tokenizer"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's deviation is a decimal; where it doesn't fit 64 bits, it is null here."""
    return whiten.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_repeats": op2_repeats,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_main_text": op5_main_text,
        "op6_mixing": op6_mixing,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_token_counts": op8_token_counts,
        "op9_token_output": op9_token_output,
        "op10_nearest": op10_nearest,
        "op11_secrets": op11_secrets,
        "op12_whitening": op12_whitening,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op8_token_counts": OP8_SQL}
