"""Markdown notes as titled, tagged sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes a text one of a topic: any of these in it (fixed values).
TAGS = {
    "classification": ("classif", "binary", "multiclass", "softmax", "logistic"),
    "regression": ("regress", "rmse", "mae", "r2", "mse"),
    "imbalance": ("imbalance", "imbalanced", "minority", "class weight", "stratified"),
    "drift": ("drift", "monitor", "production", "reference", "evidently"),
    "tuning": ("optuna", "hyperparameter", "trial", "grid search"),
    "features": ("feature", "encoding", "categorical", "datetime", "interaction", "engineering"),
    "missing": ("missing", "impute", "imputation", "null"),
}


def tags(text: Column) -> Column:
    """The sorted topics of a text; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in words]), F.lit(tag)) for tag, words in sorted(TAGS.items())]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, title, content, tags): the parts of markdown texts under `## ` and `### ` headings, in order from 0; those without content are left out.

    The part before any heading is titled with the key (its `_` as spaces, without `.md`). A `### ` heading adds to the title of the part before it.
    """
    parts = docs.select(F.col(key), F.posexplode(F.split(F.col(text), r"(?m)^(?=###? )")).alias("section", "part"))
    line = F.element_at(F.split("part", "\n", 2), 1)
    order = Window.partitionBy(key).orderBy("section")
    parts = parts.withColumns({"main": F.when(F.col("part").startswith("## "), F.trim(F.substring(line, 4, 1 << 30))), "sub": F.when(F.col("part").startswith("### "), F.trim(F.substr(line, F.lit(5))))})
    parts = parts.withColumns({"chapter": F.count("main").over(order), "first": F.coalesce(F.last("main", ignorenulls=True).over(order), F.initcap(F.replace(F.replace(F.col(key).cast("string"), F.lit(".md"), F.lit("")), F.lit("_"), F.lit(" "))))})
    subs = F.collect_list("sub").over(Window.partitionBy(key, "chapter").orderBy("section"))
    headed = F.col("main").isNotNull() | F.col("sub").isNotNull()
    body = F.when(headed, F.coalesce(F.try_element_at(F.split("part", "\n", 2), F.lit(2)), F.lit(""))).otherwise(F.col("part"))
    made = parts.select(key, "section", F.concat_ws(" — ", F.array("first"), subs).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))
    return made.where("content <> ''").withColumn("tags", F.array_sort(F.array_union(tags(F.col("title")), tags(F.col("content")))))
