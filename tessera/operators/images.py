"""Labels of image files from their paths, checks of the labels, and pixels as features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import principal_components
from .learn import best_on_holdout, class_labels, class_weight, classification_metrics, stratified_split, validate_target

#: Endings of image files and folder names that are no class (fixed values).
ENDINGS = ["jpg", "jpeg", "png", "bmp", "gif", "webp"]
GENERIC = ["images", "image", "train", "test", "val", "valid", "data", "imgs", "photos", "seg_train", "seg_test", "training", "dataset", "my_images", "training_set", "petimages", "pets", "cats_and_dogs", "animals"]
#: An image's size as a feature, in pixels.
SIDE = 64


def is_image(path: Column) -> Column:
    """Image files outside hidden and system folders."""
    return path.rlike(rf"(?i)\.({'|'.join(ENDINGS)})$") & ~path.rlike(r"(?i)(^|/)(__MACOSX|\.git|\.svn)(/|$)|(^|/)\.[^/]*$")


def _plain(name: Column) -> Column:
    """A folder's or file's name as a class: lower case, a leading synset number gone, spaces as _."""
    return F.replace(F.lower(F.regexp_replace(F.trim(name), r"(?i)^n\d+-(?=.)", "")), F.lit(" "), F.lit("_"))


def file_label(path: Column) -> Column:
    """The class that a file's name tells: dog.12 and breed_12 without their numbers, else all of it."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    pet, prefix = F.regexp_extract(stem, r"^(dog|cat)\.\d+$", 1), F.regexp_extract(stem, r"^(.+)_\d+$", 1)
    return F.replace(F.when(pet != "", pet).when((prefix != "") & ~prefix.isin(GENERIC), prefix).otherwise(stem), F.lit(" "), F.lit("_"))


def folder_label(path: Column) -> Column:
    """The name of the folder that holds the file, as a class (null at the top)."""
    return F.when(F.size(F.split(path, "/")) > 1, _plain(F.element_at(F.split(path, "/"), -2)))


def path_label(path: Column) -> Column:
    """The class that a path (below the collection's root) tells: the innermost folder with a telling name, else the file's name. A number is telling in the innermost folder only."""
    folders = F.split(path, "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    names = F.transform(folders, lambda f: _plain(f))
    last = F.size(names) - 1
    telling = F.filter(names, lambda n, i: ~n.isin(GENERIC) & (~n.rlike(r"^\d+$") | (i == last)))
    return F.when(F.size(telling) > 0, F.element_at(telling, -1)).otherwise(file_label(path))


#: The ways to label, in the order in which they are tried.
LAYOUTS = {"path": path_label, "folder": folder_label, "file": file_label}


def layouts(files: DataFrame, path: str, least: int = 10) -> DataFrame:
    """(layout, n, n_classes, least, most, numeric, good): how each way to label would work; good are those of enough images and at least two classes, not one for each image."""
    pairs = F.array(*[F.struct(F.lit(k).alias("layout"), f(F.col(path)).alias("label")) for k, f in LAYOUTS.items()])
    counts = files.where(is_image(F.col(path))).select(F.inline(pairs)).where("label IS NOT NULL").groupBy("layout", "label").agg(F.count("*").alias("n"))
    sums = counts.groupBy("layout").agg(F.sum("n").alias("n"), F.count("*").alias("n_classes"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("label").rlike(r"^\d+$")).alias("numeric"))
    alone = F.col("most") == 1
    bad = (F.col("n_classes") / F.col("n") > 0.5) & alone | (F.col("numeric") / F.col("n_classes") > 0.7) & alone
    return sums.withColumn("good", (F.col("n") >= least) & (F.col("n_classes") >= 2) & ~bad)


def labelled(files: DataFrame, path: str) -> DataFrame:
    """The image files with label, by the first layout that is good (the first of any if none is). ValueError if the labels won't do."""
    found = {r["layout"]: r for r in layouts(files, path).collect()}
    chosen = next((k for k in LAYOUTS if k in found and found[k]["good"]), next((k for k in LAYOUTS if k in found), None))
    if chosen is None:
        raise ValueError("there are no image files")
    validate(found[chosen])
    return files.where(is_image(F.col(path))).withColumn("label", LAYOUTS[chosen](F.col(path))).where("label IS NOT NULL")


def validate(layout) -> None:
    """Refuses labels of one class, nearly one for each image, or with classes of one image. layout: a row of layouts()."""
    if layout["n_classes"] < 2:
        raise ValueError("two image classes are needed: a folder for each, or names like breed_12.jpg")
    if layout["n_classes"] / layout["n"] > 0.5 or layout["numeric"] / layout["n_classes"] > 0.7 and layout["least"] == 1:
        raise ValueError(f"{layout['n_classes']} classes in {layout['n']} images: nearly every image has a label of its own")
    if layout["least"] < 2:
        raise ValueError("a class has one image only")


def pixels(images: DataFrame, side: int = SIDE) -> DataFrame:
    """(path, height, width, channels, data) as Spark's image source reads them -> (path, pixels): side x side x RGB in 0..1, nearest pixels; what can't be read is left out."""

    def run(batches):
        for batch in batches:
            rows, paths = [], []
            for r in batch.to_pylist():
                h, w, c = r["height"], r["width"], r["channels"]
                if not r["data"] or min(h, w) < 1 or c not in (1, 3, 4) or len(r["data"]) != h * w * c:
                    continue
                x = np.frombuffer(r["data"], np.uint8).reshape(h, w, c)
                x = x[np.arange(side) * h // side][:, np.arange(side) * w // side]
                x = np.repeat(x, 3, 2) if c == 1 else x[:, :, 2::-1]  # blue first
                rows.append((x / 255.0).reshape(-1).tolist())
                paths.append(r["path"])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rows, pa.list_(pa.float64()))], ["path", "pixels"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, pixels array<double>")


def train_images(df: DataFrame, key: str, column: str = "pixels", label: str = "label", candidates: tuple[str, ...] = ("random_forest", "gradient_boosting", "logistic_regression"), components: int = 128, test: float = 0.2, seed: int = 42):
    """(key, an array of numbers, label) -> (name of the best model, the model over features, labels, leaderboard, metrics): models of the principal components, compared on held-out rows."""
    validate_target(df, label)
    labels = class_labels(df, label)
    code = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label).cast("string")) - 1).cast("double")
    made, _ = principal_components(df.where(F.col(label).isNotNull()).select(key, label, column), column, components)
    rows = made.where("features IS NOT NULL").select(F.col(key).alias("__key"), array_to_vector("features").alias("features"), code.alias("label"))
    split = stratified_split(rows, "label", F.col("__key"), test, seed).persist()
    try:
        train, held = split.where(~F.col("is_test")), split.where("is_test")
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        name, model, board = best_on_holdout(train.withColumn("__weight", class_weight(counts, len(labels))), held, candidates, len(labels), seed, "__weight")
        metrics = classification_metrics(model.transform(held), "label", "prediction").first()
        return name, model, labels, df.sparkSession.createDataFrame(board, "model string, f1 double"), metrics.asDict()
    finally:
        split.unpersist()
