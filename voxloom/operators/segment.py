"""Training and applying a particle classifier, and labels for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import with_scalars


def add_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Both label tables ``(z, y, x, label)``; where both have a voxel the later one wins."""
    both = labels.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)))
    return both.groupBy("z", "y", "x").agg(F.max_by("label", "_o").alias("label"))


def unambiguous(labelled: DataFrame, key: list[str]) -> DataFrame:
    """``key.., label`` of particles all of whose labels agree."""
    return labelled.groupBy(*key).agg(F.min("label").alias("label"), F.max("label").alias("_m")).where("label = _m").drop("_m")


def ambiguity(labelled: DataFrame, key: list[str]) -> DataFrame:
    """``n_particles, n_ambiguous`` of a labelled set."""
    return labelled.groupBy(*key).agg((F.min("label") != F.max("label")).alias("bad")).agg(F.count("*").alias("n_particles"), F.count_if("bad").alias("n_ambiguous"))


def train(rows: DataFrame, features: list[str], label: str = "label", trees: int = 10, balanced: bool = True, mean_norm: bool = True, std_norm: bool = True, seed: int = 0) -> PipelineModel:
    """Scaler and random forest; balanced: each class weighs n / (classes * rows of it)."""
    rows = rows.withColumn("_y", F.col(label).cast("double"))
    counts = rows.groupBy("_y").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = with_scalars(counts, total).select("_y", (F.col("_all") / (F.col("_k") * F.col("_n")) if balanced else F.lit(1.0)).alias("_weight"))
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=mean_norm, withStd=std_norm),
        RandomForestClassifier(featuresCol="_features", labelCol="_y", weightCol="_weight", numTrees=trees, seed=seed),
    ]
    return Pipeline(stages=stages).fit(rows.join(F.broadcast(weights), "_y"))  # a row a class


def predict(rows: DataFrame, model: PipelineModel, output: str = "class") -> DataFrame:
    """rows with ``prediction``: the class, or with output="probability" an array of shares of 65535 for each class."""
    got = model.transform(rows)
    if output == "class":
        return got.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"))
    if output != "probability":
        raise ValueError("output must be class or probability")
    return got.select(*rows.columns, F.transform(vector_to_array("probability"), lambda p: F.floor(p * 65535).cast("int")).alias("prediction"))


def accuracy(predicted: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, accuracy`` of each class and of all (null label)."""
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    return predicted.rollup(label).agg(F.count("*").alias("n"), right.alias("accuracy"))


def class_shares(predicted: DataFrame) -> DataFrame:
    counts = predicted.groupBy("prediction").agg(F.count("*").alias("n"))
    return with_scalars(counts, counts.agg(F.sum("n").alias("_t"))).select("prediction", "n", (F.col("n") / F.col("_t")).alias("share"))


def segment(voxels: DataFrame, model: PipelineModel, features: Callable[[DataFrame], DataFrame], labeller: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """``mask`` (each voxel's class) and, with a labeller, ``labels``: its objects. Both functions map a table to a table."""
    mask = predict(features(voxels), model)
    out = {"mask": mask.select(*[c for c in ("row", "col", "z", "y", "x") if c in mask.columns], "prediction")}
    if labeller:
        out["labels"] = labeller(mask)
    return out


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
