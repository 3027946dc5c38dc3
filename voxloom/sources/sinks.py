"""Sinks: tables partitioned the way scans prune them, and small exports."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import octree
from .images import encode_npy, encode_tiff


def write_particles(particles: DataFrame, path: str, mode: str = "append") -> None:
    """By set and level, so a scan at a resolution reads that of it alone; rows sorted by cell for row-group skipping."""
    rows = particles.repartition("parts_name", "level", F.floor(F.col("z_l") / 64)).sortWithinPartitions("z_l", "y_l", "x_l")
    rows.write.mode(mode).partitionBy("parts_name", "level").parquet(path)


def read_particles(spark: SparkSession, path: str, parts_name: str = "particles", level: int | None = None) -> DataFrame:
    """One set of particles; level: up to it."""
    got = spark.read.parquet(path).where(F.col("parts_name") == parts_name)
    return got if level is None else got.where(F.col("level") <= level)


def write_projections(projections: DataFrame, path: str) -> None:
    projections.write.mode("overwrite").partitionBy("side", "plane").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV file with a header: for tables of a row a tile, and cells."""
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_registration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.REGISTRATION).option("header", "true").csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("z double, y double, x double").option("header", "true").csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("z", "y", "x", F.col("label").cast("short").alias("label")).write.mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LABELS).parquet(path)


def append_tree(leaves: DataFrame, path: str, l_max: int, parts_name: str = "particles", mode: str = "mean", by: list[str] | None = None) -> None:
    """Add interior nodes to stored leaves, so that coarser levels can be read by themselves."""
    tree = octree.fill_tree(leaves, l_max, mode=mode, by=by)
    write_particles(tree.withColumns({"parts_name": F.lit(parts_name), "is_leaf": F.lit(False)}), path)


def has_tree(spark: SparkSession, path: str, parts_name: str = "particles") -> bool:
    """Whether a stored set can be read at coarser levels."""
    return not read_particles(spark, path, parts_name).where("not is_leaf").isEmpty()


def pending(planned: DataFrame, existing: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Planned outputs that don't exist; all of them if forced."""
    return planned if force else planned.join(existing, key, "left_anti")


def write_planes(volume: DataFrame, folder: str, kind: str = "tif", dtype: str = "uint16") -> DataFrame:
    """An image file for each z plane of ``(z, y, x, v)``, written by tasks into a shared folder; returns ``z, path``."""
    ny, nx = volume.agg(F.max("y") + 1, F.max("x") + 1).first()
    encode = encode_tiff if kind == "tif" else encode_npy

    def plane(p: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((ny, nx), dtype)
        image[p.y, p.x] = p.v
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        z = int(p.z.iloc[0])
        part, path = f"{where}/.{uuid.uuid4().hex}", f"{where}/{z:06d}.{kind}"
        with system.open_output_stream(part) as out:
            out.write(encode(image))
        system.move(part, path)
        return pd.DataFrame({"z": [z], "path": [path]})

    return volume.select("z", "y", "x", "v").groupBy("z").applyInPandas(plane, "z int, path string")
