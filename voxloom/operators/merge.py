"""Merging registered tiles into one volume, sparse: only voxels that some tile has are rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import box

DOWNSAMPLES = (1, 2, 4, 8, 16, 32)
AXES = {"z": "ABS_D", "y": "ABS_V", "x": "ABS_H"}


def downsampled(voxels: DataFrame, factor: int, by: list[str] | None = None) -> DataFrame:
    """Means of the voxels that a block has, cut to whole numbers."""
    if factor not in DOWNSAMPLES:
        raise ValueError(f"downsample must be one of {DOWNSAMPLES}")
    if factor == 1:
        return voxels
    keys = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    return voxels.groupBy(*(by or []), *keys).agg(F.floor(F.avg("v")).cast("int").alias("v"))


def placed(voxels: DataFrame, registration: DataFrame, downsample: int = 1) -> DataFrame:
    """Tiles' voxels in the coordinates of the whole: ``z, y, x, v``.  The table of positions has a row a tile."""
    at = registration.select("row", "col", *[F.floor(F.col(c) / downsample).cast("int").alias(f"_{a}") for a, c in AXES.items()])
    return voxels.join(at, ["row", "col"]).select(*[(F.col(a) + F.col(f"_{a}")).cast("int").alias(a) for a in AXES], "v")


def merge_max(voxels: DataFrame, registration: DataFrame, downsample: int = 1) -> DataFrame:
    """The largest value where tiles overlap."""
    small = downsampled(voxels, downsample, ["row", "col"])
    return placed(small, registration, downsample).groupBy("z", "y", "x").agg(F.max("v").alias("v"))


def merge_additive(voxels: DataFrame, registration: DataFrame) -> DataFrame:
    """The sum where tiles overlap, modulo 65536."""
    return placed(voxels, registration).groupBy("z", "y", "x").agg(F.pmod(F.sum("v"), F.lit(65536)).cast("int").alias("v"))


def merge_labels(labels: DataFrame, registration: DataFrame, downsample: int = 1) -> DataFrame:
    """The largest label; downsampling takes the largest of a block as well."""
    small = labels if downsample == 1 else labels.groupBy("row", "col", *[F.floor(F.col(a) / downsample).cast("int").alias(a) for a in AXES]).agg(F.max("v").alias("v"))
    return placed(small, registration, downsample).groupBy("z", "y", "x").agg(F.max("v").alias("v"))


def crop(volume: DataFrame, background: int = 0, **limits: tuple[int | None, int | None]) -> DataFrame:
    """The volume with values outside the limits set to background."""
    return volume.withColumn("v", F.when(box(**limits), F.col("v")).otherwise(F.lit(background)).cast("int"))


def dense(volume: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Every voxel of a box from the origin, 0 where the volume has none."""
    nz, ny, nx = shape
    spark = volume.sparkSession
    every = spark.range(nz * ny * nx).select((F.col("id") / (ny * nx)).cast("int").alias("z"), (F.col("id") / nx % ny).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x"))
    return every.join(volume, ["z", "y", "x"], "left").fillna({"v": 0})


def extent(registration: DataFrame, frame: int, n_planes: int) -> DataFrame:
    """``nx, ny, nz`` of the merged volume."""
    span = lambda c: F.max(c) - F.min(c)
    return registration.agg((span("ABS_H") + frame).cast("int").alias("nx"), (span("ABS_V") + frame).cast("int").alias("ny"), (span("ABS_D") + n_planes).cast("int").alias("nz"))


def reconstruct_slice(voxels: DataFrame, registration: DataFrame, axis: str, loc: int, n_proj: int = 0, downsample: int = 1, colour: bool = False) -> DataFrame:
    """A plane of the stitched volume, or largest values over loc .. loc + n_proj.

    The z location is counted within tiles, those of y and x in the whole; only tiles that reach the plane are read.
    With colour, even and odd tiles ((row + col) mod 2) give ``v0`` and ``v1``.
    """
    rest = [a for a in AXES if a != axis]
    reg = registration.select("row", "col", *[F.col(c).alias(f"_{a}") for a, c in AXES.items()])
    at = F.col(axis) if axis == "z" else F.col(axis) + F.floor(f"_{axis}")
    got = voxels.join(reg, ["row", "col"]).where((at >= loc) & (at <= loc + n_proj))
    keys = [F.floor((F.col(a) + F.col(f"_{a}")) / downsample).cast("int").alias(a) for a in rest]
    if colour:
        odd = F.pmod(F.col("row") + F.col("col"), F.lit(2))
        return got.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(odd == k, F.col("v"))), F.lit(0)).alias(f"v{k}") for k in (0, 1)])
    return got.groupBy(*keys).agg(F.max("v").alias("v"))


def _clahe(image: np.ndarray, tiles: int, clip: float, levels: int) -> np.ndarray:
    """Contrast-limited histogram equalisation: a clipped cumulative histogram for each cell, blended between centres."""
    ny, nx = image.shape
    top = max(int(image.max()), 1)
    binned = (image.astype(np.int64) * (levels - 1)) // top
    ys, xs = np.arange(ny) * tiles // ny, np.arange(nx) * tiles // nx
    cell = ys[:, None] * tiles + xs[None, :]
    hist = np.bincount((cell * levels + binned).ravel(), minlength=tiles * tiles * levels).reshape(-1, levels).astype(float)
    limit = np.maximum(clip * hist.sum(1, keepdims=True) / levels, 1)
    over = np.maximum(hist - limit, 0).sum(1, keepdims=True)
    curve = (np.minimum(hist, limit) + over / levels).cumsum(1)
    curve /= np.maximum(curve[:, -1:], 1)
    fy, fx = (np.arange(ny) + 0.5) * tiles / ny - 0.5, (np.arange(nx) + 0.5) * tiles / nx - 0.5
    y0, x0 = np.clip(np.floor(fy).astype(int), 0, tiles - 1), np.clip(np.floor(fx).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = np.clip(fy - y0, 0, 1)[:, None], np.clip(fx - x0, 0, 1)[None, :]
    look = lambda y, x: curve[y[:, None] * tiles + x[None, :], binned]
    return ((1 - wy) * ((1 - wx) * look(y0, x0) + wx * look(y0, x1)) + wy * ((1 - wx) * look(y1, x0) + wx * look(y1, x1))) * top


def equalize_hist(volume: DataFrame, tiles: int = 8, clip: float = 2.0, levels: int = 256) -> DataFrame:
    """Adaptive histogram equalisation of each z plane; a task holds a plane at a time."""

    def plane(p: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((p.y.max() + 1, p.x.max() + 1))
        image[p.y, p.x] = p.v
        return p.assign(v=_clahe(image, tiles, clip, levels)[p.y, p.x].astype(np.int32))

    return volume.select("z", "y", "x", "v").groupBy("z").applyInPandas(plane, "z int, y int, x int, v int")
