"""Projections, slices and colour projections of sparse voxels ``(z, y, x, v)``; tiles in columns ``by``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import box, contrast, hsv, with_scalars

PLANES = {"zy": ("z", "y"), "zx": ("z", "x"), "yx": ("y", "x")}


def max_projection(voxels: DataFrame, plane: str, by: list[str] | None = None, limits: dict | None = None) -> DataFrame:
    """Largest value along the axis that a plane lacks, within a box."""
    return voxels.where(box(**(limits or {}))).groupBy(*(by or []), *PLANES[plane]).agg(F.max("v").alias("v"))


def all_projections(voxels: DataFrame, by: list[str] | None = None, limits: dict | None = None) -> DataFrame:
    """The three planes at once, ``plane, p, q, v``: one scan and one shuffle."""
    by = by or []
    spread = F.array(*[F.struct(F.lit(k).alias("plane"), F.col(a).alias("p"), F.col(b).alias("q")) for k, (a, b) in PLANES.items()])
    return voxels.where(box(**(limits or {}))).select(*by, "v", F.inline(spread)).groupBy(*by, "plane", "p", "q").agg(F.max("v").alias("v"))


def side_box(side: str, size: int, overlap: int) -> dict:
    """The strip of a tile that a neighbour on this side overlaps."""
    return {"east": {"x": (size - overlap, None)}, "west": {"x": (None, overlap)}, "south": {"y": (size - overlap, None)}, "north": {"y": (None, overlap)}}[side]


def side_projections(voxels: DataFrame, near: DataFrame, size: int, overlap_h: int, overlap_v: int, z_range: tuple | None = None) -> DataFrame:
    """``row, col, side, plane, p, q, v``: projections of the strips that face present neighbours.

    near: ``(row, col, side)`` as :func:`grid.adjacent` gives.  Coordinates are counted from the strip's begin.  z_range
    limits the yx plane only.
    """
    strips = []
    for side in ("east", "west", "south", "north"):
        limits = side_box(side, size, overlap_h if side in ("east", "west") else overlap_v)
        (axis, (begin, _)), = limits.items()
        at = [(F.col(c) - begin if c == axis and begin else F.col(c)).cast("int").alias(f"_{c}") for c in "zyx"]
        strips.append(F.when(box(**limits), F.struct(F.lit(side).alias("side"), *at)))
    rows = voxels.select("row", "col", "v", F.inline(F.array_compact(F.array(*strips)))).withColumnsRenamed({f"_{c}": c for c in "zyx"})  # one scan for all sides
    rows = rows.join(near.select("row", "col", "side"), ["row", "col", "side"], "left_semi")
    out = all_projections(rows, ["row", "col", "side"])
    if z_range:
        out = out.where("plane <> 'yx'").unionByName(max_projection(rows, "yx", ["row", "col", "side"], {"z": z_range}).select("row", "col", "side", F.lit("yx").alias("plane"), F.col("y").alias("p"), F.col("x").alias("q"), "v"))
    return out


def slice_at(voxels: DataFrame, axis: str, loc: int, n_proj: int = 0, by: list[str] | None = None) -> DataFrame:
    """The plane at loc, or the largest values over loc .. loc + n_proj."""
    rest = [a for a in ("z", "y", "x") if a != axis]
    return voxels.where(box(**{axis: (loc, loc + n_proj + 1)})).groupBy(*(by or []), *rest).agg(F.max("v").alias("v"))


def depth_colour(voxels: DataFrame, axis: str = "z", loc: int | None = None, n_proj: int | None = None, threshold: int | None = None) -> DataFrame:
    """Largest value along an axis and where it lies first (``at``)."""
    rest = [a for a in ("z", "y", "x") if a != axis]
    some = voxels if loc is None else voxels.where(box(**{axis: (loc, loc + (n_proj or 0) + 1)}))
    if threshold is not None:
        some = some.where(F.col("v") >= threshold)
    best = F.max(F.struct("v", (-F.col(axis)).alias("n")))
    return some.groupBy(*rest).agg(best.alias("_b")).select(*rest, F.col("_b.v").alias("v"), (-F.col("_b.n")).alias("at"))


def depth_rgb(projection: DataFrame, depth: int, saturation: float = 1.0, top: int = 255) -> DataFrame:
    """A depth projection as colours: hue by depth, value by contrast."""
    limits = projection.agg(F.percentile(F.log(F.col("v") + 200), F.lit(0.01)).alias("_lo"), F.percentile(F.log(F.col("v") + 200), F.lit(0.999)).alias("_hi"))
    got = with_scalars(projection, limits)
    value = contrast(F.col("v"), F.col("_lo"), F.col("_hi"), top) / top
    rgb = hsv(F.col("at") / depth, F.lit(saturation), value)
    return got.select(*[c for c in projection.columns if c not in ("v", "at")], *[F.floor(c * top).cast("int").alias(n) for c, n in zip(rgb, "rgb", strict=True)])


def for_display(image: DataFrame, top: int = 65535, by: list[str] | None = None) -> DataFrame:
    """image with v stretched between the 1 and 99.9 percentiles of log(v + 200)."""
    log = F.log(F.col("v") + 200)
    limits = image.groupBy(*(by or [])).agg(F.percentile(log, F.lit(0.01)).alias("_lo"), F.percentile(log, F.lit(0.999)).alias("_hi"))
    got = image.join(limits, by) if by else with_scalars(image, limits)
    return got.withColumn("v", contrast(F.col("v"), F.col("_lo"), F.col("_hi"), top)).drop("_lo", "_hi")
