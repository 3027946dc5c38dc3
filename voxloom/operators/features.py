"""Per-voxel features by scattered stencils: each row sends its contributions, one grouped sum gathers them.

Absent neighbours count as 0, and values come back for the rows that were there.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COORDS = ("z", "y", "x")


def stencil(voxels: DataFrame, weights: dict[str, dict[tuple[int, int, int], float]], by: list[str] | None = None, value: str = "v", keep_all: bool = False) -> DataFrame:
    """``z, y, x, value`` and for each name the sum of weight * value at coordinate + offset.

    One shuffle whatever the number of stencils.  keep_all: rows too where only neighbours were.
    """
    by = by or []
    offsets = sorted({o for w in weights.values() for o in w} | {(0, 0, 0)})
    sent = F.array(*[F.struct(*[F.lit(-o[i]).alias(f"_d{a}") for i, a in enumerate(COORDS)], F.lit(o == (0, 0, 0)).alias("_own"), *[F.lit(float(w.get(o, 0.0))).alias(f"_w_{n}") for n, w in weights.items()]) for o in offsets])
    rows = voxels.select(*by, *COORDS, F.col(value).alias("_v"), F.inline(sent))
    keys = [(F.col(a) + F.col(f"_d{a}")).cast("int").alias(a) for a in COORDS]
    sums = [F.sum(F.col("_v") * F.col(f"_w_{n}")).alias(n) for n in weights]
    out = rows.groupBy(*by, *keys).agg(F.max(F.when(F.col("_own"), F.col("_v"))).alias(value), *sums)
    return out if keep_all else out.where(F.col(value).isNotNull())


def _axis(i: int, k: int) -> tuple[int, int, int]:
    return tuple(k if j == i else 0 for j in range(3))


def gradient(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: list[str] | None = None) -> DataFrame:
    """Central differences gz, gy, gx."""
    return stencil(voxels, {f"g{a}": {_axis(i, 1): 0.5 / spacing[i], _axis(i, -1): -0.5 / spacing[i]} for i, a in enumerate(COORDS)}, by)


def gradient_magnitude(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: list[str] | None = None) -> DataFrame:
    g = gradient(voxels, spacing, by)
    return g.withColumn("gradmag", F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in COORDS), F.lit(0.0)))).drop(*[f"g{a}" for a in COORDS])


def laplacian(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: list[str] | None = None) -> DataFrame:
    """The central difference twice along each axis, added up."""
    w: dict[tuple[int, int, int], float] = {(0, 0, 0): 0.0}
    for i in range(3):
        q = 0.25 / spacing[i] ** 2
        w[_axis(i, 2)] = w[_axis(i, -2)] = q
        w[(0, 0, 0)] -= 2 * q
    return stencil(voxels, {"laplacian": w}, by)


def kernel(sigma: float, size: int) -> list[float]:
    """A normalised Gaussian of odd size."""
    r = size // 2
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(voxels: DataFrame, sigma: float = 1.5, size: int = 11, by: list[str] | None = None, name: str = "gauss") -> DataFrame:
    """Blur by three passes of one axis each, as the kernel is separable: 3 * size contributions instead of size ** 3."""
    w, r = kernel(sigma, size), size // 2
    now = voxels.select(*(by or []), *COORDS, F.col("v").cast("double").alias("v"))
    for i in range(3):
        now = stencil(now, {"_s": {_axis(i, k): w[k + r] for k in range(-r, r + 1)}}, by, keep_all=True).drop("v").withColumnRenamed("_s", "v")
    keys = [*(by or []), *COORDS]
    return voxels.join(now.withColumnRenamed("v", name), keys)


def dog(voxels: DataFrame, low: float, high: float, size: int = 11, by: list[str] | None = None) -> DataFrame:
    """Difference of two Gaussians."""
    keys = [*(by or []), *COORDS]
    a, b = gaussian(voxels, low, size, by, "_a"), gaussian(voxels, high, size, by, "_b").drop("v")
    return a.join(b, keys).withColumn("dog", F.col("_a") - F.col("_b")).drop("_a", "_b")


def standard_features(voxels: DataFrame, sigma: float = 1.5, size: int = 5, by: list[str] | None = None) -> DataFrame:
    """value, gauss, gradmag, log (Laplacian of the blurred values) and dog as columns f0 .. f4."""
    keys = [*(by or []), *COORDS]
    g = gaussian(voxels, sigma, size, by)
    blurred = g.select(*keys, F.col("gauss").alias("v"))
    parts = [
        g.select(*keys, F.col("v").cast("double").alias("f0"), F.col("gauss").alias("f1")),
        gradient_magnitude(voxels, by=by).select(*keys, F.col("gradmag").alias("f2")),
        laplacian(blurred, by=by).select(*keys, F.col("laplacian").alias("f3")),
        dog(voxels, sigma, 3 * sigma, size, by).select(*keys, F.col("dog").alias("f4")),
    ]
    return reduce(lambda a, b: a.join(b, keys), parts)
