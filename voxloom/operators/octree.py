"""The adaptive representation: an octree whose leaves are as coarse as an error bound allows.

Particles are rows ``(parts_name, is_leaf, level, z_l, y_l, x_l, v)``; a particle of level l covers a cube of side
2 ** (l_max - l).  Tiles are told apart by the columns in ``by``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("z_l", "y_l", "x_l")


def size_of(l_max: int) -> Column:
    return F.pow(F.lit(2.0), F.lit(l_max) - F.col("level"))


def leaves(voxels: DataFrame, l_max: int, by: list[str] | None = None) -> DataFrame:
    """Every voxel as a particle of the finest level."""
    return voxels.select(*(by or []), F.lit(l_max).alias("level"), *[F.col(a).alias(c) for a, c in zip("zyx", CELL, strict=True)], F.col("v").cast("double").alias("v"))


def encode(voxels: DataFrame, l_max: int, rel_error: float = 0.2, ip_th: float = 108.0, l_min: int = 0, by: list[str] | None = None) -> DataFrame:
    """Leaves ``level, z_l, y_l, x_l, v, lo, hi, n``: complete cubes of eight merge while (max - min) / 2 of all their voxels
    is within rel_error times the local scale, max(mean, ip_th).

    v is the mean, so no voxel is off by more than twice the bound.  One grouped aggregate a level, over fewer and fewer
    rows; nodes that can't merge are final.
    """
    by = by or []
    now = leaves(voxels, l_max, by).withColumns({"lo": F.col("v"), "hi": F.col("v"), "n": F.lit(1).cast("long")})
    done = []
    for level in range(l_max - 1, l_min - 1, -1):
        up = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in CELL]
        part = F.struct("level", *CELL, "v", "lo", "hi", "n")
        full = 8 ** (l_max - level)
        groups = now.groupBy(*by, *[u.alias(f"p{c}") for u, c in zip(up, CELL, strict=True)]).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.collect_list(part).alias("parts"))
        fits = (F.col("n") == full) & ((F.col("hi") - F.col("lo")) / 2 <= rel_error * F.greatest(F.col("v"), F.lit(float(ip_th))))
        merged = groups.where(fits).select(*by, F.lit(level).alias("level"), *[F.col(f"p{c}").alias(c) for c in CELL], "v", "lo", "hi", "n")
        done.append(groups.where(~fits).select(*by, F.inline("parts")))
        now = merged
    return reduce(DataFrame.unionByName, done, now)


def fill_tree(particles: DataFrame, l_max: int, l_min: int = 0, mode: str = "mean", by: list[str] | None = None) -> DataFrame:
    """Interior nodes of every level, as the mean (weighted by volume) or the largest of the leaves below.

    Each leaf is sent to its ancestors at once: one shuffle for all levels.
    """
    by = by or []
    up = particles.where(F.col("level") > l_min).withColumn("_to", F.explode(F.sequence(F.lit(l_min), F.col("level") - 1)))
    shift = F.pow(F.lit(2), F.col("level") - F.col("_to")).cast("int")
    cell = [F.floor(F.col(c) / shift).cast("int").alias(c) for c in CELL]
    weight = F.pow(F.lit(8.0), F.lit(l_max) - F.col("level"))
    value = F.max("v") if mode == "max" else F.sum(F.col("v") * weight) / F.sum(weight)
    return up.groupBy(*by, F.col("_to").alias("level"), *cell).agg(value.alias("v"))


def slice_level(particles: DataFrame, tree: DataFrame, level: int) -> DataFrame:
    """The volume at a resolution: leaves up to the level and tree nodes of it; scans prune by level."""
    cols = [c for c in particles.columns if c in tree.columns]
    return particles.where(F.col("level") <= level).select(cols).unionByName(tree.where(F.col("level") == level).select(cols))


def reconstruct(particles: DataFrame, l_max: int, mode: str = "constant", by: list[str] | None = None) -> DataFrame:
    """Voxels: each takes its leaf's value (constant), its level (level), or the mean of it and its six neighbours'
    values (smooth)."""
    by = by or []
    side = size_of(l_max).cast("int")
    rows = particles.withColumn("_s", side)
    for a, c in zip("zyx", CELL, strict=True):
        rows = rows.withColumn(a, F.explode(F.sequence(F.col(c) * F.col("_s"), F.col(c) * F.col("_s") + F.col("_s") - 1)))
    out = rows.select(*by, "z", "y", "x", (F.col("level").cast("double") if mode == "level" else F.col("v")).alias("v"))
    if mode != "smooth":
        return out
    steps = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    sent = out.select(*by, "z", "y", "x", "v", F.inline(steps))
    keys = [(F.col(a) + F.col(f"d{a}")).alias(a) for a in "zyx"]
    own = (F.col("dz") == 0) & (F.col("dy") == 0) & (F.col("dx") == 0)
    return sent.groupBy(*by, *keys).agg(F.avg("v").alias("v"), F.count_if(own).alias("_own")).where("_own > 0").drop("_own")


def level_histogram(particles: DataFrame, l_max: int, by: list[str] | None = None) -> DataFrame:
    """``level, size, n, share`` of particles by level."""
    by = by or []
    counts = particles.groupBy(*by, "level").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return counts.select(*by, "level", size_of(l_max).cast("int").alias("size"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("share"))


def computational_ratio(tiles: DataFrame, pixels: str = "n_pixels", parts: str = "n_parts") -> DataFrame:
    """Sum of pixels over sum of particles."""
    return tiles.agg((F.sum(pixels) / F.sum(parts)).alias("ratio"))


def find_particles(points: DataFrame, particles: DataFrame, l_max: int, l_min: int = 0, by: list[str] | None = None) -> DataFrame:
    """points ``(.., z, y, x)`` with the coarsest particle that holds each: an equi-join on the cell of every level."""
    by = by or []
    levels = points.withColumn("level", F.explode(F.sequence(F.lit(l_min), F.lit(l_max))))
    s = F.pow(F.lit(2), F.lit(l_max) - F.col("level")).cast("int")
    keyed = levels.withColumns({c: F.floor(F.col(a) / s).cast("int") for a, c in zip("zyx", CELL, strict=True)})
    hit = keyed.join(particles, [*by, "level", *CELL])
    best = F.min_by(F.struct(*[c for c in hit.columns if c not in points.columns]), "level").alias("_p")
    return hit.groupBy(*points.columns).agg(best).select(*points.columns, "_p.*")


def quantize(particles: DataFrame, factor: float = 1.0, background: float = 108.0) -> DataFrame:
    """Values as lossy compression keeps them: square-root steps above the background."""
    above = F.greatest(F.col("v") - background, F.lit(0.0))
    step = F.round(F.sqrt(above) / factor) * factor
    return particles.withColumn("v", F.when(F.col("v") <= background, F.col("v")).otherwise(background + step * step))
