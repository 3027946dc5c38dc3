"""Cells in an atlas: region lookup, counts, densities, and roll-ups over the tree of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import gaussian

COORDS = ("z", "y", "x")
ATLAS_UM = 25.0
DEPTH = 10


def scales(pixel_um: tuple[float, float, float]) -> dict[str, float]:
    """Pixels per atlas voxel along z, y, x."""
    return {c: ATLAS_UM / p for c, p in zip(COORDS, pixel_um, strict=True)}


def cell_regions(cells: DataFrame, atlas: DataFrame, scale: dict[str, float]) -> DataFrame:
    """cells with the ``id`` of the region that holds each; 0 outside the atlas."""
    at = cells.withColumns({f"_{c}": F.floor(F.col(c) / scale[c]).cast("int") for c in COORDS})
    known = atlas.select(*[F.col(c).alias(f"_{c}") for c in COORDS], "id")
    return at.join(known, [f"_{c}" for c in COORDS], "left").select(*cells.columns, F.coalesce("id", F.lit(0)).cast("long").alias("id"))


def region_at(atlas: DataFrame, z: float, y: float, x: float) -> DataFrame:
    """The region of one point."""
    return atlas.where(" and ".join(f"{c} = {int(v)}" for c, v in zip(COORDS, (z, y, x), strict=True))).select("id")


def region_counts(ids: DataFrame) -> DataFrame:
    """``id, n`` of cells; id 0 is outside."""
    return ids.where("id <> 0").groupBy("id").agg(F.count("*").alias("n"))


def painted_counts(ids: DataFrame, atlas: DataFrame) -> DataFrame:
    """The atlas with each region's number of cells."""
    return atlas.join(region_counts(ids), "id", "left").select(*COORDS, F.coalesce("n", F.lit(0)).alias("n"))


def region_density(ids: DataFrame, atlas: DataFrame) -> DataFrame:
    """``id, n, voxels, density`` of regions with cells."""
    size = atlas.groupBy("id").agg(F.count("*").alias("voxels"))
    return region_counts(ids).join(size, "id").select("id", "n", "voxels", (F.col("n") / F.col("voxels")).alias("density"))


def presence(cells: DataFrame, scale: dict[str, float]) -> DataFrame:
    """Atlas voxels that hold any cell, ``z, y, x, v = 1``."""
    return cells.select(*[F.floor(F.col(c) / scale[c]).cast("int").alias(c) for c in COORDS]).distinct().withColumn("v", F.lit(1))


def presence_density(cells: DataFrame, scale: dict[str, float], sigma: float, size: int | None = None) -> DataFrame:
    """Blurred presence where cells are."""
    return gaussian(presence(cells, scale), sigma, size or 2 * int(3 * sigma) + 1, name="density").select(*COORDS, "density")


def with_paths(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """Regions ``(id, parent_id, ..)`` with ``path``: ids from the region itself up to its root.

    A tree of regions is small; each step joins all regions to their next ancestor, until none has one.  depth: steps of
    one plan, after which the table is checkpointed if there are ancestors left.
    """
    up = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"))
    now = nodes.withColumns({"path": F.array("id"), "_at": F.col("parent_id")})
    while True:
        for _ in range(max(depth, 1)):
            now = now.join(up, now._at == up._id, "left").withColumn("path", F.when(F.col("_id").isNotNull(), F.concat("path", F.array("_id"))).otherwise(F.col("path")))
            now = now.withColumn("_at", F.col("_up")).drop("_id", "_up")
        left = now.join(up, now._at == up._id, "left_semi")
        if left.isEmpty():
            return now.drop("_at")
        if not left.where(F.array_contains("path", F.col("_at"))).isEmpty():
            raise ValueError("a region is its own ancestor")
        now = now.checkpoint()


def climbed(path: Column, n: int) -> Column:
    """The ancestor that a label counts for when climbing n levels, counted from a depth of ``DEPTH``."""
    size, start = F.size(path), DEPTH - F.size(path)
    return (
        F.when((F.lit(n) <= start) | (size == 1), F.get(path, F.lit(0)))
        .when(size > n - start + 1, F.get(path, F.lit(n) - start))
        .otherwise(F.get(path, size - 2))
    )


def ontology_counts(ids: DataFrame, ontology: DataFrame, n: int = 0) -> DataFrame:
    """``name, n``: cells by the area they count for; ids that the tree lacks are ``unknown``."""
    areas = ontology.select("id", climbed(F.col("path"), n).alias("_area"))
    names = ontology.select(F.col("id").alias("_area"), F.col("name"))
    counted = ids.groupBy("id").agg(F.count("*").alias("n"))  # before the joins: a row a region
    return counted.join(areas, "id", "left").join(names, "_area", "left").groupBy(F.coalesce("name", F.lit("unknown")).alias("name")).agg(F.sum("n").alias("n"))


def descendants(ontology: DataFrame, acronyms: list[str]) -> DataFrame:
    """``acronym, id``: each structure with all below it."""
    roots = ontology.where(F.col("acronym").isin(acronyms)).select("acronym", F.col("id").alias("_root"))
    below = ontology.select("id", F.explode("path").alias("_root"))
    return below.join(roots, "_root").select("acronym", "id")


def counts_by_acronym(ids: DataFrame, ontology: DataFrame, acronyms: list[str]) -> DataFrame:
    """``acronym, n``: cells in a structure and all below it."""
    counted = ids.groupBy("id").agg(F.count("*").alias("n"))
    return descendants(ontology, acronyms).join(counted, "id", "left").groupBy("acronym").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def area_mask(atlas: DataFrame, ontology: DataFrame, acronyms: list[str]) -> DataFrame:
    """The atlas with ``inside``: whether a voxel belongs to any of the structures or below."""
    ids = descendants(ontology, acronyms).select("id", F.lit(True).alias("_in")).dropDuplicates(["id"])
    return atlas.join(ids, "id", "left").select(*COORDS, F.coalesce("_in", F.lit(False)).alias("inside"))
