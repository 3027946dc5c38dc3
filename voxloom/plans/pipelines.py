"""Whole pipelines: stitching, multi-channel acquisitions, segmentation over tiles, atlas reports, display manifests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import with_scalars
from ..operators import atlas, cells, graph, grid, merge, morphology, octree, project, register, segment
from ..sources import acquisition, sinks
from ..streaming import live


@dataclass(frozen=True)
class StitchOptions:
    """Overlaps in percent of the frame; bounds of shifts in pixels."""

    frame: int
    overlap_h: float
    overlap_v: float
    margin: float = 20.0
    reg_h: float | None = None
    reg_v: float | None = None
    reg_d: float = 20.0
    z_range: tuple[int, int] | None = None
    mask_percentile: float | None = None
    kernel: Callable = register.default_kernel

    def with_margin(self, margin: float) -> StitchOptions:
        if not 1 <= margin <= 45:
            raise ValueError("margin must be within 1 and 45")
        return replace(self, margin=margin)

    @property
    def expected(self) -> tuple[int, int]:
        return int(self.overlap_h / 100 * self.frame), int(self.overlap_v / 100 * self.frame)

    @property
    def searched(self) -> tuple[int, int]:
        h, v = self.expected
        return int(h * (1 + self.margin / 100)), int(v * (1 + self.margin / 100))


    @property
    def used_kernel(self) -> Callable:
        return register.masked_kernel(self.mask_percentile, self.kernel) if self.mask_percentile else self.kernel


@dataclass
class Stitched:
    edges: DataFrame
    tree: DataFrame
    registration: DataFrame


def projections(voxels: DataFrame, tiles: DataFrame, o: StitchOptions) -> DataFrame:
    return project.side_projections(voxels, grid.adjacent(tiles, tiles), o.frame, *o.searched, o.z_range)


def stitch(projected: DataFrame, tiles: DataFrame, o: StitchOptions) -> Stitched:
    """Shifts of neighbouring tiles from their projections (fresh or saved), regularised, and positions along the trees."""
    pairs = grid.edges(tiles)
    return placed(register.pair_shifts(register.plane_shifts(projected, pairs, o.used_kernel)), tiles, o, grid.shape(tiles).first().ncol)


def placed(pairs: DataFrame, tiles: DataFrame, o: StitchOptions, ncol: int) -> Stitched:
    """Positions from the shifts of strips."""
    shifts = register.strip_offsets(pairs, o.frame, *o.searched)
    eh, ev = o.expected
    want = {"east": (o.frame - eh, 0.0), "south": (0.0, o.frame - ev)}
    bound = 0.05 * o.frame
    edges = morphology.durable(register.regularize(shifts, bound if o.reg_h is None else o.reg_h, bound if o.reg_v is None else o.reg_v, o.reg_d, want))
    tree = graph.spanning_tree(graph.by_axis(edges), ["axis"])
    table = graph.registration_table(tiles, graph.tree_positions(tree, ["axis"]), ncol)
    return Stitched(edges, tree, table)


class LiveStitch:
    """Tiles of an acquisition that are converted, projected and registered as they complete; positions at any time.

    Everything is a table in folder, a batch a partition: a batch run again replaces what it has written, and a restart
    goes on from the tiles done.  load gives the voxels ``(channel, row, col, z, y, x, v)`` of tiles ``(tile, channel, row,
    col)``; without it, files named by pattern (with ``{tile}`` and ``{channel}``) are decoded.
    """

    def __init__(self, folder: str, options: StitchOptions, ncol: int, n_planes: int, l_max: int, load: Callable[[DataFrame], DataFrame] | None = None, pattern: str = "", ftype: str = "tiff", channel: int = 0, rel_error: float = 0.2, ip_th: float = 108.0):
        self.folder, self.options, self.ncol, self.l_max, self.channel, self.rel_error, self.ip_th = folder, options, ncol, l_max, channel, rel_error, ip_th
        self.load = load or (lambda tiles: self._decoded(tiles, pattern, ftype))
        self.live = live.LivePipeline(f"{folder}/done", ncol, n_planes, self._convert, self._register)

    def _decoded(self, tiles: DataFrame, pattern: str, ftype: str) -> DataFrame:
        named = F.replace(F.replace(F.lit(pattern), F.lit("{tile}"), F.col("tile").cast("string")), F.lit("{channel}"), F.col("channel").cast("string"))
        at = tiles.withColumn("path", named)
        channels = [r[0] for r in at.select("channel").distinct().collect()]  # a few
        parts = [acquisition.scan_voxels(at.where(F.col("channel") == c), ftype, self.options.frame).withColumn("channel", F.lit(c)) for c in channels]
        return reduce(DataFrame.unionByName, parts)

    def _save(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={self.live.batch}")

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").drop("batch")

    def _convert(self, tiles: DataFrame) -> None:
        if tiles.isEmpty():
            return
        by = ["channel", "row", "col"]
        voxels = self.load(tiles)
        self._save(octree.encode(voxels, self.l_max, self.rel_error, self.ip_th, by=by).select(*by, "level", *octree.CELL, "v"), "particles")
        mine = voxels.where(F.col("channel") == self.channel)
        sides = F.explode(F.array(*[F.lit(x) for x in ("east", "south", "west", "north")]))
        near = tiles.where(F.col("channel") == self.channel).select("row", "col", sides.alias("side"))
        self._save(project.side_projections(mine, near, self.options.frame, *self.options.searched, self.options.z_range), "projections")

    def _register(self, edges: DataFrame) -> None:
        """edges: a new tile and a neighbour that is there, seen from the new one."""
        flip = F.col("side").isin("west", "north")
        turned = F.when(F.col("side") == "west", "east").when(F.col("side") == "north", "south").otherwise(F.col("side"))
        ends = [F.when(flip, F.col(f"n_{c}")).otherwise(F.col(c)).cast("int").alias(c) for c in ("row", "col")] + [F.when(flip, F.col(c)).otherwise(F.col(f"n_{c}")).cast("int").alias(f"n_{c}") for c in ("row", "col")]
        some = edges.where(F.col("channel") == self.channel).select(*ends, turned.alias("side")).distinct()
        number = lambda r, c: (F.col(r) * self.ncol + F.col(c)).cast("int")
        some = some.withColumns({"a": number("row", "col"), "b": number("n_row", "n_col")})
        if not some.isEmpty():
            self._save(register.plane_shifts(self._read(some.sparkSession, "projections"), some, self.options.used_kernel), "shifts")

    def start(self, frames: DataFrame, checkpoint: str):
        return self.live.start(frames, checkpoint)

    def stitched(self, spark: SparkSession) -> Stitched:
        """Positions from all that has been registered so far."""
        tiles = self.live.done(spark).where(F.col("channel") == self.channel).withColumn("path", F.col("tile").cast("string"))
        return placed(register.pair_shifts(self._read(spark, "shifts")), tiles, self.options, self.ncol)

    def particles(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "particles")


@dataclass
class MultiChannel:
    """An acquisition of several channels: tiles ``(channel, row, col, path)`` and voxels with a channel column."""

    tiles: DataFrame
    voxels: DataFrame
    options: StitchOptions
    registrations: dict[int, DataFrame] = field(default_factory=dict)

    def channel(self, c: int) -> tuple[DataFrame, DataFrame]:
        return self.tiles.where(F.col("channel") == c).drop("channel"), self.voxels.where(F.col("channel") == c).drop("channel")

    def convert(self, path: str, l_max: int, existing: DataFrame | None = None, force: bool = False, rel_error: float = 0.2, ip_th: float | None = None, tree_mode: str = "mean", lazy: bool = True) -> DataFrame:
        """Particles of tiles that have none yet, written by set and level; returns the tiles converted."""
        todo = sinks.pending(self.tiles, existing, ["channel", "row", "col"], force) if existing is not None else self.tiles
        by = ["channel", "row", "col"]
        some = self.voxels.join(todo.select(*by), by, "left_semi")
        threshold = ip_th if ip_th is not None else float(acquisition.darkest_corner(some).first().ip_th or 0)
        leaves = octree.encode(some, l_max, rel_error, threshold, by=by).select(*by, F.lit(True).alias("is_leaf"), "level", *octree.CELL, "v")
        out = leaves
        if lazy:
            out = leaves.unionByName(octree.fill_tree(leaves, l_max, mode=tree_mode, by=by).withColumn("is_leaf", F.lit(False)))
        sinks.write_particles(out.withColumn("parts_name", F.lit("particles")), path)
        return todo

    def stitch(self, c: int, middle: int | None = 100) -> DataFrame:
        """Positions from one channel; middle: the yx projection takes that many planes around the middle one."""
        tiles, voxels = self.channel(c)
        o = self.options
        if middle and o.z_range is None:
            depth = voxels.agg(F.max("z") + 1).first()[0]
            o = replace(o, z_range=(max(0, (depth - middle) // 2), (depth + middle) // 2))
        self.registrations[c] = stitch(projections(voxels, tiles, o), tiles, o).registration
        return self.registrations[c]

    def align(self, reference: int, moving: int, limits: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
        """Positions of another channel: those of the reference with each tile's own shift added.

        limits: begin and end of axes, within which the channels are compared.
        """
        whole = lambda c: project.all_projections(self.channel(c)[1], ["row", "col"], limits)
        shifts = register.channel_shifts(whole(reference), whole(moving), self.options.kernel)
        self.registrations[moving] = register.update_registration(self.registrations[reference], shifts)
        return self.registrations[moving]

    def reconstruct(self, downsample: int = 16) -> DataFrame:
        """All channels' merged volumes at once, with the positions of the first channel that was stitched."""
        table = next(iter(self.registrations.values()))
        small = merge.downsampled(self.voxels, downsample, ["channel", "row", "col"])
        at = table.select("row", "col", *[F.floor(F.col(c) / downsample).cast("int").alias(f"_{a}") for a, c in merge.AXES.items()])
        placed = small.join(at, ["row", "col"])
        return placed.groupBy("channel", *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in "zyx"]).agg(F.max("v").alias("v"))


def segment_tiles(voxels: DataFrame, registration: DataFrame, model: PipelineModel, features: Callable[[DataFrame], DataFrame], shape: tuple[int, int, int], object_class: int = 1, least: int = 1, lowe_ratio: float = 0.7, distance_max: float = 5.0) -> DataFrame:
    """Cells ``(row, col, cell_id, z, y, x)`` of all tiles in whole coordinates: classify, label, drop objects at the
    sides (not at first and last planes), take centres, and remove what an earlier tile has."""
    by = ["row", "col"]
    mask = segment.predict(features(voxels), model).where(F.col("prediction") == object_class)
    labels = morphology.connected_components(mask.select(*by, "z", "y", "x"), by)
    inside = morphology.without_edge_objects(morphology.size_filter(labels, least, by=by), shape, z_edges=False, by=by)
    found = morphology.centers(inside, by).withColumn("cell_id", F.xxhash64("row", "col", "label")).drop("label")
    return cells.merge_tiles(cells.to_global(found, registration), lowe_ratio, distance_max)


def atlas_report(found: DataFrame, regions: DataFrame, ontology: DataFrame, pixel_um: tuple[float, float, float], level: int = 0) -> dict[str, DataFrame]:
    """Cells with their region, counts and densities by region, and counts by area."""
    ids = atlas.cell_regions(found, regions, atlas.scales(pixel_um))
    return {"cells": ids, "density": atlas.region_density(ids, regions), "areas": atlas.ontology_counts(ids, ontology, level)}


def layers(tiles: DataFrame, registration: DataFrame, limits: DataFrame | None = None, downsample: int = 1) -> DataFrame:
    """What a viewer needs to show tiles: position, colour of the checkerboard, contrast limits ``(row, col, low, high)``."""
    got = tiles.select("row", "col", "path").join(registration.drop("path"), ["row", "col"])
    got = got.select("row", "col", "path", *[(F.col(c) / downsample).alias(f"at_{a}") for a, c in merge.AXES.items()], F.when((F.col("row") + F.col("col")) % 2 == 0, "red").otherwise("green").alias("colour"))
    return got.join(limits, ["row", "col"], "left") if limits is not None else got


def compare_stitching(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two slices ``(.., v)`` side by side with their difference."""
    keys = [c for c in first.columns if c != "v"]
    both = first.withColumnRenamed("v", "v1").join(second.withColumnRenamed("v", "v2"), keys, "full").fillna(0, ["v1", "v2"])
    return both.withColumn("diff", F.col("v1") - F.col("v2"))


def stitching_info(tree: DataFrame, registration: DataFrame, frame: int, ncol: int) -> DataFrame:
    """``row, col, error`` of each tile with the effective overlaps of the whole."""
    errors = graph.vertex_errors(tree).select(F.floor(F.col("vertex") / ncol).cast("int").alias("row"), F.pmod("vertex", F.lit(ncol)).cast("int").alias("col"), "error")
    return with_scalars(errors, graph.effective_overlap(registration, frame))
