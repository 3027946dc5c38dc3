"""The tile grid: offsets, presence, neighbours, serpentine order, and gaps in frame sequences.

Tiles are rows ``(row, col, path, ..)``, keyed by any further columns in ``by`` (acquisition, channel), so that one plan
handles all acquisitions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import snake_col, snake_row, with_scalars

#: Side names in the order in which neighbours are listed, with (row, col) offsets.
SIDES = {"east": (0, 1), "south": (1, 0), "west": (0, -1), "north": (-1, 0)}


def _extent(tiles: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """tiles with aggregates of their group; one row of totals without a key."""
    totals = tiles.groupBy(*by).agg(*aggs)
    return tiles.join(totals, by) if by else with_scalars(tiles, totals)


def normalise_offset(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and columns counted from the least of them."""
    got = _extent(tiles, by or [], F.min("row").alias("_r"), F.min("col").alias("_c"))
    return got.withColumns({"row": (F.col("row") - F.col("_r")).cast("int"), "col": (F.col("col") - F.col("_c")).cast("int")}).drop("_r", "_c")


def unique_tiles(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One tile a cell: the first by path."""
    key = [*(by or []), "row", "col"]
    rest = [c for c in tiles.columns if c not in key]
    return tiles.groupBy(*key).agg(F.min(F.struct("path", *[c for c in rest if c != "path"])).alias("_t")).select(*[F.col(c) if c in key else F.col(f"_t.{c}") for c in tiles.columns])


def nth(tiles: DataFrame, n: int) -> DataFrame:
    """The n-th tile (from 0; from the end if negative) by row and column; no row beyond the last."""
    by = [F.col(c).asc() if n >= 0 else F.col(c).desc() for c in ("row", "col")]
    first = tiles.orderBy(*by).limit(n + 1 if n >= 0 else -n)
    back = [F.col(c).desc() if n >= 0 else F.col(c).asc() for c in ("row", "col")]
    return first.withColumn("_n", F.count("*").over(Window.partitionBy())).where(F.col("_n") == (n + 1 if n >= 0 else -n)).drop("_n").orderBy(*back).limit(1)


def at(tiles: DataFrame, row: int, col: int) -> DataFrame:
    """The tile in a cell; no row where there is none."""
    return tiles.where((F.col("row") == row) & (F.col("col") == col))


def shape(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``nrow, ncol`` of each grid."""
    return tiles.groupBy(*(by or [])).agg((F.max("row") + 1).cast("int").alias("nrow"), (F.max("col") + 1).cast("int").alias("ncol"))


def cells(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every cell of the dense grids."""
    s = shape(tiles, by)
    rows = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("nrow") - 1)))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("ncol") - 1))).select(*(by or []), "row", "col")


def pattern(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``row, col, present (0 or 1), path`` of every cell."""
    key = [*(by or []), "row", "col"]
    return cells(tiles, by).join(tiles.select(*key, "path", F.lit(1).alias("present")), key, "left").select(*key, F.coalesce("present", F.lit(0)).alias("present"), "path")


def adjacent(origins: DataFrame, tiles: DataFrame, sides=("east", "south", "west", "north"), by: list[str] | None = None) -> DataFrame:
    """``row, col, side, side_nr, n_row, n_col, n_path``: present tiles next to each origin."""
    by = by or []
    offsets = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).alias("side_nr"), F.lit(SIDES[s][0]).alias("dr"), F.lit(SIDES[s][1]).alias("dc")) for i, s in enumerate(SIDES) if s in sides])
    wanted = origins.select(*by, "row", "col", F.inline(offsets)).withColumns({"n_row": F.col("row") + F.col("dr"), "n_col": F.col("col") + F.col("dc")})
    there = tiles.select(*by, F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("path").alias("n_path"))
    return wanted.join(there, [*by, "n_row", "n_col"]).select(*by, "row", "col", "side", "side_nr", "n_row", "n_col", "n_path")


def neighbour_map(tiles: DataFrame, sides=("east", "south", "west", "north"), by: list[str] | None = None) -> DataFrame:
    """Present neighbours of every cell, those of absent cells too, as an array in the order of sides."""
    by = by or []
    every = cells(tiles, by)
    found = adjacent(every, tiles, sides, by).groupBy(*by, "row", "col").agg(F.array_sort(F.collect_list(F.struct("side_nr", "n_row", "n_col"))).alias("_n"))
    return every.join(found, [*by, "row", "col"], "left").select(*by, "row", "col", F.coalesce(F.transform("_n", lambda s: F.struct(s["n_row"].alias("row"), s["n_col"].alias("col"))), F.array().cast("array<struct<row:int,col:int>>")).alias("neighbours"))


def edges(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``a, b, side``: east and south edges between present tiles; a vertex is row * ncol + col."""
    by = by or []
    near = adjacent(tiles, tiles, ("east", "south"), by)
    sized = near.join(shape(tiles, by), by) if by else with_scalars(near, shape(tiles))
    return sized.select(*by, (F.col("row") * F.col("ncol") + F.col("col")).cast("int").alias("a"), (F.col("n_row") * F.col("ncol") + F.col("n_col")).cast("int").alias("b"), "side", "row", "col", "n_row", "n_col")


def edge_counts(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``n_edges`` between present tiles, and ``n_edges_dense``, which counts those that start at absent cells as well."""
    by = by or []
    near = adjacent(cells(tiles, by), tiles, ("east", "south"), by)
    here = tiles.select(*by, "row", "col", F.lit(1).alias("_here"))
    return near.join(here, [*by, "row", "col"], "left").groupBy(*by).agg(F.count("_here").alias("n_edges"), F.count("*").alias("n_edges_dense"))


def place_snake(df: DataFrame, n: str, ncol: int) -> DataFrame:
    """df with row and col of the n-th tile (from 1) in serpentine order."""
    return df.withColumns({"row": snake_row(F.col(n), ncol), "col": snake_col(F.col(n), ncol)})


def earlier_neighbours(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Neighbours acquired before a tile in serpentine order: even rows west and north, odd rows north and east."""
    near = adjacent(tiles, tiles, ("west", "north", "east"), by)
    return near.where((F.col("side") == "north") | (F.col("side") == F.when(F.col("row") % 2 == 0, "west").otherwise("east")))


def missing_frames(frames: DataFrame, tile: str = "tile", n: str = "n") -> DataFrame:
    """``tile, after, before, missing``: gaps between a tile's frames."""
    w = Window.partitionBy(tile).orderBy(n)
    gaps = frames.select(tile, n).distinct().withColumn("after", F.lag(n).over(w)).where(F.col(n) - F.col("after") > 1)
    return gaps.select(tile, "after", F.col(n).alias("before"), (F.col(n) - F.col("after") - 1).alias("missing"))


def absent_frames(frames: DataFrame, n_planes: int, tile: str = "tile", n: str = "n") -> DataFrame:
    """Frames 0 .. n_planes - 1 that a tile lacks."""
    want = frames.select(tile).distinct().select(tile, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_planes - 1).cast("long"))).alias(n))
    return want.join(frames.select(tile, F.col(n).cast("long").alias(n)), [tile, n], "left_anti")


def islands(absent: DataFrame, tile: str = "tile", n: str = "n") -> DataFrame:
    """Runs of consecutive absent frames: ``tile, first, last, size``."""
    run = F.col(n) - F.row_number().over(Window.partitionBy(tile).orderBy(n))
    return absent.withColumn("_run", run).groupBy(tile, "_run").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("size")).drop("_run")


def interpolate_frames(frames: DataFrame, value: str, tile: str = "tile", n: str = "n", legacy_weights: bool = False) -> DataFrame:
    """``tile, n, value`` of frames missing between two others: their weighted mean, cut to a whole number.

    The i-th of k missing frames takes i / (k + 1) of the next frame; legacy_weights gives that share to the previous one.
    value may be a number or an array of pixels.  Frames missing at an end are not made.
    """
    w = Window.partitionBy(tile).orderBy(n)  # over numbers alone: pixels come by joins
    gaps = frames.select(tile, n).withColumn("_n", F.lead(n).over(w)).where(F.col("_n") - F.col(n) > 1)
    pairs = gaps.join(frames.select(tile, n, value), [tile, n]).join(frames.select(tile, F.col(n).alias("_n"), F.col(value).alias("_v")), [tile, "_n"])
    made = pairs.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") - F.col(n) - 1)))
    # a column of its own: within a lambda the name n would mean the new frame number
    made, share = made.withColumn("_share", F.col("_i") / (F.col("_n") - F.col(n))), F.col("_share")
    first, second = (share, 1 - share) if legacy_weights else (1 - share, share)
    mean = F.zip_with(value, "_v", lambda a, b: F.floor(a * first + b * second).cast("int")) if "array" in dict(frames.dtypes)[value] else F.floor(F.col(value) * first + F.col("_v") * second).cast("int")
    return made.select(tile, (F.col(n) + F.col("_i")).alias(n), mean.alias(value))
