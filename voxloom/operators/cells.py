"""Objects of overlapping tiles: de-duplication by nearest neighbours, and merging tile by tile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .morphology import durable

COORDS = ("z", "y", "x")
#: Grids are made finer until a point shares its grid cell with about so many of its tile, or this often.
FEW, DEEPEST = 4, 40


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def matches(first: DataFrame, second: DataFrame, lowe_ratio: float = 0.7, distance_max: float = 5.0) -> DataFrame:
    """``id1, id2, distance``: the nearest second of each first nearer than distance_max, if nearer than lowe_ratio times
    the second nearest.

    A second nearest that matters lies within distance_max / lowe_ratio, so both come from an equi-join on cells of that
    side and their neighbours: no pair beyond that is made.
    """
    if not 0 <= lowe_ratio <= 1:
        raise ValueError("lowe_ratio must be within 0 and 1")
    side = distance_max / max(lowe_ratio, 1e-3)
    shifts = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = first.select(F.col("cell_id").alias("id1"), *[F.col(c).alias(f"{c}1") for c in COORDS], *[_cell(c, side).alias(f"_{c}") for c in COORDS])
    b = second.select(F.col("cell_id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in COORDS], *[_cell(c, side).alias(f"_{c}") for c in COORDS])
    for c in COORDS:
        b = b.withColumn("_s", F.explode(shifts)).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_s")).drop("_s")
    d = F.sqrt(reduce(lambda x, y: x + y, [(F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in COORDS]))
    near = a.join(b, [f"_{c}" for c in COORDS]).select("id1", "id2", d.alias("distance")).where(F.col("distance") < side)
    w = Window.partitionBy("id1").orderBy("distance", "id2")
    two = near.withColumns({"_r": F.row_number().over(w), "_next": F.lead("distance").over(w)}).where("_r = 1")
    return two.where((F.col("distance") < distance_max) & (F.col("_next").isNull() | (F.col("distance") < lowe_ratio * F.col("_next")))).select("id1", "id2", "distance")


def deduplicate(first: DataFrame, second: DataFrame, lowe_ratio: float = 0.7, distance_max: float = 5.0) -> DataFrame:
    """All of first and those of second that no first matches."""
    found = matches(first, second, lowe_ratio, distance_max).select(F.col("id2").alias("cell_id")).distinct()
    return first.unionByName(second.join(found, "cell_id", "left_anti"))


def in_box(cells: DataFrame, low: dict[str, float], high: dict[str, float]) -> Column:
    """Whether a cell lies within the box."""
    out = F.lit(True)
    for c in COORDS:
        out &= (F.col(c) >= low[c]) & (F.col(c) <= high[c])
    return out


def to_global(cells: DataFrame, registration: DataFrame) -> DataFrame:
    """Cells ``(row, col, cell_id, z, y, x)`` of tiles in the coordinates of the whole."""
    at = registration.select("row", "col", F.col("ABS_D").alias("_z"), F.col("ABS_V").alias("_y"), F.col("ABS_H").alias("_x"))
    return cells.join(at, ["row", "col"]).withColumns({c: F.col(c) + F.col(f"_{c}") for c in COORDS}).drop("_z", "_y", "_x")


def _apart(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """The distance of the points in columns a and b."""
    return F.sqrt(reduce(lambda x, y: x + y, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b, strict=True)]))


def _around(rows: DataFrame, radius: Column, side: Column) -> DataFrame:
    """Each row once for each grid cell ``_z, _y, _x`` of a side that reaches into the ball around its point ``z1, y1, x1``:
    at most eight where the side is twice the radius."""
    out = rows.withColumns({"_radius": radius, "_side": side})
    gap = []
    for c in COORDS:
        at = F.col(f"{c}1")
        out = out.withColumn(f"_{c}", F.explode(F.sequence(F.floor((at - F.col("_radius")) / F.col("_side")), F.floor((at + F.col("_radius")) / F.col("_side")))))
        low = F.col(f"_{c}") * F.col("_side")
        gap.append(F.greatest(low - at, at - low - F.col("_side"), F.lit(0.0)))
    # the cells' limits are rounded: a little more than the radius
    near = reduce(lambda x, y: x + y, [g * g for g in gap]) <= F.col("_radius") * F.col("_radius") * 1.0001 + 1e-9
    return out.where(near).drop("_radius", "_side")


def _finest(points: DataFrame, side: float) -> int:
    """How often the side of the grid is halved until a point finds a few of its tile in its grid cell."""
    for level in range(DEEPEST):
        per_cell = points.groupBy("t", *[_cell(c, 2 * side / 2**level) for c in COORDS]).count()
        seen = per_cell.agg((F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).alias("s")).first().s
        if seen is None or seen <= FEW:
            return level
    return DEEPEST


def tile_matches(cells: DataFrame, lowe_ratio: float = 0.7, distance_max: float = 5.0, boxes: DataFrame | None = None) -> DataFrame:
    """``id1, id2``: a cell and the one of a later tile that it matches, for every pair of tiles at once.

    Nearest and second nearest are sought among the later tile's cells.  boxes ``(row, col, z0, z1, y0, y1, x0, x1)``:
    extents of the tiles; only cells within the later tile's extent are compared then.

    The nearest is sought within a small radius first, then within twice that by those that found none, up to
    distance_max: however many cells lie within distance_max, most are compared with few.  It is a match if it is the
    only one within its distance / lowe_ratio, so a second search counts those.  Both searches are equi-joins on grid
    cells of twice the radius, and what comes of the pairs is added up where they are made: pairs are never shuffled.
    Cells of a tile at one place are one point.
    """
    side = distance_max / max(lowe_ratio, 1e-3)
    here, there = tuple(f"{c}1" for c in COORDS), tuple(f"{c}2" for c in COORDS)
    grid = [f"_{c}" for c in COORDS]
    finite = reduce(lambda x, y: x & y, [F.abs(c) < F.lit(float("inf")) for c in COORDS])
    points = durable(cells.where(finite).groupBy(F.struct("row", "col").alias("t"), *COORDS).agg(F.min("cell_id").alias("id"), F.count("*").alias("n")))
    level = _finest(points, side)
    a = points.select(F.col("id").alias("id1"), F.col("t").alias("t1"), *[F.col(c).alias(f"{c}1") for c in COORDS])
    b = points.select(F.col("id").alias("id2"), "n", F.col("t").alias("t2"), *[F.col(c).alias(f"{c}2") for c in COORDS])
    if boxes is not None:
        limits = boxes.select(F.struct("row", "col").alias("t2"), F.struct(*[F.col(f"{c}{k}").alias(f"_{c}{k}") for c in COORDS for k in (0, 1)]).alias("box"))
        inside = lambda k: reduce(lambda x, y: x & y, [(F.col(f"{c}{k}") >= F.col(f"box._{c}0")) & (F.col(f"{c}{k}") <= F.col(f"box._{c}1")) for c in COORDS])
        b = b.join(limits, "t2").where(inside(2)).drop("box")
    # each point with the later tiles that have points around: settled by coarse grid cells
    coarse = {f"_{c}": F.floor(F.col(f"{c}1") / (2 * side)) for c in COORDS}
    reach = b.select("t2", *[F.floor(F.col(f"{c}2") / (2 * side)).alias(f"_{c}") for c in COORDS]).distinct()
    for c in COORDS:
        reach = reach.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + k for k in (-1, 0, 1)])))
    left = a.withColumns(coarse).join(reach.distinct(), grid).where(F.col("t1") < F.col("t2")).drop(*grid)
    if boxes is not None:
        left = left.join(limits, "t2").where(inside(1)).drop("box")
    left = durable(left)
    key = ["id1", "t1", "t2", *here]
    found = None
    for k in range(level, -1, -1):
        radius = min(distance_max, side / 2**k)
        grained = b.withColumns({f"_{c}": F.floor(F.col(f"{c}2") / (2 * radius)) for c in COORDS})
        pairs = _around(left, F.lit(radius), F.lit(2.0 * radius)).join(grained, ["t2", *grid]).withColumn("d", _apart(here, there))
        nearest = durable(pairs.where(F.col("d") < radius).groupBy(*key).agg(F.min("d").alias("nearest")))
        found = nearest if found is None else found.unionByName(nearest)
        if radius >= distance_max:
            break
        left = durable(left.join(nearest.select("id1", "t1", "t2"), ["id1", "t1", "t2"], "left_anti"))
    # all that are no farther than the nearest's distance / lowe_ratio, on the finest grid for that radius
    radius = F.least(F.col("nearest") * (1.0001 / lowe_ratio), F.lit(float(side))) if lowe_ratio else F.lit(float(side))
    grain = F.greatest(F.lit(0), F.least(F.lit(level), F.floor(F.log2(F.lit(float(side)) / F.greatest(radius, F.lit(side / 2.0**level)))))).cast("int")
    sides = F.lit(2.0 * side) / F.pow(F.lit(2.0), F.col("_level"))
    asked = _around(found.withColumn("_level", grain), radius, sides)
    levels = b.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(level + 1)])))
    grained = levels.withColumns({f"_{c}": F.floor(F.col(f"{c}2") / sides) for c in COORDS})
    pairs = asked.join(grained, ["_level", "t2", *grid]).withColumn("d", _apart(here, there))
    pairs = pairs.where((F.col("d") < side) & ~(F.col("nearest") < lowe_ratio * F.col("d")))
    alone = pairs.groupBy(*key).agg(F.sum("n").alias("n"), F.min("id2").alias("id2")).where("n = 1")
    at = cells.select(F.col("cell_id").alias("id"), F.struct("row", "col").alias("t1"), *[F.col(c).alias(f"{c}1") for c in COORDS])
    return alone.select("t1", *here, "id2").join(at, ["t1", *here]).select(F.col("id").alias("id1"), "id2").distinct()


def merge_tiles(cells: DataFrame, lowe_ratio: float = 0.7, distance_max: float = 5.0, boxes: DataFrame | None = None) -> DataFrame:
    """Cells ``(row, col, cell_id, z, y, x)`` of all tiles, in whole coordinates, taken in tile by tile, row by row: a cell
    stays out if a cell that is in already matches it.

    What matches what doesn't depend on what is in, so all matches come from one join.  Then rounds over the matches
    alone settle who is in: a cell that nothing unsettled matches is in, and what it matches is out.  There are as many
    rounds as the longest chain of matches is long; each settles at least the earliest tile that is left.  Tiles with
    few cells are treated like all others.
    """
    left = durable(tile_matches(cells, lowe_ratio, distance_max, boxes))
    out = None
    while not left.isEmpty():
        targets = left.select(F.col("id2").alias("id1")).distinct()
        gone = durable(left.join(targets, "id1", "left_anti").select(F.col("id2").alias("cell_id")).distinct())
        out = gone if out is None else durable(out.unionByName(gone))
        # matches of cells that are out count no more, and what is out needs no others
        left = durable(left.join(gone.withColumnRenamed("cell_id", "id2"), "id2", "left_anti").join(gone.withColumnRenamed("cell_id", "id1"), "id1", "left_anti").select("id1", "id2"))
    return cells if out is None else cells.join(out, "cell_id", "left_anti")
