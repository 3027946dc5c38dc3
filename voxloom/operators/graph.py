"""Global placement: spanning trees of the registration graph and positions along them.

The graph of one acquisition has a vertex a tile, thousands at most; there may be any number of acquisitions.  So trees
and walks are grouped by acquisition and axis, a task holding one graph.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import with_scalars

AXES = ("h", "v", "d")


def by_axis(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``axis, a, b, d, w``: edges ``(a, b, d_*, r_*)`` as rows for each axis, weights of repeated edges added up."""
    spread = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"d_{k}").alias("d"), F.col(f"r_{k}").alias("w")) for k in AXES])
    rows = edges.select(*(by or []), "a", "b", F.inline(spread))
    return rows.groupBy(*(by or []), "axis", "a", "b").agg(F.last("d").alias("d"), F.sum("w").alias("w"))


def spanning_tree(edges: DataFrame, key: list[str]) -> DataFrame:
    """The edges of a minimum spanning forest of each key's graph, ties by (w, a, b); all columns of edges stay."""
    def kruskal(p: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        p = p.sort_values(["w", "a", "b"], kind="stable")
        keep = []
        for a, b in zip(p.a, p.b, strict=True):
            x, y = root(a), root(b)
            keep.append(x != y)
            up[x] = y
        return p[keep]

    return edges.groupBy(*key).applyInPandas(kruskal, edges.schema)


def tree_positions(tree: DataFrame, key: list[str]) -> DataFrame:
    """``key.., vertex, pos, root``: positions along each tree; its smallest vertex is at 0, and an edge a - b with
    displacement d puts the larger vertex at the smaller one's position plus d."""
    def walk(p: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for a, b, d in zip(p.a, p.b, p.d, strict=True):
            near.setdefault(a, []).append((b, d if b > a else -d))
            near.setdefault(b, []).append((a, -d if b > a else d))
        pos: dict[int, tuple[float, int]] = {}
        for start in sorted(near):
            if start in pos:
                continue
            pos[start], todo = (0.0, start), [start]
            while todo:
                v = todo.pop()
                for w, d in near[v]:
                    if w not in pos:
                        pos[w] = (pos[v][0] + d, start)
                        todo.append(w)
        out = pd.DataFrame({"vertex": list(pos), "pos": [x for x, _ in pos.values()], "root": [r for _, r in pos.values()]})
        for k in key:
            out[k] = p[k].iloc[0]
        return out

    kinds = dict(tree.dtypes)
    schema = "vertex int, pos double, root int" + "".join(f", {k} {kinds[k]}" for k in key)
    return tree.select(*key, "a", "b", "d").groupBy(*key).applyInPandas(walk, schema)


def registration_table(tiles: DataFrame, positions: DataFrame, ncol: int) -> DataFrame:
    """``path, row, col, dH, dV, dD, ABS_H, ABS_V, ABS_D`` from positions ``(axis, vertex, pos)`` of one acquisition.

    d*: position less that of the first tile's grid place is left to the caller's edges; ABS_* count from their least.
    Tiles without an edge are at 0.
    """
    wide = positions.groupBy("vertex").pivot("axis", list(AXES)).agg(F.first("pos"))
    got = tiles.select("path", "row", "col", (F.col("row") * ncol + F.col("col")).cast("int").alias("vertex")).join(wide, "vertex", "left").fillna(0.0, list(AXES))
    least = got.agg(*[F.min(k).alias(f"_{k}") for k in AXES])
    got = with_scalars(got, least)
    return got.select("path", "row", "col", *[F.col(k).alias(f"d{k.upper()}") for k in AXES], *[(F.col(k) - F.col(f"_{k}")).alias(f"ABS_{k.upper()}") for k in AXES])


def expected_registration(tiles: DataFrame, step_h: float, step_v: float) -> DataFrame:
    """Positions by the grid alone."""
    zero = F.lit(0.0)
    return tiles.select("path", "row", "col", *[zero.alias(f"d{k}") for k in "HVD"], (F.col("col") * F.lit(float(step_h))).alias("ABS_H"), (F.col("row") * F.lit(float(step_v))).alias("ABS_V"), zero.alias("ABS_D"))


def effective_overlap(registration: DataFrame, frame: int) -> DataFrame:
    """``overlap_h, overlap_v`` in percent: from the median step between the median positions of columns and of rows."""
    def axis(pos: str, index: str, name: str) -> DataFrame:
        middle = registration.groupBy(index).agg(F.percentile(pos, F.lit(0.5)).alias("m"))
        steps = middle.select((F.col("m") - F.lag("m").over(Window.orderBy(index))).alias("s"))  # a row a grid column
        return steps.agg(((frame - F.percentile("s", F.lit(0.5))) / frame * 100).alias(name))

    return with_scalars(axis("ABS_H", "col", "overlap_h"), axis("ABS_V", "row", "overlap_v"))


def vertex_errors(tree: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``vertex, error``: the largest error of the tree edges at a vertex on each axis, averaged over the axes."""
    by = by or []
    ends = tree.select(*by, "axis", "w", F.explode(F.array("a", "b")).alias("vertex"))
    return ends.groupBy(*by, "vertex", "axis").agg(F.max("w").alias("e")).groupBy(*by, "vertex").agg(F.avg("e").alias("error"))


def edge_report(edges: DataFrame) -> DataFrame:
    """Edges with the colour band of their error: good under 0.15, fair under 0.3, else poor."""
    return edges.withColumn("band", F.when(F.col("w") < 0.15, "good").when(F.col("w") < 0.3, "fair").otherwise("poor"))


def overlap_warnings(overlap: DataFrame, expected_h: float, expected_v: float, off: float = 0.2) -> DataFrame:
    """Whether each effective overlap is off the expected one by over a share of it."""
    return overlap.withColumns({f"warn_{k}": F.abs(F.col(f"overlap_{k}") - e) > off * e for k, e in (("h", expected_h), ("v", expected_v))})
