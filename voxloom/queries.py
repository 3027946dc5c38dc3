"""Every imaging query by name: the engine's operators over views of the driver's tables, with equivalent SQL.

The views: a voxel volume from line items, a tile grid from nations, cells from embeddings, frames from events, and a
tree of regions from region, nation and customer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import snake_col, snake_row, with_scalars
from .operators import atlas, cells, features, graph, grid, merge, morphology, octree, project, register, segment
from .plans import pipelines
from .sources import acquisition, sinks
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "vox": "SELECT CAST(l_linenumber % 8 AS INTEGER) AS z, CAST(l_suppkey % 32 AS INTEGER) AS y, CAST(l_partkey % 32 AS INTEGER) AS x, CAST(sum(l_quantity) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3",
    "fg": "SELECT z, y, x, v FROM vox WHERE v > (SELECT quantile_cont(v, 0.85) FROM vox)",
    "grid": "SELECT CAST(n_nationkey // 5 AS INTEGER) AS row, CAST(n_nationkey % 5 AS INTEGER) AS col, n_name AS path FROM nation WHERE n_nationkey % 7 <> 3",
    "cell": "SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) * 100 AS z, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS x FROM embeddings",
    "edge": "SELECT r1.row * 5 + r1.col AS a, r2.row * 5 + r2.col AS b, CASE WHEN r2.col > r1.col THEN 'east' ELSE 'south' END AS side FROM grid r1 JOIN grid r2 ON (r2.row = r1.row AND r2.col = r1.col + 1) OR (r2.col = r1.col AND r2.row = r1.row + 1)",
    "wedge": "SELECT a, b, CAST((a * 37 + b * 101) % 997 AS DOUBLE) AS w, CAST((a * 13 + b * 7) % 50 AS DOUBLE) AS d FROM edge",
    "tvox": "SELECT CAST(l_orderkey % 2 AS INTEGER) AS row, CAST(l_orderkey % 3 AS INTEGER) AS col, CAST(l_linenumber % 4 AS INTEGER) AS z, CAST(l_suppkey % 16 AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS x, CAST(max(l_quantity) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3, 4, 5",
    "reg": "SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(c * 12 AS DOUBLE) AS abs_h, CAST(r * 12 AS DOUBLE) AS abs_v, CAST((r + c) % 2 AS DOUBLE) AS abs_d FROM range(2) a(r), range(3) b(c)",
    "frame": "SELECT DISTINCT user_id AS tile, event_id % 80 AS n FROM events",
    "node": "SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS acronym UNION ALL SELECT 1 + r_regionkey, 0, r_name FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, c_name FROM customer",
    "tree": "SELECT id, acronym, id AS anc, 0 AS up FROM node UNION ALL SELECT t.id, t.acronym, n.parent_id, t.up + 1 FROM tree t JOIN node n ON t.anc = n.id WHERE n.parent_id IS NOT NULL",
    "oid": "SELECT CASE WHEN o_orderkey % 97 = 0 THEN 7 ELSE 1000 + o_custkey END AS id FROM orders",
    "atl": "SELECT CAST(p_size % 5 AS INTEGER) AS z, CAST(p_partkey % 20 AS INTEGER) AS y, CAST(p_partkey // 20 % 20 AS INTEGER) AS x, CAST(min(p_size) AS BIGINT) AS id FROM part GROUP BY 1, 2, 3",
    "acell": "SELECT l_orderkey * 8 + l_linenumber AS cell_id, CAST(l_linenumber * 1.3 AS DOUBLE) AS z, CAST(l_suppkey % 97 AS DOUBLE) / 2 AS y, CAST(l_partkey % 89 AS DOUBLE) / 2 AS x FROM lineitem",
}
NEEDS = {"fg": ["vox"], "edge": ["grid"], "wedge": ["edge"], "tree": ["node"]}


def sql(text: str, *views: str) -> str:
    order: list[str] = []

    def need(v: str) -> None:
        for w in NEEDS.get(v, ()):
            need(w)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    return f"WITH RECURSIVE {', '.join(f'{v} AS ({VIEWS[v]})' for v in order)} {text}" if order else text


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add


# the views in Spark


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def vox(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy((F.col("l_linenumber") % 8).cast("int").alias("z"), (F.col("l_suppkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x")).agg(F.sum("l_quantity").cast("int").alias("v"))


def fg(s: SparkSession, d: str) -> DataFrame:
    v = vox(s, d)
    return with_scalars(v, v.agg(F.percentile("v", F.lit(0.85)).alias("_p"))).where("v > _p").drop("_p")


def tiles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(s, d, "nation").where(k % 7 != 3).select(F.floor(k / 5).cast("int").alias("row"), (k % 5).cast("int").alias("col"), F.col("n_name").alias("path"))


def cell(s: SparkSession, d: str, odd: int | None = None) -> DataFrame:
    e = table(s, d, "embeddings")
    e = e if odd is None else e.where(F.col("vec_id") % 2 == odd)
    return e.select(F.col("vec_id").alias("cell_id"), *[(F.col("embedding")[i].cast("double") * 100).alias(c) for i, c in enumerate("zyx")])


def wedges(s: SparkSession, d: str) -> DataFrame:
    e = grid.edges(tiles(s, d))
    return e.select("a", "b", ((F.col("a") * 37 + F.col("b") * 101) % 997).cast("double").alias("w"), ((F.col("a") * 13 + F.col("b") * 7) % 50).cast("double").alias("d"))


def tvox(s: SparkSession, d: str) -> DataFrame:
    c = lambda n, k, a: (F.col(n) % k).cast("int").alias(a)
    return table(s, d, "lineitem").groupBy(c("l_orderkey", 2, "row"), c("l_orderkey", 3, "col"), c("l_linenumber", 4, "z"), c("l_suppkey", 16, "y"), c("l_partkey", 16, "x")).agg(F.max("l_quantity").cast("int").alias("v"))


def reg(s: SparkSession, d: str) -> DataFrame:
    r = s.range(6).select(F.floor(F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"))
    zero = F.lit(0.0)
    return r.select(F.lit("").alias("path"), "row", "col", zero.alias("dH"), zero.alias("dV"), zero.alias("dD"), (F.col("col") * 12.0).alias("ABS_H"), (F.col("row") * 12.0).alias("ABS_V"), ((F.col("row") + F.col("col")) % 2).cast("double").alias("ABS_D"))


def frames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("tile"), (F.col("event_id") % 80).alias("n")).distinct()


def nodes(s: SparkSession, d: str) -> DataFrame:
    parts = [
        table(s, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("acronym")),
        table(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long"), (F.col("n_regionkey") + 1).cast("long"), "n_name"),
        table(s, d, "customer").select((F.col("c_custkey") + 1000).cast("long"), (F.col("c_nationkey") + 100).cast("long"), "c_name"),
    ]
    out = s.range(1).select(F.col("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("acronym"))
    for p in parts:
        out = out.union(p)
    return out.withColumn("name", F.col("acronym"))


def ontology(s: SparkSession, d: str) -> DataFrame:
    return atlas.with_paths(nodes(s, d), depth=4)


def order_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.when(F.col("o_orderkey") % 97 == 0, F.lit(7)).otherwise(F.col("o_custkey") + 1000).cast("long").alias("id"))


def atl(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy((F.col("p_size") % 5).cast("int").alias("z"), (F.col("p_partkey") % 20).cast("int").alias("y"), (F.floor(F.col("p_partkey") / 20) % 20).cast("int").alias("x")).agg(F.min("p_size").cast("long").alias("id"))


def acells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cell_id"), (F.col("l_linenumber") * F.lit(1.3)).alias("z"), ((F.col("l_suppkey") % 97).cast("double") / 2).alias("y"), ((F.col("l_partkey") % 89).cast("double") / 2).alias("x"))


SCALE = {"z": 2.5, "y": 2.5, "x": 2.5}

# projections


@query("SELECT z, y, max(v) AS v FROM vox GROUP BY z, y", "vox")
def max_projection_zy(s, d):
    return project.max_projection(vox(s, d), "zy")


@query("SELECT z, x, max(v) AS v FROM vox GROUP BY z, x", "vox")
def max_projection_zx(s, d):
    return project.max_projection(vox(s, d), "zx")


@query("SELECT y, x, max(v) AS v FROM vox GROUP BY y, x", "vox")
def max_projection_yx(s, d):
    return project.max_projection(vox(s, d), "yx")


@query("SELECT y, x, max(v) AS v FROM vox WHERE z >= 2 AND z < 5 AND y >= 4 AND x < 20 GROUP BY y, x", "vox")
def max_projection_patch(s, d):
    return project.max_projection(vox(s, d), "yx", limits={"z": (2, 5), "y": (4, None), "x": (None, 20)})


@query("SELECT CASE WHEN GROUPING(x) = 1 THEN 'zy' WHEN GROUPING(y) = 1 THEN 'zx' ELSE 'yx' END AS plane, CASE WHEN GROUPING(z) = 1 THEN y ELSE z END AS p, CASE WHEN GROUPING(x) = 1 THEN y ELSE x END AS q, max(v) AS v FROM vox GROUP BY GROUPING SETS ((z, y), (z, x), (y, x))", "vox")
def all_projections(s, d):
    return project.all_projections(vox(s, d))


def _patch(side: str, where: str, shift: str):
    def run(s, d):
        p = vox(s, d).withColumns({"row": F.lit(0), "col": F.lit(0)})
        near = s.range(1).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(side).alias("side"))
        return project.side_projections(p, near, 32, 8, 8).select("plane", "p", "q", "v")

    run.__name__ = f"patch_projection_{side}"
    a = {"y": "y", "x": "x"} | {shift[0]: shift}
    query(f"SELECT plane, p, q, max(v) AS v FROM (SELECT v, unnest([{{'plane': 'zy', 'p': z, 'q': {a['y']}}}, {{'plane': 'zx', 'p': z, 'q': {a['x']}}}, {{'plane': 'yx', 'p': {a['y']}, 'q': {a['x']}}}], recursive := true) FROM vox WHERE {where}) GROUP BY 1, 2, 3", "vox")(run)


for _side, _where, _shift in (("east", "x >= 24", "x - 24"), ("west", "x < 8", "x"), ("south", "y >= 24", "y - 24"), ("north", "y < 8", "y")):
    _patch(_side, _where, _shift)


@query("SELECT y, x, max(v) AS v FROM vox WHERE z BETWEEN 3 AND 5 GROUP BY y, x", "vox")
def z_slice(s, d):
    return project.slice_at(vox(s, d), "z", 3, 2)


@query("SELECT z, x, v FROM vox WHERE y = 9", "vox")
def y_slice(s, d):
    return project.slice_at(vox(s, d), "y", 9)


@query("SELECT z, y, v FROM vox WHERE x = 17", "vox")
def x_slice(s, d):
    return project.slice_at(vox(s, d), "x", 17)


@query("SELECT y, x, v, z AS at FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY v DESC, z) AS r FROM vox) WHERE r = 1", "vox")
def z_color(s, d):
    return project.depth_colour(vox(s, d))


_PART = "CAST(floor((w - w * greatest(0.0, least((k + h * 6) % 6, 4 - (k + h * 6) % 6, 1.0))) * 255) AS INTEGER)"


@query(f"SELECT y, x, {_PART.replace('k', '5.0')} AS r, {_PART.replace('k', '3.0')} AS g, {_PART.replace('k', '1.0')} AS b FROM (SELECT y, x, h, CAST(CASE WHEN hi <= lo THEN 0 ELSE floor(least(greatest((ln(v + 200) - lo) / (hi - lo), 0.0), 1.0) * 255) END AS INTEGER) / 255 AS w FROM deep, (SELECT quantile_cont(ln(v + 200), 0.01) AS lo, quantile_cont(ln(v + 200), 0.999) AS hi FROM deep))".replace("FROM deep", "FROM (SELECT y, x, v, CAST(z AS DOUBLE) / 8 AS h FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY v DESC, z) AS n FROM vox) WHERE n = 1) deep"), "vox")
def z_color_rgb(s, d):
    return project.depth_rgb(project.depth_colour(vox(s, d)), 8)


@query("SELECT z, x, v, y AS at FROM (SELECT *, row_number() OVER (PARTITION BY z, x ORDER BY v DESC, y) AS r FROM vox WHERE y BETWEEN 4 AND 12 AND v >= 100) WHERE r = 1", "vox")
def colored_projection(s, d):
    return project.depth_colour(vox(s, d), "y", 4, 8, 100)


@query("SELECT y, x, CAST(CASE WHEN hi <= lo THEN 0 ELSE floor(least(greatest((ln(v + 200) - lo) / (hi - lo), 0.0), 1.0) * 65535) END AS INTEGER) AS v FROM p, (SELECT quantile_cont(ln(v + 200), 0.01) AS lo, quantile_cont(ln(v + 200), 0.999) AS hi FROM p)".replace("FROM p", "FROM (SELECT y, x, max(v) AS v FROM vox GROUP BY y, x) p"), "vox")
def contrast_rescale(s, d):
    return project.for_display(project.max_projection(vox(s, d), "yx"))


# merging

_PLACED = "SELECT CAST(z + abs_d AS INTEGER) AS z, CAST(y + abs_v AS INTEGER) AS y, CAST(x + abs_h AS INTEGER) AS x, v FROM tvox JOIN reg USING (row, col)"


@query(f"SELECT z, y, x, max(v) AS v FROM ({_PLACED}) GROUP BY z, y, x", "tvox", "reg")
def merge_max(s, d):
    return merge.merge_max(tvox(s, d), reg(s, d))


@query(f"SELECT z, y, x, CAST(sum(v * 999) % 65536 AS INTEGER) AS v FROM ({_PLACED}) GROUP BY z, y, x", "tvox", "reg")
def merge_additive(s, d):
    return merge.merge_additive(tvox(s, d).withColumn("v", F.col("v") * 999), reg(s, d))


@query("SELECT z, y, x, max(v) AS v FROM (SELECT CAST(z // 2 + floor(abs_d / 2) AS INTEGER) AS z, CAST(y // 2 + floor(abs_v / 2) AS INTEGER) AS y, CAST(x // 2 + floor(abs_h / 2) AS INTEGER) AS x, v FROM tvox JOIN reg USING (row, col)) GROUP BY z, y, x", "tvox", "reg")
def merge_labels(s, d):
    return merge.merge_labels(tvox(s, d), reg(s, d), 2)


@query("SELECT z, y, x, max(v) AS v FROM (SELECT CAST(z + floor(abs_d / 4) AS INTEGER) AS z, CAST(y + floor(abs_v / 4) AS INTEGER) AS y, CAST(x + floor(abs_h / 4) AS INTEGER) AS x, v FROM (SELECT row, col, z // 4 AS z, y // 4 AS y, x // 4 AS x, CAST(floor(avg(v)) AS INTEGER) AS v FROM tvox GROUP BY ALL) JOIN reg USING (row, col)) GROUP BY z, y, x", "tvox", "reg")
def merge_max_downsampled(s, d):
    return merge.merge_max(tvox(s, d), reg(s, d), 4)


@query("SELECT CAST(z // 2 AS INTEGER) AS z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(floor(avg(v)) AS INTEGER) AS v FROM vox GROUP BY 1, 2, 3", "vox")
def block_mean(s, d):
    return merge.downsampled(vox(s, d), 2)


@query("SELECT z, y, x, CASE WHEN y >= 5 AND y < 20 AND x >= 3 THEN v ELSE 7 END AS v FROM vox", "vox")
def crop_mask(s, d):
    return merge.crop(vox(s, d), 7, y=(5, 20), x=(3, None))


@query("SELECT CAST(z.z AS INTEGER) AS z, CAST(y.y AS INTEGER) AS y, CAST(x.x AS INTEGER) AS x, coalesce(v, 0) AS v FROM range(8) z(z) CROSS JOIN range(32) y(y) CROSS JOIN range(32) x(x) LEFT JOIN vox ON vox.z = z.z AND vox.y = y.y AND vox.x = x.x", "vox")
def dense_volume(s, d):
    return merge.dense(vox(s, d), (8, 32, 32))


@query("SELECT CAST(max(abs_h) - min(abs_h) + 16 AS INTEGER) AS nx, CAST(max(abs_v) - min(abs_v) + 16 AS INTEGER) AS ny, CAST(max(abs_d) - min(abs_d) + (SELECT max(z) + 1 FROM tvox) AS INTEGER) AS nz FROM reg", "reg", "tvox")
def merged_extent(s, d):
    planes = tvox(s, d).agg((F.max("z") + 1).alias("n"))
    return with_scalars(merge.extent(reg(s, d), 16, 0), planes).select("nx", "ny", (F.col("nz") + F.col("n")).alias("nz"))


@query("SELECT CAST(y + abs_v AS INTEGER) AS y, CAST(x + abs_h AS INTEGER) AS x, max(v) AS v FROM tvox JOIN reg USING (row, col) WHERE z BETWEEN 1 AND 2 GROUP BY 1, 2", "tvox", "reg")
def reconstruct_z_slice(s, d):
    return merge.reconstruct_slice(tvox(s, d), reg(s, d), "z", 1, 1)


@query("SELECT CAST(floor((z + abs_d) / 2) AS INTEGER) AS z, CAST(floor((x + abs_h) / 2) AS INTEGER) AS x, max(v) AS v FROM tvox JOIN reg USING (row, col) WHERE y + abs_v BETWEEN 13 AND 15 GROUP BY 1, 2", "tvox", "reg")
def reconstruct_y_slice(s, d):
    return merge.reconstruct_slice(tvox(s, d), reg(s, d), "y", 13, 2, 2)


@query("SELECT CAST(z + abs_d AS INTEGER) AS z, CAST(y + abs_v AS INTEGER) AS y, coalesce(max(v) FILTER (WHERE (row + col) % 2 = 0), 0) AS v0, coalesce(max(v) FILTER (WHERE (row + col) % 2 = 1), 0) AS v1 FROM tvox JOIN reg USING (row, col) WHERE x + abs_h = 13 GROUP BY 1, 2", "tvox", "reg")
def reconstruct_x_slice_color(s, d):
    return merge.reconstruct_slice(tvox(s, d), reg(s, d), "x", 13, colour=True)


@query()
def clahe(s, d):
    return merge.equalize_hist(vox(s, d))


# the adaptive representation


for _mode in ("mean", "max"):
    _f = lambda s, d, mode=_mode: octree.fill_tree(octree.leaves(vox(s, d), 5), 5, mode=mode).withColumn("v", F.round("v", 6))
    _f.__name__ = f"pyramid_{_mode}"
    _value = "max(v)" if _mode == "max" else "round(avg(v), 6)"
    query(f"SELECT CAST(lv AS INTEGER) AS level, CAST(z >> CAST(5 - lv AS INTEGER) AS INTEGER) AS z_l, CAST(y >> CAST(5 - lv AS INTEGER) AS INTEGER) AS y_l, CAST(x >> CAST(5 - lv AS INTEGER) AS INTEGER) AS x_l, CAST({_value} AS DOUBLE) AS v FROM vox, range(5) l(lv) GROUP BY 1, 2, 3, 4", "vox")(_f)

_CUBES = "cube AS (SELECT z // 2 AS cz, y // 2 AS cy, x // 2 AS cx, count(*) = 8 AND (max(v) - min(v)) / 2.0 <= 0.4 * greatest(avg(v), 108.0) AS ok, avg(v) AS m FROM vox GROUP BY 1, 2, 3)"
_LEAF = f"leaf AS (SELECT 4 AS level, CAST(cz AS INTEGER) AS z_l, CAST(cy AS INTEGER) AS y_l, CAST(cx AS INTEGER) AS x_l, m AS v FROM cube WHERE ok UNION ALL SELECT 5, z, y, x, CAST(v AS DOUBLE) FROM vox JOIN cube ON z // 2 = cz AND y // 2 = cy AND x // 2 = cx WHERE NOT ok)"


def _leaves(s, d):
    return octree.encode(vox(s, d), 5, 0.4, 108.0, l_min=4).select("level", *octree.CELL, "v")


def _full_tree() -> str:
    """Five levels of merging: the nodes of a level, their cubes, and the nodes whose cube can't merge."""
    out = ["n5 AS (SELECT z AS z_l, y AS y_l, x AS x_l, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) AS lo, CAST(v AS DOUBLE) AS hi, 1 AS n FROM vox)"]
    for k in range(4, -1, -1):
        out.append(f"g{k} AS (SELECT *, n = {8 ** (5 - k)} AND (hi - lo) / 2 <= 0.2 * greatest(v, 108.0) AS ok FROM (SELECT z_l // 2 AS cz, y_l // 2 AS cy, x_l // 2 AS cx, min(lo) AS lo, max(hi) AS hi, sum(n) AS n, sum(v * n) / sum(n) AS v FROM n{k + 1} GROUP BY 1, 2, 3))")
        out.append(f"n{k} AS (SELECT cz AS z_l, cy AS y_l, cx AS x_l, v, lo, hi, n FROM g{k} WHERE ok)")
    parts = [f"SELECT {k + 1} AS level, z_l, y_l, x_l, m.v FROM n{k + 1} m JOIN g{k} ON z_l // 2 = cz AND y_l // 2 = cy AND x_l // 2 = cx WHERE NOT ok" for k in range(5)]
    every = " UNION ALL ".join([*parts, "SELECT 0, z_l, y_l, x_l, v FROM n0"])
    return ", ".join(out) + f" SELECT CAST(level AS INTEGER) AS level, CAST(z_l AS INTEGER) AS z_l, CAST(y_l AS INTEGER) AS y_l, CAST(x_l AS INTEGER) AS x_l, round(v, 6) AS v FROM ({every})"


@query()
def octree_encode_full(s, d):
    return octree.encode(vox(s, d), 5).select("level", *octree.CELL, F.round("v", 6).alias("v"))


SQL["octree_encode_full"] = sql("", "vox").rstrip() + ", " + _full_tree()


for _name, _run, _text in (
    ("octree_encode", lambda s, d: _leaves(s, d).withColumn("v", F.round("v", 6)), "SELECT CAST(level AS INTEGER) AS level, z_l, y_l, x_l, round(v, 6) AS v FROM leaf"),
    ("reconstruct_constant", lambda s, d: octree.reconstruct(_leaves(s, d), 5).withColumn("v", F.round("v", 6)), "SELECT z, y, x, round(CASE WHEN ok THEN m ELSE v END, 6) AS v FROM vox JOIN cube ON z // 2 = cz AND y // 2 = cy AND x // 2 = cx"),
    ("reconstruct_level", lambda s, d: octree.reconstruct(_leaves(s, d), 5, "level"), "SELECT z, y, x, CAST(CASE WHEN ok THEN 4 ELSE 5 END AS DOUBLE) AS v FROM vox JOIN cube ON z // 2 = cz AND y // 2 = cy AND x // 2 = cx"),
    ("particle_histogram", lambda s, d: octree.level_histogram(_leaves(s, d), 5).withColumn("share", F.round("share", 6)), "SELECT CAST(level AS INTEGER) AS level, CAST(1 << (5 - level) AS INTEGER) AS size, count(*) AS n, round(count(*) / (SELECT count(*) FROM leaf), 6) AS share FROM leaf GROUP BY level"),
    ("find_particle", lambda s, d: octree.find_particles(vox(s, d).where("v % 5 = 0").select("z", "y", "x"), _leaves(s, d), 5).select("z", "y", "x", "level", F.round("v", 6).alias("v")), "SELECT z, y, x, CAST(CASE WHEN ok THEN 4 ELSE 5 END AS INTEGER) AS level, round(CASE WHEN ok THEN m ELSE v END, 6) AS v FROM vox JOIN cube ON z // 2 = cz AND y // 2 = cy AND x // 2 = cx WHERE vox.v % 5 = 0"),
    ("slice_level", lambda s, d: octree.slice_level(_leaves(s, d), octree.fill_tree(_leaves(s, d), 5), 4).withColumn("v", F.round("v", 6)), "SELECT 4 AS level, CAST(z // 2 AS INTEGER) AS z_l, CAST(y // 2 AS INTEGER) AS y_l, CAST(x // 2 AS INTEGER) AS x_l, round(avg(v), 6) AS v FROM vox GROUP BY 2, 3, 4"),
):
    _run.__name__ = _name
    QUERIES[_name] = _run
    SQL[_name] = sql(_text, "vox").replace("WITH RECURSIVE ", "WITH ", 1).replace(f"vox AS ({VIEWS['vox']})", f"vox AS ({VIEWS['vox']}), {_CUBES}, {_LEAF}", 1)


@query("SELECT CAST(sum(p) AS DOUBLE) / sum(q) AS ratio FROM (SELECT l_orderkey % 2 AS row, count(*) AS p, count(DISTINCT l_partkey) AS q FROM lineitem GROUP BY 1)")
def comp_ratio(s, d):
    t = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 2).alias("row")).agg(F.count("*").alias("n_pixels"), F.countDistinct("l_partkey").alias("n_parts"))
    return octree.computational_ratio(t)


@query("SELECT z, y, x, round(CASE WHEN v <= 108 THEN v ELSE 108.0 + (round(sqrt(v - 108.0) / 2.0) * 2.0) * (round(sqrt(v - 108.0) / 2.0) * 2.0) END, 6) AS v FROM vox", "vox")
def quantize_values(s, d):
    return octree.quantize(vox(s, d).withColumn("v", F.col("v").cast("double")), 2.0).withColumn("v", F.round("v", 6))


# catalog and grid


@query("SELECT user_id, CAST(floor((user_id) / 15) AS INTEGER) AS row, CAST(CASE WHEN floor(user_id / 15) % 2 = 0 THEN user_id % 15 ELSE 14 - user_id % 15 END AS INTEGER) AS col FROM (SELECT DISTINCT user_id FROM events)")
def snake_position(s, d):
    return table(s, d, "events").select("user_id").distinct().select("user_id", snake_row(F.col("user_id") + 1, 15).alias("row"), snake_col(F.col("user_id") + 1, 15).alias("col"))


@query(r"SELECT url AS path, CAST(regexp_extract(url, '/(\d+)\?page=(\d+)', 1) AS INTEGER) AS row, CAST(regexp_extract(url, '/(\d+)\?page=(\d+)', 2) AS INTEGER) AS col FROM pages WHERE regexp_matches(url, '/(\d+)\?page=(\d+)')")
def path_to_grid(s, d):
    return acquisition.by_pattern(table(s, d, "pages").select(F.col("url").alias("path")), r"/(\d+)\?page=(\d+)", "path")


@query(r"""SELECT event_id, regexp_extract(props, '"(\w+)": (\d+)', 1) AS key, CAST(regexp_extract(props, '"(\w+)": (\d+)', 2) AS DOUBLE) AS number FROM events""")
def settings_parse(s, d):
    e = table(s, d, "events").select("event_id", F.col("props").alias("value"))
    return e.select("event_id", F.regexp_extract("value", r'"(\w+)": (\d+)', 1).alias("key"), F.expr(r"""try_cast(regexp_extract(value, r'"(\w+)": (\d+)', 2) as double)""").alias("number"))


@query("SELECT CAST(g.r AS INTEGER) AS row, CAST(h.c AS INTEGER) AS col, CASE WHEN path IS NULL THEN 0 ELSE 1 END AS present, path FROM range(5) g(r) CROSS JOIN range(5) h(c) LEFT JOIN grid ON grid.row = g.r AND grid.col = h.c", "grid")
def grid_pattern(s, d):
    return grid.pattern(tiles(s, d))


@query("SELECT CAST(row - 1 AS INTEGER) AS row, CAST(col - (SELECT min(col) FROM grid WHERE row > 0 AND col > 1) AS INTEGER) AS col, path FROM grid WHERE row > 0 AND col > 1", "grid")
def grid_offset(s, d):
    t = tiles(s, d).where("row > 0 and col > 1").select((F.col("row") + 3).alias("row"), (F.col("col") + 2).alias("col"), "path")
    return grid.normalise_offset(t)


def _near(name: str, sides: tuple[str, ...]):
    def run(s, d):
        t = tiles(s, d)
        return grid.adjacent(grid.cells(t), t, sides).select("row", "col", "side", "n_row", "n_col", "n_path")

    run.__name__ = name
    offsets = ", ".join(f"('{k}', {r}, {c})" for k, (r, c) in grid.SIDES.items() if k in sides)
    query(f"SELECT CAST(g.r AS INTEGER) AS row, CAST(h.c AS INTEGER) AS col, o.side, grid.row AS n_row, grid.col AS n_col, path AS n_path FROM range(5) g(r) CROSS JOIN range(5) h(c) CROSS JOIN (VALUES {offsets}) o(side, dr, dc) JOIN grid ON grid.row = g.r + dr AND grid.col = h.c + dc", "grid")(run)


_near("neighbors_all", ("east", "south", "west", "north"))
_near("neighbors_es", ("east", "south"))


@query("SELECT count(*) AS n_edges, count(*) + (SELECT count(*) FROM (SELECT r, c FROM range(5) g(r) CROSS JOIN range(5) h(c) WHERE NOT EXISTS (SELECT 1 FROM grid WHERE row = r AND col = c)) m JOIN grid ON (row = r AND col = c + 1) OR (row = r + 1 AND col = c)) AS n_edges_dense FROM edge", "edge")
def n_edges(s, d):
    return grid.edge_counts(tiles(s, d))


@query("SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, side FROM edge", "edge")
def grid_edges(s, d):
    return grid.edges(tiles(s, d)).select("a", "b", "side")


@query("SELECT t.row, t.col, g.row AS n_row, g.col AS n_col FROM grid t JOIN grid g ON (g.col = t.col AND g.row = t.row - 1) OR (g.row = t.row AND g.col = t.col + CASE WHEN t.row % 2 = 0 THEN -1 ELSE 1 END)", "grid")
def earlier_neighbors(s, d):
    return grid.earlier_neighbours(tiles(s, d)).select("row", "col", "n_row", "n_col")


@query("SELECT CAST(max(row) + 1 AS INTEGER) AS nrow, CAST(max(col) + 1 AS INTEGER) AS ncol FROM grid", "grid")
def grid_shape(s, d):
    return grid.shape(tiles(s, d))


@query("SELECT tile, prev AS after, n AS before, n - prev - 1 AS missing FROM (SELECT *, lag(n) OVER (PARTITION BY tile ORDER BY n) AS prev FROM frame) WHERE n - prev > 1", "frame")
def missing_frames(s, d):
    return grid.missing_frames(frames(s, d))


_ABSENT = "SELECT tile, n, n - row_number() OVER (PARTITION BY tile ORDER BY n) AS g FROM (SELECT tile, r AS n FROM (SELECT DISTINCT tile FROM frame), range(80) x(r)) w WHERE NOT EXISTS (SELECT 1 FROM frame f WHERE f.tile = w.tile AND f.n = w.n)"


@query(f"SELECT tile, min(n) AS first, max(n) AS last, count(*) AS size FROM ({_ABSENT}) GROUP BY tile, g", "frame")
def frame_islands(s, d):
    return grid.islands(grid.absent_frames(frames(s, d), 80))


@query("SELECT tile, n + i AS n, CAST(floor(v * (1 - CAST(i AS DOUBLE) / (nn - n)) + nv * (CAST(i AS DOUBLE) / (nn - n))) AS INTEGER) AS v FROM (SELECT *, unnest(range(1, nn - n)) AS i FROM (SELECT tile, n, v, lead(n) OVER w AS nn, lead(v) OVER w AS nv FROM (SELECT user_id AS tile, event_id % 80 AS n, CAST(max(value * 100) AS INTEGER) AS v FROM (SELECT user_id, event_id, floor(value) AS value FROM events) GROUP BY 1, 2) WINDOW w AS (PARTITION BY tile ORDER BY n)) WHERE nn - n > 1)")
def frame_interpolate(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("tile"), (F.col("event_id") % 80).alias("n")).agg(F.max(F.floor("value") * 100).cast("int").alias("v"))
    return grid.interpolate_frames(e, "v")


@query("SELECT CAST(floor(avg(v)) AS INTEGER) AS ip_th FROM vox WHERE z = 0 + 1 AND y < 10 AND x < 10", "vox")
def ip_black_corner(s, d):
    return acquisition.darkest_corner(vox(s, d).withColumn("z", F.col("z") - 1), 10)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def pending_outputs(s, d):
    done = table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.pending(table(s, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


# registration

_IMAGES = "ref AS (SELECT y.y, x.x, coalesce(max(v) FILTER (WHERE vox.z <= 3), 0) AS a, coalesce(max(v) FILTER (WHERE vox.z > 3), 0) AS b FROM range(32) y(y) CROSS JOIN range(32) x(x) LEFT JOIN vox ON vox.y = y.y AND vox.x = x.x GROUP BY 1, 2), pair AS (SELECT m.a AS a, n.b AS b FROM ref m JOIN ref n ON n.y = (m.y - 3 + 32) % 32 AND n.x = (m.x - 5 + 32) % 32)"


def _pairs(s, d):
    """The largest values of the lower and of the upper half, as two images of 32 x 32."""
    every = s.range(1024).select(F.floor(F.col("id") / 32).cast("int").alias("p"), (F.col("id") % 32).cast("int").alias("q"))
    half = lambda c: F.coalesce(F.max(F.when(c, F.col("v"))), F.lit(0))
    flat = vox(s, d).groupBy(F.col("y").alias("p"), F.col("x").alias("q")).agg(half(F.col("z") <= 3).alias("reference"), half(F.col("z") > 3).alias("moving"))
    return every.join(flat, ["p", "q"], "left").fillna(0)


for _name, _text in (
    ("reliability_p99", "SELECT round(2 * quantile_cont(a, 0.99) / quantile_cont(a + b, 0.99), 6) AS reliability FROM pair"),
    ("nrmse", "SELECT round(sqrt(avg(CAST(a - b AS DOUBLE) * (a - b))) / avg(a), 6) AS nrmse FROM pair"),
):
    QUERIES[_name] = lambda s, d, col=_name.removesuffix("_p99"): register.shift_quality(_pairs(s, d), (3, 5)).select(F.round(col, 6).alias(col))
    SQL[_name] = sql(_text, "vox").replace(f"vox AS ({VIEWS['vox']})", f"vox AS ({VIEWS['vox']}), {_IMAGES}", 1)


@query()
def phase_shift(s, d):
    """Shift of each plane against itself moved by (3, 5)."""
    flat = project.all_projections(vox(s, d).withColumns({"row": F.lit(0), "col": F.lit(0)}), ["row", "col"])
    moved = flat.withColumns({"q": F.pmod(F.col("q") - 5, F.lit(32)), "p": F.when(F.col("plane") == "yx", F.pmod(F.col("p") - 3, F.lit(32))).otherwise(F.col("p"))})
    return register.channel_shifts(flat, moved)


@query("SELECT a, b, side, CASE WHEN abs(d_h - eh) > 20 THEN eh ELSE d_h END AS d_h, CASE WHEN abs(d_v - ev) > 20 THEN ev ELSE d_v END AS d_v, CASE WHEN abs(d_d) > 20 THEN 0.0 ELSE d_d END AS d_d, CASE WHEN abs(d_h - eh) > 20 THEN 2.0 ELSE r END AS r_h, CASE WHEN abs(d_v - ev) > 20 THEN 2.0 ELSE r END AS r_v, CASE WHEN abs(d_d) > 20 THEN 2.0 ELSE r END AS r_d FROM (SELECT *, CASE WHEN side = 'east' THEN 100.0 ELSE 0.0 END AS eh, CASE WHEN side = 'east' THEN 0.0 ELSE 80.0 END AS ev FROM (SELECT CAST(o_orderkey AS INTEGER) AS a, CAST(o_custkey AS INTEGER) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'east' ELSE 'south' END AS side, CAST(o_orderkey % 150 AS DOUBLE) AS d_h, CAST(o_custkey % 120 AS DOUBLE) AS d_v, CAST(o_custkey % 61 - 30 AS DOUBLE) AS d_d, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS r FROM orders))")
def regularize_shift(s, d):
    c = lambda e, t: e.cast(t)
    o = table(s, d, "orders")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    r = c(k % 10, "double") / 10
    rows = o.select(c(k, "int").alias("a"), c(u, "int").alias("b"), F.when(k % 2 == 0, "east").otherwise("south").alias("side"), c(k % 150, "double").alias("d_h"), c(u % 120, "double").alias("d_v"), c(u % 61 - 30, "double").alias("d_d"), r.alias("r_h"), r.alias("r_v"), r.alias("r_d"))
    return register.regularize(rows, 20, 20, 20, {"east": (100, 0), "south": (0, 80)})


@query("SELECT a, b, CASE WHEN e1 < e0 THEN s1 ELSE s0 END AS d_d, CAST(least(CASE WHEN e1 = 0 THEN 1e-6 ELSE e1 END, CASE WHEN e0 = 0 THEN 1e-6 ELSE e0 END) AS DOUBLE) AS r_d FROM (SELECT CAST(l_orderkey AS INTEGER) AS a, CAST(l_orderkey % 7 AS INTEGER) AS b, CAST(max(l_quantity) FILTER (WHERE l_linenumber = 1) AS DOUBLE) AS s0, CAST(max(l_quantity) FILTER (WHERE l_linenumber = 2) AS DOUBLE) AS s1, max(l_discount) FILTER (WHERE l_linenumber = 1) AS e0, max(l_discount) FILTER (WHERE l_linenumber = 2) AS e1 FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2) WHERE s1 IS NOT NULL AND s0 IS NOT NULL")
def choose_shift(s, d):
    rows = table(s, d, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").cast("int").alias("a"), (F.col("l_orderkey") % 7).cast("int").alias("b"), F.when(F.col("l_linenumber") == 1, "zy").otherwise("zx").alias("plane")).agg(F.max("l_quantity").alias("s0"), F.lit(0.0).alias("s1"), F.max("l_discount").alias("e"))
    both = rows.groupBy("a", "b").count().where("count = 2").select("a", "b")
    return register.pair_shifts(rows.join(both, ["a", "b"]).withColumn("side", F.lit("east"))).select("a", "b", "d_d", "r_d")


@query("SELECT n_name AS path, CAST(n_nationkey // 5 AS INTEGER) AS row, CAST(n_nationkey % 5 AS INTEGER) AS col, coalesce(s, 0.0) + 1 AS dh, 10.0 + coalesce(s, 0.0) AS abs_h FROM nation LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS s FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1) ON s_nationkey = n_nationkey")
def channel_update(s, d):
    k = F.col("n_nationkey")
    at = lambda c: (F.floor(c / 5).cast("int").alias("row"), (c % 5).cast("int").alias("col"))
    r = table(s, d, "nation").select(F.col("n_name").alias("path"), *at(k), F.lit(1.0).alias("dH"), F.lit(0.0).alias("dV"), F.lit(0.0).alias("dD"), F.lit(10.0).alias("ABS_H"), F.lit(0.0).alias("ABS_V"), F.lit(0.0).alias("ABS_D"))
    n = table(s, d, "supplier").where("s_nationkey % 3 = 0").groupBy("s_nationkey").agg(F.count("*").cast("double").alias("d_h")).select(*at(F.col("s_nationkey")), "d_h", F.lit(0.0).alias("d_v"), F.lit(0.0).alias("d_d"))
    return register.update_registration(r, n).select("path", "row", "col", F.col("dH").alias("dh"), F.col("ABS_H").alias("abs_h"))


# the graph

_TREE = ", reach AS (SELECT e.a AS ea, e.b AS eb, e.w AS ew, e.a AS v FROM wedge e UNION SELECT ea, eb, ew, CASE WHEN g.a = v THEN g.b ELSE g.a END FROM reach JOIN wedge g ON (g.a = v OR g.b = v) AND g.w < ew), mst AS (SELECT * FROM wedge WHERE NOT EXISTS (SELECT 1 FROM reach WHERE ea = a AND eb = b AND v = b))"
_WALK = ", walk AS (SELECT (SELECT min(a) FROM mst) AS v, CAST(0 AS DOUBLE) AS pos UNION SELECT CASE WHEN m.a = v THEN m.b ELSE m.a END, pos + CASE WHEN m.a = v THEN m.d ELSE -m.d END FROM walk JOIN mst m ON m.a = v OR m.b = v)"


def _graph_sql(text: str) -> str:
    head = sql("", "wedge")
    return head.rstrip() + _TREE + _WALK + " " + text


def _mst(s, d):
    return graph.spanning_tree(wedges(s, d).withColumn("axis", F.lit("h")), ["axis"])


def _table(s, d):
    return graph.registration_table(tiles(s, d), graph.tree_positions(_mst(s, d), ["axis"]), 5)


for _name, _run, _text in (
    ("mst_edges", lambda s, d: _mst(s, d).select("a", "b", "w"), "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, w FROM mst"),
    ("tree_positions", lambda s, d: graph.tree_positions(_mst(s, d), ["axis"]).select("vertex", "pos"), "SELECT CAST(v AS INTEGER) AS vertex, pos FROM walk"),
    ("registration_table", lambda s, d: _table(s, d).select("path", "row", "col", F.col("dH").alias("dh"), F.col("ABS_H").alias("abs_h")), "SELECT path, row, col, coalesce(pos, 0.0) AS dh, coalesce(pos, 0.0) - (SELECT min(coalesce(pos, 0.0)) FROM grid LEFT JOIN walk ON v = row * 5 + col) AS abs_h FROM grid LEFT JOIN walk ON v = row * 5 + col"),
    ("vertex_error", lambda s, d: graph.vertex_errors(_mst(s, d)), "SELECT CAST(v AS INTEGER) AS vertex, max(w) AS error FROM (SELECT a AS v, w FROM mst UNION ALL SELECT b, w FROM mst) GROUP BY v"),
    ("edge_report", lambda s, d: graph.edge_report(_mst(s, d).withColumn("w", F.col("w") / 1000)).groupBy("band").agg(F.count("*").alias("n")), "SELECT CASE WHEN w / 1000 < 0.15 THEN 'good' WHEN w / 1000 < 0.3 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM mst GROUP BY 1"),
):
    QUERIES[_name] = _run
    SQL[_name] = _graph_sql(_text)


@query("SELECT round((100 - median(sh)) / 100 * 100, 6) AS overlap_h, (SELECT round((100 - median(sv)) / 100 * 100, 6) FROM (SELECT m - lag(m) OVER (ORDER BY row) AS sv FROM (SELECT row, median(row * 70.0 + col % 3) AS m FROM grid GROUP BY row))) AS overlap_v FROM (SELECT m - lag(m) OVER (ORDER BY col) AS sh FROM (SELECT col, median(col * 75.0 + row % 2) AS m FROM grid GROUP BY col))", "grid")
def effective_overlap(s, d):
    r = tiles(s, d).withColumns({"ABS_H": F.col("col") * 75.0 + F.col("row") % 2, "ABS_V": F.col("row") * 70.0 + F.col("col") % 3})
    return graph.effective_overlap(r, 100).select(F.round("overlap_h", 6).alias("overlap_h"), F.round("overlap_v", 6).alias("overlap_v"))


@query("SELECT path, row, col, CAST(col * 75.0 AS DOUBLE) AS abs_h, CAST(row * 70.0 AS DOUBLE) AS abs_v FROM grid", "grid")
def expected_registration(s, d):
    return graph.expected_registration(tiles(s, d), 75, 70).select("path", "row", "col", F.col("ABS_H").alias("abs_h"), F.col("ABS_V").alias("abs_v"))


# features


def _shifted(dz: int, dy: int, dx: int) -> str:
    return f"coalesce((SELECT n.v FROM vox n WHERE n.z = o.z + {dz} AND n.y = o.y + {dy} AND n.x = o.x + {dx}), 0)"


_GRAD = ", ".join(f"({_shifted(*p)} - {_shifted(*m)}) / 2.0 AS g{a}" for a, p, m in (("z", (1, 0, 0), (-1, 0, 0)), ("y", (0, 1, 0), (0, -1, 0)), ("x", (0, 0, 1), (0, 0, -1))))


@query(f"SELECT z, y, x, v, CAST(gz AS DOUBLE) AS gz, CAST(gy AS DOUBLE) AS gy, CAST(gx AS DOUBLE) AS gx FROM (SELECT o.z, o.y, o.x, o.v, {_GRAD} FROM vox o)", "vox")
def gradient(s, d):
    return features.gradient(vox(s, d))


@query(f"SELECT z, y, x, v, round(sqrt(gz * gz + gy * gy + gx * gx), 6) AS gradmag FROM (SELECT o.z, o.y, o.x, o.v, {_GRAD} FROM vox o)", "vox")
def gradient_mag(s, d):
    return features.gradient_magnitude(vox(s, d)).withColumn("gradmag", F.round("gradmag", 6))


@query("SELECT o.z, o.y, o.x, o.v, CAST((" + " + ".join(f"{_shifted(*o)}" for o in ((2, 0, 0), (-2, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 2), (0, 0, -2))) + " - 6 * o.v) / 4.0 AS DOUBLE) AS laplacian FROM vox o", "vox")
def laplacian(s, d):
    return features.laplacian(vox(s, d))


def _blur_sql(name: str, sigma: float, size: int) -> str:
    w, r = features.kernel(sigma, size), size // 2
    k = ", ".join(f"({i - r}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w))
    steps, src = [f"k{name}(o, w) AS (VALUES {k})"], "vox"
    for i, a in enumerate("zyx"):
        keys = ", ".join(f"CAST({c} - o AS INTEGER) AS {c}" if c == a else c for c in "zyx")
        steps.append(f"{name}{i} AS (SELECT z, y, x, sum(v * w) AS v FROM (SELECT {keys}, v, w FROM {src}, k{name}) GROUP BY z, y, x)")
        src = f"{name}{i}"
    return ", ".join(steps)


for _name, _run, _steps, _text in (
    ("gaussian_blur", lambda s, d: features.gaussian(vox(s, d), 1.5, 5).select("z", "y", "x", F.round("gauss", 6).alias("gauss")), [("a", 1.5, 5)], "SELECT z, y, x, round(a2.v, 6) AS gauss FROM vox JOIN a2 USING (z, y, x)"),
    ("difference_of_gaussians", lambda s, d: features.dog(vox(s, d), 1.0, 3.0, 5).select("z", "y", "x", F.round("dog", 6).alias("dog")), [("a", 1.0, 5), ("b", 3.0, 5)], "SELECT z, y, x, round(a2.v - b2.v, 6) AS dog FROM vox JOIN a2 USING (z, y, x) JOIN b2 USING (z, y, x)"),
):
    QUERIES[_name] = _run
    SQL[_name] = sql(_text, "vox").replace(f"vox AS ({VIEWS['vox']})", f"vox AS ({VIEWS['vox']}), " + ", ".join(_blur_sql(*x) for x in _steps), 1)


@query("SELECT DISTINCT z, y, x, CAST(pow(2, 5 - v % 6) AS INTEGER) AS size FROM vox", "vox")
def particle_sizes(s, d):
    return vox(s, d).withColumn("level", F.col("v") % 6).select("z", "y", "x", octree.size_of(5).cast("int").alias("size")).distinct()


# objects

_DENSE = "big AS (SELECT z, y, x FROM vox WHERE v > 60), steps(dz, dy, dx) AS (VALUES (0,0,0), (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))"


def _mask(s, d):
    return vox(s, d).where("v > 60")


for _name, _run, _text in (
    ("erosion", lambda s, d: morphology.erode(_mask(s, d)), "SELECT z, y, x FROM (SELECT CAST(z + dz AS INTEGER) AS z, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM big, steps) GROUP BY z, y, x HAVING count(*) = 7"),
    ("opening", lambda s, d: morphology.opening(_mask(s, d)), "SELECT DISTINCT CAST(z + dz AS INTEGER) AS z, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM (SELECT z, y, x FROM (SELECT z + dz AS z, y + dy AS y, x + dx AS x FROM big, steps) GROUP BY z, y, x HAVING count(*) = 7), steps"),
):
    QUERIES[_name] = _run
    SQL[_name] = sql(_text, "vox").replace(f"vox AS ({VIEWS['vox']})", f"vox AS ({VIEWS['vox']}), {_DENSE}", 1)

_CC = ", link AS (SELECT (f.z * 32 + f.y) * 32 + f.x + 1 AS a, (g.z * 32 + g.y) * 32 + g.x + 1 AS b FROM fg f JOIN fg g ON abs(f.z - g.z) + abs(f.y - g.y) + abs(f.x - g.x) = 1), reach AS (SELECT (z * 32 + y) * 32 + x + 1 AS s, (z * 32 + y) * 32 + x + 1 AS t FROM fg UNION SELECT s, b FROM reach JOIN link ON t = a), lab AS (SELECT z, y, x, v, CAST(l AS BIGINT) AS label FROM fg JOIN (SELECT s, min(t) AS l FROM reach GROUP BY s) ON s = (z * 32 + y) * 32 + x + 1)"


def _labels(s, d):
    mask = fg(s, d)
    return morphology.connected_components(mask, shape=(32, 32), block=16).join(mask, ["z", "y", "x"])


for _name, _run, _text in (
    ("connected_components", lambda s, d: _labels(s, d).select("z", "y", "x", "label"), "SELECT z, y, x, label FROM lab"),
    ("label_volume", lambda s, d: morphology.volumes(_labels(s, d)), "SELECT label, count(*) AS volume FROM lab GROUP BY label"),
    ("size_filter", lambda s, d: morphology.size_filter(_labels(s, d), 3, 40).select("z", "y", "x", "label"), "SELECT z, y, x, label FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) BETWEEN 3 AND 40)"),
    ("edge_objects", lambda s, d: morphology.without_edge_objects(_labels(s, d), (8, 32, 32), z_edges=False).select("z", "y", "x", "label"), "SELECT z, y, x, label FROM lab WHERE label NOT IN (SELECT label FROM lab WHERE y <= 0 OR y >= 31 OR x <= 0 OR x >= 31)"),
    ("label_centers", lambda s, d: morphology.centers(_labels(s, d), value="v").select("label", *[F.round(c, 6).alias(c) for c in "zyx"]), "SELECT label, round(sum(z * v) / sum(v), 6) AS z, round(sum(y * v) / sum(v), 6) AS y, round(sum(x * v) / sum(v), 6) AS x FROM lab GROUP BY label"),
    ("map_feature", lambda s, d: morphology.map_feature(_labels(s, d).select("z", "y", "x", "label"), morphology.volumes(_labels(s, d)).withColumnRenamed("volume", "value")).select("z", "y", "x", "value"), "SELECT z, y, x, CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) AS value FROM lab"),
):
    QUERIES[_name] = _run
    SQL[_name] = sql("", "fg").rstrip() + _CC + " " + _text


@query("SELECT count(*) AS n_particles, count(*) FILTER (WHERE lo <> hi) AS n_ambiguous FROM (SELECT doc_id % 50 AS k, min(quality) AS lo, max(quality) AS hi FROM labels GROUP BY 1)")
def label_ambiguity(s, d):
    return segment.ambiguity(table(s, d, "labels").select((F.col("doc_id") % 50).alias("k"), F.col("quality").alias("label")), ["k"])


@query("SELECT k, min(toxic) AS label FROM (SELECT doc_id % 200 AS k, toxic FROM labels) GROUP BY k HAVING min(toxic) = max(toxic)")
def unambiguous_labels(s, d):
    return segment.unambiguous(table(s, d, "labels").select((F.col("doc_id") % 200).alias("k"), F.col("toxic").alias("label")), ["k"])


@query()
def forest_predict(s, d):
    volume = morphology.durable(vox(s, d))
    rows = features.standard_features(volume).join(fg(s, d).select("z", "y", "x", F.lit(1).alias("label")), ["z", "y", "x"], "left").fillna(0, ["label"])
    rows = morphology.durable(rows)  # training passes over it again and again
    model = segment.train(rows.where("(z + y + x) % 3 = 0"), [f"f{i}" for i in range(5)])
    return segment.predict(rows, model).select("z", "y", "x", "label", "prediction")


# cells

_TWO = "near AS (SELECT a.cell_id AS id1, b.cell_id AS id2, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS dist FROM cell a JOIN cell b ON a.cell_id % 2 = 0 AND b.cell_id % 2 = 1), two AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS nxt FROM near WINDOW w AS (PARTITION BY id1 ORDER BY dist, id2)), hit AS (SELECT id1, id2 FROM two WHERE r = 1 AND dist < 5 AND (nxt IS NULL OR dist < 0.7 * nxt))"


@query("SELECT id1, id2 FROM hit", "cell")
def cell_matches(s, d):
    return cells.matches(cell(s, d, 0), cell(s, d, 1)).select("id1", "id2")


@query("SELECT cell_id FROM cell WHERE cell_id NOT IN (SELECT id2 FROM hit)", "cell")
def cell_dedup_2nn(s, d):
    return cells.deduplicate(cell(s, d, 0), cell(s, d, 1)).select("cell_id")


for _name in ("cell_matches", "cell_dedup_2nn"):
    SQL[_name] = SQL[_name].replace(f"cell AS ({VIEWS['cell']})", f"cell AS ({VIEWS['cell']}), {_TWO}", 1)


@query("SELECT c_custkey, c_acctbal >= 1000 AND c_acctbal <= 5000 AND c_custkey >= 100 AND c_custkey <= 900 AND c_nationkey >= 3 AND c_nationkey <= 20 AS inside FROM customer")
def overlap_box(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("z"), F.col("c_custkey").cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("x"))
    return c.select("c_custkey", cells.in_box(c, {"z": 1000, "y": 100, "x": 3}, {"z": 5000, "y": 900, "x": 20}).alias("inside"))


def _fold(tiles_: int) -> str:
    """Cells taken in tile by tile: o<k> are those of tile k that one of an earlier tile matches which is in."""
    near = "near AS (SELECT a.cell_id AS id1, b.cell_id AS id2, b.cell_id % {n} AS t2, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS dist FROM cell a JOIN cell b ON a.cell_id % {n} < b.cell_id % {n})".replace("{n}", str(tiles_))
    two = "two AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS nxt FROM near WINDOW w AS (PARTITION BY id1, t2 ORDER BY dist, id2))"
    hit = "hit AS (SELECT id1, id2, t2 FROM two WHERE r = 1 AND dist < 20 AND (nxt IS NULL OR dist < 0.9 * nxt)), o0 AS (SELECT id2 FROM hit WHERE false)"
    steps = [f"o{k} AS (SELECT id2 FROM o{k - 1} UNION SELECT id2 FROM hit WHERE t2 = {k} AND id1 NOT IN (SELECT id2 FROM o{k - 1}))" for k in range(1, tiles_)]
    return ", ".join([near, two, hit, *steps])


@query("SELECT cell_id FROM cell WHERE cell_id NOT IN (SELECT id2 FROM o4)", "cell")
def merge_cells(s, d):
    c = cell(s, d).withColumns({"row": (F.col("cell_id") % 5).cast("int"), "col": F.lit(0)})
    return cells.merge_tiles(c, lowe_ratio=0.9, distance_max=20.0).select("cell_id")


SQL["merge_cells"] = SQL["merge_cells"].replace(f"cell AS ({VIEWS['cell']})", f"cell AS ({VIEWS['cell']}), {_fold(5)}", 1)


# atlas

_REGION = "idc AS (SELECT cell_id, c.z, c.y, c.x, coalesce(id, 0) AS id FROM acell c LEFT JOIN atl a ON a.z = floor(c.z / 2.5) AND a.y = floor(c.y / 2.5) AND a.x = floor(c.x / 2.5))"


def _ids(s, d):
    return atlas.cell_regions(acells(s, d), atl(s, d), SCALE)


for _name, _run, _text in (
    ("atlas_lookup", lambda s, d: _ids(s, d).select("cell_id", "id"), "SELECT cell_id, id FROM idc"),
    ("region_count", lambda s, d: atlas.region_counts(_ids(s, d)), "SELECT id, count(*) AS n FROM idc WHERE id <> 0 GROUP BY id"),
    ("painted_count", lambda s, d: atlas.painted_counts(_ids(s, d), atl(s, d)), "SELECT z, y, x, coalesce(n, 0) AS n FROM atl LEFT JOIN (SELECT id, count(*) AS n FROM idc WHERE id <> 0 GROUP BY id) USING (id)"),
    ("region_density", lambda s, d: atlas.region_density(_ids(s, d), atl(s, d)).withColumn("density", F.round("density", 6)), "SELECT id, n, voxels, round(n / voxels, 6) AS density FROM (SELECT id, count(*) AS n FROM idc WHERE id <> 0 GROUP BY id) JOIN (SELECT id, count(*) AS voxels FROM atl GROUP BY id) USING (id)"),
    ("point_region", lambda s, d: atlas.region_at(atl(s, d), 2.7, 3.9, 6.0), "SELECT id FROM atl WHERE z = 2 AND y = 3 AND x = 6"),
):
    QUERIES[_name] = _run
    SQL[_name] = sql(_text, "atl", "acell").replace(f"acell AS ({VIEWS['acell']})", f"acell AS ({VIEWS['acell']}), {_REGION}", 1)

QUERIES["presence_density"] = lambda s, d: atlas.presence_density(acells(s, d), SCALE, 1.0, 3).withColumn("density", F.round("density", 6))
SQL["presence_density"] = sql("SELECT z, y, x, round(a2.v, 6) AS density FROM vox JOIN a2 USING (z, y, x)", "acell").replace(f"acell AS ({VIEWS['acell']})", f"acell AS ({VIEWS['acell']}), vox AS (SELECT DISTINCT CAST(floor(z / 2.5) AS INTEGER) AS z, CAST(floor(y / 2.5) AS INTEGER) AS y, CAST(floor(x / 2.5) AS INTEGER) AS x, 1 AS v FROM acell), {_blur_sql('a', 1.0, 3)}", 1)


def _climb(n: int) -> str:
    return f"SELECT coalesce(m.acronym, 'unknown') AS name, CAST(sum(o.n) AS BIGINT) AS n FROM (SELECT id, count(*) AS n FROM oid GROUP BY id) o LEFT JOIN (SELECT t.id, t.anc FROM tree t JOIN (SELECT id, max(up) + 1 AS size FROM tree GROUP BY id) z ON z.id = t.id WHERE t.up = CASE WHEN {n} <= 10 - size OR size = 1 THEN 0 WHEN size > {n} - (10 - size) + 1 THEN {n} - (10 - size) ELSE size - 2 END) p ON p.id = o.id LEFT JOIN node m ON m.id = p.anc GROUP BY 1"


for _n in (0, 7, 9):
    _f = lambda s, d, n=_n: atlas.ontology_counts(order_ids(s, d), ontology(s, d), n)
    _f.__name__ = f"ontology_rollup_{_n}"
    query(_climb(_n), "tree", "oid")(_f)

NAMES = ["root", "ASIA", "EUROPE", "FRANCE"]
_IN = ", ".join(f"'{x}'" for x in NAMES)


@query(f"SELECT r.acronym, count(o.id) AS n FROM (SELECT id, acronym FROM node WHERE acronym IN ({_IN})) r JOIN tree t ON t.anc = r.id LEFT JOIN oid o ON o.id = t.id GROUP BY 1", "tree", "oid")
def acronym_count(s, d):
    return atlas.counts_by_acronym(order_ids(s, d), ontology(s, d), NAMES)


@query("SELECT z, y, x, id IN (SELECT t.id FROM tree t JOIN node r ON t.anc = r.id WHERE r.acronym IN ('ASIA', 'EUROPE')) AS inside FROM atl", "tree", "atl")
def area_mask(s, d):
    return atlas.area_mask(atl(s, d), ontology(s, d), ["ASIA", "EUROPE"])


# streaming and display


@query("SELECT user_id AS tile, count(*) AS n_frames FROM events GROUP BY 1 HAVING count(*) >= 60")
def stream_complete_tiles(s, d):
    """Replay of the events as a stream that ends; the result is the last state of its sink."""
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet" if not _folder(s, f"{d}/events.parquet") else "*").parquet(d if not _folder(s, f"{d}/events.parquet") else f"{d}/events.parquet")
    out = f"{morphology.shared_folder(s)}/live-{uuid.uuid4().hex}"
    frames_ = stream.select(F.col("user_id").alias("tile"))
    live.run_available(live.complete_tiles(frames_, ["tile"], 60), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{out}-checkpoint")
    return s.read.parquet(out).groupBy("tile").agg(F.max("n_frames").alias("n_frames"))


def _folder(s: SparkSession, path: str) -> bool:
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT path, row, col, CAST(col * 75.0 / 4 AS DOUBLE) AS at_x, CAST(row * 70.0 / 4 AS DOUBLE) AS at_y, CASE WHEN (row + col) % 2 = 0 THEN 'red' ELSE 'green' END AS colour FROM grid", "grid")
def layer_manifest(s, d):
    t = tiles(s, d)
    return pipelines.layers(t, graph.expected_registration(t, 75, 70), downsample=4).select("path", "row", "col", "at_x", "at_y", "colour")


@query("SELECT coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, coalesce(a.v, 0) AS v1, coalesce(b.v, 0) AS v2, coalesce(a.v, 0) - coalesce(b.v, 0) AS diff FROM (SELECT y, x, v FROM vox WHERE z = 3) a FULL JOIN (SELECT y, x, v FROM vox WHERE z = 4) b ON a.y = b.y AND a.x = b.x", "vox")
def compare_slices(s, d):
    return pipelines.compare_stitching(project.slice_at(vox(s, d), "z", 3), project.slice_at(vox(s, d), "z", 4))
