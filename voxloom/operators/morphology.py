"""Binary morphology, connected components and objects of sparse voxels ``(z, y, x)``; labels in column ``label``."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COORDS = ("z", "y", "x")
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
#: Side of the blocks within which components are found before they are joined.
BLOCK = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for local masters that set none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or "file://" + tempfile.mkdtemp(prefix="voxloom-")


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _sent(mask: DataFrame, by: list[str]) -> DataFrame:
    steps = F.array(*[F.struct(*[F.lit(k).alias(f"_d{a}") for a, k in zip(COORDS, s, strict=True)]) for s in [(0, 0, 0), *SIX]])
    return mask.select(*by, *COORDS, F.inline(steps)).select(*by, *[(F.col(a) + F.col(f"_d{a}")).cast("int").alias(a) for a in COORDS])


def erode(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Voxels that are there with all six neighbours."""
    by = by or []
    return _sent(mask.select(*by, *COORDS).distinct(), by).groupBy(*by, *COORDS).count().where("count = 7").drop("count")


def dilate(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Voxels that are there or next to one."""
    return _sent(mask, by or []).distinct()


def opening(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Erosion, then dilation, by the six-neighbour cross."""
    return dilate(erode(mask, by), by)


def closure(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that each node of edges ``(u, v)`` reaches.

    Rounds of two steps: every node takes the least label around it, then labels take their own labels, which halves
    paths; rows follow nodes and edges, and rounds grow with the logarithm of a component's length.
    """
    both = durable(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("n2")).agg(F.min("label").alias("least"))
        new = labels.join(near, labels.node == near.n2).select("node", F.least("label", "least").alias("label"))
        jump = new.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = durable(new.join(jump, new.label == jump._n, "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "_old"), "node").where("label <> _old").limit(1).count()
        labels = new
        if not changed:
            return labels


def connected_components(mask: DataFrame, by: list[str] | None = None, shape: tuple[int, int] = (1 << 20, 1 << 20), block: int = BLOCK) -> DataFrame:
    """``z, y, x, label`` of six-connected objects; label: the least voxel number, (z * shape[0] + y) * shape[1] + x + 1.

    Blocks find their own objects first, so only objects that meet at faces of blocks take part in the rounds.  With by,
    labels are those within each group, and negative voxels must not occur.
    """
    by = by or []
    number = ((F.col("z").cast("long") * shape[0] + F.col("y")) * shape[1] + F.col("x") + 1).alias("id")
    rows = mask.select(*by, *COORDS).distinct().withColumn("id", number)
    for a in COORDS:
        rows = rows.withColumn(f"_b{a}", F.floor(F.col(a) / block).cast("int"))

    def local(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        z, y, x = (p[a].to_numpy() - p[a].min() + 1 for a in COORDS)
        grid = np.zeros((z.max() + 2, y.max() + 2, x.max() + 2), np.int64)
        grid[z, y, x] = np.arange(len(p)) + 1
        up = np.arange(len(p) + 1)

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for dz, dy, dx in SIX[::2]:
            other = grid[z + dz, y + dy, x + dx]
            for k in np.flatnonzero(other):
                a, b = root(k + 1), root(int(other[k]))
                up[max(a, b)] = min(a, b)
        ids = p["id"].to_numpy()
        return p.assign(label=ids[[root(k + 1) - 1 for k in range(len(p))]])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", label long"
    found = durable(rows.groupBy(*by, "_bz", "_by", "_bx").applyInPandas(local, schema))
    tagged = found.select(*by, *COORDS, F.struct(*by, "label").alias("node"))
    links = None
    for a in COORDS:
        edge = tagged.where(F.pmod(F.col(a), F.lit(block)) == block - 1).select(*by, *[(F.col(c) + (1 if c == a else 0)).alias(c) for c in COORDS], F.col("node").alias("u"))
        part = edge.join(tagged.where(F.pmod(F.col(a), F.lit(block)) == 0), [*by, *COORDS]).select("u", F.col("node").alias("v"))
        links = part if links is None else links.unionAll(part)
    links = durable(links.distinct())
    if links.isEmpty():
        return found.select(*by, *COORDS, "label")
    joined = closure(links)
    got = found.withColumn("node", F.struct(*by, "label")).join(joined.withColumnRenamed("label", "_new"), "node", "left")
    return got.select(*by, *COORDS, F.coalesce(F.col("_new.label"), F.col("label")).alias("label"))


def volumes(labels: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``label, volume``: voxels of each label, or the sum of a weight (particles: 8 ** (l_max - level))."""
    total = F.sum(weight).cast("long") if weight else F.count("*")
    return labels.where("label <> 0").groupBy(*(by or []), "label").agg(total.alias("volume"))


def size_filter(labels: DataFrame, least: int = 0, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Objects of least .. most voxels."""
    by = by or []
    ok = volumes(labels, by).where(F.col("volume") >= least)
    ok = ok if most is None else ok.where(F.col("volume") <= most)
    return labels.join(ok.select(*by, "label"), [*by, "label"], "left_semi")


def without_edge_objects(labels: DataFrame, shape: tuple[int, int, int], z_edges: bool = True, by: list[str] | None = None) -> DataFrame:
    """Objects that don't touch the border; z_edges: the first and last planes count as border."""
    by = by or []
    border = F.lit(False)
    for a, n in zip(COORDS, shape, strict=True):
        if a != "z" or z_edges:
            border |= (F.col(a) <= 0) | (F.col(a) >= n - 1)
    return labels.join(labels.where(border).select(*by, "label").distinct(), [*by, "label"], "left_anti")


def centers(labels: DataFrame, by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """``label, z, y, x``: centre of each object, weighted by a value if given."""
    w = F.col(value) if value else F.lit(1)
    return labels.where("label <> 0").groupBy(*(by or []), "label").agg(*[(F.sum(F.col(a) * w) / F.sum(w)).alias(a) for a in COORDS])


def map_feature(labels: DataFrame, features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """labels with the value of each object, 0 for the background; features: ``(label, value)``.

    A label without a feature is an error.
    """
    by = by or []
    got = labels.join(features, [*by, "label"], "left")
    missing = F.raise_error(F.lit("features do not match the objects")).cast("double")
    return got.withColumn("value", F.when(F.col("label") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("value").cast("double"), missing)))
