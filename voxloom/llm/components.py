"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node with an edge to another one; component: the smallest node reachable.

    Each round is two grouped minima and two joins on the node, both of which Spark can split where a hub has a large
    share of the edges.  Self-loops and edges with a null end are ignored.  No edges: no rows.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stage(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("y0")).select("x", F.least("x", "y0").alias("m"))
        large = stage(both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stage(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large), discard(old)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
