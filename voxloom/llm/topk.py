"""Exact top-k inner products by the three-phase uniform threshold.

The dimensions are cut into lists; a vector's score is the sum of its partial scores in the lists.

1. Each partition reports the k best entries of each list and the lists' least partial scores.  Sums over what a vector
   is known to have, and the least elsewhere, bound scores from below: the k-th best bound of a query is a safe cutoff.
2. The cutoff is broadcast.  A vector at or above it has a partial score of at least cutoff / lists in one of the lists:
   partitions report those entries, and their sums, with the threshold where a list did not report, bound scores from
   above.
3. Vectors whose upper bound reaches the cutoff, raised by what phase 2 has found, have their scores resolved exactly.

Queries are taken in blocks of bounded size, so a cutoff table is bounded as well.  All sums are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stage, table

LISTS = 2
#: Queries of a block: with 64 dimensions, 4 MB.
BLOCK = 8_192
#: Scores in memory at once.
CELLS = 1 << 21
SCALE = 256


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with whole numbers floor(scale * x) in doubles.  Rows with a null id or vector, and vectors with null or
    non-finite components, are left out."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    whole = F.forall(F.col(vec_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def even(rows: DataFrame) -> DataFrame:
    """rows with all vectors v as long as the longest: what a shorter one lacks counts as zero."""
    size = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if size[0] == size[1]:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size[1]) - F.size("v"))))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _partials(query: np.ndarray, vectors: np.ndarray, lists: int) -> list[np.ndarray]:
    cuts = np.linspace(0, query.shape[1], lists + 1).astype(int)
    return [query[:, a:b] @ vectors[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k best scores."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.argpartition(-score, k - 1, axis=1)[:, :k]


def _rows(q, v, j, s, names=("q", "id", "list", "s")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (q, v, j, s)], names=list(names))


ENTRY = "q long, id long, list long, s long"


def top_k(vectors: DataFrame, is_query, k: int = 5, lists: int = LISTS, block: int = BLOCK, distinct: bool = True) -> DataFrame:
    """``(query_id, rank, id, score)`` of the k best other vectors of each query, ties to the smaller id.

    vectors: ``(id, v)``, shorter vectors as if filled up with zeros; a query takes no part among its own id's rows.
    Every row is an entry of its own, but equal rows are one if ``distinct``; of an id's query rows, the best scores of
    all count.  is_query: a condition on id.  Fewer than k candidates: all of them.  No queries: no rows.
    """
    spark = vectors.sparkSession
    rows = stage((vectors.select("id", "v").distinct() if distinct else vectors.select("id", "v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows = even(rows)
    total = rows.where(is_query).count()
    parts = -(-total // block)
    folder = new_path(spark, "top-k")
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    empty.write.parquet(folder)
    for b in range(max(parts, 1)):
        mine = rows.where(is_query & (F.pmod(F.xxhash64("id"), F.lit(max(parts, 1))) == b)).orderBy("id")
        got = mine.toArrow()  # one block
        if got.num_rows:
            block_ = _block(spark, rows, np.array(got.column("id")), _matrix(got.column("v").combine_chunks()), k, lists)
            block_.write.mode("append").parquet(folder)  # so that a later block's plan doesn't hold those before it
    return spark.read.schema(empty.schema).parquet(folder)


def _block(spark, rows: DataFrame, ids: np.ndarray, query: np.ndarray, k: int, lists: int) -> DataFrame:
    shared = spark.sparkContext.broadcast((ids, query))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, query = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v, m, row = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            step = max(1, CELLS // len(m))
            for a in range(0, len(ids), step):
                yield ids[a : a + step], v, row, _partials(query[a : a + step], m, lists), ids[a : a + step][:, None] == v[None, :], a

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1; q: the query's number in the block, id: the entry's row. list >= 0: entries with their partial scores; list < 0: -1 - list's least score."""
        for ids, _, row, scores, own, a in chunks(batches):
            q = np.arange(a, a + len(ids))
            for j, s in enumerate(scores):
                masked = np.where(own, -np.inf, s)
                at = _best(masked, row, k)
                got = np.take_along_axis(masked, at, 1)
                ok = np.isfinite(got)
                yield _rows(np.repeat(q, ok.sum(1)), row[at][ok], np.full(ok.sum(), j), got[ok])
                yield _rows(q, np.full(len(q), -1), np.full(len(q), -1 - j), s.min(1))

    w = Window.partitionBy("q", "list").orderBy(F.desc("s"), "id")
    first = stage(rows.select("id", "v", "row").mapInArrow(local, ENTRY), "local-lists")
    best = first.where("list >= 0").withColumn("r", F.row_number().over(w)).where(f"r <= {k}")
    least = first.where("list < 0").groupBy("q").pivot("list", [-1 - j for j in range(lists)]).agg(F.min("s"))
    known = best.groupBy("q", "id").pivot("list", list(range(lists))).agg(F.max("s")).join(least, "q")
    lower = sum((F.coalesce(F.col(f"`{j}`"), F.col(f"`{-1 - j}`")) for j in range(1, lists)), F.coalesce(F.col("`0`"), F.col("`-1`")))
    w = Window.partitionBy("q").orderBy(F.desc("low"))
    bounds = known.select("q", lower.alias("low")).withColumn("r", F.row_number().over(w)).where(f"r = {k}").select("q", "low")
    cut = np.full(len(ids), -(2.0**62))  # fewer candidates than k: everything counts
    for r in bounds.collect():  # a row a query of the block
        cut[r.q] = r.low
    cutoff = spark.sparkContext.broadcast(cut)

    def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 2: the entries at or above cutoff / lists; phase 3 happens where the vector is: those whose upper bound
        reaches the cutoff are resolved, and of them the k best of the partition can matter."""
        for q, v, _, scores, own, a in chunks(batches):
            low = cutoff.value[a : a + len(q), None]
            enough = np.floor(low / lists)
            reported = [s >= enough for s in scores]
            upper = sum(np.where(r, s, enough) for r, s in zip(reported, scores, strict=True))
            open_ = np.logical_or.reduce(reported) & (upper >= low) & ~own
            exact = np.where(open_, sum(scores), -np.inf)
            exact[exact < low] = -np.inf
            if exact.shape[1] > k:
                exact[exact < -np.partition(-exact, k - 1, axis=1)[:, k - 1 : k]] = -np.inf
            i, j = np.nonzero(exact > -np.inf)
            order = np.lexsort((v[j], -exact[i, j], i))  # of ties of the k-th, the smallest ids
            i, j = i[order], j[order]
            few = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[few], j[few]
            yield _rows(q[i], v[j], np.zeros(len(i)), exact[i, j])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    got = rows.select("id", "v", "row").mapInArrow(sufficient, ENTRY).select("q", "id", "s").withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")
    return got.select(F.col("q").alias("query_id"), F.col("rank").cast("int"), "id", F.col("s").alias("score"))


def op8(spark, sf_dir: str) -> DataFrame:
    found = top_k(quantized(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, distinct=False)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL8 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
