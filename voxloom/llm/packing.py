"""Packing token sequences: non-negative least squares over length combinations.

Documents of n tokens give n // WINDOW full windows and a rest.  The histogram of rests, a number for each length,
is all that the plan needs: combinations of two and three lengths that fill a window exactly are enumerated, repeat
counts solved so that the combinations use up the histogram (least squares, counts at least 0), rounded down and made
to fit.  What is left is packed greedily, longest first, by cutting at window ends; the last window is cut at powers of
two, which need no padding.

Which document takes which place follows from its rank among documents of its rest's length.  Ranks come from counts by
(partition, length), so neither a hot length nor the order of tasks matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stage, table, texts
from .tokens import default_path, encoder

WINDOW = 1024
END = 0
ROUNDS = 300
#: Rows of the table of ranks (partitions times lengths) up to which it is broadcast: about 60 MB at the 110 bytes that a
#: row of a broadcast table takes. Beyond, the documents are joined by partition and length.
BROADCAST_ROWS = 500_000


def combinations(lengths: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Pairs and triples of the given lengths, in order within each, that add up to the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = np.flatnonzero(have[: window // 2 + 1])
    pairs = np.stack([a, window - a], 1)[have[window - a]]
    b = np.flatnonzero(have)
    x, y = (g.ravel() for g in np.meshgrid(b, b, indexing="ij"))
    z = window - x - y
    ok = (x <= y) & (y <= z)
    ok[ok] = have[z[ok]]
    return [pairs[pairs[:, 0] > 0], np.stack([x, y, z], 1)[ok & (x > 0)]]


def solve(counts: np.ndarray, combos: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Repeat counts x >= 0 of the combinations that make the lengths' totals as near to counts as they get.

    Projected gradient with momentum on the squared error; each combination's step is scaled by how many share its
    lengths.
    """
    size = np.zeros(len(counts))
    for c in combos:
        size += np.bincount(c.ravel(), minlength=len(counts))
    step = [1 / (np.maximum(size[c], 1).sum(1)) for c in combos]
    x = [np.zeros(len(c)) for c in combos]
    ahead, t = [v.copy() for v in x], 1.0
    for _ in range(rounds):
        error = -counts.astype(float)
        for c, v in zip(combos, ahead, strict=True):
            for k in range(c.shape[1]):
                error += np.bincount(c[:, k], v, minlength=len(counts))
        new = [np.maximum(0, v - s * error[c].sum(1)) for c, v, s in zip(combos, ahead, step, strict=True)]
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = [n + (old - 1) / t * (n - v) for n, v in zip(new, x, strict=True)]
        x = new
    return x


class Plan:
    """Places of rests. counts: documents by the length of their rest, index 0 to window - 1."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        left = counts.astype(np.int64).copy()
        left[0] = 0
        combos = combinations(np.flatnonzero(left), window)
        runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window)]  # first rank, count, first sequence, offset
        used = np.zeros(window, np.int64)
        self.sequences = 0
        weights = solve(left, combos)
        todo = sorted(((-w, tuple(c)) for cs, ws in zip(combos, weights, strict=True) for w, c in zip(ws[ws >= 1], cs[ws >= 1].tolist(), strict=True)))
        for w, combo in todo:
            times = min([int(-w), *(int(left[x]) // combo.count(x) for x in combo)])
            offset = 0
            for x in combo if times else ():
                runs[x].append((int(used[x]), times, self.sequences, offset))
                used[x] += times
                left[x] -= times
                offset += x
            self.sequences += times
        # what is left forms one stream, longest first, cut at window ends
        self.window, self.used, self.runs = window, used, [np.array(r, np.int64).reshape(-1, 4) for r in runs]
        order = np.arange(window)[::-1]
        at = np.zeros(window, np.int64)
        at[order] = np.cumsum(left[order] * order) - left[order] * order
        self.stream = at
        total = int((left * np.arange(window)).sum())
        self.tail = total - total % window
        rest, self.tail_cuts = total % window, [self.tail]
        for k in range(window.bit_length() - 1, -1, -1):
            if rest >> k & 1:
                self.tail_cuts.append(self.tail_cuts[-1] + (1 << k))
        self.sequences += self.tail // window + len(self.tail_cuts) - 1

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the rest, length, sequence, offset) of the rest with this rank among those of its length."""
        if rank < self.used[length]:
            r = self.runs[length]
            k = int(np.searchsorted(r[:, 0], rank, side="right")) - 1
            return [(0, length, int(r[k, 2]) + rank - int(r[k, 0]), int(r[k, 3]))]
        begin = int(self.stream[length]) + (rank - int(self.used[length])) * length
        first = self.sequences - self.tail // self.window - len(self.tail_cuts) + 1
        out, at = [], begin
        while at < begin + length:
            if at < self.tail:
                k = at // self.window
                low, high = k * self.window, (k + 1) * self.window
            else:
                j = int(np.searchsorted(self.tail_cuts, at, side="right")) - 1
                k, low, high = self.tail // self.window + j, self.tail_cuts[j], self.tail_cuts[j + 1]
            n = min(high, begin + length) - at
            out.append((at - begin, n, first + k, at - low))
            at += n
        return out


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, window: int = WINDOW) -> DataFrame:
    """Documents' ids with the end id, and each one's rank within its partition: among rests of its length (``nth``), and
    of its full windows (``full_nth``)."""
    bounded_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path).encode
        seen, full, part = np.zeros(window, np.int64), 0, TaskContext.get().partitionId()
        for b in batches:
            ids, n, rest, nth, full_nth = [], [], [], [], []
            for t in texts(b, "text"):
                x = code(t) + tail
                k = len(x) // 4
                r = k % window
                ids.append(x), n.append(k), rest.append(r), nth.append(int(seen[r])), full_nth.append(full)
                seen[r] += 1
                full += k // window
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, rest, nth, full_nth, [part] * len(n)))], names=["id", "ids", "n", "rest", "nth", "full_nth", "part"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary, n long, rest long, nth long, full_nth long, part long")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, window: int = WINDOW) -> DataFrame:
    """One row a piece: ``id, start, length, ids`` (binary, little-endian 32-bit)``, doc_tokens, sequence_id, offset``.

    Null texts count as empty and give their end id; rows with repeated or null ids are packed each; a text longer than
    a window fills windows of its own.  Other columns, whatever their names, are left aside.  Empty table: no rows.  Sequences have at most ``window`` tokens; all but up to ten have exactly so many, and those are powers of two.
    """
    spark = docs.sparkSession
    rows = stage(tokenized(docs, path or default_path(), id_col, text_col, end, window), "tokens")
    counts = rows.groupBy("part", F.col("rest").alias("rest")).agg(F.count("*").alias("c"))
    full = rows.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).alias("c")).select("part", F.lit(window).cast("long").alias("rest"), "c")
    before = F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c")
    base = stage(counts.unionByName(full).withColumn("base", before), "ranks")
    hist, fulls = np.zeros(window, np.int64), 0
    for r in base.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # a row a length
        if r.rest == window:
            fulls = r.c
        else:
            hist[r.rest] = r.c
    plan = spark.sparkContext.broadcast(Plan(hist, window))  # bounded by the window, whatever the documents are
    of_full = base.where(f"rest = {window}").select("part", F.col("base").alias("full_base"))
    base = base.where(f"rest < {window}").select("part", "rest", "base").join(of_full, "part")
    placed = rows.join(F.broadcast(base) if base.count() <= BROADCAST_ROWS else base, ["part", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for id_, ids, n, rest, rank, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = [(k * window, window, seq + k, 0) for k in range(n // window)]
                if rest:
                    found += [(n - rest + s, m, fulls + q, o) for s, m, q, o in plan.value.pieces(rest, rank)]
                for s, m, q, o in found:
                    for column, x in zip(out, (id_, s, m, ids[4 * s : 4 * (s + m)], n, q, o), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = placed.select("id", "ids", "n", "rest", (F.col("base") + F.col("nth")).alias("rank"), (F.col("full_base") + F.col("full_nth")).alias("seq"))
    return placed.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
