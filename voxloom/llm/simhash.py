"""SimHash near-duplicates by anchor-point covering.

A fingerprint is linked to another if at most ``DISTANCE`` of 64 bits differ.  The bits are cut into blocks, each with
a covering code and an allowance t such that the allowances plus one add up to more than the distance: two linked
fingerprints differ by at most t bits in one block.  In that block each fingerprint is replicated to every code word
(anchor) within covering radius + t, and compared with those whose nearest anchor it is.  As the nearest anchor of a
lies within the radius, any b within t of it has been replicated there: no link is lost.

23-bit blocks use the perfect binary Golay code (radius 3), other bits stand for themselves (radius 0).

Fingerprints of four-word shingles at 4 bits are what :func:`near_duplicates` takes; :func:`keep_one` takes five-word
shingles at 7 bits, what a similarity of 0.9 gives on average.  The similarity itself is not computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage, texts
from .components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: (first bit, Golay bits, plain bits, allowance) of each block.
NARROW = ((0, 23, 0, 1), (23, 23, 0, 1), (46, 0, 18, 0))
#: Two halves, 21-bit anchors: more replicas and far smaller buckets, for large corpora.
WIDE = ((0, 23, 9, 2), (32, 23, 9, 1))
#: Shingle and distance of the documents that keep_one takes for copies, and the layouts of each distance.
KEEP_SHINGLE, KEEP_DISTANCE = 5, 7
LAYOUTS = {4: (NARROW, WIDE), 7: (((0, 23, 0, 2), (23, 23, 0, 2), (46, 0, 18, 1)), ((0, 23, 9, 3), (32, 23, 9, 3)))}
WIDE_FROM = 50_000_000
#: Rows of one comparison; larger buckets are split into pairs of chunks.
CHUNK = 16_384
GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RADIUS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 without words."""
    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n < 1:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[k : k + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long; null texts count as empty.  Repeated rows stay."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b, "text")], dtype="<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache
def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndrome contributions of the 23 bits, and for each weight the words of that weight."""
    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    base = np.array([remainder(1 << k) for k in range(23)], dtype=np.int64)
    # all words up to weight RADIUS + 3, by weight
    words, layer = [], np.zeros(1, np.int64)
    for _ in range(RADIUS + 4):
        words.append(layer)
        bits = (np.int64(1) << np.arange(23))[None, :]
        grown = layer[:, None] | bits
        layer = np.unique(grown[(layer[:, None] < bits)])
    return base, words


def syndrome(x: np.ndarray) -> np.ndarray:
    base, _ = _golay()
    out = np.zeros_like(x)
    for k in range(23):
        out ^= np.where(x >> k & 1, base[k], 0)
    return out


@lru_cache
def _cosets(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns up to a weight, sorted by syndrome: starts for each of 2048 syndromes, words, weights."""
    _, words = _golay()
    every, weight = np.concatenate(words[: radius + 1]), np.concatenate([np.full(len(w), k) for k, w in enumerate(words[: radius + 1])])
    s = syndrome(every)
    order = np.lexsort((every, weight, s))
    return np.searchsorted(s[order], np.arange(2049)), every[order], weight[order]


def anchors(fp: np.ndarray, block: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchors and whether the anchor is the row's nearest one."""
    first, coded, plain, allow = block
    part = (fp >> np.uint64(first)).astype(np.int64) & ((1 << coded + plain) - 1)
    rows = np.arange(len(fp))
    if not coded:
        flips = np.array(_flips(plain, allow), np.int64)
        return np.repeat(rows, len(flips)), (part[:, None] ^ flips[None, :]).ravel(), np.tile(flips == 0, len(fp))
    low, high = part & ((1 << 23) - 1), part >> 23
    start, words, weight = _cosets(RADIUS + allow)
    s = syndrome(low)
    counts = start[s + 1] - start[s]
    who = np.repeat(rows, counts)
    at = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start[s], counts)
    anchor, far, out = low[who] ^ words[at], weight[at], []
    for flips in _flips(plain, allow + RADIUS):  # plain bits: code words at a distance of their own
        left = RADIUS + allow - bin(flips).count("1")
        ok = far <= left
        out.append((who[ok], anchor[ok] | (high[who[ok]] ^ flips) << 23, (far[ok] <= RADIUS) & (flips == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@lru_cache
def _flips(bits: int, most: int) -> list[int]:
    return [x for x in range(1 << bits) if bin(x).count("1") <= most] if bits else [0]


def _replicate(fps: DataFrame, layout: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k, block in enumerate(layout):
                who, anchor, home = anchors(fp.view(np.uint64), block)
                key = (np.int64(k) << 40) | anchor
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[who]), pa.array(rep[who]), pa.array(np.where(home, 2, 0).astype(np.int32))], names=["key", "fp", "rep", "role"])

    return fps.select("fp", "rep").mapInArrow(run, "key long, fp long, rep long, role int")


def _links(fp: np.ndarray, rep: np.ndarray, role: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between the homes (role 1, 2) and the replicas (0, 2) of one bucket."""
    homes = np.flatnonzero(role > 0)
    if not len(homes) or len(fp) < 2:
        return rep[:0], rep[:0]
    order = np.argsort(rep, kind="stable")
    fp, homes = fp[order].view(np.uint64), np.argsort(order)[homes]
    rep = rep[order]
    label = np.arange(len(fp))  # the lowest row of the set, that is, the lowest representative
    step = max(1, (1 << 21) // len(fp))
    for k in range(0, len(homes), step):
        some = homes[k : k + step]
        near = np.bitwise_count(fp[some][:, None] ^ fp[None, :]) <= distance
        near[np.arange(len(some)), some] = True
        for i in np.flatnonzero(near.sum(1) > 1):
            found = label[near[i]]
            if (found != found[0]).any():
                sets = np.unique(found)
                label[np.isin(label, sets)] = sets[0]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return rep[moved], rep[label[moved]]


def _compare(rows: DataFrame, distance: int) -> DataFrame:
    """Links within runs of equal (key, part); rows come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def closed(cols: list[np.ndarray]) -> pa.RecordBatch:
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            found = [_links(cols[2][a:b], cols[3][a:b], cols[4][a:b], distance) for a, b in zip([0, *cut], [*cut, len(cols[0])], strict=True) if b - a > 1]
            a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(cols[0]):
                continue
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]
            if last:
                yield closed([c[:last] for c in cols])
            kept = [c[last:] for c in cols]
        if kept is not None:
            yield closed(kept)

    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, layout: tuple | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)``: links between representatives of distinct fingerprints, enough to connect all that are linked.

    fps: ``(fp, rep)``, one row a fingerprint.  Buckets over ``chunk`` rows are dealt out as pairs of chunks, so that no
    task holds more than two of them.
    """
    layout = layout or LAYOUTS[distance][fps.count() >= WIDE_FROM]
    if sum(allow + 1 for *_, allow in layout) <= distance:
        raise ValueError("the layout doesn't cover the distance")
    rows = _replicate(fps, layout)
    hot = rows.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    hot = stage(hot, "hot-anchors")
    if hot.isEmpty():
        dealt = rows.select("key", F.lit(0).alias("part"), "fp", "rep", "role")
    else:
        j = rows.join(hot, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        own = F.pmod(F.hash("rep"), F.col("n"))
        calm = j.where("n = 1").select("key", F.lit(0).alias("part"), "fp", "rep", "role")
        split = j.where("n > 1").withColumn("own", own)
        homes = split.where("role = 2").select("key", F.explode(F.expr("transform(sequence(0, n - 1), k -> own * n + k)")).alias("part"), "fp", "rep", F.lit(1).alias("role"))
        others = split.select("key", F.explode(F.expr("transform(sequence(0, n - 1), k -> k * n + own)")).alias("part"), "fp", "rep", F.lit(0).alias("role"))
        dealt = calm.unionAll(homes).unionAll(others)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return _compare(dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part"), distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: tuple | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(id, fp, component_id)``: each document with the smallest id that near-duplicate links reach.

    Rows with a null id are fingerprinted and returned with a null component; equal fingerprints (all texts without
    words among them) are one class.  Empty table: no rows.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    comp = components(links(classes, layout=layout, chunk=chunk), "a", "b")
    classes = classes.join(comp, classes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(stage(classes, "class-components"), "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those near-duplicates whose component has a smaller id; one row stays of repeated ids with
    equal fingerprints, or with fingerprints of one component.  Other texts under a repeated id are judged by themselves.

    Copies are texts whose fingerprints of ``KEEP_SHINGLE``-word shingles differ in at most ``KEEP_DISTANCE`` bits: a
    similarity of 0.9 gives 7 on average, one of 0.8 gives 10.  Rows with a null id stay; long texts are taken whole; no
    rows: no rows; other columns stay as they are.
    """
    bounded_batches(docs.sparkSession)
    # docs' columns travel within a struct: whatever their names, they don't meet those made here
    bare = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = bare.select("row", "_id").schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, KEEP_SHINGLE) for t in texts(b, "_text")], dtype="<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=["row", "_id", "_fp"])

    rows = stage(bare.mapInArrow(run, schema), "with-fingerprints")
    classes = stage(rows.where("_id is not null").groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("id")), "classes")
    comp = components(links(classes.select("fp", F.col("fp").alias("rep")), KEEP_DISTANCE), "a", "b")
    first = classes.join(comp, classes.fp == comp.node, "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min(F.struct("id", "fp")).alias("m"))
    first = stage(first.select(F.col("m.id").alias("_first"), F.col("m.fp").alias("_of")), "first-rows")
    kept = rows.where("_id is not null").join(first, (F.col("_id") == F.col("_first")) & (F.col("_fp") == F.col("_of")), "left_semi")
    if not kept.groupBy("_id", "_fp").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_fp"])
    return rows.where("_id is null").unionByName(kept).select("row.*")
