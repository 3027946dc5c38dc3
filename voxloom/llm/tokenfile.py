"""Token-id files: ids of documents in order, coded by :mod:`coder`.

A file: ``MAGIC``, then segments.  A segment holds whole documents, about ``SEGMENT`` tokens of them, in two sections, each
``<length, crc32><bytes>``: the documents (their number, the number of tokens, then ids and numbers of tokens, deflated),
and the coded sequence of all their token ids, in blocks of ``coder.BLOCK``.  All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coder, fsio, words
from .common import bounded_batches, new_path, stage, table
from .tokens import default_path, encoder

MAGIC = b"VXTOKEN3"
#: Tokens after which a segment and a file are closed.
SEGMENT, ROLL = 1 << 20, 8 << 20
END = 2


def section(data: bytes) -> bytes:
    return struct.pack("<QI", len(data), zlib.crc32(data)) + data


def sections(f) -> Iterator[bytes]:
    """The sections of a file; ValueError for anything damaged."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := f.read(12):
        n, crc = struct.unpack("<QI", head) if len(head) == 12 else (0, -1)
        data = f.read(n)
        if len(data) != n or zlib.crc32(data) != crc:
            raise ValueError("a damaged section")
        yield data


def pack_docs(ids: list[int | None], sizes: list[int]) -> bytes:
    """The documents' section; sizes: their numbers of tokens."""
    known = np.array([i is not None for i in ids], "<u1")
    heads = np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes() + np.array(sizes, "<u4").tobytes()
    return struct.pack("<QQ", len(ids), sum(sizes)) + zlib.compress(heads, 1)


def unpack_docs(data: bytes) -> tuple[list[int | None], np.ndarray]:
    n, total = struct.unpack_from("<QQ", data)
    heads = zlib.decompress(data[16:])
    ids, known, sizes = np.frombuffer(heads, "<i8", n), np.frombuffer(heads, "<u1", n, 8 * n), np.frombuffer(heads, "<u4", n, 9 * n)
    if sizes.sum(dtype=np.int64) != total:
        raise ValueError("a damaged section")
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], sizes


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Write token files in ascending id order, nulls first; returns ``(file, docs, tokens)``.

    Names ascend with the ids.  Null texts count as empty: their end id only.  Repeated ids stay, next to each other.  No
    rows: no files.  A very long text makes a long segment of its own; it is held whole by one task.  Other columns,
    whatever their names, are left aside.
    """
    spark = docs.sparkSession
    path = path or default_path()
    bounded_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lacking, ids, sizes, coded, found, size = encoder(path).lacking, [], [], [], [], 0

        def row(*parts: bytes | None, docs: int = 0, tokens: int = 0) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts] + [pa.array([x], pa.int64()) for x in (docs, tokens)], names=["head", "ids", "keys", "found", "docs", "tokens"])

        for b in batches:
            keys, values = [], []
            for i, some, *lacks in zip(b.column(0).to_pylist(), *(c.to_pylist() for c in b.column(1).flatten()), strict=True):
                new, n = lacking(*lacks), len(some) // 4
                counts = [len(x) // 4 for x in new]
                if new:
                    open_ = np.frombuffer(some, "<i4")[:-1]
                    open_ = -1 - open_[open_ < 0]
                    n += int(np.array(counts)[open_].sum()) - len(open_)
                    if lacks[2] is None:
                        keys += filter(None, lacks[:2])
                        values += new
                ids.append(i), sizes.append(n), coded.append(some)
                found += struct.pack(f"<{1 + len(new)}I", len(new), *counts), *new
                size += n
                if size >= SEGMENT:
                    yield row(pack_docs(ids, sizes), b"".join(coded), None, b"".join(found), docs=len(ids), tokens=size)
                    ids, sizes, coded, found, size = [], [], [], [], 0
            if keys:  # the executor learns them now, not with the segment
                yield row(None, None, b"  ".join(keys), struct.pack(f"<{1 + len(values)}I", len(values), *(len(x) // 4 for x in values)) + b"".join(values))
        if ids:
            yield row(pack_docs(ids, sizes), b"".join(coded), None, b"".join(found), docs=len(ids), tokens=size)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist() if r["head"] is not None)
        part, k, r = TaskContext.get().partitionId(), 0, next(rows, None)
        while r:
            uri, n, tokens = f"{folder}/part-{part:06d}-{k:05d}.tok", 0, 0
            with fsio.output(uri) as out:
                out.write(MAGIC)
                while r and tokens < ROLL:
                    out.write(section(r["head"])), out.write(section(r["coded"]))
                    n, tokens, r = n + r["docs"], tokens + r["tokens"], next(rows, None)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], names=["file", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")  # the same files when a task is run again
    known = ordered.select("id", words.code(spark, path, F.col("text")))
    segments = known.mapInArrow(cut, "head binary, ids binary, keys binary, found binary, docs long, tokens long")
    ids = words.fill(spark, path, F.col("ids"), F.col("keys"), F.col("found"), end)
    coded = segments.select("head", "docs", "tokens", coder.encode(spark, ids).alias("coded"))
    return stage(coded.mapInArrow(save, "file string, docs long, tokens long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """``(id, start, ids)`` of the documents of files as :func:`write` returns them; start: ids of all documents before.

    ids: binary, little-endian unsigned 32-bit.  Damaged files fail.
    """
    spark = files.sparkSession
    bounded_batches(spark)
    before = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    todo = files.select("file", before.alias("base"))  # a row a file
    todo = todo.repartition(min(10_000, max(1, files.count())), "file")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fsio.source(uri) as f:
                    parts = sections(f)
                    for head, coded in zip(parts, parts, strict=True):
                        ids, sizes = unpack_docs(head)
                        starts = start + np.cumsum(sizes, dtype=np.int64) - sizes
                        yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([sizes.astype("<u4").tobytes()], pa.binary()), pa.array([coded], pa.binary())], names=["id", "start", "sizes", "coded"])
                        start += struct.unpack_from("<QQ", head)[1]

    segments = todo.mapInArrow(load, "id array<long>, start array<long>, sizes binary, coded binary")
    ids = coder.cut(spark, coder.decode(spark, F.col("coded")), F.col("sizes"))
    return segments.select("id", "start", ids.alias("ids")).select(F.inline(F.arrays_zip("id", "start", "ids")))


def op2(spark, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read(files).select(F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
