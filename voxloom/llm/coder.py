"""The adaptive context-mixing range coder of id sequences (``java/TokenCoder.java``) as SQL functions.

A sequence is ids as little-endian unsigned 32-bit integers.  Its blocks are coded apart: each starts from an empty model
and has a checksum.  An adaptive model is followed id by id, which is no work for array operations, so this runs in the
executors' JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import jvm

BLOCK = 8_192


def encode(spark: SparkSession, ids: Column, block: int = BLOCK) -> Column:
    """The coded sequence (binary); null for null."""
    return F.call_function(jvm.register(spark, "voxloom_tokens_encode", "TokenCoder", "Encode", "binary"), ids, F.lit(block))


def decode(spark: SparkSession, data: Column) -> Column:
    """The ids of a coded sequence; the query fails on damaged data."""
    return F.call_function(jvm.register(spark, "voxloom_tokens_decode", "TokenCoder", "Decode", "binary"), data)


def cut(spark: SparkSession, ids: Column, sizes: Column) -> Column:
    """An array of the runs of ids that have these sizes (32-bit integers); the query fails if they aren't all of them."""
    return F.call_function(jvm.register(spark, "voxloom_tokens_cut", "TokenCoder", "Cut", "array<binary>"), ids, sizes)
