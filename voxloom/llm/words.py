"""Token ids of texts by an executor's table of pre-tokens (``java/WordTable.java``), as SQL functions.

All ids are the library's (:meth:`tokens.Encoder.lacking`).  A text's words are mostly known, and looking them up is what
takes longest; so this runs in the executors' JVM, and Python gets what the table lacks.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import jvm
from .tokens import encoder


def code(spark: SparkSession, path: str, text: Column) -> Column:
    """``(ids, pieces, stretches, whole)``: ids with what the table lacks left open, and what it is; null reads as empty."""
    added = b"".join(struct.pack("<i", len(x)) + x for x in (t.encode() for t in encoder(path).added))
    name = jvm.register(spark, "voxloom_words_code", "WordTable", "Code", "struct<ids binary, pieces binary, stretches binary, whole binary>", path, added)
    return F.call_function(name, text.cast("binary")).alias("coded")


def fill(spark: SparkSession, path: str, ids: Column, keys: Column, found: Column, end: int) -> Column:
    """The ids of documents, each with its end, when what was open is found; null for a row of keys to be learned."""
    return F.call_function(jvm.register(spark, "voxloom_words_fill", "WordTable", "Fill", "binary", path), ids, keys, found, F.lit(end))
