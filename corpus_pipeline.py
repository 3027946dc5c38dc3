"""Four stages from raw documents to packed sequences; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import langid, packing, quality, simhash
from voxloom.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail the base rules; null languages and sources are groups of their own; repeated rows are
    judged each; long texts are taken whole; no rows: no rows.  Columns come back as they are, extra ones too.
    """
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty, by models fitted on a bounded sample of these documents.

    Texts without letters go; documents without a language are judged like others but teach nothing; if none has one,
    all go.  Repeated rows are judged each; no rows: no rows.  Columns come back as they are.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Fingerprints of five-word shingles, at most 7 of 64 bits apart.  Texts without words are copies of each other; rows
    with a null id stay; repeated rows leave one; no rows: no rows.  Columns come back as they are.
    """
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024: a row a piece, as op10 returns it.

    Null and empty texts are their end id; repeated rows are packed each; long texts are cut; no rows: no rows.
    """
    return packing.digest(packing.pack(docs))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", pack)]
#: Robust estimates, language models and bit covers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
