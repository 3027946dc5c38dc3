"""Shared plumbing of the training-data operators: the shared work folder, stages and bounded Arrow batches.

An executor can be lost at any time, so everything an operator reads twice goes through :func:`stage`, a Parquet
table in the folder that ``spark.checkpoint.dir`` names.  Nothing is cached and nothing is checkpointed locally.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: texts may be long, so batches are kept small.
BATCH_ROWS = 256
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for local masters that set none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="voxloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.  options: Parquet's."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete a stage that nothing reads any more."""
    spark = staged.sparkSession
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()[:1]}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for functions that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def free(columns: list[str], name: str) -> str:
    """A name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  One with fewer splits than there are cores (a file of one row group) is dealt out to all:
    its rows are texts that take long each.  Larger tables are read as they are split."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The strings of a column, null read as the empty text."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or ""
