"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session; on a cluster leave master out and set the number of shuffle partitions to a few times its cores."""
    builder = SparkSession.builder.appName("voxloom").config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("VOXLOOM_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
