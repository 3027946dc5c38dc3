"""Live acquisition: a file stream of frames, tiles that complete, and incremental registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grid


def frame_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Rows about frames as files with them arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def tile_counts(frames: DataFrame, key: list[str]) -> DataFrame:
    """Frames of each tile so far: the state is a count a tile."""
    return frames.groupBy(*key).agg(F.count("*").alias("n_frames"))


def complete_tiles(frames: DataFrame, key: list[str], n_planes: int) -> DataFrame:
    """Tiles with at least n_planes frames (an update-mode stream gives a tile again when it grows)."""
    return tile_counts(frames, key).where(F.col("n_frames") >= n_planes)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what has arrived, then stop. A run with the same checkpoint goes on where the last one ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def run_live(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Process frames as they arrive, until stopped."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()


class LivePipeline:
    """Tiles that complete are handed to steps once each, with their neighbours acquired before them.

    convert(tiles) and register(edges) are the steps; the table of tiles done is what makes a restart go on.
    """

    def __init__(self, done_path: str, ncol: int, n_planes: int, convert: Callable[[DataFrame], None] | None = None, register: Callable[[DataFrame], None] | None = None):
        self.done_path, self.ncol, self.n_planes, self.convert, self.register = done_path, ncol, n_planes, convert, register
        self.batch = -1  # the one that the steps work on

    def done(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.parquet(self.done_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "tile long, channel int, row int, col int, batch long")

    def sink(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: complete tiles ``(tile, channel, n_frames)`` of a batch. A batch run again changes nothing."""
        spark = batch.sparkSession
        before = self.done(spark)
        if not before.where(F.col("batch") == number).isEmpty():
            return
        fresh = batch.select(F.col("tile").cast("long").alias("tile"), F.col("channel").cast("int").alias("channel")).join(before, ["tile", "channel"], "left_anti")
        fresh = grid.place_snake(fresh, "tile", self.ncol).withColumn("batch", F.lit(number).cast("long"))
        self.batch = number
        if self.convert:
            self.convert(fresh)
        if self.register:
            every = before.unionByName(fresh).withColumn("path", F.col("tile").cast("string"))
            new = fresh.select("channel", "row", "col")
            near = grid.adjacent(every, every, ("east", "south", "west", "north"), ["channel"])
            self.register(near.join(new, ["channel", "row", "col"], "left_semi"))
        fresh.write.mode("append").parquet(self.done_path)

    def start(self, frames: DataFrame, checkpoint: str) -> StreamingQuery:
        return run_available(complete_tiles(frames, ["tile", "channel"], self.n_planes), self.sink, checkpoint)
