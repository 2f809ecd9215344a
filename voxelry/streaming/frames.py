"""Frames that arrive as files, taken up as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelry.sources import clouds


def take_up(spark: SparkSession, folder: str, kept: str) -> DataFrame:
    """Adds the frames below ``folder`` that are new since the last call to the table ``kept``, and gives all of it.

    The offset stands beside the table, so each frame is added once, also if a call fails half way and is made again.
    A folder without frames gives an empty table.
    """
    arriving = clouds.stream_frames(spark, folder)
    started = arriving.writeStream.format("parquet").option("path", f"{kept}/rows").option("checkpointLocation", f"{kept}/offsets").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(arriving.schema).parquet(f"{kept}/rows")
