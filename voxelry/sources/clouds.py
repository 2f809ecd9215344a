"""Binary point-cloud files as DataFrames, and the sinks that write them.

A file is little-endian float32, ``width`` values a point. The reader is a Python data source,
registered as ``pointcloud``; the readers here go through Spark's own file access, so any store that Spark
reads will do. The writers and the stream of frames use that data source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.schemas import CLASSES, CLOUD, POINTS, classes
from voxelry.sources import pointcloud

FRAME_WIDTH, OBJECT_WIDTH = 5, 3


def files(spark: SparkSession, folder: str, width: int, recursive: bool = True) -> DataFrame:
    """path, length, content, valid of each ``*.bin`` file: valid if not empty and of whole points."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", "length", "content", ((F.col("length") > 0) & (F.col("length") % (4 * width) == 0)).alias("valid"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Points of a frame sequence, POINTS plus frame_ns; a frame's number is its rank by file name.

    The stem of a file's name is its time in nanoseconds. Files that are not of whole points raise.
    """
    found = files(spark, folder, FRAME_WIDTH)
    found = found.withColumn("frame_ns", F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("bigint"))
    return found.withColumn("ok", F.assert_true("valid", F.concat(F.lit("not whole points: "), F.col("path")))).where("ok IS NULL").select("frame_ns", "content").mapInPandas(
        _unpacked, "frame_ns bigint, point_id bigint, x float, y float, z float, intensity float, ring float"
    )


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for ns, content in zip(pdf.frame_ns, pdf.content, strict=True):
            xyz = np.frombuffer(content, "<f4").reshape(-1, FRAME_WIDTH)
            out = pd.DataFrame(xyz, columns=["x", "y", "z", "intensity", "ring"])
            out.insert(0, "point_id", np.arange(len(xyz)))
            out.insert(0, "frame_ns", ns)
            yield out


def numbered(points: DataFrame) -> DataFrame:
    """Frames numbered in order of time: POINTS. The list of frames is small against the points and joined by key."""
    from pyspark.sql import Window

    order = points.select("frame_ns").distinct().withColumn("frame_id", (F.row_number().over(Window.orderBy("frame_ns")) - 1).cast("bigint"))
    return points.join(order, "frame_ns").select(*[c.split()[0] for c in POINTS.split(", ")])


def objects(spark: SparkSession, folder: str, width: int = OBJECT_WIDTH) -> DataFrame:
    """sample_id, path, label, pts of the class folders below ``folder``; unknown folders and invalid files are left out."""
    found = files(spark, folder, width).where("valid").withColumn("class_name", F.regexp_extract("path", r"([^/]+)/[^/]+\.bin$", 1))
    known = found.join(F.broadcast(classes(spark)), "class_name")  # four classes

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pts = [[{"x": x, "y": y, "z": z} for x, y, z in np.frombuffer(c, "<f4").reshape(-1, width)[:, :3].astype(float).tolist()] for c in pdf.content]
            yield pdf.drop(columns="content").assign(pts=pts)

    rows = known.select(F.xxhash64("path").alias("sample_id"), "path", F.col("class_id").cast("int").alias("label"), "content")
    return rows.mapInPandas(unpacked, f"sample_id bigint, path string, label int, pts {CLOUD}")


def rejected(spark: SparkSession, folder: str, width: int = OBJECT_WIDTH) -> DataFrame:
    """path and reason of the files that :func:`objects` leaves out as invalid; Spark's reader skips empty files itself."""
    return files(spark, folder, width).where("NOT valid").select("path", F.lit("not whole points").alias("reason"))


def write_objects(clouds: DataFrame, folder: str) -> None:
    """Clouds (label, pts) as Parquet by class, the engine's form of a folder of object files."""
    names = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    clouds.withColumn("class", names[F.col("label")]).write.partitionBy("class").parquet(folder)


def _save(points: DataFrame, folder: str, width: int) -> None:
    """Points with their ``file`` as files: a file's rows meet in one partition, sorted, and are published together."""
    pointcloud.register(points.sparkSession)
    rows = points.repartition("file").sortWithinPartitions("file", "point_id").select("file", *pointcloud.NAMES[:width])
    rows.write.format("pointcloud").option("width", width).mode("append").save(folder)


def write_object_files(clouds: DataFrame, folder: str) -> DataFrame:
    """Writes clouds (label, number, pts) as ``class/aug_NNNNNN.bin``, in a folder for this write below ``folder``, which driver and executors share.

    Gives path and n_points of each file below ``folder``. Clouds without points make no file.
    """
    names = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    file = F.format_string("%s/aug_%06d.bin", names[F.col("label")], F.col("number"))
    points = clouds.select(file.alias("file"), F.posexplode("pts").alias("point_id", "p")).select("file", "point_id", "p.*")
    _save(points, folder, OBJECT_WIDTH)
    return files(clouds.sparkSession, folder, OBJECT_WIDTH).select("path", (F.col("length") / (4 * OBJECT_WIDTH)).cast("bigint").alias("n_points"))


def write_frames(points: DataFrame, folder: str) -> None:
    """Writes points (frame_ns, point_id, x, y, z, intensity, ring) as ``NS.bin``, a file a frame; a reader finds all frames of a call or none."""
    _save(points.withColumn("file", F.concat(F.col("frame_ns").cast("string"), F.lit(".bin"))), folder, FRAME_WIDTH)


def stream_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The frames below ``folder`` as a stream of points, with frame_ns; frames appear in order of time (see :mod:`voxelry.sources.pointcloud`)."""
    pointcloud.register(spark)
    found = spark.readStream.format("pointcloud").option("width", FRAME_WIDTH).load(folder)
    return found.select(F.regexp_extract(F.substring_index("file", "/", -1), r"(\d+)\.bin$", 1).cast("bigint").alias("frame_ns"), "point_id", *pointcloud.NAMES)
