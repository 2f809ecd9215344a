"""Schemas of the data model and the class dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = "frame_id bigint, point_id bigint, x float, y float, z float, intensity float, ring float"
CLOUD = "array<struct<x:double,y:double,z:double>>"
CLUSTER = (
    "frame_id bigint, cluster_id bigint, label_id bigint, n_points bigint, centroid struct<x:double,y:double,z:double>, z_range double, xy_spread double, "
    f"z_above_ground double, was_split boolean, track_guided boolean, pts {CLOUD}"
)
TRACKS = (
    "sensor_id bigint, frame_id bigint, track_id bigint, x double, y double, z double, vx double, vy double, vz double, speed double, class_label string, "
    "class_confidence double, hits int, misses int, age int, status string, n_points bigint, last_class string, last_confidence double, frames_alive int"
)
#: Detections that the tracker takes in.
DETECTIONS = "sensor_id bigint, frame_id bigint, det_id bigint, x double, y double, z double, class_label string, class_confidence double, n_points bigint"
#: Class ids and names.
CLASSES = {0: "background", 1: "bicyclist", 2: "car", 3: "pedestrian"}


def frame_key(df: DataFrame) -> list[str]:
    """The columns that name a frame: frame_id, and sensor_id where there are several sensors."""
    return [c for c in ("sensor_id", "frame_id") if c in df.columns]


def classes(spark: SparkSession) -> DataFrame:
    """class_id, class_name: four rows, small enough to broadcast by definition."""
    return spark.createDataFrame(list(CLASSES.items()), "class_id int, class_name string")
