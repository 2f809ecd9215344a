"""Views of tabular data as points, clouds, detections and predictions.

Each has the same definition in SQL, so that results can be checked independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOUD_POINTS = 21

POINTS_SQL = """
points AS (
  SELECT l_orderkey % 10 AS frame_id, (l_partkey % 160) - 80 + l_discount * 5 AS x, (l_suppkey % 100) - 50 + l_tax * 5 AS y,
         l_quantity / 10 - 1 AS z, l_extendedprice / 1000 AS intensity, l_linenumber AS ring
  FROM lineitem
)"""

#: Frames by 1,024 orders, a tenth of a second apart, in single precision as in files; their number grows with the data.
TIMED_SQL = """
timed AS (
  SELECT (l_orderkey // 1024) * 100000000 AS frame_ns, ((l_partkey % 160) - 80 + l_discount * 5)::FLOAT AS x, ((l_suppkey % 100) - 50 + l_tax * 5)::FLOAT AS y,
         (l_quantity / 10 - 1)::FLOAT AS z, (l_extendedprice / 1000)::FLOAT AS intensity, l_linenumber::FLOAT AS ring
  FROM lineitem
)"""

CLOUDS_SQL = """
cloud AS (
  SELECT vec_id AS sample_id, (label % 4)::INT AS label, j::INT AS j, embedding[3 * j + 1]::DOUBLE AS x, embedding[3 * j + 2]::DOUBLE AS y, embedding[3 * j + 3]::DOUBLE AS z
  FROM embeddings, range(21) r(j)
)"""

#: A detection by event: the day is the frame, the type its class, user and value its place.
DETECTIONS_SQL = """
detections AS (
  SELECT event_id AS det_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS frame_id, user_id % 40 + value / 100 AS x, floor(user_id / 40) * 2 + value / 200 AS y, 0.9::DOUBLE AS z,
         CASE length(event_type) % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'pedestrian' ELSE 'bicyclist' END AS class_label
  FROM events
)"""

#: Truth and prediction by labelled document, with a made-up confidence.
PREDS_SQL = """
preds AS (
  SELECT doc_id, ((doc_id * 7 + quality * 3) % 4)::INT AS truth,
         (CASE WHEN (doc_id * 13 + toxic) % 5 < 3 THEN (doc_id * 7 + quality * 3) % 4 ELSE (doc_id * 11 + 1) % 4 END)::INT AS pred,
         ((doc_id * 37) % 1000) / 1000.0::DOUBLE AS conf, ((doc_id * 53) % 1000) / 1000.0::DOUBLE AS bg_proba
  FROM labels
)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, x, y, z, intensity, ring: one row per point."""
    return _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("frame_id"),
        ((F.col("l_partkey") % 160) - 80 + F.col("l_discount") * 5).alias("x"),
        ((F.col("l_suppkey") % 100) - 50 + F.col("l_tax") * 5).alias("y"),
        (F.col("l_quantity") / 10 - 1).alias("z"),
        (F.col("l_extendedprice") / 1000).alias("intensity"),
        F.col("l_linenumber").alias("ring"),
    )


def timed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_ns, point_id, x, y, z, intensity, ring: one row per point; point_id only orders the points of a frame."""
    places = [
        (F.col("l_partkey") % 160) - 80 + F.col("l_discount") * 5, (F.col("l_suppkey") % 100) - 50 + F.col("l_tax") * 5, F.col("l_quantity") / 10 - 1,
        F.col("l_extendedprice") / 1000, F.col("l_linenumber"),
    ]
    made = _table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 1024) * 100_000_000).cast("bigint").alias("frame_ns"), *[c.cast("float").alias(n) for c, n in zip(places, ("x", "y", "z", "intensity", "ring"), strict=True)])
    return made.withColumn("point_id", F.xxhash64("x", "y", "z", "intensity", "ring"))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, pts: one row per pre-segmented object, its points as an array; no shuffle."""
    e = lambda j, k: F.get("embedding", j * 3 + k).cast("double")
    pts = F.transform(F.sequence(F.lit(0), F.lit(CLOUD_POINTS - 1)), lambda j: F.struct(e(j, 0).alias("x"), e(j, 1).alias("y"), e(j, 2).alias("z")))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 4).cast("int").alias("label"), pts.alias("pts"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, frame_id, x, y, z, class_label."""
    kind = F.length("event_type") % 3
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("det_id"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")).cast("bigint").alias("frame_id"),
        (F.col("user_id") % 40 + F.col("value") / 100).alias("x"), (F.floor(F.col("user_id") / 40) * 2 + F.col("value") / 200).alias("y"), F.lit(0.9).alias("z"),
        F.when(kind == 0, "car").when(kind == 1, "pedestrian").otherwise("bicyclist").alias("class_label"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, pred, conf, bg_proba."""
    d, truth = F.col("doc_id"), ((F.col("doc_id") * 7 + F.col("quality") * 3) % 4).cast("int")
    return _table(spark, sf_dir, "labels").select(
        "doc_id", truth.alias("truth"), F.when((d * 13 + F.col("toxic")) % 5 < 3, truth).otherwise(((d * 11 + 1) % 4).cast("int")).alias("pred"),
        ((d * 37) % 1000 / F.lit(1000.0)).alias("conf"), ((d * 53) % 1000 / F.lit(1000.0)).alias("bg_proba"),
    )
