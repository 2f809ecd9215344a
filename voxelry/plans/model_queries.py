"""Queries that fit forests: prediction, folds, two stages, importance, ablation, and the whole pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions import features as feats
from voxelry.functions.geometry import rotation_to_vertical
from voxelry.operators import classify, evaluation, forests
from voxelry.operators.classify import DEPTH, STAGE_TREES, TREES
from voxelry.operators.evaluation import FOLDS
from voxelry.operators.ground import Calibration
from voxelry.plans import pipeline
from voxelry.plans.registry import query
from voxelry.plans.scene_queries import MIN_POINTS
from voxelry.session import shared_folder, written
from voxelry.sources.adapters import clouds, points


#: Files of the features; forests are fitted by as many tasks at once.
PARTS = 32


def _rows(spark: SparkSession, sf_dir: str, mode: int = 19) -> DataFrame:
    """Features with folds, written once: forests read them again and again. Rows have a fixed place, on which the trees' samples depend."""
    made = feats.features(clouds(spark, sf_dir), mode).drop("pts")
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    dealt = evaluation.with_folds(made.withColumn("group_id", F.floor(F.col("sample_id") / 4)), FOLDS).repartition(PARTS, "sample_id").sortWithinPartitions("sample_id")
    dealt.write.parquet(path)
    return spark.read.parquet(path)


@query()
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and confidence of every cloud."""
    rows = _rows(spark, sf_dir)
    return classify.predict(classify.train(rows, feats.COMPACT, TREES, DEPTH), rows).select("sample_id", "label", "pred", "conf", classify.second_class(F.col("proba"))["class"].alias("second"))


@query()
def rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-wise report over folds that keep groups together."""
    got = written(classify.cross_validate(_rows(spark, sf_dir), feats.COMPACT, FOLDS, TREES, "group_fold", DEPTH), "folds")
    return evaluation.precision_recall(got)


@query()
def rf_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two stages over stratified folds."""
    return classify.cross_validate_two_stage(_rows(spark, sf_dir), feats.COMPACT, 3.0, FOLDS, STAGE_TREES, DEPTH)


@query()
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by falling importance."""
    model = classify.train(_rows(spark, sf_dir), feats.COMPACT, TREES, DEPTH)
    return spark.createDataFrame(classify.importances(model, feats.COMPACT), "feature string, importance double")


#: Every fourth object is a test object; so are those that come from the same group.
_TEST = "group_id % 4 = 3"


@query()
def rf_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-wise report, and confidences of right and wrong predictions, of objects that the forest never saw."""
    rows = _rows(spark, sf_dir)
    got = written(classify.test_predictions(rows.where(f"NOT {_TEST}"), rows.where(_TEST), feats.COMPACT, TREES, DEPTH), "tested")
    found = evaluation.evaluate(got)
    return found["report"].join(found["confidence"].withColumnRenamed("truth", "class_id"), "class_id", "left")


@query()
def rf_ablation_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature set's macro F1 over folds and on test objects, with the confidences."""
    rows = _rows(spark, sf_dir, 35)
    return classify.ablation_summary(rows.where(f"NOT {_TEST}"), rows.where(_TEST), trees=TREES, depth=DEPTH, tested=classify.test_predictions)


@query()
def rf_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the three feature sets."""
    rows = _rows(spark, sf_dir, 35)
    return classify.ablation(rows.where("fold > 0"), rows.where("fold = 0"), trees=TREES, depth=DEPTH)


#: The adapter's scene in the size of a street: a point's place shrinks, so that clusters are as large as people and cars.
STREET, STREET_CELL = Calibration(rotation_to_vertical((0.002, -0.0015, 1.0)), -0.3), 0.25


def _street(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumns({"x": F.col("x") * 0.12, "y": F.col("y") * 0.12, "z": F.col("z") * 0.4})


def _frames_forest(spark: SparkSession, sf_dir: str) -> forests.Grown:
    """The forest that classifies a frame's clusters, fitted on all clouds, which have no folds here."""
    made, path = feats.features(clouds(spark, sf_dir), 19).drop("pts"), f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    made.repartition(PARTS, "sample_id").sortWithinPartitions("sample_id").write.parquet(path)
    rows = spark.read.parquet(path)
    return forests.fitted(rows, forests.Plan(feats.COMPACT, F.col("label"), F.lit(False), TREES), DEPTH).sent(spark)


@query()
def pipeline_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to tracks, with confirmed tracks guiding the next frame's splits."""
    return pipeline.run(_street(spark, sf_dir), STREET, _frames_forest(spark, sf_dir), mode=19, cell=STREET_CELL, min_points=MIN_POINTS, dt=0.1)


@query()
def pipeline_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to classified objects, each frame on its own."""
    return pipeline.objects(_street(spark, sf_dir), STREET, _frames_forest(spark, sf_dir), mode=19, cell=STREET_CELL, min_points=MIN_POINTS).drop("pts", "proba")


@query()
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame, stage, rows and milliseconds of frames to classified objects."""
    return pipeline.latencies(_street(spark, sf_dir), STREET, _frames_forest(spark, sf_dir), mode=19, cell=STREET_CELL, min_points=MIN_POINTS)


@query()
def pipeline_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed tracks of kept objects: the earlier half of the frames is computed and kept first, then only the others."""
    forest = _frames_forest(spark, sf_dir)
    scene, path, options = _street(spark, sf_dir), f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", {"mode": 19, "cell": STREET_CELL, "min_points": MIN_POINTS}
    middle = scene.agg((F.min("frame_id") + F.max("frame_id")) / 2).first()[0] or 0
    pipeline.kept_objects(scene.where(F.col("frame_id") <= middle), STREET, forest, path, **options)
    return pipeline.track_cached(pipeline.kept_objects(scene, STREET, forest, path, **options))
