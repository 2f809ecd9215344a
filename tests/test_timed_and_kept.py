"""The timed stream against the batch tracker, and results that are kept by frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.schemas import DETECTIONS
from voxelry.sources import store
from voxelry.streaming import timed, tracker


def _rows(seed=0):
    """Three sensors; sensor 1 falls silent after frame 9, sensor 2 pauses from frame 6 to 14."""
    rng, rows, det = np.random.default_rng(seed), [], 0
    for sensor in (0, 1, 2):
        start = rng.uniform(-20, 20, (4, 3))
        for frame in range(24):
            if (sensor == 1 and frame > 9) or (sensor == 2 and 6 <= frame <= 14):
                continue
            for k, p in enumerate(start):
                if rng.random() < 0.85:
                    det += 1
                    rows.append((sensor, frame, det, *map(float, p + frame * 0.1 + rng.normal(scale=0.05, size=3)), ("car", "pedestrian")[k % 2], 0.8, 50))
    return rows


def _sorted(found):
    return found.orderBy("sensor_id", "frame_id", "track_id").toPandas().round(9)


@pytest.mark.parametrize("parts", [1, 4])
def test_a_silent_sensors_tracks_die_in_the_stream_as_in_batch(spark, parts):
    frames = spark.createDataFrame(_rows(), DETECTIONS)
    batch = _sorted(tracker.track(frames, until=30))
    stream = _sorted(timed.track_timed_streamed(frames, 30, parts, 2))
    assert stream.equals(batch)
    silent = batch[batch.sensor_id == 1]
    assert silent.frame_id.max() in (11, 12) and silent[silent.frame_id > 9].misses.min() >= 1
    assert tracker.track(frames).where("sensor_id = 1").agg(F.max("frame_id")).first()[0] <= 9  # without a time to reach, nothing is stepped behind the last frame


def test_state_keeps_a_track(spark):
    t = tracker.Track(3, np.array([1.0, 2.0, 3.0]), "car", 7, np.array([0.1, 0.2, 0.3]), 1.5, 0.5, 2.5, 0.75, 4, 1, 2, True, False, "pedestrian", 0.5, 9, {"car": (1.5, 2), "pedestrian": (0.5, 1)})
    back = timed.from_row(timed.to_row(t))
    assert timed.to_row(back) == timed.to_row(t) and back.votes == t.votes and back.status == "CONFIRMED"


def test_an_empty_table_streams_to_nothing(spark):
    assert timed.track_timed_streamed(spark.createDataFrame([], DETECTIONS), 5).count() == 0


def test_kept_frames_are_computed_once_for_the_same_parameters(spark, tmp_path):
    points = spark.createDataFrame([(f, s, float(i)) for f in range(6) for s in (0, None) for i in range(3)], "frame_id bigint, sensor_id bigint, x double")
    path, asked = str(tmp_path / "kept"), []

    def make(scale):
        def of(missing):
            asked.append(missing.count())
            return points.join(missing, store.same_key(points, missing, ["frame_id", "sensor_id"]), "left_semi").groupBy("frame_id", "sensor_id").agg((F.sum("x") * scale).alias("s"))
        return of

    frames = lambda n: points.where(F.col("frame_id") < n).select("frame_id", "sensor_id").distinct()
    first = store.kept_by_frame(spark, path, {"cell": 0.15, "scale": 1}, frames(4), make(1))
    assert first.count() == 8 and asked == [8]
    second = store.kept_by_frame(spark, path, {"scale": 1, "cell": 0.15}, frames(6), make(1))
    assert second.count() == 12 and asked == [8, 4]  # only new frames, whatever the order of the parameters
    assert store.kept_by_frame(spark, path, {"cell": 0.15, "scale": 1}, frames(2), make(1)).count() == 4 and asked == [8, 4]
    other = store.kept_by_frame(spark, path, {"cell": 0.15, "scale": 2}, frames(6), make(2))
    assert asked == [8, 4, 12] and {r["s"] for r in other.collect()} == {6.0} and {r["s"] for r in second.collect()} == {3.0}


def test_a_run_that_failed_leaves_nothing_that_is_read(spark, tmp_path):
    path = str(tmp_path / "kept")
    frames = spark.createDataFrame([(0,), (1,)], "frame_id bigint")

    def fails(missing):
        return missing.withColumn("v", F.assert_true(F.col("frame_id") < 1, F.lit("broken")).cast("string"))

    with pytest.raises(Exception, match="broken"):
        store.kept_by_frame(spark, path, {}, frames, fails)
    found = store.kept_by_frame(spark, path, {}, frames, lambda missing: missing.withColumn("v", F.lit("fine")))
    assert sorted(map(tuple, found.select("frame_id", "v").collect())) == [(0, "fine"), (1, "fine")]


def test_object_frames_without_objects_are_not_computed_again(spark, tmp_path):
    asked = []

    def make(missing):
        asked.append(missing.count())
        return missing.where("frame_id > 0").withColumn("v", F.lit(1))

    frames = spark.createDataFrame([(0,), (1,)], "frame_id bigint")
    for _ in range(2):
        assert store.kept_by_frame(spark, str(tmp_path / "k"), {"a": 1}, frames, make).count() == 1
    assert asked == [2]


def test_forest_arrays_give_the_models_probabilities(spark, sf_dir):
    from voxelry.functions import features as feats
    from voxelry.operators import classify
    from voxelry.sources.adapters import clouds

    rows = feats.features(clouds(spark, sf_dir), 19).drop("pts").persist()
    model = classify.train(rows, feats.COMPACT, 7, 6)
    got = classify.predict(model, rows).select(*feats.COMPACT, "proba").toPandas()
    forest = classify.Forest(model)
    assert np.allclose(forest.proba(got[list(feats.COMPACT)].to_numpy(float), 100), np.stack(got.proba.to_numpy()), atol=1e-12)
    assert forest.proba(np.zeros((0, 19))).shape == (0, 4)
    assert forest.digest() == classify.Forest(model).digest() != classify.Forest(classify.train(rows, feats.COMPACT, 3, 6)).digest()
