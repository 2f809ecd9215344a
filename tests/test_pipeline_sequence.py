"""The pipeline with tracks, held against one loop over the frames; what is known of a frame is not computed again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelry.operators import splitting
from voxelry.plans import pipeline
from voxelry.plans.model_queries import STREET, STREET_CELL, _street
from voxelry.schemas import CLASSES
from voxelry.streaming.tracker import COLUMNS, Tracker, track_rows


def _forest():
    class Stub:
        """Confident pedestrians and cars, by the number of points."""

        def proba(self, rows):
            odd = rows[:, 0].astype(int) % 2
            return np.column_stack([np.full(len(rows), 0.05), np.full(len(rows), 0.05), np.where(odd, 0.7, 0.2), np.where(odd, 0.2, 0.7)])

    return Stub()


def test_run_equals_one_loop_over_the_frames(spark, sf_dir):
    scene = _street(spark, sf_dir).withColumn("sensor_id", F.col("ring") % 2)
    options = {"cell": STREET_CELL * 2, "min_points": 5}
    got = pipeline.run(scene, STREET, _forest(), mode=19, **options).toPandas()
    made = pipeline.clusters(scene.withColumn("sensor_id", F.col("sensor_id").cast("bigint")), STREET, **options).toPandas()
    frames, out = scene.select("sensor_id", "frame_id").distinct().toPandas(), []
    for sensor in (0, 1):
        tracker, guides = Tracker(pipeline.MAX_MISSES, 2, pipeline.GATE_DISTANCE, 0.1, True), []
        for frame in sorted(frames[frames.sensor_id == sensor].frame_id):
            rows = made[(made.sensor_id == sensor) & (made.frame_id == frame)]
            here = pipeline.merge_frame(splitting.split_frame(splitting.clusters_of(rows), guides))
            seen = [c for c in pipeline.classified(here, _forest(), 19, {}) if c["pred"] > 0]
            tracks = tracker.step([{"position": c["xyz"].mean(0), "class_label": CLASSES[c["pred"]], "class_confidence": c["conf"], "n_points": c["n_points"]} for c in seen])
            out += track_rows(sensor, frame, tracks)
            guides = [{"position": t.position, "class_label": t.last_class} for t in tracker.confirmed() if t.last_class != "background"]
    want = pd.DataFrame(out, columns=COLUMNS)
    order = lambda d: d.sort_values(["sensor_id", "frame_id", "track_id"], ignore_index=True)
    assert len(want) > 10
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_known_clusters_are_not_looked_at_again():
    rng = np.random.default_rng(0)
    found = [{"cluster_id": i, "xyz": rng.uniform(0, 1, (20 + i, 3)), "n_points": 20 + i, "z_range": 1.0, "xy_spread": 0.8, "z_above_ground": 1.0} for i in range(4)]
    asked = []

    class Counting:
        def proba(self, rows):
            asked.append(len(rows))
            return _forest().proba(rows)

    whole = pipeline.classified(found, Counting(), 19, {})
    known = {pipeline._digest(c): np.array(c["proba"]) for c in whole[1:3]}
    again = pipeline.classified(found, Counting(), 19, known)
    assert asked == [4, 2] and [(c["cluster_id"], c["pred"], c["conf"], c["proba"]) for c in again] == [(c["cluster_id"], c["pred"], c["conf"], c["proba"]) for c in whole]
    moved = [found[1] | {"xyz": found[1]["xyz"][:10]}]
    pipeline.classified(moved, Counting(), 19, known)
    assert asked == [4, 2, 1] and pipeline.classified([], Counting(), 19, known) == []
    assert pipeline.classified(found[1:3], Counting(), 19, known)[0]["conf"] == pytest.approx(whole[1]["conf"]) and asked == [4, 2, 1]
