"""Colours of points and boxes, and times of stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.operators import latency, views

BOXES = "frame_id long, cluster_id long, class_label string, was_split boolean, track_guided boolean, " + ", ".join(f"{a}_{e} double" for a in "xyz" for e in ("min", "max"))


def _boxes(spark, rows):
    return spark.createDataFrame([(*r, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0) for r in rows], BOXES)


def _colours(edges):
    return {r["cluster_id"]: (r["r"], r["g"], r["b"], round(r["alpha"], 6)) for r in edges.collect()}


def test_boxes_have_twelve_edges_in_one_colour(spark):
    rows = _boxes(spark, [(0, 1, "car", False, False), (0, 2, "car", True, False), (0, 3, "car", True, True), (0, 4, None, True, True), (0, 5, "background", False, False), (0, 6, "tram", None, None)])
    edges = views.wireframe(rows)
    assert edges.groupBy("cluster_id").count().where("count <> 12").count() == 0 and edges.select("cluster_id", "r", "g", "b", "alpha").distinct().count() == 4
    assert _colours(edges) == {1: (0.2, 0.6, 1.0, 1.0), 2: (1.0, 0.0, 1.0, 1.0), 3: (0.0, 1.0, 1.0, 1.0), 6: (0.7, 0.7, 0.7, 0.7)}
    assert edges.agg(F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")) + F.abs(F.col("z2") - F.col("z1")))).first()[0] == 4 * 4 * (1 + 2 + 3)
    assert views.wireframe(rows.limit(0)).count() == 0


def test_a_selection_dims_the_other_boxes_of_its_frame(spark):
    rows = _boxes(spark, [(0, 1, "car", True, True), (0, 2, "pedestrian", False, False), (0, 6, "tram", False, False), (1, 3, "pedestrian", False, False), (2, 4, "background", False, False), (2, 5, "car", None, None)])
    got = _colours(views.wireframe(rows, F.col("cluster_id").isin(1, 4)))
    assert got == {1: (1.0, 1.0, 1.0, 1.0), 2: (1.0, 0.3, 0.3, 0.25), 6: (0.7, 0.7, 0.7, 0.175), 3: (1.0, 0.3, 0.3, 1.0), 5: (0.2, 0.6, 1.0, 0.25)}
    assert _colours(views.wireframe(rows, F.lit(None).cast("boolean")))[2] == (1.0, 0.3, 0.3, 1.0)


@pytest.mark.parametrize("palette", views.PALETTES)
def test_points_take_the_colour_of_ground_class_or_neither(spark, palette):
    rows = spark.createDataFrame([(1, True, True, "car"), (2, False, True, "car"), (3, False, True, None), (4, False, True, "tram"), (5, False, False, None), (6, None, None, "car")], "i int, g boolean, c boolean, k string")
    got = {r["i"]: tuple(r["v"]) for r in rows.select("i", views.point_colour(F.col("g"), F.col("c"), F.col("k"), palette).alias("v")).collect()}
    of = views.PALETTES[palette]
    assert got == {1: of["ground"], 2: (0.2, 0.6, 1.0, 1.0), 3: (0.7, 0.7, 0.7, of["background"]), 4: (0.5, 0.5, 0.5, 1.0), 5: of["loose"], 6: of["loose"]}
    with pytest.raises(ValueError):
        views.point_colour(F.lit(True), F.lit(True), F.lit("car"), "no such")


def test_summary_of_times(spark):
    rng = np.random.default_rng(1)
    times = {"a": rng.uniform(0, 9, 200), "b": np.array([4.0]), None: rng.uniform(0, 9, 7)}
    rows = [(k, float(v)) for k, vs in times.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    got = {r["stage"]: r for r in latency.summary(spark.createDataFrame(rows, "stage string, ms double"), ["stage"]).collect()}
    assert set(got) == set(times)
    for k, vs in times.items():
        want = (len(vs), vs.mean(), np.median(vs), np.sort(vs)[int(0.95 * (len(vs) - 1))], vs.max())
        assert [got[k][c] for c in ("n", "mean", "median", "p95", "most")] == pytest.approx(want)
    assert latency.summary(spark.createDataFrame([], "stage string, ms double"), ["stage"]).count() == 0


def test_times_of_a_run_count_what_each_stage_leaves(spark, sf_dir):
    from voxelry.functions import features as feats
    from voxelry.operators import classify, clustering, ground, splitting
    from voxelry.plans import pipeline
    from voxelry.plans.model_queries import STREET, STREET_CELL, _street
    from voxelry.sources.adapters import clouds

    forest = classify.Forest(classify.train(feats.features(clouds(spark, sf_dir), 19).drop("pts"), feats.COMPACT, 3, 3))
    scene = _street(spark, sf_dir)
    got = pipeline.latencies(scene, STREET, forest, 19, STREET_CELL, 20).persist()
    assert got.where("ms < 0 OR ms IS NULL").count() == 0
    whole = {r["stage"]: r["rows"] for r in got.where("frame_id IS NULL").collect()}
    found = splitting.as_clusters(clustering.cluster_frame(ground.non_ground(scene, STREET), STREET.ground_height, STREET_CELL, 20))
    assert whole == {"ground": ground.non_ground(scene, STREET).count(), "clusters": found.count()}
    by = {(r["frame_id"], r["stage"]): r["rows"] for r in got.where("frame_id IS NOT NULL").collect()}
    assert {k: v for k, v in by.items() if k[1] == "read"} == {(r["frame_id"], "read"): r["count"] for r in found.groupBy("frame_id").count().collect()}
    objects = pipeline.objects(scene, STREET, forest, 19, cell=STREET_CELL, min_points=20)
    assert {k: v for k, v in by.items() if k[1] == "predict"} == {(r["frame_id"], "predict"): r["count"] for r in objects.groupBy("frame_id").count().collect()}
