"""What the reviewer's third round found, one small test each."""

import tracemalloc

import numpy as np

from voxelry.functions import features as feats
from voxelry.llm import near
from voxelry.operators import assignment, classify, clustering, tracks
from voxelry.plans import model_queries
from voxelry.sources import pointcloud
from voxelry.sources.adapters import clouds
from voxelry.streaming import tracker


def test_track_summary_counts_by_sensor(spark):
    rows = [(0, 1, 1, "car", "CONFIRMED"), (0, 2, 1, "car", "CONFIRMED"), (0, 2, 2, "pedestrian", "tentative"), (0, 1, 3, "bicyclist", "CONFIRMED"), (1, 5, 1, "pedestrian", "CONFIRMED")]
    found = tracks.summary(spark.createDataFrame(rows, "sensor_id bigint, frame_id bigint, track_id bigint, class_label string, status string"))
    got = {r["sensor_id"]: (r["n_tracks"], r["last_frame"], r["n_pedestrian"], r["n_car"], r["n_bicyclist"]) for r in found.collect()}
    assert got == {0: (3, 2, 0, 1, 0), 1: (1, 5, 1, 0, 0)}


def test_labels_come_from_cells_not_from_a_frames_points(spark):
    rows = [(f, x * 0.1, 0.0, float(x)) for f in (None, 3) for x in range(30)] + [(3, 9.0, 9.0, 0.0), (3, 9.0, 9.0, 1.0), (3, 20.0, 20.0, 0.0)]
    celled = clustering.with_cells(spark.createDataFrame(rows, "frame_id bigint, x double, y double, z double"), 0.5)
    found = clustering.with_labels(celled, sizes=True)
    assert "InPandas" not in found._jdf.queryExecution().toString()  # points meet their label by a join
    got = found.groupBy("frame_id", "label", "n_label").count().collect()
    assert sorted((r["frame_id"] or -1, r["n_label"], r["count"]) for r in got) == [(-1, 30, 30), (3, 2, 2), (3, 30, 30)]


def test_a_frame_is_never_a_matrix_of_all_pairs():
    seen = [{"position": (10.0 * k, 0.0, 0.0), "class_label": "car", "class_confidence": 0.9, "n_points": 9} for k in range(3000)]
    t = tracker.Tracker()
    t.step(seen)
    tracemalloc.start()
    try:
        found = t.step(seen)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 3000 and all(x.hits == 2 for x in found)
    assert peak < 20e6  # 3,000 x 3,000 costs alone are 72 MB


def test_folds_are_fitted_on_parts_and_cover_every_row(spark, sf_dir):
    rows = model_queries._rows(spark, sf_dir)
    assert rows.rdd.getNumPartitions() > 1
    got = classify.cross_validate(rows, ["z_range", "xy_spread"], 3, 2, "group_fold", 3)
    seen = [r["sample_id"] for r in got.collect()]
    assert len(seen) == len(set(seen)) == rows.where("group_fold < 3").count() > 0


def test_a_forest_is_fitted_by_trees_in_few_tasks(spark, sf_dir):
    rows = feats.features(clouds(spark, sf_dir), 19).drop("pts").persist()
    models = classify.train_by_trees(rows.repartition(16, "sample_id"), feats.COMPACT, 25, 4)
    trees = [m.stages[-1].getNumTrees for m in models]
    assert trees == [10, 10, 5] and len({m.stages[-1].trees[0].toDebugString.split("\n", 1)[1] for m in models}) == 3
    forest = classify.Forest(*models)
    assert len(forest.roots) == 25
    local = rows.orderBy("sample_id").toPandas()
    each = [np.stack(classify.predict(m, rows).orderBy("sample_id").toPandas().proba.to_numpy()) for m in models]
    assert np.allclose(forest.proba(local[feats.COMPACT].to_numpy()), sum(n * p for n, p in zip(trees, each, strict=True)) / 25)


def test_parities_never_claim_more_than_sets_differ_and_spare_most_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 400)))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 200))]))
        assert near.apart(near.parity(x), near.parity(y)) <= len(np.setxor1d(x, y))
    half = " ".join(f"c{i}" for i in range(60))
    rows = [(k, f"{half} {' '.join(f'o{k}x{i}' for i in range(60))}") for k in range(30)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(3)]
    compared, similar = [], near._similar

    def counted(pairs, *more):
        compared.append(pairs.distinct().count())
        return similar(pairs, *more)

    monkeypatch.setattr(near, "_similar", counted)
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: k % 100 for k, _ in rows} and sum(compared) == 3  # hundreds of pairs meet by a rare shingle


def test_pivot_distances_discard_no_similar_sets_and_most_others():
    rng = np.random.default_rng(7)
    for _ in range(300):
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 400)))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 800))]))
        assert near.apart_by_pivots(near.distances(x), near.distances(y)) <= len(np.setxor1d(x, y))
    left = 0
    for _ in range(100):  # half of the shingles are common
        x = rng.integers(-(1 << 63), 1 << 63, 600)
        y = np.concatenate([x[:300], rng.integers(-(1 << 63), 1 << 63, 300)])
        left += near.apart_by_pivots(near.distances(x), near.distances(y)) <= 1200 / 9
    assert left <= 5
    same = np.arange(1000) << 20  # one part of them all: a byte does not hold its distances
    assert near.distances(same) == b"" and near.apart_by_pivots(b"", near.distances(x)) == 0


def test_the_stage_searches_fingerprints_in_pivot_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(0, 24, 3):
        w = [f"w{i}" for i in rng.integers(0, 9000, 1200)]
        rows += [(k, " ".join(w)), (k + 1, " ".join([*w, "end"])), (k + 2, " ".join(["other", *w[1:]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near_in_bits = {d: near.sketch(near.shingles(t)) for d, t in rows}
    close = [(a, b) for a, _ in rows for b, _ in rows if a < b and ((near_in_bits[a] ^ near_in_bits[b]) & (1 << 64) - 1).bit_count() <= 2]
    root = {d: d for d, _ in rows}
    for a, b in close:
        root = {d: min(root[a], root[b]) if r in (root[a], root[b]) else r for d, r in root.items()}
    assert len(close) >= 12
    monkeypatch.setattr(near, "_may_be", lambda *_: near.F.lit(False))  # no pair meets by a prefix
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(docs).collect()}
    assert got == root


def test_groups_of_places_are_the_groups_of_all_edges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(int(f), (1 << 60) + int(d), int(t)) for f, d, t in zip(rng.integers(0, 2, 300), rng.integers(0, 200, 300), rng.integers(0, 200, 300), strict=True)]
    edges = sorted({*edges, *[(5, (1 << 60) + k, t) for k in range(60) for t in (k, k + 1)]})  # and a chain through all places
    linked, groups = [], assignment.groups
    monkeypatch.setattr(assignment, "groups", lambda links: (linked.append(links.count()), groups(links))[1])
    df = spark.createDataFrame([(*e, 0.5, e[1] % (1 << 60) // 20) for e in edges], "frame_id bigint, det_id bigint, track_id bigint, cost double, place bigint")
    got = assignment.members(df, by=("place",)).toPandas()
    assert linked[0] < len(edges) / 2  # rounds are over what joins places, not over edges
    of_det = got[got.det_id.notna()].groupby("group_node")
    _, root = clustering.linked_labels(np.array([f * 1000 + d % (1 << 60) for f, d, _ in edges]), np.array([10000 + f * 1000 + t for f, _, t in edges]))
    assert got.group_node.nunique() == len(set(root.tolist())) and of_det.n_edges.sum().sum() == len(edges)
    assert 120 in of_det.n_edges.sum().tolist()
    assert assignment.grouped(df, by=("place",)).groupBy("group_node").count().count() == len(set(root.tolist()))


def test_frames_of_some_megabytes_are_read_by_several_tasks():
    found = pointcloud._partitions([(f"{k}.bin", 4 << 20) for k in range(8)])
    assert [len(p.value) for p in found] == [2, 2, 2, 2]
