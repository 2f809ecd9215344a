import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelry.functions import features as feats
from voxelry.functions.geometry import rotation_to_vertical
from voxelry.operators import ground
from voxelry.operators.clustering import EDGES, STRIDE, component_labels
from voxelry.operators.merging import fold
from voxelry.operators.splitting import gap_thresholds, split_frame
from voxelry.plans import pipeline
from voxelry.schemas import DETECTIONS
from voxelry.streaming.tracker import FAR, Tracker, assign, assign_feasible


@pytest.mark.parametrize("normal", [(0, 0, 1), (0, 0, -1), (1, 0, 0), (-1, 0, 0), (0.1, -0.2, 0.9)])
def test_rotation_is_orthonormal_and_takes_the_normal_up(normal):
    r = rotation_to_vertical(normal)
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    assert np.allclose(r @ (np.array(normal) / np.linalg.norm(normal)), [0, 0, 1])


def test_calibration_finds_a_tilted_plane(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-8, 8, (200, 2))
    tilt = np.tan(np.radians(10))
    plane = np.column_stack([xy, tilt * xy[:, 0] - 1.5])
    cloud = np.vstack([plane, np.column_stack([rng.uniform(-5, 5, (20, 2)), rng.uniform(0, 3, 20)])])
    points = spark.createDataFrame([tuple(map(float, p)) for p in cloud], "x double, y double, z double")
    found = ground.calibrate(points, max_iterations=100, seed=3)
    want = np.array([-tilt, 0, 1]) / np.hypot(tilt, 1)
    assert np.allclose(found.normal, want, atol=0.05)
    assert abs(found.ground_height - -1.5 * want[2]) < 0.15


def test_calibration_without_three_near_points_is_level(spark):
    points = spark.createDataFrame([(50.0, 0.0, 1.0), (60.0, 0.0, 2.0)], "x double, y double, z double")
    with pytest.warns(UserWarning, match="no valid plane"):
        found = ground.calibrate(points)
    assert found.normal == (0.0, 0.0, 1.0) and not found.fitted


@pytest.mark.parametrize(("n", "accepted"), [(4, False), (5, True), (39, True), (40, True)])
def test_polar_cell_needs_five_points_and_takes_the_kth(spark, n, accepted):
    rows = [(0, 11.0, 0.5, -0.5 + i / 100) for i in range(n)]
    cal = ground.Calibration(np.eye(3), -0.5)
    got = ground.polar_cells(ground.clip(spark.createDataFrame(rows, "frame_id int, x double, y double, z double"), cal), cal).collect()
    assert len(got) == 1 and got[0]["accepted"] == accepted
    assert got[0]["ground"] == pytest.approx(-0.5 + (max(1, int(0.05 * n)) / 100 if accepted else 0))


def test_diagonal_cells_are_not_connected():
    label = component_labels(np.array([0, 0, 1, 2]), np.array([0, 1, 2, 2]))
    assert len(set(label.tolist())) == 2 and label[0] == label[1] and label[2] == label[3] == STRIDE + 2


@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=40), st.randoms())
@settings(max_examples=40, deadline=None)
def test_components_do_not_depend_on_order(cells, random):
    a = sorted(cells)
    b = a[:]
    random.shuffle(b)
    of = lambda c: dict(zip(c, component_labels(np.array([x for x, _ in c]), np.array([y for _, y in c])).tolist(), strict=True))
    assert of(a) == of(b)


def test_box_has_twelve_edges_of_one_bit():
    assert len(EDGES) == 12 and all(bin(b).count("1") == 1 for _, b in EDGES)


def test_chain_of_boxes_is_folded_in_order():
    assert fold({0: 100, 1: 40, 2: 10}, [(0, 1), (0, 2), (1, 2)]) == {1: 0, 2: 0}
    assert fold({0: 100, 1: 50}, [(0, 1)]) == {}


def test_only_closed_gaps_split():
    edges = np.linspace(0, 29, 30)
    closed, trailing = np.full(29, 10), np.full(29, 10)
    closed[10:13], trailing[20:] = 0, 0
    assert len(gap_thresholds(closed, edges)) == 1 and gap_thresholds(trailing, edges) == []


def _person(x, n=200, seed=0):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(x - 0.25, x + 0.25, n), rng.uniform(-0.25, 0.25, n), rng.uniform(0, 1.7, n)])


def _cluster(xyz):
    return {"frame_id": 0, "cluster_id": 5, "label_id": 5, "n_points": len(xyz), "xyz": xyz, "z_range": float(np.ptp(xyz[:, 2])), "xy_spread": 2.0, "z_above_ground": 1.7, "was_split": False, "track_guided": False}


def test_two_people_side_by_side_are_split():
    out = split_frame([_cluster(np.vstack([_person(0), _person(2.0, seed=1)]))], [])
    assert [c["n_points"] for c in out] == [200, 200] and all(c["was_split"] for c in out) and len({c["cluster_id"] for c in out}) == 2


def test_tracks_guide_a_split_without_a_gap():
    xyz = np.vstack([_person(0), _person(0.55, seed=1)])
    tracks = [{"class_label": "pedestrian", "position": (0.0, 0, 0.85)}, {"class_label": "pedestrian", "position": (0.55, 0, 0.85)}]
    assert len(split_frame([_cluster(xyz)], [])) == 1
    out = split_frame([_cluster(xyz)], tracks)
    assert len(out) == 2 and all(c["track_guided"] for c in out)


def test_hull_of_a_cube_with_inner_points():
    cube = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    inner = np.random.default_rng(0).uniform(0.2, 0.8, (10, 3))
    assert feats.hull_vertices(np.vstack([cube, inner])) == 8
    assert feats.hull_vertices(np.column_stack([inner[:, :2], np.zeros(10)])) is None


@pytest.mark.parametrize("n", [1, 3, 4, 6, 7, 10, 11, 20, 21, 60])
def test_features_of_small_clouds_agree_with_numpy(spark, n):
    xyz = np.random.default_rng(n).uniform(0, 2, (n, 3))
    pts = [{"x": a, "y": b, "z": c} for a, b, c in xyz.tolist()]
    row = feats.features(spark.createDataFrame([(1, 2, pts)], "sample_id bigint, label int, pts array<struct<x:double,y:double,z:double>>"), 35).first()
    assert all(np.isfinite(row[k]) for k in feats.FULL)
    assert sum(row[f"layer_frac_{i}"] for i in range(5)) <= 1 + 1e-9
    got = feats.features(spark.createDataFrame([(1, 2, pts)], "sample_id bigint, label int, pts array<struct<x:double,y:double,z:double>>"), 23).first()
    for k, want in zip(feats.EXTENDED, feats.matrix([xyz], 23)[0], strict=True):
        assert got[k] == pytest.approx(want, rel=1e-6, abs=1e-7), k


@given(st.integers(0, 5), st.integers(0, 5), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, m, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).uniform(0, 10, (n, m))
    got = assign(cost)
    assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    small = cost if n <= m else cost.T
    best = min((sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0])), default=0)
    assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_groups_of_feasible_pairs_are_solved_exactly(n, m, seed):
    rng = np.random.default_rng(seed)
    cost = np.where(rng.random((n, m)) < 0.4, rng.uniform(0, 3, (n, m)), FAR)
    whole = [p for p in assign(cost) if cost[p] < FAR]
    parts = assign_feasible(cost)
    assert len(parts) == len(whole) and sum(cost[p] for p in parts) == pytest.approx(sum(cost[p] for p in whole))


def _det(x, label="car"):
    return {"position": (x, 0.0, 0.0), "class_label": label, "class_confidence": 0.9, "n_points": 10}


def test_track_life():
    t = Tracker()
    t.step([_det(0)])
    assert not t.tracks[0].confirmed
    assert t.step([]) == []
    for frame in ([_det(0)], [_det(0)], [], [], []):
        t.step(frame)
        assert len(t.tracks) == (0 if t.born == 2 and t.tracks == [] else 1)
    assert t.tracks == [] and t.born == 2
    assert t.step([]) == []


def test_class_gate_keeps_tracks_apart():
    assert FAR > 1e5
    hard, soft = Tracker(), Tracker(class_gate=False)
    for t in (hard, soft):
        t.step([_det(0)])
        t.step([_det(0.1, "pedestrian")])
    assert hard.born == 2 and soft.born == 1


def test_covariance_stays_positive():
    t = Tracker()
    for k in range(30):
        t.step([_det(0.1 * k)] if k % 3 else [])
        for x in t.tracks:
            assert x.a > 0 and x.c > 0 and x.a * x.c - x.b * x.b > -1e-9


def test_tracks_follow_a_filter_of_whole_matrices(spark):
    # Position and velocity in three dimensions with diagonal noise, as one filter of 6 by 6.
    dt, rng = 0.1, np.random.default_rng(4)
    move, see = np.eye(6) + dt * np.eye(6, k=3), np.eye(3, 6)
    noise, seen_noise = np.diag([0.5] * 3 + [2.0] * 3), 0.3 * np.eye(3)
    x, p = np.zeros(6), np.diag([0.5] * 3 + [10.0] * 3)
    t = Tracker(dt=dt)
    track = None
    for k in range(12):
        z = np.array([0.3 * k, -0.1 * k, 0.0]) + rng.normal(0, 0.1, 3)
        if track is None:
            x[:3] = z
        else:
            x, p = move @ x, move @ p @ move.T + noise
            if k % 4:
                gain = p @ see.T @ np.linalg.inv(see @ p @ see.T + seen_noise)
                x, p = x + gain @ (z - see @ x), (np.eye(6) - gain @ see) @ p
        t.step([{"position": tuple(z), "class_label": "car", "class_confidence": 0.9, "n_points": 10}] if k % 4 or track is None else [])
        track = t.tracks[0]
        assert np.allclose([*track.position, *track.velocity], x) and np.isclose(track.a, p[0, 0]) and np.isclose(track.b, p[0, 3]) and np.isclose(track.c, p[3, 3])


def test_confidence_is_the_mean_of_the_current_class():
    t = Tracker(class_gate=False)
    said = [("car", 0.9), ("pedestrian", 0.95), ("car", 0.5), ("pedestrian", 0.96)]
    for label, conf in said:
        t.step([{"position": (0.0, 0, 0), "class_label": label, "class_confidence": conf, "n_points": 10}])
        track = t.tracks[0]
        votes = [c for k, c in said[: said.index((label, conf)) + 1] if k == track.class_label]
        assert track.confidence == pytest.approx(np.mean(votes) if len(said[: said.index((label, conf))]) else 1.0)
    assert track.class_label == "pedestrian"  # 0.955 against 0.7


def test_pieces_of_different_clusters_have_different_ids():
    pair = np.vstack([_person(0), _person(2.0, seed=1)])
    clusters = [_cluster(pair) | {"cluster_id": i, "label_id": i} for i in (5, 321, 322)]
    out = split_frame([*clusters, _cluster(_person(9.0)) | {"cluster_id": 323}], [])
    assert len(out) == 7 and len({c["cluster_id"] for c in out}) == 7


def test_components_and_hulls_equal_brute_force():
    rng = np.random.default_rng(8)
    for n in (12, 30, 80):
        xyz = np.vstack([rng.normal(c, 0.3, (n // 3, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))])
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        eps = 2.5 * np.median(np.sort(d, axis=1)[:, 1])
        near = d <= eps
        core = near.sum(1) >= 3
        group = np.arange(len(xyz))
        for _ in range(len(xyz)):  # core points take the least number within reach
            group = np.array([min(group[j] for j in range(len(xyz)) if core[j] and near[i, j]) if core[i] else group[i] for i in range(len(xyz))])
        # A border point goes to the first group that reaches it; groups are numbered by their first core point.
        sizes = {}
        for i in range(len(xyz)):
            groups = [group[i]] if core[i] else sorted(group[j] for j in range(len(xyz)) if core[j] and near[i, j])[:1]
            for g in groups:
                sizes[g] = sizes.get(g, 0) + 1
        assert feats.component_values(xyz) == ((len(sizes), pytest.approx(max(sizes.values()) / len(xyz))) if sizes else (1.0, 1.0))
        corners = set()
        for a in range(len(xyz)):
            for b in range(a):
                for c in range(b):  # a triangle with all points on one side is a face
                    side = (xyz - xyz[a]) @ np.cross(xyz[b] - xyz[a], xyz[c] - xyz[a])
                    if (side <= 1e-9).all() or (side >= -1e-9).all():
                        corners |= {a, b, c}
        if n < 80:
            assert feats.hull_vertices(xyz) == len(corners)


def test_batch_and_stream_give_the_same_tracks(spark, sf_dir):
    from voxelry.plans.evaluation_queries import track_batch, track_stream

    a, b = (q(spark, sf_dir).orderBy("sensor_id", "frame_id", "track_id").toPandas() for q in (track_batch, track_stream))
    assert len(a) and a.equals(b)


def test_sources_read_what_was_written(spark, tmp_path):
    from voxelry.sources import clouds, pointcloud

    for name, data in {"car/a.bin": np.arange(9), "car/empty.bin": np.zeros(0), "car/odd.bin": np.zeros(4), "tree/b.bin": np.zeros(3)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        data.astype("<f4").tofile(tmp_path / name)
    got = clouds.objects(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["label"] == 2 and [tuple(p) for p in got[0]["pts"]] == [(0, 1, 2), (3, 4, 5), (6, 7, 8)]
    assert {r["reason"] for r in clouds.rejected(spark, str(tmp_path)).collect()} == {"not whole points"}
    pointcloud.register(spark)
    assert spark.read.format("pointcloud").load(str(tmp_path / "car")).count() == 3
    frame = tmp_path / "scan"
    frame.mkdir()
    for ns in (2_000_000_000, 1_000_000_000):
        np.full(10, ns / 1e9, "<f4").tofile(frame / f"{ns}.bin")
    rows = clouds.numbered(clouds.frames(spark, str(frame))).orderBy("frame_id", "point_id").collect()
    assert [(r["frame_id"], r["x"]) for r in rows] == [(0, 1.0), (0, 1.0), (1, 2.0), (1, 2.0)]


def test_model_and_feature_caches(spark, sf_dir, tmp_path):
    from voxelry.operators import classify
    from voxelry.sources import store
    from voxelry.sources.adapters import clouds

    made = feats.features(clouds(spark, sf_dir), 19).drop("pts")
    cached = store.cached_features(spark, str(tmp_path / "f"), feats.COMPACT, made.count(), lambda: made)
    again = store.cached_features(spark, str(tmp_path / "f"), feats.COMPACT, made.count(), lambda: 1 / 0)
    assert cached.count() == again.count() == made.count()
    model = classify.train(cached, feats.COMPACT, 3, 4)
    store.save_model(model, str(tmp_path / "m"), feats.COMPACT, 19)
    loaded, names, mode = store.load_model(spark, str(tmp_path / "m"))
    assert names == feats.COMPACT and mode == 19
    rows = classify.predict(loaded, cached).orderBy("sample_id").limit(50).toPandas()
    x = cached.orderBy("sample_id").limit(50).toPandas()[feats.COMPACT].to_numpy()
    forest = classify.Forest(loaded)
    assert (forest.proba(x).argmax(1) == rows.pred).mean() > 0.95


@pytest.mark.parametrize(("bg", "conf", "s2", "pred", "unsure"), [(True, 0.70, 0.9, 0, False), (True, 0.69, 0.5, 2, True), (True, 0.69, 0.49, 0, True), (False, 0.9, 0.1, 2, False)])
def test_routing_boundaries(spark, bg, conf, s2, pred, unsure):
    from voxelry.operators.evaluation import route

    row = route(spark.createDataFrame([(bg, conf, 2, s2)], "s1_background boolean, s1_conf double, s2_class int, s2_conf double")).first()
    assert (row["pred"], row["uncertain"]) == (pred, unsure)


def test_augmented_classes_do_not_outgrow_the_originals(spark, sf_dir):
    from voxelry.operators.augmentation import augment
    from voxelry.plans.object_queries import SMALL
    from voxelry.sources.adapters import clouds

    c = clouds(spark, sf_dir)
    out = augment(c, min_points=5, limits=SMALL).groupBy("label").count().collect()
    before = {r["label"]: r["count"] for r in c.groupBy("label").count().collect()}
    assert all(before[r["label"]] <= r["count"] <= 2 * before[r["label"]] for r in out)


def test_bicyclists_have_four_cuts_two_along_the_longer_side(spark):
    from voxelry.operators import augmentation

    v = [i / 100 for i in range(100)]
    rows = [(1, 1, [{"x": 2 * t, "y": t, "z": t} for t in v]), (2, 1, [{"x": t, "y": 3 * t, "z": t} for t in v]), (3, 3, [{"x": 2 * t, "y": t, "z": t} for t in v])]
    clouds = spark.createDataFrame(rows, "sample_id bigint, label int, pts array<struct<x:double,y:double,z:double>>")
    got = {(r["sample_id"], r["cut"]): sorted(p["y"] for p in r["pts"]) for r in augmentation.all_cuts(clouds).collect()}
    assert {s: sorted(c for t, c in got if t == s) for s in (1, 2, 3)} == {1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1]}
    for s, k in ((1, 1), (2, 3)):
        low, high = [k * t for t in v if t < 0.67 * 0.99], [k * t for t in v[:-1] if t >= 0.33 * 0.99]
        assert got[s, 0] == pytest.approx(low) and got[s, 1] == pytest.approx(high)


def test_tracks_of_every_sensor_are_listed(spark, sf_dir):
    from voxelry.plans.evaluation_queries import track_batch, track_list

    rows = track_batch(spark, sf_dir).toPandas()
    rows = rows[rows.frame_id == rows.groupby("sensor_id").frame_id.transform("max")]
    want = {s: sorted(g.track_id)[:15] for s, g in rows.groupby("sensor_id")}
    got = track_list(spark, sf_dir).toPandas()
    assert all(g.more.iloc[0] == max((rows.sensor_id == s).sum() - 15, 0) for s, g in got.groupby("sensor_id"))
    assert len(want) > 1 and {s: sorted(g.track_id) for s, g in got.groupby("sensor_id")} == want


def test_tracks_die_in_gaps_of_any_length(spark, tmp_path):
    from voxelry.streaming import tracker

    for gap in (1, 2, 3, 4, 64, 65, 1000):
        rows = [(0, f, f, 0.0, 0.0, 0.0, "car", 0.9, 10) for f in (0, 1, 2, 2 + gap)]
        tracks = {r["track_id"] for r in tracker.track(spark.createDataFrame(rows, DETECTIONS)).collect()}
        assert tracks == ({1} if gap <= 3 else {1, 2})  # three misses end a track
    rows = [(0, f, f, 0.0, 0.0, 0.0, "car", 0.9, 10) for f in (0, 1, 2, 102, 103)]
    frames = spark.createDataFrame(rows, DETECTIONS)
    batch = tracker.track(frames).orderBy("frame_id", "track_id").toPandas()
    assert batch.frame_id.tolist() == [0, 1, 2, 3, 4, 102, 103] and batch.track_id.tolist() == [1] * 5 + [2] * 2
    assert tracker.track_streamed(frames, str(tmp_path)).orderBy("frame_id", "track_id").toPandas().equals(batch)


def _car(sensor, frame, at, z=-0.2):
    side = np.random.default_rng(0).uniform(0, 1, (400, 3)) * (1.0, 1.0, 1.2) + (at, 20.0, z)
    return [(sensor, frame, *map(float, p)) for p in side]


def test_sensors_are_clouds_of_their_own_and_empty_frames_are_steps(spark):
    class _Sure:
        """A forest that takes everything for a car."""

        def proba(self, x):
            return np.tile([0.0, 0.0, 1.0, 0.0], (len(x), 1))

    cal = ground.Calibration(np.eye(3), -1.0)
    alone = _car(0, 0, 3.0) + _car(0, 1, 3.0) + [(0, f, 30.0, 30.0, 0.0) for f in range(2, 6)] + _car(0, 6, 3.0)
    other = [(7, *r[1:]) for r in _car(0, 0, 3.4) + _car(0, 1, 3.4)]
    both = spark.createDataFrame(alone + other, "sensor_id bigint, frame_id bigint, x double, y double, z double").repartition(3)
    got = pipeline.run(both, cal, _Sure(), mode=19).toPandas().sort_values(["sensor_id", "frame_id", "track_id"])
    one = got[got.sensor_id == 0]
    assert one.frame_id.tolist() == [0, 1, 2, 3, 6] and one.track_id.tolist() == [1, 1, 1, 1, 2] and one.misses.tolist() == [0, 0, 1, 2, 0]
    assert got[got.sensor_id == 7].frame_id.tolist() == [0, 1] and (got[got.misses == 0].n_points < 401).all()
    made = pipeline.objects(both, cal, _Sure(), mode=19).toPandas()
    assert sorted(zip(made.sensor_id, made.frame_id, strict=True)) == [(0, 0), (0, 1), (0, 6), (7, 0), (7, 1)]


def test_registered_forests_have_the_production_sizes():
    from voxelry.plans import model_queries

    assert (model_queries.TREES, model_queries.STAGE_TREES, model_queries.DEPTH, model_queries.FOLDS) == (100, 300, 20, 5)


def test_results_are_kept_and_tracked_later(spark, tmp_path):
    class _Sure:
        def proba(self, x):
            return np.tile([0.0, 0.0, 1.0, 0.0], (len(x), 1))

    cal = ground.Calibration(np.eye(3), -1.0)
    points = spark.createDataFrame([r for f in range(4) for r in _car(0, f, 3.0 + 0.1 * f)], "sensor_id bigint, frame_id bigint, x double, y double, z double")
    kept = pipeline.cached_objects(spark, str(tmp_path / "r"), lambda: pipeline.objects(points, cal, _Sure(), mode=19))
    again = pipeline.cached_objects(spark, str(tmp_path / "r"), lambda: 1 / 0)
    assert kept.count() == again.count() == 4 and "proba" not in again.columns and "pts" in again.columns
    tracks = pipeline.track_cached(again).toPandas().sort_values("frame_id")
    assert tracks.frame_id.tolist() == [1, 2, 3] and set(tracks.track_id) == {1} and set(tracks.class_label) == {"car"} and tracks.frames_alive.tolist() == [2, 3, 4]
    live = pipeline.run(points, cal, _Sure(), mode=19).where("status = 'CONFIRMED'").toPandas().sort_values("frame_id")
    assert np.allclose(live[["x", "y", "z", "vx"]], tracks[["x", "y", "z", "vx"]])
    with pytest.raises(ZeroDivisionError):
        pipeline.cached_objects(spark, str(tmp_path / "r"), lambda: 1 / 0, force=True)


def test_object_files_and_csv_round_trip(spark, tmp_path):
    from voxelry.sources import clouds, store

    rows = [(k % 3 + 1, k, [{"x": k + i / 4, "y": 1.0, "z": -i / 2} for i in range(5)]) for k in range(6)]
    made = spark.createDataFrame(rows, "label int, number int, pts array<struct<x:double,y:double,z:double>>")
    assert clouds.write_object_files(made, (tmp_path / "out").as_uri()).count() == 6
    got = sorted((r["label"], [tuple(p) for p in r["pts"]]) for r in clouds.objects(spark, str(tmp_path / "out")).collect())
    assert got == sorted((a, [(p["x"], p["y"], p["z"]) for p in pts]) for a, _, pts in rows)
    table = spark.createDataFrame([(1.5, 2.0, 3, "a"), (0.25, -1.0, 0, "b")], "num_points double, z_range double, label int, path string")
    store.write_feature_csv(table, str(tmp_path / "csv"))
    assert sorted(map(tuple, store.read_feature_csv(spark, str(tmp_path / "csv"), ["num_points", "z_range"]).collect())) == sorted(map(tuple, table.collect()))


def test_inliers_of_given_planes(spark):
    points = spark.range(20000).selectExpr("cast(id % 100 AS double) / 10 AS x", "cast(id DIV 100 AS double) / 20 AS y", "0.0D AS z")
    counts = {r["hyp"]: r["n_inliers"] for r in ground.inlier_counts(points, [(0, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, -5.0)], 0.15).collect()}
    assert counts == {0: 20000, 1: 600}


def test_ablation_summary_and_test_report(spark, sf_dir):
    from voxelry.operators import classify, evaluation
    from voxelry.sources.adapters import clouds

    rows = feats.features(clouds(spark, sf_dir), 35).drop("pts").withColumn("group_id", __import__("pyspark.sql.functions", fromlist=["col"]).col("sample_id"))
    rows = evaluation.with_folds(rows, 3).persist()
    train, test = rows.where("sample_id % 4 > 0"), rows.where("sample_id % 4 = 0")
    got = classify.ablation_summary(train, test, (19,), trees=3, depth=3, folds=3).first()
    assert got["n_features"] == 19 and 0 <= got["cv_f1"] <= 1 and 0 <= got["test_f1"] <= 1 and got["cv_std"] >= 0
    report = classify.evaluate_on_test(classify.train(train, feats.COMPACT, 3, 3), test)
    assert report["report"].first()["macro_f1"] == pytest.approx(got["test_f1"]) and set(report) == {"report", "confusion", "confidence", "pairs"}
