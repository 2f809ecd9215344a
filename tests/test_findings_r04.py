"""What the reviewer's fourth round found, one small test each."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from voxelry.functions import features as feats
from voxelry.operators import assignment, classify, evaluation, forests
from voxelry.plans import model_queries
from voxelry.sources.adapters import clouds
from voxelry.streaming import timed, tracker

NAMES = [f"f{i}" for i in range(9)]


def _made(spark, n=3000, seed=3):
    """Rows whose class three of nine features tell, with some noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9)).round(3)
    label = np.where(rng.random(n) < 0.1, rng.integers(0, 4, n), (x[:, 0] > 0) * 1 + (x[:, 4] + x[:, 7] > 0.3) * 2)
    pdf = pd.DataFrame(x, columns=NAMES).assign(sample_id=np.arange(n) * 7, label=label.astype("int32"), fold=(np.arange(n) % 3).astype("int32"))
    return spark.createDataFrame(pdf).withColumn("label", F.col("label").cast("int"))


def _plain(x, y, times, weight, slots_of, depth):
    """A tree's root cut by brute force: feature, bin and gain."""
    gini = lambda c: 1 - ((c * weight / (c * weight).sum()) ** 2).sum()
    count = lambda s: np.bincount(y[s], times[s], len(weight))
    whole, best = count(np.ones(len(y), bool)), (0.0, None)
    for slot in slots_of:
        for b in range(forests.MAX_BINS):
            left = x[:, slot] <= b
            a, c = count(left), count(~left)
            if min(a.sum(), c.sum()) >= forests.LEAF:
                share = (a * weight).sum() / (whole * weight).sum()
                best = max(best, (gini(whole) - share * gini(a) - (1 - share) * gini(c), (-slots_of.index(slot), -b)))
    return best


def test_a_tree_cuts_where_brute_force_does_and_keeps_its_limits():
    rng = np.random.default_rng(1)
    for seed in range(6):
        x = rng.integers(0, 40, (300, 9)).astype(np.uint8)
        y = rng.integers(0, 3, 300)
        times, weight = forests.bag(np.arange(300), seed), np.array([1.0, 2.5, 0.5])
        tree = forests.grow(x, y, times, weight, 6, seed)
        slots = forests._chosen(9, 1, seed, 0)[0].tolist()
        gain, (slot, cut) = _plain(x, y, times, weight, slots, 6)
        assert gain > 0 and (tree.feature[0], tree.cut[0]) == (slots[-slot], -cut)
        leaf = forests.leaf_of(tree, x)
        assert (tree.feature[leaf] < 0).all()
        reached = np.bincount(leaf, times, len(tree.feature))[tree.feature < 0]
        assert reached.sum() == times.sum() and reached.min() >= forests.LEAF
        for node in np.unique(leaf):  # a leaf's probabilities are its rows'
            w = np.bincount(y[leaf == node], times[leaf == node], 3) * weight
            assert np.allclose(tree.value[tree.left[node]], w / w.sum(), atol=1e-6)


def test_folds_predict_every_row_as_well_as_sparks_forests_and_fit_none_on_the_driver(spark, monkeypatch):
    rows = _made(spark).persist()
    models = [classify.train(rows.where(F.col("fold") != k), NAMES, 20, 8) for k in range(3)]
    theirs = sum(classify.predict(m, rows.where(F.col("fold") == k)).where("pred = label").count() for k, m in enumerate(models)) / 3000
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: 1 / 0)
    got = classify.cross_validate(rows, NAMES, 3, 20, "fold", 8).toPandas().sort_values("sample_id", ignore_index=True)
    want = rows.orderBy("sample_id").toPandas()
    assert (got.sample_id == want.sample_id).all() and (got.fold == want.fold).all() and (got.truth == want.label).all()
    assert (got.pred == got.truth).mean() == pytest.approx(theirs, abs=0.015)
    again = classify.cross_validate(rows.repartition(7), NAMES, 3, 20, "fold", 8).toPandas().sort_values("sample_id", ignore_index=True)
    assert got.equals(again)  # whatever the partitions


def test_forests_of_more_rows_than_a_task_takes_are_grown_by_nodes(spark, monkeypatch):
    rows = _made(spark, 4000).persist()
    train, test = rows.where("fold > 0"), rows.where("fold = 0")
    one = classify.test_predictions(train, test, NAMES, 15, 8).toPandas()
    monkeypatch.setattr(forests, "TASK_ROWS", 300)
    many = classify.test_predictions(train, test, NAMES, 15, 8).toPandas()
    assert len(one) == len(many) == test.count() and set(one.sample_id) == set(many.sample_id)
    assert (many.pred == many.truth).mean() == pytest.approx((one.pred == one.truth).mean(), abs=0.02)
    # The same trees as arrays give the same probabilities.
    forest = forests.fitted(train, forests.Plan(NAMES, F.col("label"), F.lit(False), 15), 8)
    local = test.orderBy("sample_id").toPandas()
    told = many.sort_values("sample_id")
    assert np.allclose(forest.proba(local[NAMES].to_numpy()), np.stack(told.proba.to_numpy()), atol=1e-6)
    assert len(forest.arrays[0]) == 15 and forest.digest() == forests.fitted(train.repartition(3), forests.Plan(NAMES, F.col("label"), F.lit(False), 15), 8).digest()


def test_rows_that_repeat_an_id_and_folds_without_rows_are_predicted_once_each(spark):
    rows = _made(spark, 300)
    twice = rows.unionByName(rows.where("sample_id < 70").withColumn("fold", F.lit(0)))
    assert classify.cross_validate(twice, NAMES, 5, 2, "fold", 3).count() == 310


def test_both_stages_of_all_folds_are_grown_side_by_side(spark, monkeypatch):
    rows = _made(spark, 1500).persist()
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: 1 / 0)
    got = classify.cross_validate_two_stage(rows, NAMES, 3.0, 3, 12, 8).toPandas()
    assert sorted(got.sample_id) == sorted(r[0] for r in rows.select("sample_id").collect())
    assert set(got.columns) == {"sample_id", "truth", "fold", "pred", "conf", "uncertain"} and got.pred.between(0, 3).all()
    objects = got[got.truth > 0]
    assert (objects.pred == objects.truth).mean() > 0.75


def test_reports_of_feature_sets_and_of_test_objects_need_no_forest_on_the_driver(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: 1 / 0)
    rows = evaluation.with_folds(feats.features(clouds(spark, sf_dir), 35).drop("pts").withColumn("group_id", F.col("sample_id")), 3).persist()
    train, test = rows.where("fold > 0"), rows.where("fold = 0")
    report = classify.ablation(train, test, (19, 23), trees=3, depth=3).toPandas()
    assert report.groupby("mode").support.sum().tolist() == [test.count()] * 2
    summary = classify.ablation_summary(train, test, (19,), trees=3, depth=3, folds=3, tested=classify.test_predictions).first()
    assert 0 <= summary["test_f1"] <= 1 and summary["test_f1"] == pytest.approx(report[report["mode"] == 19].macro_f1.iloc[0])
    monkeypatch.setattr(model_queries, "TREES", 3)
    found = model_queries.rf_test_report(spark, sf_dir).toPandas()
    assert (found.n_right + found.n_wrong).sum() == found.support.sum() > 0


def test_the_pipelines_forest_is_sent_once_and_not_with_every_task(spark, sf_dir, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: 1 / 0)
    monkeypatch.setattr(model_queries, "TREES", 40)
    forest = model_queries._frames_forest(spark, sf_dir)
    assert sum(a.nbytes for a in forest.arrays) > 20_000 > len(cloudpickle.dumps(forest))
    x = np.random.default_rng(2).normal(size=(50, 19))
    assert np.allclose(forest.proba(x).sum(1), 1.0) and np.allclose(forest.proba(x, 7), forest.proba(x))


def _strip(n, seed=4):
    """Gate edges of detections and tracks that lie along a street, ids in no order."""
    rng = np.random.default_rng(seed)
    a, b = (np.column_stack([rng.uniform(0, 40, m), rng.uniform(0, n / 26, m)]) for m in (n, n + n // 30))
    by = np.argsort(b[:, 1])
    lo, hi = (np.searchsorted(b[by, 1], a[:, 1] + d) for d in (-3.3, 3.3))
    rows, at = np.repeat(np.arange(n), hi - lo), np.concatenate([by[i:j] for i, j in zip(lo, hi, strict=True)])
    d = np.hypot(*(a[rows] - b[at]).T)
    met = d < 3.3
    return rows[met], at[met], d[met].round(6)


def test_a_large_group_takes_some_bytes_an_edge():
    rows, cols, costs = _strip(4000)
    assert len(rows) > 60_000
    edges = list(zip(rows.tolist(), cols.tolist(), costs.tolist(), strict=True))
    tracemalloc.start()
    try:
        got = assignment.cheapest(edges)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len({r for r, *_ in got}) == len({c for _, c, _ in got}) == len(got) > 3900
    assert peak < 250 * len(edges)


def test_parts_with_too_many_of_either_side_are_solved_by_matrix_and_edges_alike():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        # A street whose one end has more detections and whose other end more tracks.
        a = np.concatenate([rng.uniform(0, 30, 45), rng.uniform(30, 60, 20)])
        b = np.concatenate([rng.uniform(0, 30, 20), rng.uniform(30, 60, 45)])
        d = np.abs(a[:, None] - b)
        rows, cols = np.nonzero(d < 1.2)
        cost = np.full(d.shape, tracker.FAR)
        cost[rows, cols] = d[rows, cols].round(3)
        want = [cost[i, j] for i, j in tracker.assign_feasible(cost)]
        at = assignment.cheapest_places(rows * 3 + 1, cols * 2, cost[rows, cols])  # numbers may leave gaps
        assert len(at) == len(want) and cost[rows, cols][at].sum() == pytest.approx(sum(want))
        assert len(set(rows[at])) == len(set(cols[at])) == len(at)


def _crowd(frames, n, sensor=0):
    rng = np.random.default_rng(6)
    place = rng.uniform(0, 4000, (n, 3)).round(2)
    rows = [(sensor, f, k, *(place[k] + 0.1 * f).tolist(), ("car", "pedestrian")[k % 2], 0.5 + k % 5 / 10, 10 + k % 7) for f in range(frames) for k in range(n)]
    return pd.DataFrame(rows, columns=["sensor_id", "frame_id", "det_id", "x", "y", "z", "class_label", "class_confidence", "n_points"])


def test_a_trigger_of_many_frames_is_stepped_frame_by_frame():
    crowd = _crowd(12, 1500)
    way = tracker._advance(tracker.Tracker(), 0, None, crowd)
    next(way)
    tracemalloc.start()
    try:
        sizes = [len(pdf) for pdf in way]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(sizes) == 11 and min(sizes) >= 1500
    assert peak < 6e6  # the rows of all frames as tuples are some 15 MB


def test_a_streams_state_is_arrays_and_brings_back_the_same_tracks():
    t = tracker.Tracker(max_misses=2)
    for f in range(4):
        t.step([{"position": (f + 9.0 * k, 1.0 / 3, 0.1 * k), "class_label": "car", "class_confidence": 0.3 + 0.1 * f, "n_points": k} for k in range(1000) if (k + f) % 11])
    t.tracks[3].vote("bicyclist", 0.95)
    kept = tracker.packed(t, 3)
    assert len(kept) < 200 * len(t.tracks)
    again, last = tracker.unpacked(kept, {"max_misses": 2})
    assert last == 3 and again.born == t.born and again.max_misses == 2
    assert tracker.track_rows(0, 4, again.step([])) == tracker.track_rows(0, 4, t.step([]))
    assert [x.votes for x in again.tracks] == [x.votes for x in t.tracks]
    assert tracker.unpacked(tracker.packed(tracker.Tracker(), None), {})[0].tracks == []


def test_what_waits_for_a_timer_is_read_a_frame_at_a_time():
    class State:
        def __init__(self):
            self.of, self.most, self.value = {}, 0, None

        def updateValue(self, key, value):
            self.of[key] = value
            self.most = max(self.most, len(value[0]))

        def getValue(self, key):
            return self.of[key]

        def removeKey(self, key):
            del self.of[key]

        def keys(self):
            return iter(list(self.of))

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value if isinstance(self.value, tuple) else iter(self.value or [])

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]
            self.most = max(self.most, len(rows))

    class Handle:
        def __init__(self):
            self.timers = set()

        def getMapState(self, name, *_):
            return self.__dict__.setdefault(name, State())

        getListState = getValueState = getMapState

        def listTimers(self):
            return iter(sorted(self.timers))

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Passed:
        def getCurrentWatermarkInMs(self):
            return 100 * 7 + 1

    crowd, handle = _crowd(9, 5000), Handle()
    own = timed.TimedTracker(100, {"dt": 0.1})
    own.init(handle)
    mixed = crowd.sample(frac=1.0, random_state=1)
    list(own.handleInputRows((0,), iter([mixed.iloc[:20_000], mixed.iloc[20_000:]]), None))
    assert handle.waiting.most <= timed.ENTRY and sorted({k[0] for k in handle.waiting.of}) == list(range(9))
    got = list(own.handleExpiredTimer((0,), Passed(), None))
    assert [len(set(pdf.frame_id)) for pdf in got] == [1] * 7 and handle.tracks.most <= timed.ENTRY
    assert {k[0] for k in handle.waiting.of} == {7, 8} and handle.timers == {800}
    want = pd.concat(tracker._advance(tracker.Tracker(dt=0.1), 0, None, crowd[crowd.frame_id < 7]), ignore_index=True)
    assert pd.concat(got, ignore_index=True).equals(want)
