"""Calibration, order statistics, components and neighbours of large groups, held against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.functions.features import density_components, neighbour_distances
from voxelry.operators import clustering, ground
from voxelry.operators.quantiles import quantiles, ranks, steps

POINTS = "frame_id bigint, x double, y double, z double"


def _tilted(n=500, seed=2):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(-6, 6, (2, n))
    return [(0, float(a), float(b), float(0.2 * a - 1.5)) for a, b in zip(x, y, strict=True)]


@pytest.mark.parametrize("times", [2, 10])
def test_repeated_points_give_the_same_plane(spark, times):
    points = spark.createDataFrame(_tilted() * times, POINTS)
    assert ground.planes(points, 60, 0).count() == 60
    found = ground.calibrations(points, 60).first()
    want = np.array([-0.2, 0, 1]) / np.hypot(0.2, 1)
    assert found["fitted"] and np.allclose([found["nx"], found["ny"], found["nz"]], want, atol=1e-5) and found["n_inliers"] == 500 * times
    once = ground.calibrations(spark.createDataFrame(_tilted(), POINTS), 60).first()
    assert (found["nx"], found["ny"], found["nz"], found["d"]) == (once["nx"], once["ny"], once["nz"], once["d"])


def test_frames_are_calibrated_apart(spark):
    steep = [(1, 0.0, float(i % 7), float(i // 7)) for i in range(49)]
    line = [(2, float(i), float(i), 1.0) for i in range(6)]
    far = [(3, 50.0, 1.0, 2.0)]
    points = spark.createDataFrame(_tilted() + steep + line + far + [(4, 1.0, 1.0, 40.0)], POINTS)
    found = {r["frame_id"]: r for r in ground.calibrations(points, 40).collect()}
    assert set(found) == {0, 1, 2, 3} and [found[i]["fitted"] for i in range(4)] == [True, False, False, False]
    assert found[1]["d"] == -np.percentile([p[3] for p in steep], 20) and found[2]["d"] == -1.0 and found[3]["d"] == 0 and found[3]["ground_height"] == 2.0
    alone = ground.calibrations(spark.createDataFrame(_tilted(), POINTS), 40).first()
    assert found[0] == alone
    assert ground.calibrations(spark.createDataFrame([], POINTS), 40).count() == 0


def test_reservoir_is_a_sample_of_distinct_points(spark):
    points = spark.range(20000).select(F.lit(0).cast("bigint").alias("frame_id"), (F.col("id") % 5000 / 10).alias("x"), F.lit(0.5).alias("y"), F.lit(-1.25).alias("z"))
    got = ground.reservoir(points, 1, 64).toPandas()
    assert len(got) == 64 and got.x.nunique() == 64 and sorted(got.place) == list(range(64)) and got.x.between(0, 500).all() and 150 < got.x.mean() < 350
    assert sorted(ground.reservoir(points.repartition(7), 1, 64).toPandas().x) == sorted(got.x)
    few = ground.reservoir(points.where("x < 1"), 1, 64).toPandas()
    assert set(few.x.round(6)) <= {i / 10 for i in range(10)}


VALUES = {
    "uniform": lambda r: r.random(4000), "equal": lambda r: np.full(3000, 2.5), "two": lambda r: np.repeat([1.0, -1.0], [2999, 1]), "outliers": lambda r: np.r_[r.normal(size=3000), 1e18, -1e12],
    "one": lambda r: np.array([7.0]), "pair": lambda r: np.array([1.0, 2.0]), "integers": lambda r: r.integers(0, 9, 2500).astype(float),
}


@pytest.mark.parametrize(("bins", "kept"), [(16, 20), (4096, 65536)])
def test_quantiles_equal_numpy(spark, bins, kept):
    rng = np.random.default_rng(4)
    groups = {name: f(rng) for name, f in VALUES.items()} | {None: rng.normal(size=50)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("one", None), ("one", float("inf"))]
    shares = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p90": 0.9, "top": 1.0}
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", shares, bins, kept).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert np.allclose([got[k][c] for c in shares], np.quantile(values, list(shares.values())), rtol=1e-12), k


def test_ranks_without_keys_and_of_an_empty_table(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("v"))
    got = {r["rank"]: r["v"] for r in ranks(rows.withColumn("k", F.lit(1)), ["k"], "v", [F.lit(0), F.lit(499), F.col("total") - 1], 8, 16).collect()}
    assert got == {0: 0.0, 499: 499.0, 999: 999.0}
    assert quantiles(rows, [], "v", {"q": 0.25}).first()["q"] == np.quantile(np.arange(1000), 0.25)
    assert quantiles(rows.where("v < 0").withColumn("k", F.lit(1)), ["k"], "v", {"q": 0.5}).count() == 0


def test_steps_cross_the_ranges(spark):
    values = [5, 1, 1, 9, 30, 12, 100, 2, None]
    got = sorted(r["d"] for r in steps(spark.createDataFrame([(v,) for v in values], "t bigint").repartition(4), F.col("t")).collect())
    assert got == sorted(np.diff(sorted(v for v in values if v is not None)).tolist())
    assert steps(spark.createDataFrame([], "t bigint"), F.col("t")).count() == 0


@pytest.mark.parametrize("tile", [3, 8, 1000])
def test_tiles_give_the_components_of_whole_frames(spark, tile):
    rng = np.random.default_rng(6)
    cells = [(f, int(x), int(y)) for f in range(3) for x, y in {tuple(p) for p in rng.integers(0, 24, (300, 2)).tolist()}]
    spiral = [(9, x, y) for x in range(16) for y in range(16) if (x % 2 == 0) or (y == (15 if x % 4 == 1 else 0))]
    table = spark.createDataFrame([(*c, True) for c in cells + spiral] + [(9, 40, 40, False)], "frame_id bigint, cx bigint, cy bigint, occupied boolean")
    order = lambda d: sorted(map(tuple, d.select("frame_id", "cx", "cy", "label").collect()))
    assert order(clustering.tiled_components(table, tile)) == order(clustering.components(table))


def test_tiled_labels_equal_labels_by_frame(spark):
    rng = np.random.default_rng(8)
    rows = [(int(f), *map(float, p)) for f in range(2) for p in rng.normal(scale=6, size=(800, 3))]
    points = spark.createDataFrame(rows, POINTS)
    order = lambda d: sorted(map(tuple, d.select("frame_id", "x", "y", "z", "cx", "cy", "label").collect()))
    want = order(clustering.with_labels(clustering.with_cells(points, 0.5)))
    assert order(clustering.tiled_labels(clustering.cells_from(points, 0.5), 7)) == want and want


CLOUDS = {
    "random": lambda r: r.normal(size=(700, 3)), "repeated": lambda r: r.integers(0, 4, (600, 3)).astype(float), "on a line": lambda r: np.outer(r.random(500), [1, 2, 3]), "all equal": lambda r: np.ones((300, 3)),
    "far point": lambda r: np.r_[r.normal(size=(400, 3)) * 1e-3, [[1e6, 0, 0]]], "few": lambda r: r.random((7, 3)), "two groups": lambda r: np.r_[r.normal(size=(200, 3)), r.normal(size=(200, 3)) + 50],
}


def _scan(xyz, eps, least=3):
    near = [np.flatnonzero(row) for row in ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= eps * eps]
    label, found = np.full(len(xyz), -1), 0
    for i in range(len(xyz)):
        if label[i] < 0 and len(near[i]) >= least:
            label[i], todo = found, [i]
            while todo:
                for j in near[todo.pop()]:
                    if label[j] < 0:
                        label[j] = found
                        if len(near[j]) >= least:
                            todo.append(j)
            found += 1
    return label


@pytest.mark.parametrize("name", CLOUDS)
def test_neighbours_and_density_equal_all_pairs(name):
    xyz = CLOUDS[name](np.random.default_rng(1))
    want = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)), axis=1)[:, 1:6]
    assert (neighbour_distances(xyz, 5) == want).all()
    for eps in (2.5 * np.median(want[:, 0]), 0.0, 0.3):
        assert (density_components(xyz, eps) == _scan(xyz, eps)).all()
