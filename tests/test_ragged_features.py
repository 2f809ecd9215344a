"""Features of many clouds at once, held against one cloud at a time."""

import numpy as np
import pytest

from voxelry.functions import features as feats
from voxelry.functions.ragged import Ragged, shape_features

CLOUDS = "sample_id bigint, label int, pts array<struct<x:double,y:double,z:double>>"


def plain(xyz):
    """The shape features of mode 23 of one cloud, step by step."""
    n, z = len(xyz), np.sort(xyz[:, 2])
    zr = float(z[-1] - z[0])
    if n > 3:
        values, vectors = np.linalg.eigh(np.cov(xyz[:, :2].T, bias=True))
        axes, aspect = vectors[:, ::-1], max(values[1], 1e-9) / max(values[0], 1e-9)
    else:
        axes, aspect = np.eye(2), 1.0
    uv = xyz[:, :2] @ axes
    x, y = np.ptp(uv, axis=0)
    e = np.maximum(np.linalg.eigvalsh(np.cov(xyz.T)) if n > 1 else np.zeros(3), 1e-9)
    spread, area = float(np.hypot(x, y)), max(float(x * y), 1e-9)
    s = (xyz[:, 2] - z[0]) / zr if zr > 0.01 else None
    layers = [float(((s >= i / 5) & (s < (i + 1) / 5)).mean()) if s is not None else 0.2 for i in range(5)]
    widths = []
    if zr > 0.1 and n > 20:
        parts = [uv[(xyz[:, 2] >= z[0] + i * zr / 5) & (xyz[:, 2] < z[0] + (i + 1) * zr / 5)] for i in range(5)]
        widths = [float(np.hypot(*np.ptp(p, axis=0))) if len(p) > 2 else 0.0 for p in parts]
    rank = lambda q: float(z[int(q * (n - 1))])
    return {
        "num_points": n, "xy_spread": spread, "xy_area": area, "z_range": zr, "height_to_footprint": zr / max(spread, 1e-6), "density": n / max(area * np.sqrt(zr + 1e-6), 1e-6),
        "z_25": rank(0.25), "z_75": rank(0.75), "z_std": z.std(), "xy_aspect_ratio": aspect, "scattering": e[0] / e[2], "linearity": (e[2] - e[1]) / e[2], "planarity": (e[1] - e[0]) / e[2],
        **{f"layer_frac_{i}": v for i, v in enumerate(layers)}, "cross_section_var": np.std(widths) if widths else 0.0, "cross_section_mean": np.mean(widths) if widths else 0.0,
        "z_range_cleaned": rank(0.95) - rank(0.05) if n > 10 else zr,
    }


def _random(sizes):
    rng = np.random.default_rng(3)
    return [rng.uniform(0, 2, (n, 3)) * rng.uniform(0.1, 3, 3) + rng.uniform(-50, 50, 3) for n in sizes]


def test_many_clouds_at_once_equal_one_at_a_time():
    clouds = _random([1, 2, 3, 4, 5, 10, 11, 20, 21, 60, 400, 5000])
    for mode in (19, 23):
        got = feats.matrix(clouds, mode)
        for row, xyz in zip(got, clouds, strict=True):
            want = plain(xyz) | {"nn_dist_std": feats.neighbour_spread(xyz), "hull_point_ratio": feats.hull_ratio(xyz)}
            assert row == pytest.approx([want[k] for k in feats.MODES[mode]], rel=1e-6, abs=1e-7)


def test_clouds_that_are_cut_into_runs_give_the_same(monkeypatch):
    clouds = _random([7, 300, 1, 40, 40, 999, 2])
    whole = feats.matrix(clouds, 23)
    monkeypatch.setattr(feats, "TOGETHER", 50)
    assert (feats.matrix(clouds, 23) == whole).all()


def test_repeated_and_flat_points():
    same, line, flat = np.ones((30, 3)), np.column_stack([np.arange(30.0), np.zeros(30), np.zeros(30)]), np.column_stack([*_random([30])[0][:, :2].T, np.ones(30)])
    starts = np.array([0, 30, 60, 90])
    found = shape_features(Ragged(np.concatenate([same, line, flat]), starts), 35)
    assert all(np.isfinite(v).all() for v in found.values())
    assert found["z_range"].tolist() == [0, 0, 0] and found["x_range"][1] == 29 and found["xy_area"][0] == 1e-9
    assert found["layer_frac_3"].tolist() == [0.2, 0.2, 0.2] and found["cross_section_mean"].tolist() == [0, 0, 0]


def test_null_and_empty_clouds_nan_points_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    some = [{"x": float(i), "y": float(i * i), "z": float(i % 5)} for i in range(12)]
    odd = some[:5] + [{"x": float("nan"), "y": 0.0, "z": 1.0}, {"x": None, "y": 0.0, "z": 1.0}]
    rows = spark.createDataFrame([(1, 0, some), (2, 0, None), (3, 0, []), (4, 0, odd), (5, 0, some)], CLOUDS).withColumn("density", F.lit("mine"))
    for mode in feats.MODES:
        got = {r["sample_id"]: r for r in feats.features(rows, mode).collect()}
        assert len(got) == 5
        assert all(got[i][k] == 0 for i in (2, 3) for k in feats.MODES[mode])
        assert all(np.isfinite(got[4][k]) for k in feats.MODES[mode]) and got[4]["num_points"] == 7
        assert [got[1][k] for k in feats.MODES[mode]] == [got[5][k] for k in feats.MODES[mode]]
    assert feats.features(rows.limit(0), 35).count() == 0
    assert feats.matrix([], 23).shape == (0, 23)
    with pytest.raises(ValueError):
        feats.features(rows, 20)


def test_stacked_neighbours_equal_one_cloud_at_a_time(monkeypatch):
    clouds = [*_random([1, 6, 7, 7, 8, 21, 21, 127, 128, 129, 300, 12]), np.ones((9, 3)), np.repeat(_random([6])[0], 3, axis=0)]
    want = [feats.neighbour_spread(c) for c in clouds]
    assert feats.neighbour_spreads(clouds) == pytest.approx(want, rel=1e-12, abs=1e-15)
    monkeypatch.setattr(feats, "SQUARES", 500)
    assert feats.neighbour_spreads(clouds) == pytest.approx(want, rel=1e-12, abs=1e-15)
    assert len(feats.neighbour_spreads([])) == 0
