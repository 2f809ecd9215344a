"""Clipping, calibration and ground removal.

A frame is clipped in the rotated coordinates first, then its ground is estimated by polar cell; the
order matters, as clipping changes the cells' order statistics. Points keep their original coordinates.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.geometry import horizontal_range, ring_bin, rotated, rotation_to_vertical, sector_bin
from voxelry.operators.quantiles import quantiles
from voxelry.schemas import frame_key
from voxelry.session import written

# The limits of the clip, the calibration and the ground test.
MAX_RANGE, MAX_HEIGHT, MIN_HEIGHT = 80.0, 3.0, -1.0
NEAR_RANGE, LOWEST, HIGHEST = 10.0, -10.0, 30.0
INLIER, LEAST_NZ = 0.3, 0.7
CELL_SHARE, LEAST_CELL = 0.05, 5
BELOW, ABOVE = 0.1, 0.15
#: Distinct points of a frame that planes are drawn from, and the resolution at which points are distinct.
SLOTS, STEP = 4096, 1e-6


@dataclass(frozen=True)
class Calibration:
    """One sensor's ground: rotation to vertical, height of the ground, and the fitted plane."""

    rotation: np.ndarray
    ground_height: float
    normal: tuple[float, float, float] = (0.0, 0.0, 1.0)
    d: float = 0.0
    fitted: bool = True


def with_rotated(points: DataFrame, calibration: Calibration) -> DataFrame:
    """Adds rx, ry, rz."""
    rx, ry, rz = rotated(calibration.rotation, F.col("x"), F.col("y"), F.col("z"))
    return points.withColumns({"rx": rx, "ry": ry, "rz": rz})


def clip_reason(calibration: Calibration) -> Column:
    """``far``, ``high`` or ``low`` for a point that the clip drops, else null; needs rx, ry, rz."""
    height = F.col("rz") - F.lit(calibration.ground_height)
    return F.when(horizontal_range(F.col("rx"), F.col("ry")) > MAX_RANGE, "far").when(height > MAX_HEIGHT, "high").when(height < MIN_HEIGHT, "low")


def clip(points: DataFrame, calibration: Calibration) -> DataFrame:
    """The points within range and height, with rx, ry, rz."""
    return with_rotated(points, calibration).where(clip_reason(calibration).isNull())


def calibration_points(points: DataFrame) -> DataFrame:
    """Adds ``near``; drops points outside the plausible heights."""
    return points.where((F.col("z") > LOWEST) & (F.col("z") < HIGHEST)).withColumn("near", horizontal_range(F.col("x"), F.col("y")) < NEAR_RANGE)


def _number(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def reservoir(near: DataFrame, seed: int, slots: int = SLOTS) -> DataFrame:
    """The frame's key, place, x, y, z: up to ``slots`` of its distinct points, at a resolution of STEP, drawn by a seeded hash.

    Each distinct point has one slot and one hash; a slot keeps its least. So it is one mergeable aggregate of ``slots``
    rows a frame, in which copies of a point count once. Places run from 0 in the order of the hashes.
    """
    key = frame_key(near)
    q = {f"q{c}": F.floor(F.col(c).cast("double") * (1 / STEP)) for c in "xyz"}
    hashed = near.select(*key, *[v.alias(k) for k, v in q.items()]).withColumn("h", _number(F.md5(F.concat_ws(":", F.lit(seed), *q)), 1, 15))
    kept = hashed.groupBy(*key, (F.col("h") % slots).alias("slot")).agg(F.min("h").alias("least"), *[F.min_by(k, "h").alias(k) for k in q])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("least", "slot")) - 1
    return kept.select(*key, place.alias("place"), *[(F.col(k) / (1 / STEP)).alias(k[1:]) for k in q])


def planes(near: DataFrame, n: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """The frame's key, hyp, nx, ny, nz, d: the valid ones of ``n`` planes through triples of different points.

    Triples are drawn independently from the frame's reservoir by hashes of seed and number. Planes that are too steep
    and those through points on a line are left out; frames of fewer than three points have none.
    """
    key = frame_key(near)
    frames = reservoir(near, seed, slots).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "z"))).alias("p"))
    frames = frames.withColumn("m", F.size("p")).where("m >= 3")

    def triple(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), i))
        a = _number(digest, 1, 8) % F.col("m")
        b = (a + 1 + _number(digest, 9, 8) % (F.col("m") - 1)) % F.col("m")
        c = _number(digest, 17, 8) % (F.col("m") - 2)
        # The third is drawn among the places that are left.
        c = c + (c >= F.least(a, b)).cast("int")
        c = c + (c >= F.greatest(a, b)).cast("int")
        return F.struct(i.alias("hyp"), *[F.get("p", j.cast("int")).alias(k) for k, j in (("a", a), ("b", b), ("c", c))])

    drawn = frames.select(*key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), triple)).alias("t")).select(*key, "t.*")
    u, v = ([F.col(f"{to}.{k}") - F.col(f"a.{k}") for k in "xyz"] for to in "bc")
    cross = drawn.select(*key, "hyp", "a", (u[1] * v[2] - u[2] * v[1]).alias("cx"), (u[2] * v[0] - u[0] * v[2]).alias("cy"), (u[0] * v[1] - u[1] * v[0]).alias("cz"))
    cross = cross.withColumn("norm", F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"))).where(F.col("norm") >= 1e-10)
    up = F.when(F.col("cz") < 0, -F.col("norm")).otherwise(F.col("norm"))
    unit = cross.select(*key, "hyp", "a", *[(F.col(f"c{k}") / up).alias(f"n{k}") for k in "xyz"]).where(F.col("nz") >= LEAST_NZ)
    return unit.select(*key, "hyp", "nx", "ny", "nz", (-(F.col("nx") * F.col("a.x") + F.col("ny") * F.col("a.y") + F.col("nz") * F.col("a.z"))).alias("d"))


def frame_inliers(near: DataFrame, found: DataFrame, threshold: float = INLIER, block: int = 16384) -> DataFrame:
    """The frame's key, hyp, n_inliers: points of a frame within ``threshold`` of each of its own planes.

    A frame's points are dealt to blocks, each of which meets the frame's planes and sends one count a plane.
    """
    key = frame_key(near)
    numbered = near.select(*key, *[F.col(c).cast("double").alias(c) for c in "xyz"], F.monotonically_increasing_id().alias("at"))
    blocks = numbered.groupBy(*key, F.floor(F.col("at") / block).alias("block")).agg(F.collect_list(F.struct("x", "y", "z")).alias("p"))
    of = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("hyp", "nx", "ny", "nz", "d"))).alias("planes"))
    schema = pa.schema([*[pa.field(k, pa.int64()) for k in key], pa.field("hyp", pa.int32()), pa.field("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points, tested = batch.column("p")[i].values, batch.column("planes")[i].values
                x, y, z = (np.asarray(points.field(c))[:, None] for c in "xyz")
                nx, ny, nz, d = (np.asarray(tested.field(c)) for c in ("nx", "ny", "nz", "d"))
                n = np.zeros(len(d), np.int64)
                for at in range(0, len(x), 1024):
                    part = slice(at, at + 1024)
                    n += (np.abs(x[part] * nx + y[part] * ny + z[part] * nz + d) < threshold).sum(0)
                same = [pa.array([batch.column(k)[i].as_py()] * len(n), pa.int64()) for k in key]
                yield pa.RecordBatch.from_arrays([*same, tested.field("hyp").cast(pa.int32()), pa.array(n)], schema=schema)

    joined = blocks.join(of, key).select(*[F.col(k).cast("bigint").alias(k) for k in key], "p", "planes")
    return joined.mapInArrow(count, ", ".join([*[f"{k} bigint" for k in key], "hyp int, n bigint"])).groupBy(*key, "hyp").agg(F.sum("n").alias("n_inliers"))


def inlier_counts(near: DataFrame, planes: list[tuple[int, float, float, float, float]], threshold: float = INLIER) -> DataFrame:
    """hyp, n_inliers: points within ``threshold`` of each plane (id, nx, ny, nz, d); each point is read once. Without points no rows.

    A task counts all planes over its points, some at a time, and sends one row by plane.
    """
    hyp, coefficients = np.array([p[0] for p in planes], np.int32), np.array([p[1:] for p in planes], float).reshape(-1, 4)
    nx, ny, nz, d = coefficients.T

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = np.zeros(len(hyp), np.int64), 0
        for batch in batches:
            x, y, z = (np.asarray(batch.column(c), float)[:, None] for c in "xyz")
            seen += batch.num_rows
            for a in range(0, batch.num_rows, 1024):
                part = slice(a, a + 1024)
                found += (np.abs(x[part] * nx + y[part] * ny + z[part] * nz + d) < threshold).sum(0)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(hyp), pa.array(found)], ["hyp", "n"])

    return near.select("x", "y", "z").mapInArrow(count, "hyp int, n bigint").groupBy("hyp").agg(F.sum("n").alias("n_inliers"))


def best_planes(near: DataFrame, max_iterations: int = 1000, threshold: float = INLIER, seed: int = 0, slots: int = SLOTS) -> DataFrame:
    """The frame's key, nx, ny, nz, d, n_inliers for each frame with a valid plane: most inliers, of equal ones the first."""
    key = frame_key(near)
    found = written(planes(near, max_iterations, seed, slots), "planes")
    best = frame_inliers(near, found, threshold).groupBy(*key).agg(F.max(F.struct("n_inliers", (-F.col("hyp")).alias("first"))).alias("m"))
    return found.join(best.select(*key, (-F.col("m.first")).alias("hyp"), "m.n_inliers"), [*key, "hyp"]).drop("hyp")


def calibrations(points: DataFrame, max_iterations: int = 1000, threshold: float = INLIER, seed: int = 0, slots: int = SLOTS) -> DataFrame:
    """The frame's key, nx, ny, nz, d, n_inliers, fitted, ground_height: the ground of each frame with points of plausible height.

    The plane is the best one near the sensor. ``fitted`` is false where no plane was valid; then it is level at the 20th
    percentile of the near heights, or at 0 without any. ground_height is the 5th percentile of the heights along the
    plane's normal, over near and far points. Points that stand there several times draw no plane more often.
    """
    key = frame_key(points)
    valid = written(calibration_points(points).select(*key, "x", "y", "z", "near"), "calibration")
    near = valid.where("near").drop("near")
    low = quantiles(near, key, "z", {"low": 0.2})
    made = valid.select(*key).distinct().join(best_planes(near, max_iterations, threshold, seed, slots), key, "left").join(low, key, "left")
    level = {"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "d": -F.coalesce("low", F.lit(0.0)), "n_inliers": F.lit(0).cast("bigint")}
    made = made.withColumn("fitted", F.col("nz").isNotNull())
    made = written(made.withColumns({k: F.coalesce(k, v) for k, v in level.items()}).drop("low"), "planes")
    along = F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz")
    heights = valid.join(made, key).select(*key, along.alias("height"))
    return made.join(quantiles(heights, key, "height", {"ground_height": 0.05}), key)


def calibrate(points: DataFrame, max_iterations: int = 1000, threshold: float = INLIER, seed: int = 0) -> Calibration:
    """The ground of one frame, whatever its number; see :func:`calibrations`. Says so where no plane was valid."""
    one = points.select(F.lit(0).cast("bigint").alias("frame_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    found = calibrations(one, max_iterations, threshold, seed).first()
    if not found or not found["fitted"]:
        warnings.warn("no valid plane was found near the sensor: the ground is taken for level", stacklevel=2)
    if not found:
        return Calibration(rotation_to_vertical((0.0, 0.0, 1.0)), 0.0, fitted=False)
    normal = (found["nx"], found["ny"], found["nz"])
    return Calibration(rotation_to_vertical(normal), found["ground_height"], normal, found["d"], found["fitted"])


def ground_height(valid: DataFrame, rotation: np.ndarray) -> DataFrame:
    """ground_height: the interpolated 5th percentile of rotated z."""
    _, _, rz = rotated(rotation, F.col("x"), F.col("y"), F.col("z"))
    return quantiles(valid.select(rz.alias("rz")), [], "rz", {"ground_height": 0.05})


def _with_local(clipped: DataFrame) -> DataFrame:
    """Adds the polar cell, its n, and ``local``: the cell's order statistic at max(1, floor(5 % of n)), null below five points.

    Three windows by cell share one shuffle and one sort.
    """
    cell = Window.partitionBy(*frame_key(clipped), "r_bin", "theta_bin")
    k = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(CELL_SHARE)))
    keyed = clipped.withColumn("r_bin", ring_bin(F.col("rx"), F.col("ry"))).withColumn("theta_bin", sector_bin(F.col("rx"), F.col("ry")))
    ranked = keyed.withColumn("n", F.count(F.lit(1)).over(cell)).withColumn("nth", F.row_number().over(cell.orderBy("rz")) - 1)
    return ranked.withColumn("local", F.max(F.when((F.col("n") >= LEAST_CELL) & (F.col("nth") == k), F.col("rz"))).over(cell)).drop("nth")


def _accepted(calibration: Calibration) -> Column:
    """Whether ``local`` is near enough to the calibrated height; farther cells may differ more."""
    tolerance = F.least(0.5 + 0.08 * (F.col("r_bin") + 0.5) * 5.0, F.lit(2.0))
    return F.coalesce(F.abs(F.col("local") - F.lit(calibration.ground_height)) <= tolerance, F.lit(False))


def _ground(calibration: Calibration) -> Column:
    return F.when(_accepted(calibration), F.col("local")).otherwise(F.lit(calibration.ground_height))


def polar_cells(clipped: DataFrame, calibration: Calibration) -> DataFrame:
    """frame_id (and sensor_id, if given), r_bin, theta_bin, n, local, accepted, ground for each polar cell.

    Cells of fewer than five points, and those whose value is too far from the calibrated height, use
    that height.
    """
    cells = _with_local(clipped).groupBy(*frame_key(clipped), "r_bin", "theta_bin").agg(F.max("n").alias("n"), F.max("local").alias("local"))
    return cells.withColumn("accepted", _accepted(calibration)).withColumn("ground", _ground(calibration))


def with_ground(clipped: DataFrame, calibration: Calibration) -> DataFrame:
    """Adds ``is_ground``: a point from 0.1 below to 0.15 above its cell's ground. The frame is read once and shuffled once."""
    local = _ground(calibration)
    return _with_local(clipped).withColumn("is_ground", (F.col("rz") >= local - BELOW) & (F.col("rz") <= local + ABOVE)).drop("r_bin", "theta_bin", "n", "local")


def non_ground(points: DataFrame, calibration: Calibration) -> DataFrame:
    """Clipped points that are not ground, in their original coordinates."""
    return with_ground(clip(points, calibration), calibration).where(~F.col("is_ground")).drop("rx", "ry", "rz", "is_ground")
