"""Augmentation: cuts of complete objects, capped by class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.operators.evaluation import hash_rank
from voxelry.schemas import CLOUD

# Least points, height, least and largest width of a complete object by class id.
FULL = {2: (150, 0.8, 2.5, None), 3: (90, 1.0, None, 2.0), 1: (70, 1.0, None, None)}
# The axis and the shares of it that each cut keeps, by class id. ``long`` is the longer of x and y of each
# object (of equal ones x), ``short`` the other one.
AXIS_CUTS: dict[int, list[tuple[str, float, float]]] = {
    2: [
        ("long", 0.0, 0.5), ("long", 0.5, 1.0), ("short", 0.0, 0.5), ("short", 0.5, 1.0), ("long", 0.0, 0.33), ("long", 0.67, 1.0),
        ("long", 0.0, 0.67), ("long", 0.33, 1.0), ("short", 0.0, 0.33), ("short", 0.67, 1.0), ("short", 0.0, 0.67), ("short", 0.33, 1.0),
    ],
    3: [("z", 0.33, 1.0), ("z", 0.0, 0.67)],
    1: [("long", 0.0, 0.67), ("long", 0.33, 1.0), ("z", 0.3, 1.0), ("z", 0.0, 0.7)],
}
HEIGHT_CUTS: dict[int, list[tuple[float, float]]] = {2: [(0.67, 1.0), (0.0, 0.67), (0.5, 1.0), (0.0, 0.5)]}
LEAST_RANGE, LEAST_POINTS, SEED = 0.1, 30, 42


def _values(axis: str) -> Column:
    return F.transform("pts", lambda p: p[axis])


def fullness(clouds: DataFrame, limits: dict = FULL) -> DataFrame:
    """Adds occupied_bins and is_full. A quarter of the height is occupied if it has over 5 % of the points."""
    z, n = _values("z"), F.size("pts")
    side = lambda k: F.array_max(_values(k)) - F.array_min(_values(k))
    a = clouds.withColumns({"z0": F.array_min(z), "zr": side("z"), "dx": side("x"), "dy": side("y")})

    def occupied(i: int) -> Column:
        inside = F.filter("pts", lambda p: ((p["z"] - F.col("z0")) / F.col("zr") >= i / 4) & ((p["z"] - F.col("z0")) / F.col("zr") < (i + 1) / 4))
        return (F.size(inside) > F.lit(0.05) * n).cast("int")

    full = [occupied(i) for i in range(4)]
    a = a.withColumn("occupied_bins", F.when(F.col("zr") > 0.1, sum(full[1:], full[0])).otherwise(0))
    width = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    test = F.lit(False)
    for label, (points, height, narrow, wide) in limits.items():
        ok = (F.col("label") == label) & (n >= points) & (F.col("zr") >= height) & (F.col("occupied_bins") >= 3)
        ok = ok & (width >= narrow) if narrow is not None else ok
        test |= ok & (width < wide) if wide is not None else ok
    return a.withColumn("is_full", test).drop("z0", "zr", "dx", "dy")


def axis_cuts(clouds: DataFrame, min_points: int = LEAST_POINTS, cuts: dict[int, list[tuple[str, float, float]]] = AXIS_CUTS) -> DataFrame:
    """sample_id, label, cut, pts: half-open shares of each object's extent; thin axes and small cuts are left out."""
    side = lambda k: F.array_max(_values(k)) - F.array_min(_values(k))
    a = clouds.withColumn("x_is_long", side("x") >= side("y"))
    on = {
        "long": lambda p: F.when(F.col("x_is_long"), p["x"]).otherwise(p["y"]), "short": lambda p: F.when(F.col("x_is_long"), p["y"]).otherwise(p["x"]),
        "z": lambda p: p["z"],
    }
    ends = {axis: F.transform("pts", along) for axis, along in on.items()}
    a = a.withColumns({f"lo_{k}": F.array_min(v) for k, v in ends.items()} | {f"size_{k}": F.array_max(v) - F.array_min(v) for k, v in ends.items()})

    def cut(axis: str, lo: float, hi: float, k: int) -> Column:
        low, size = F.col(f"lo_{axis}"), F.col(f"size_{axis}")
        kept = F.filter("pts", lambda p: (on[axis](p) >= low + F.lit(lo) * size) & (on[axis](p) < low + F.lit(hi) * size))
        return F.struct(F.lit(k).alias("cut"), F.when(size >= LEAST_RANGE, kept).alias("pts"))

    rows = F.array().cast(f"array<struct<cut:int,pts:{CLOUD}>>")
    for label, of_class in cuts.items():
        rows = F.when(F.col("label") == label, F.array(*[cut(x, lo, hi, k) for k, (x, lo, hi) in enumerate(of_class)])).otherwise(rows)
    return a.select("sample_id", "label", F.explode(rows).alias("c")).select("sample_id", "label", "c.*").where(F.size("pts") >= min_points)


def height_axis(xyz: np.ndarray) -> np.ndarray:
    """The axis of least scatter, pointing up."""
    axis = np.linalg.eigh(np.cov(xyz.T))[1][:, 0]
    return axis if axis[2] >= 0 else -axis


def height_cuts(clouds: DataFrame, min_points: int = LEAST_POINTS, cuts: dict[int, list[tuple[float, float]]] = HEIGHT_CUTS, first: int = 12) -> DataFrame:
    """sample_id, label, cut, pts: shares along the axis of least scatter; ``first`` is the first cut's number.

    Shares are half-open; a share that ends at 1 leaves out the farthest points, however the sum of start and size is
    rounded. Null clouds and those of fewer than four points give no cut.
    """
    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for r in pdf.itertuples():
                xyz = np.array([(p["x"], p["y"], p["z"]) for p in r.pts if p is not None] if r.pts is not None else [], float)
                if len(xyz) < 4:
                    continue
                along = (xyz - xyz.mean(0)) @ height_axis(xyz)
                low, size = along.min(), np.ptp(along)
                for k, (lo, hi) in enumerate(cuts[r.label]):
                    kept = xyz[(along >= low + lo * size) & (along < (low + hi * size if hi < 1 else along.max()))]
                    if size >= LEAST_RANGE and len(kept) >= min_points:
                        out.append((r.sample_id, r.label, first + k, [{"x": x, "y": y, "z": z} for x, y, z in kept.tolist()]))
            yield pd.DataFrame(out, columns=["sample_id", "label", "cut", "pts"])

    rows = clouds.where(F.col("label").isin(list(cuts))).select("sample_id", "label", "pts")
    return rows.mapInPandas(cut, f"sample_id bigint, label int, cut int, pts {CLOUD}")


def all_cuts(clouds: DataFrame, min_points: int = LEAST_POINTS) -> DataFrame:
    """sample_id, label, cut, pts of every cut: along the axes and by height."""
    return axis_cuts(clouds, min_points).unionByName(height_cuts(clouds, min_points))


def capped(cuts: DataFrame, originals: DataFrame, most: int | None = None, seed: int = SEED) -> DataFrame:
    """label, cut, pts, group_id: at most as many cuts of a class as it had objects (or ``most``), by a seeded hash.

    The group is the object that was cut, so that folds can keep the two together.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string"), F.col("cut").cast("string")))
    limit = originals.groupBy("label").agg((F.lit(most) if most is not None else F.count(F.lit(1))).alias("most"))
    kept = hash_rank(cuts, "label", key, ["sample_id", "cut"]).join(F.broadcast(limit), "label").where("nth <= most")  # limit: a row by class
    return kept.select("label", "cut", "pts", F.col("sample_id").alias("group_id"))


def augment(clouds: DataFrame, min_points: int = LEAST_POINTS, balance: bool = True, most: int | None = None, seed: int = SEED, limits: dict = FULL) -> DataFrame:
    """Originals and their cuts: sample_id (null for cuts), label, pts, group_id."""
    full = fullness(clouds, limits).where("is_full")
    cuts = all_cuts(full, min_points)
    added = capped(cuts, clouds, most, seed) if balance else cuts.select("label", "cut", "pts", F.col("sample_id").alias("group_id"))
    first = clouds.select("sample_id", "label", "pts", F.col("sample_id").alias("group_id"))
    return first.unionByName(added.select(F.lit(None).cast("bigint").alias("sample_id"), "label", "pts", "group_id"))
