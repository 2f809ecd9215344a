"""Splitting clusters that hold several pedestrians, along the principal axis or between known tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.schemas import CLOUD, CLUSTER, frame_key

# Limits of candidates, pieces and the histogram.
LOW, HIGH, LEAST, MOST, STRICT = 1.0, 2.2, 100, 2000, 150
MAX_Z_WEIGHT, MIN_LINEARITY = 0.5, 0.3
BINS, GAP_SHARE = 29, 0.2
PIECE, PIECE_MOST, EVEN = 20, 1000, 0.25
#: A cluster has fewer pieces than the histogram has bins, and one for the rest.
MOST_PIECES = 64
NARROW, WIDE, TALL, ASPECT, FLAT, ROUGH = 0.3, 1.5, 0.8, 0.8, 0.3, 1.5


def principal_axis(xyz: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit axis of the largest scatter, made to point to +x (then +y, +z), and the linearity."""
    c = xyz - xyz.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    axis = vectors[:, 2]
    lead = axis[np.flatnonzero(np.abs(axis) > 1e-12)[0]]
    return axis * np.sign(lead), float((values[2] - values[1]) / (values.sum() + 1e-12))


def is_candidate(xyz: np.ndarray, z_range: float) -> tuple[bool, np.ndarray, float]:
    axis, linearity = principal_axis(xyz)
    fits = LOW <= z_range <= HIGH and LEAST <= len(xyz) <= MOST and len(xyz) > STRICT
    return bool(fits and abs(axis[2]) <= MAX_Z_WEIGHT and linearity > MIN_LINEARITY), axis, linearity


def bin_edges(projections: np.ndarray) -> np.ndarray:
    return np.linspace(projections.min(), projections.max(), BINS + 1)


def gaps(counts: np.ndarray, edges: np.ndarray) -> list[tuple[float, int]]:
    """The centre of each run of sparse bins that a full bin ends, and the number of that bin."""
    sparse = counts < max(counts.mean() * GAP_SHARE, 1)
    centers = (edges[1:] + edges[:-1]) / 2
    ends = np.flatnonzero(sparse[:-1] & ~sparse[1:]) + 1
    starts = np.flatnonzero(sparse & ~np.concatenate([[False], sparse[:-1]]))[: len(ends)]
    return [(float(centers[(a + b) // 2]), int(b)) for a, b in zip(starts, ends, strict=True)]


def gap_thresholds(counts: np.ndarray, edges: np.ndarray) -> list[float]:
    return [at for at, _ in gaps(counts, edges)]


def split_points(projections: np.ndarray) -> list[float]:
    edges = bin_edges(projections)
    return gap_thresholds(np.histogram(projections, bins=edges)[0], edges)


def _width(xyz: np.ndarray) -> float:
    return float(np.hypot(*np.ptp(xyz[:, :2], axis=0)))


def person_like(xyz: np.ndarray) -> bool:
    """Whether a piece of a principal-axis split may be a pedestrian."""
    if len(xyz) < PIECE:
        return False
    z, height, width = xyz[:, 2], float(np.ptp(xyz[:, 2])), _width(xyz)
    if height < TALL or not NARROW <= width <= WIDE or height / (width + 1e-6) < ASPECT:
        return False
    low, high = np.percentile(z, [5, 95])
    if high - low < FLAT:
        return False
    counts = np.histogram(z, bins=np.linspace(low, high, 5))[0].astype(float)
    return not (counts.mean() > 0 and counts.std() / counts.mean() > ROUGH)


def _even(sizes: list[int]) -> bool:
    return len(sizes) >= 2 and max(sizes) <= PIECE_MOST and min(sizes) >= EVEN * max(sizes)


def by_tracks(xyz: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray] | None:
    """Masks of the two halves between two tracks; [] to keep the cluster whole; None if this way doesn't apply."""
    axis = b - a
    norm = np.linalg.norm(axis)
    if norm <= 0.3:
        return None
    side = (xyz - (a + b) / 2) @ (axis / norm)
    halves = [m for m in (side <= 0, side > 0) if m.sum() >= PIECE and NARROW <= _width(xyz[m]) <= WIDE]
    if len(halves) < 2 or any(m.sum() > PIECE_MOST for m in halves):
        return None
    return halves if _even([int(m.sum()) for m in halves]) else []


def by_axis(xyz: np.ndarray, axis: np.ndarray) -> list[np.ndarray]:
    """Masks of the person-like pieces and of the rest, if it is a piece too; [] to keep the cluster whole.

    Pieces are tracked by segment, so the rest never repeats points of a piece; a rest that is too
    large keeps the cluster whole.
    """
    along = (xyz - xyz.mean(0)) @ axis
    cuts = split_points(along)
    if not cuts:
        return []
    segment = np.searchsorted(cuts, along, side="right")
    good = [k for k in range(len(cuts) + 1) if person_like(xyz[segment == k])]
    if not _even([int((segment == k).sum()) for k in good]):
        return []
    rest = ~np.isin(segment, good)
    if rest.sum() > PIECE_MOST:
        return []
    return [segment == k for k in good] + ([rest] if rest.sum() >= PIECE else [])


def as_clusters(found: DataFrame) -> DataFrame:
    """Rows of the clustering step in the cluster schema, after their sensor_id, if they have one."""
    return found.select(
        *frame_key(found), F.col("label").alias("cluster_id"), F.col("label").alias("label_id"), "n_points", F.struct(F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z")).alias("centroid"),
        "z_range", "xy_spread", "z_above_ground", F.lit(False).alias("was_split"), F.lit(False).alias("track_guided"), F.col("pts").cast(CLOUD).alias("pts"),
    )


def candidates(found: DataFrame) -> DataFrame:
    """Adds ``candidate`` and ``linearity``; the cheap limits are tested again on the column side by Catalyst."""
    @F.pandas_udf("candidate boolean, linearity double")
    def test(pts: pd.Series, z_range: pd.Series) -> pd.DataFrame:
        rows = [is_candidate(np.array([(p["x"], p["y"], p["z"]) for p in a], float), z) for a, z in zip(pts, z_range, strict=True)]
        return pd.DataFrame({"candidate": [r[0] for r in rows], "linearity": [r[2] for r in rows]})

    return found.withColumn("__t", test("pts", "z_range")).select("*", "__t.*").drop("__t")


def split_frame(clusters: list[dict], tracks: list[dict], legacy_gate: bool = False) -> list[dict]:
    """Clusters of one frame after splitting. ``legacy_gate``: tracks count only if some cluster is a candidate.

    Each cluster is a dict of the cluster schema with ``xyz`` instead of ``pts``. Pieces keep the
    label, lack a height above ground, and get ids of their own: below zero, so that no label is met.
    """
    tested = [is_candidate(c["xyz"], c["z_range"]) for c in clusters]
    guided = bool(tracks) and (not legacy_gate or any(t[0] for t in tested))
    out = []
    for c, (fits, axis, _) in zip(clusters, tested, strict=True):
        xyz, masks, by = c["xyz"], None, False
        if guided and c["z_range"] > LOW and LEAST < c["n_points"] < MOST:
            centre = xyz.mean(0)
            near = [p for t in tracks if t["class_label"] != "background" and np.linalg.norm((p := np.array(t["position"])) - centre) < c["xy_spread"] + 1.0]
            if len(near) >= 2:
                masks = by_tracks(xyz, near[0], near[1])
                by = bool(masks)
        if masks is None:
            masks = by_axis(xyz, axis) if fits else []
        if not masks:
            out.append(c)
            continue
        for k, m in enumerate(masks):
            piece = xyz[m]
            out.append(c | {
                "cluster_id": -(c["cluster_id"] * MOST_PIECES + k + 1), "xyz": piece, "n_points": len(piece), "z_range": float(np.ptp(piece[:, 2])),
                "xy_spread": _width(piece), "z_above_ground": None, "was_split": True, "track_guided": by,
            })
    return out


def rows_of(clusters: list[dict]) -> pd.DataFrame:
    """Clusters as rows of the cluster schema."""
    names = ["frame_id", "cluster_id", "label_id", "n_points", "centroid", "z_range", "xy_spread", "z_above_ground", "was_split", "track_guided", "pts"]
    rows = []
    for c in clusters:
        m = c["xyz"].mean(0)
        rows.append([c["frame_id"], c["cluster_id"], c["label_id"], c["n_points"], {"x": m[0], "y": m[1], "z": m[2]}, c["z_range"], c["xy_spread"], c["z_above_ground"], c["was_split"], c["track_guided"],
                     [{"x": a, "y": b, "z": d} for a, b, d in c["xyz"].tolist()]])
    return pd.DataFrame(rows, columns=names)


def clusters_of(pdf: pd.DataFrame) -> list[dict]:
    """Rows of the cluster schema as dicts with ``xyz``, by cluster id."""
    rows = pdf.sort_values("cluster_id").to_dict("records")
    return [r | {"xyz": np.array([(p["x"], p["y"], p["z"]) for p in r["pts"]], float).reshape(-1, 3)} for r in rows]


def split(clusters: DataFrame, tracks: DataFrame | None = None, legacy_gate: bool = False) -> DataFrame:
    """Clusters (cluster schema) after splitting; ``tracks`` has frame_id, class_label, x, y, z of the frame before."""
    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return rows_of(split_frame(clusters_of(pdf), []))

    if tracks is None:
        return clusters.groupBy("frame_id").applyInPandas(alone, CLUSTER)

    def guided(pdf: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        known = [{"class_label": t.class_label, "position": (t.x, t.y, t.z)} for t in seen.itertuples()]
        return rows_of(split_frame(clusters_of(pdf), known, legacy_gate)) if len(pdf) else rows_of([])

    return clusters.groupBy("frame_id").cogroup(tracks.toDF(*tracks.columns).groupBy("frame_id")).applyInPandas(guided, CLUSTER)
