"""The whole perception pipeline.

Clipping, ground removal and clustering run frame by frame in parallel, and so do splitting, merging and
classification without tracks. What tracks change depends on the frame before, so it is one stateful function
by sensor, which streams through the frames in order; without feedback there is none, and results can be kept
and tracked later.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions import features as feats
from voxelry.operators import clustering, ground, merging, splitting
from voxelry.operators.classify import Forest
from voxelry.operators.evaluation import demoted
from voxelry.operators.ground import Calibration
from voxelry.operators.latency import timed
from voxelry.schemas import CLASSES, CLUSTER, TRACKS, frame_key
from voxelry.session import written
from voxelry.sources import store
from voxelry.streaming.tracker import COLUMNS, Tracker, track_rows, whole_frames
from voxelry.streaming.tracker import track as tracker_of

GATE_DISTANCE, MAX_MISSES = 5.0, 3


def clusters(points: DataFrame, calibration: Calibration, cell: float = clustering.CELL, min_points: int = clustering.MIN_POINTS) -> DataFrame:
    """Clusters (cluster schema) of every frame."""
    return splitting.as_clusters(clustering.cluster_frame(written(ground.non_ground(points, calibration), "other"), calibration.ground_height, cell, min_points))


def merge_frame(found: list[dict]) -> list[dict]:
    """Clusters of one frame after the greedy merge; owners get the points and new widths of what they take in."""
    low, high = [c["xyz"].min(0) for c in found], [c["xyz"].max(0) for c in found]
    pairs = [(i, j) for i in range(len(found)) for j in range(len(found)) if i != j and (low[j] >= low[i]).all() and (high[j] <= high[i]).all()]
    owner = merging.fold({i: c["n_points"] for i, c in enumerate(found)}, pairs)
    out = []
    for i, c in enumerate(found):
        if i in owner:
            continue
        taken = [found[j]["xyz"] for j, k in owner.items() if k == i]
        if taken:
            xyz = np.concatenate([c["xyz"], *taken])
            c = c | {"xyz": xyz, "n_points": len(xyz), "z_range": float(np.ptp(xyz[:, 2])), "xy_spread": float(np.hypot(*np.ptp(xyz[:, :2], axis=0)))}
        out.append(c)
    return out


def with_features(found: list[dict], mode: int) -> list[dict]:
    """Clusters of one frame with their ``features``, all at once."""
    return [c | {"features": row} for c, row in zip(found, feats.matrix([c["xyz"] for c in found], mode), strict=True)]


def _decided(c: dict, proba: np.ndarray) -> dict:
    k = int(np.argmax(proba))
    return c | {"pred": demoted(k, c["xy_spread"], c["z_above_ground"], c["z_range"]), "s2_pred": k, "conf": float(proba[k]), "proba": list(map(float, proba))}


def predicted(found: list[dict], forest: Forest) -> list[dict]:
    """Clusters with features, with their class and probabilities."""
    return [_decided(c, p) for c, p in zip(found, forest.proba(np.array([c["features"] for c in found])), strict=True)] if found else []


def _digest(c: dict) -> bytes:
    """Tells clusters of a frame apart by their points, in their order."""
    return hashlib.sha256(c["xyz"].tobytes()).digest()


def classified(found: list[dict], forest: Forest, mode: int, known: dict[bytes, np.ndarray]) -> list[dict]:
    """Clusters with their class and probabilities; only those whose points have no ``known`` probabilities are looked at."""
    digests = [_digest(c) for c in found]
    new = [c for c, d in zip(found, digests, strict=True) if d not in known]
    fresh = iter(predicted(with_features(new, mode), forest))
    return [_decided(c, known[d]) if d in known else next(fresh) for c, d in zip(found, digests, strict=True)]


def frame_steps(pdf: pd.DataFrame, forest: Forest, mode: int) -> Iterator[tuple[str, list[dict]]]:
    """What is done with one frame's clusters without tracks: each step's name and the clusters after it."""
    yield "read", (found := splitting.clusters_of(pdf))
    yield "split", (found := splitting.split_frame(found, []))
    yield "merge", (found := merge_frame(found))
    yield "features", (found := with_features(found, mode))
    yield "predict", predicted(found, forest)


def objects(points: DataFrame, calibration: Calibration, forest: Forest, mode: int = 23, **options) -> DataFrame:
    """Every frame's clusters with their class, split and merged without tracks."""
    made = clusters(points, calibration, **options)
    key = frame_key(made)
    sensors = [c for c in key if c != "frame_id"]
    schema = f"{CLUSTER}, pred int, s2_pred int, conf double, proba array<double>"

    def of_frame(pdf: pd.DataFrame) -> pd.DataFrame:
        *_, (_, found) = frame_steps(pdf, forest, mode)
        return splitting.rows_of(found).assign(**{c: pdf[c].iloc[0] for c in sensors}, pred=[c["pred"] for c in found], s2_pred=[c["s2_pred"] for c in found], conf=[c["conf"] for c in found], proba=[c["proba"] for c in found])

    return made.groupBy(*key).applyInPandas(of_frame, ", ".join([*[f"{c} bigint" for c in sensors], schema]))


def latencies(points: DataFrame, calibration: Calibration, forest: Forest, mode: int = 23, cell: float = clustering.CELL, min_points: int = clustering.MIN_POINTS) -> DataFrame:
    """The frame's key, stage, rows, ms of a run without tracks; ``rows`` are those that the stage leaves.

    The steps on a frame's clusters are timed where they run, a row for each frame that has clusters. Ground removal and
    clustering run on all frames together and have one row each, without frame: the time of the whole job, which reads
    what the stage before wrote. Nothing is computed twice.
    """
    made, rows, took = timed(ground.non_ground(points, calibration), "ground")
    stages = [("ground", rows, took)]
    made, rows, took = timed(splitting.as_clusters(clustering.cluster_frame(made, calibration.ground_height, cell, min_points)), "clusters")
    stages.append(("clusters", rows, took))
    key = frame_key(made)

    def clocked(pdf: pd.DataFrame) -> pd.DataFrame:
        out, began = [], time.perf_counter()
        for stage, found in frame_steps(pdf, forest, mode):
            out.append((*[pdf[k].iloc[0] for k in key], stage, len(found), (time.perf_counter() - began) * 1000))
            began = time.perf_counter()
        return pd.DataFrame(out, columns=[*key, "stage", "rows", "ms"])

    schema = "stage string, rows bigint, ms double"
    whole = made.sparkSession.createDataFrame(stages, schema)
    return made.groupBy(*key).applyInPandas(clocked, f"{', '.join(f'{k} bigint' for k in key)}, {schema}").unionByName(whole, allowMissingColumns=True)


def run(points: DataFrame, calibration: Calibration, forest: Forest, mode: int = 23, dt: float = 0.1, legacy_split_gate: bool = False, class_gate: bool = True, **options) -> DataFrame:
    """Track rows of all frames. Points may have a sensor_id; sensors run in parallel, a sensor's frames in order.

    Without sensor_id the sensor is 0; null ones are sensor -1. Tracks take a step in every frame that
    has points, also where no cluster passes. What does not depend on tracks is done before, by frame and in parallel:
    each frame is split, merged and classified as if there were no tracks. In a sensor's sequence only clusters
    that a track made different are classified again.
    """
    sensor = F.coalesce(F.col("sensor_id").cast("bigint"), F.lit(-1)) if "sensor_id" in points.columns else F.lit(0)
    points = points.withColumn("sensor_id", sensor.cast("bigint"))
    found, frames = written(clusters(points, calibration, **options), "clusters"), points.select("sensor_id", "frame_id").distinct()

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        *_, (_, here) = frame_steps(pdf, forest, mode)
        return pd.DataFrame([(pdf.sensor_id.iloc[0], pdf.frame_id.iloc[0], _digest(c), c["proba"]) for c in here], columns=["sensor_id", "frame_id", "digest", "proba"])

    known = found.groupBy("sensor_id", "frame_id").applyInPandas(alone, "sensor_id bigint, frame_id bigint, digest binary, proba array<double>")
    # Rows without cluster_id are what is known of a frame's clusters, and the frame itself, which may have no clusters.
    every = found.unionByName(known, allowMissingColumns=True).unionByName(frames, allowMissingColumns=True)
    every = every.repartition("sensor_id").sortWithinPartitions("sensor_id", "frame_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tracker, guides = None, None, []
        for sensor, frame, rows in whole_frames(batches):
            if sensor != at:
                at, tracker, guides = sensor, Tracker(MAX_MISSES, 2, GATE_DISTANCE, dt, class_gate), []
            told = rows[rows.digest.notna()]
            before = {bytes(d): np.asarray(p, float) for d, p in zip(told.digest, told.proba, strict=True)}
            rows = rows[rows.cluster_id.notna()].drop(columns=["digest", "proba"]).astype({"cluster_id": "int64", "label_id": "int64", "n_points": "int64"})
            here = merge_frame(splitting.split_frame(splitting.clusters_of(rows), guides, legacy_split_gate))
            seen = [c for c in classified(here, forest, mode, before) if c["pred"] > 0]
            tracks = tracker.step([{"position": c["xyz"].mean(0), "class_label": CLASSES[c["pred"]], "class_confidence": c["conf"], "n_points": c["n_points"]} for c in seen])
            yield pd.DataFrame(track_rows(sensor, frame, tracks), columns=COLUMNS)
            guides = [{"position": t.position, "class_label": t.last_class} for t in tracker.confirmed() if t.last_class != "background"]

    return every.mapInPandas(run, TRACKS)


def cached_objects(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Every frame's objects from the table at ``path`` if there is one, else what ``make`` gives, written there; see :func:`objects`."""
    return store.cached_results(spark, path, make, force)


def kept_objects(points: DataFrame, calibration: Calibration, forest: Forest, path: str, mode: int = 23, **options) -> DataFrame:
    """The objects of every frame of ``points`` as they are kept at ``path``; only frames that are not there yet are computed.

    Frames are kept by calibration, forest, mode and options; see :func:`voxelry.sources.store.kept_by_frame`.
    """
    keys = frame_key(points)
    parameters = {"rotation": calibration.rotation.tolist(), "ground_height": calibration.ground_height, "forest": forest.digest(), "mode": mode, **options}

    def make(missing: DataFrame) -> DataFrame:
        return store.cacheable(objects(points.join(missing, store.same_key(points, missing, keys), "left_semi"), calibration, forest, mode, **options))

    return store.kept_by_frame(points.sparkSession, path, parameters, points.select(*keys).distinct(), make)


def track_cached(found: DataFrame, dt: float = 0.1) -> DataFrame:
    """Confirmed tracks of kept objects, with the class and confidence of the last detection; no feedback on splits."""
    names = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    sensor = F.col("sensor_id") if "sensor_id" in found.columns else F.lit(0).cast("bigint")
    seen = found.where("pred > 0").select(
        sensor.alias("sensor_id"), "frame_id", F.col("cluster_id").alias("det_id"), "centroid.*", names[F.col("pred")].alias("class_label"), F.col("conf").alias("class_confidence"), "n_points"
    )
    tracks = tracker_of(seen, max_misses=MAX_MISSES, gate_distance=GATE_DISTANCE, dt=dt).where("status = 'CONFIRMED'")
    return tracks.withColumn("class_label", F.col("last_class")).withColumn("class_confidence", F.col("last_confidence"))
