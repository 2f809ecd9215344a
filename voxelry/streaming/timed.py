"""The tracker as a stream with event-time timers.

Rows wait in state until the watermark has passed their frame, so they may come in any order within the delay; rows that
come later than that are dropped. A timer for each sensor's next frame steps it: with the detections that wait for
it, or with none, so that the tracks of a sensor that falls silent miss, and die, while others still send. A sensor
without tracks and without waiting rows has no timer and costs nothing.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxelry.schemas import DETECTIONS, TRACKS
from voxelry.session import shared_folder
from voxelry.streaming.tracker import COLUMNS, Track, Tracker, track_rows

#: The state store that timers and lists need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A frame's rows wait as columns, some rows in one entry, so that no task ever holds all that waits.
FRAME = "frame_id bigint, part int"
WAITING = "det_id array<bigint>, x array<double>, y array<double>, z array<double>, class_label array<string>, class_confidence array<double>, n_points array<bigint>"
ENTRY = 4096
#: A track's state, a column each.
STATE = (
    "track_id bigint, x double, y double, z double, vx double, vy double, vz double, a double, b double, c double, class_label string, confidence double, n_points bigint, hits int, misses int, age int, "
    "confirmed boolean, last_class string, last_confidence double, frames_alive int, vote_classes array<string>, vote_sums array<double>, vote_counts array<int>"
)


def to_row(t: Track) -> tuple:
    votes = sorted(t.votes.items())
    return (
        t.track_id, *map(float, t.position), *map(float, t.velocity), float(t.a), float(t.b), float(t.c), t.class_label, float(t.confidence), int(t.n_points), t.hits, t.misses, t.age,
        bool(t.confirmed), t.last_class, float(t.last_confidence), t.frames_alive, [k for k, _ in votes], [float(s) for _, (s, _) in votes], [int(n) for _, (_, n) in votes],
    )


def from_row(r: tuple) -> Track:
    votes = {k: (s, n) for k, s, n in zip(r[20], r[21], r[22], strict=True)}
    return Track(
        int(r[0]), np.array(r[1:4], float), r[10], int(r[12]), np.array(r[4:7], float), r[7], r[8], r[9], r[11], int(r[13]), int(r[14]), int(r[15]), bool(r[16]), False, r[17], r[18], int(r[19]), votes
    )


class TimedTracker(StatefulProcessor):
    """Steps one sensor's tracker when the watermark passes its frames; ``step_ms`` is the time from frame to frame."""

    def __init__(self, step_ms: int, options: dict) -> None:
        self.step_ms, self.options = step_ms, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", FRAME, WAITING)
        self.tracks = handle.getListState("tracks", STATE)
        self.place = handle.getValueState("place", "last bigint, born bigint")

    def _time(self, frame: int) -> int:
        return (frame + 1) * self.step_ms

    def _timer(self, frame: int) -> None:
        """One timer a sensor: that of its next frame."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(self._time(frame))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names, first, parts = [c.split()[0] for c in WAITING.split(", ")], None, self._parts()
        for pdf in rows:
            for frame, new in pdf.groupby("frame_id"):
                frame = int(frame)
                for at in range(0, len(new), ENTRY):
                    columns = new.iloc[at : at + ENTRY]
                    entry = tuple((columns[c] if c == "class_label" else columns[c].astype("int64" if c in ("det_id", "n_points") else float)).tolist() for c in names)
                    self.waiting.updateValue((frame, parts.get(frame, 0)), entry)
                    parts[frame] = parts.get(frame, 0) + 1
                first = frame if first is None else min(first, frame)
        if first is not None:
            due = list(self.handle.listTimers())
            if not due or self._time(first) < min(due):
                self._timer(first)
        return iter(())

    def _parts(self) -> dict[int, int]:
        """The entries of each frame that waits."""
        return dict(Counter(int(k[0]) for k in self.waiting.keys()))

    def _taken(self, frame: int, parts: int) -> list[dict]:
        """A frame's detections by id, which wait no longer."""
        found = []
        for part in range(parts):
            found += zip(*self.waiting.getValue((frame, part)), strict=True)
            self.waiting.removeKey((frame, part))
        return [{"position": r[1:4], "class_label": r[4], "class_confidence": r[5], "n_points": int(r[6])} for r in sorted(found, key=lambda r: r[0])]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = self._parts()
        last, born = self.place.get() if self.place.exists() else (None, 0)
        tracker = Tracker(**self.options, tracks=[from_row(r) for r in self.tracks.get()], born=int(born))
        while True:
            due = min(waiting, default=None)
            frame = int(last) + 1 if tracker.tracks else due
            if frame is None or self._time(frame) >= passed:
                break
            yield pd.DataFrame(track_rows(int(key[0]), frame, tracker.step(self._taken(frame, waiting.pop(frame, 0)))), columns=COLUMNS)
            last = frame
        self.tracks.clear()
        for at in range(0, len(tracker.tracks), ENTRY):
            self.tracks.appendList([to_row(t) for t in tracker.tracks[at : at + ENTRY]])
        if last is not None:
            self.place.update((int(last), tracker.born))
        if frame is not None:
            self._timer(frame)

    def close(self) -> None:
        pass


def track_timed(frames: DataFrame, dt: float = 0.1, delay: float = 0.0, **options) -> DataFrame:
    """Track rows from a stream of detections (see DETECTIONS), by sensor and frame, as soon as the watermark passes a frame.

    Frame k, from 0, is at (k + 1) * dt seconds, as the watermark starts at 0; rows may come up to ``delay`` seconds after the
    latest frame of any sensor, later ones are dropped. Null sensors are sensor -1. The session's state store has to be STORE.
    """
    rows = frames.withColumn("sensor_id", F.coalesce(F.col("sensor_id").cast("bigint"), F.lit(-1))).withColumn("at", F.timestamp_millis(((F.col("frame_id") + 1) * round(dt * 1000)).cast("bigint")))
    timed = rows.withWatermark("at", f"{round(delay * 1000)} milliseconds")
    return timed.groupBy("sensor_id").transformWithStateInPandas(TimedTracker(round(dt * 1000), {"dt": dt, **options}), TRACKS, "Append", "EventTime")


def track_timed_streamed(frames: DataFrame, until: int, parts: int = 3, files: int = 4, dt: float = 0.1, **options) -> DataFrame:
    """Streams ``frames`` from files through :func:`track_timed`, ``parts`` triggers in order of time, and gives all rows up to frame ``until``.

    Each part is ``files`` files, one trigger's worth, dealt by sensor. A last file holds one row of a sensor of its own,
    -2, behind ``until``: it moves the watermark, as the clock of a live source would, and is left out of the result.
    """
    spark = frames.sparkSession
    folder = f"{shared_folder(spark)}/timed-{uuid.uuid4().hex}"
    names = [c.split()[0] for c in DETECTIONS.split(", ")]
    lo, hi = frames.agg(F.min("frame_id"), F.max("frame_id")).first()
    part = F.floor((F.col("frame_id") - (lo or 0)) * parts / (((hi or 0) - (lo or 0)) + 1))
    frames.select(*names, part.alias("part")).write.partitionBy("part").parquet(f"{folder}/parts")
    read = spark.read.parquet(f"{folder}/parts") if lo is not None else None
    for k in range(parts if read is not None else 0):  # only the part's own files are read
        read.where(F.col("part") == k).drop("part").repartition(files, "sensor_id").select(names).write.mode("append").parquet(f"{folder}/in")
    end = spark.range(1).select(F.lit(-2).cast("bigint").alias("sensor_id"), F.lit(until + 1).cast("bigint").alias("frame_id"), F.lit(0).cast("bigint").alias("det_id"), *[F.lit(0.0).alias(c) for c in "xyz"], F.lit("car").alias("class_label"), F.lit(0.0).alias("class_confidence"), F.lit(0).cast("bigint").alias("n_points"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        run = track_timed(stream, dt, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)  # other streams of the session keep their own
    return spark.read.schema(TRACKS).parquet(f"{folder}/out").where("sensor_id <> -2")
