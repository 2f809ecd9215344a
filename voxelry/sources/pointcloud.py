"""The ``pointcloud`` data source: ``spark.read.format("pointcloud").option("width", 5).load(folder)``.

It reads and writes files with Python, so it is for folders that driver and executors share; for other stores use
:mod:`voxelry.sources.clouds`. Rows are points: file, point_id, and as many coordinates as ``width`` says.

Reading takes every ``*.bin`` file of whole points below the folder, but nothing whose name begins with ``_`` or ``.``.
Files are read in batches of bounded size, and small files share a partition.

As a stream (``readStream``), files are frames: the digits that end a file's name are its time in nanoseconds, and the
offset is the latest time that was seen. Frames have to appear whole and in order of time, as :class:`_Writer` publishes
them. A file that appears at a time already read, one without a time, or one not of whole points raises an error, so
no frame is lost in silence. An empty file is a frame without points.

Writing appends. ``file`` is the path below the folder, ends with ``.bin``, and its rows should be sorted within one partition
(:func:`voxelry.sources.clouds.write_frames` sees to it); null coordinates become NaN. Each task attempt writes below a
folder of its own, which readers leave out. The commit drops what attempts left that do not count and publishes the
others by a single rename, the abort removes them (a task that is still running then may leave some, unseen), so a
reader finds all of a write or nothing. As a stream sink each
batch is published under its number, and a batch that is run again is published once.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAMES = ("x", "y", "z", "intensity", "ring")
#: Bytes of files that share a partition, and points of one batch.
PARTITION_BYTES, BATCH_POINTS = 8 << 20, 1 << 16


class PointCloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def _folder(self) -> tuple[str, int]:
        return self.options["path"].removeprefix("file://").rstrip("/"), int(self.options.get("width", 3))

    def schema(self) -> str:
        return ", ".join(["file string", "point_id bigint", *[f"{n} float" for n in NAMES[: self._folder()[1]]]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._folder())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(*self._folder())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("pointcloud only appends")
        return _Writer(*self._folder(), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(*self._folder(), schema)


def _files(folder: str) -> list[tuple[str, int]]:
    """Path and bytes of each published ``*.bin`` file, in order of path."""
    out = []
    for at, below, names in os.walk(folder):
        below[:] = [b for b in below if b[0] not in "_."]
        out += [(p, os.path.getsize(p)) for n in names if n.endswith(".bin") and n[0] not in "_." and (p := os.path.join(at, n))]
    return sorted(out)


def _partitions(found: list[tuple[str, int]]) -> list[InputPartition]:
    """Files in runs of at most PARTITION_BYTES, a larger file alone."""
    out, held = [], PARTITION_BYTES + 1
    for path, size in found:
        if held + size > PARTITION_BYTES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [InputPartition(paths) for paths in out] or [InputPartition([])]


def _points(paths: list[str], width: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = ["file", "point_id", *NAMES[:width]]
    for path in paths:
        at = 0
        with open(path, "rb") as file:
            while len(xyz := np.fromfile(file, "<f4", BATCH_POINTS * width).reshape(-1, width)):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), len(xyz)), pa.array(np.arange(at, at + len(xyz))), *[pa.array(np.ascontiguousarray(c)) for c in xyz.T]], names)
                at += len(xyz)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, width: int) -> None:
        self.folder, self.width = folder, width

    def partitions(self) -> list[InputPartition]:
        return _partitions([(path, size) for path, size in _files(self.folder) if size and size % (4 * self.width) == 0])

    def read(self, partition: InputPartition) -> Iterator:
        return _points(partition.value, self.width)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, width: int) -> None:
        self.folder, self.width = folder, width

    def _frames(self) -> list[tuple[int, str, int]]:
        out = []
        for path, size in _files(self.folder):
            stem = re.search(r"(\d+)\.bin$", path)
            if not stem:
                raise ValueError(f"no time in the file's name: {path}")
            if size % (4 * self.width):
                raise ValueError(f"not whole points: {path}")
            out.append((int(stem[1]), path, size))
        return sorted(out)

    def initialOffset(self) -> dict:
        return {"ns": -1, "files": 0}

    def latestOffset(self) -> dict:
        found = self._frames()
        return {"ns": found[-1][0] if found else -1, "files": len(found)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = self._frames()
        for offset in (start, end):
            if sum(ns <= offset["ns"] for ns, _, _ in found) > offset["files"]:
                raise ValueError(f"files appeared below {self.folder} at a time already read, {offset['ns']} or before")
        return _partitions([(path, size) for ns, path, size in found if start["ns"] < ns <= end["ns"]])

    def read(self, partition: InputPartition) -> Iterator:
        return _points(partition.value, self.width)


@dataclass
class _Attempt(WriterCommitMessage):
    """The folder of a task attempt that counts, and what it holds."""

    folder: str
    n_files: int
    n_points: int


class _Attempts:
    """What both writers do: an attempt's files below ``pending``, and publishing them."""

    def _begin(self, folder: str, width: int, schema: StructType) -> None:
        self.folder, self.names = folder, NAMES[:width]
        self.pending = f"{folder}/_pending-{uuid.uuid4().hex}"
        missing = {"file", *self.names} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import numpy as np
        import pyarrow.compute as pc

        own = f"{self.pending}/{uuid.uuid4().hex}"
        name, file, seen, n_points = object(), None, set(), 0  # no name yet
        try:
            for batch in iterator:
                runs = pc.run_end_encode(batch.column("file"))  # no name becomes a Python object for every point
                xyz = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype("<f4") for n in self.names], 1)
                at = 0
                for found, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if found != name:
                        name = found
                        if not name or not name.endswith(".bin") or name.startswith("/") or any(p[:1] in ("", "_", ".") for p in name.split("/")):
                            raise ValueError(f"not a name for a file of points: {name!r}")
                        if file:
                            file.close()
                        os.makedirs(os.path.dirname(f"{own}/{name}"), exist_ok=True)
                        file = open(f"{own}/{name}", "ab")  # rows that come unsorted are added to their file
                        seen.add(name)
                    file.write(np.ascontiguousarray(xyz[at:end]).tobytes())
                    at = end
                n_points += batch.num_rows
        finally:
            if file:
                file.close()
        return _Attempt(own, len(seen), n_points)

    def _publish(self, messages: list, final: str) -> None:
        counted = [m for m in messages if m and m.n_files]
        for pending in {os.path.dirname(m.folder) for m in counted}:
            for attempt in os.listdir(pending):
                if f"{pending}/{attempt}" not in {m.folder for m in counted}:
                    shutil.rmtree(f"{pending}/{attempt}")
            if os.path.exists(final):
                shutil.rmtree(pending)  # this batch was published before
            else:
                os.rename(pending, final)

    def _drop(self, messages: list) -> None:
        for pending in {self.pending, *[os.path.dirname(m.folder) for m in messages if m]}:
            shutil.rmtree(pending, ignore_errors=True)


class _Writer(_Attempts, DataSourceArrowWriter):
    def __init__(self, folder: str, width: int, schema: StructType) -> None:
        self._begin(folder, width, schema)

    def commit(self, messages: list) -> None:
        self._publish(messages, self.pending.replace("/_pending-", "/run-"))

    def abort(self, messages: list) -> None:
        self._drop(messages)


class _StreamWriter(_Attempts, DataSourceStreamArrowWriter):
    """For one query a folder, as the batches' numbers are the query's."""

    def __init__(self, folder: str, width: int, schema: StructType) -> None:
        self._begin(folder, width, schema)

    def commit(self, messages: list, batchId: int) -> None:
        self._publish(messages, f"{self.folder}/batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointCloudSource)
