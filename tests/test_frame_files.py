"""Frame files: the sink's commit and abort, the stream's offsets, and what a broken file does."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.sources import clouds, pointcloud
from voxelry.streaming import frames

SCHEMA = "frame_ns bigint, point_id bigint, x float, y float, z float, intensity float, ring float"


def _points(spark, stamps, n=7):
    rows = [(ns, i, float(ns), float(i), 0.5, None if i == 3 else 1.0, 2.0) for ns in stamps for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "point_id")


def _left(folder):
    return sorted(os.path.join(os.path.relpath(at, folder), n) for at, _, names in os.walk(folder) for n in names)


def test_frames_come_back_in_order_and_nothing_pends(spark, tmp_path):
    clouds.write_frames(_points(spark, [30, 5, 100]), str(tmp_path))
    assert not any("_pending" in d for d in os.listdir(tmp_path)) and len(os.listdir(tmp_path)) == 1
    got = clouds.numbered(clouds.frames(spark, str(tmp_path))).orderBy("frame_id", "point_id").toPandas()
    assert got.frame_id.tolist() == [0] * 7 + [1] * 7 + [2] * 7 and got.x.tolist() == [5.0] * 7 + [30.0] * 7 + [100.0] * 7
    assert got.y.tolist() == [0, 1, 2, 3, 4, 5, 6] * 3 and got.intensity.isna().sum() == 3


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    bad = _points(spark, range(8)).withColumn("x", F.when((F.col("frame_ns") == 5) & (F.col("point_id") == 6), F.raise_error(F.lit("broken")).cast("float")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        clouds.write_frames(bad, str(tmp_path))
    assert pointcloud._files(str(tmp_path)) == []
    for name in ("../x.bin", "_x.bin", "x.txt", None):
        named = spark.createDataFrame([(name, 1.0, 1.0, 1.0)], "file string, x float, y float, z float")
        with pytest.raises(Exception, match="not a name"):
            named.write.format("pointcloud").mode("append").save(str(tmp_path))
    assert pointcloud._files(str(tmp_path)) == []


def test_attempts_that_do_not_count_are_dropped(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("file string, x float, y float, z float")
    batch = lambda names: pa.RecordBatch.from_pydict({"file": names, "x": [1.0] * len(names), "y": [2.0] * len(names), "z": [3.0] * len(names)})
    writer = pointcloud._Writer(str(tmp_path), 3, schema)
    lost, kept, none = writer.write(iter([batch(["a.bin"])])), writer.write(iter([batch(["a.bin", "b.bin"]), batch(["a.bin"])])), writer.write(iter([]))
    assert pointcloud._files(str(tmp_path)) == [] and lost.n_files == 1 and none.n_files == 0
    writer.commit([kept, none, None])
    assert [(os.path.basename(p), n) for p, n in pointcloud._files(str(tmp_path))] == [("a.bin", 24), ("b.bin", 12)]  # unsorted rows join their file
    for _ in range(2):  # a batch that is run again
        stream = pointcloud._StreamWriter(str(tmp_path), 3, schema)
        stream.commit([stream.write(iter([batch(["c.bin"])]))], 4)
    assert sum(p.endswith("c.bin") for p, _ in pointcloud._files(str(tmp_path))) == 1
    stream = pointcloud._StreamWriter(str(tmp_path), 3, schema)
    stream.abort([stream.write(iter([batch(["d.bin"])])), None], 5)
    assert len(_left(tmp_path)) == 3


def test_the_stream_takes_up_each_frame_once(spark, tmp_path):
    src, kept = str(tmp_path / "src"), str(tmp_path / "kept")
    os.makedirs(src)
    assert frames.take_up(spark, src, kept).count() == 0
    clouds.write_frames(_points(spark, [10, 9, 1000]), src)
    assert frames.take_up(spark, src, kept).count() == 21
    assert frames.take_up(spark, src, kept).count() == 21  # nothing new
    open(f"{src}/1001.bin", "w").close()  # a frame without points
    clouds.write_frames(_points(spark, [1002, 10000], 2), src)
    got = frames.take_up(spark, src, kept)
    assert got.count() == 25 and [tuple(r) for r in got.groupBy("frame_ns").count().orderBy("frame_ns").collect()] == [(9, 7), (10, 7), (1000, 7), (1002, 2), (10000, 2)]
    np.zeros(5, "<f4").tofile(f"{src}/11.bin")
    with pytest.raises(Exception, match="at a time already read"):
        frames.take_up(spark, src, kept)


@pytest.mark.parametrize(("name", "values", "message"), [("5.bin", 4, "not whole points"), ("five.bin", 5, "no time")])
def test_the_stream_refuses_broken_files(spark, tmp_path, name, values, message):
    np.zeros(values, "<f4").tofile(tmp_path / name)
    with pytest.raises(Exception, match=message):
        frames.take_up(spark, str(tmp_path), str(tmp_path / "_kept"))


def test_frames_as_a_sink_of_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    clouds.write_frames(_points(spark, [1, 2]), src)
    for stamps in ([], [3]):
        if stamps:
            clouds.write_frames(_points(spark, stamps), src)
        arriving = clouds.stream_frames(spark, src).withColumn("file", F.format_string("%d.bin", "frame_ns"))
        arriving.writeStream.format("pointcloud").option("width", 5).option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert clouds.frames(spark, out).count() == 21 and not any("_pending" in d for d in os.listdir(out))


def test_large_and_small_files_share_out(tmp_path, monkeypatch):
    monkeypatch.setattr(pointcloud, "PARTITION_BYTES", 100)
    parts = pointcloud._partitions([("a", 60), ("b", 40), ("c", 1), ("d", 500), ("e", 0)])
    assert [p.value for p in parts] == [["a", "b"], ["c"], ["d"], ["e"]] and pointcloud._partitions([])[0].value == []
    monkeypatch.setattr(pointcloud, "BATCH_POINTS", 2)
    np.arange(15, dtype="<f4").tofile(tmp_path / "f.bin")
    batches = list(pointcloud._points([str(tmp_path / "f.bin")], 3))
    assert [b.num_rows for b in batches] == [2, 2, 1] and sum((b.column("point_id").to_pylist() for b in batches), []) == list(range(5))
