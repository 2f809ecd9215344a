"""Session settings that the engine is designed for."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a Python worker holds at once, however many points a cloud has.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.ui.enabled": "false",
}
#: Used where the session names no shared folder, as in tests on one machine.
OWN_FOLDER = "/tmp/checkpoints/voxelry"


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``more`` overrides them, with ``__`` for dots."""
    builder = SparkSession.builder.appName("voxelry")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


@cache
def _own_folder(application: str) -> str:
    """A folder for one application on one machine; it goes when Python ends."""
    path = f"{OWN_FOLDER}/{application}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; our own if unset, on one machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return _own_folder(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, which cuts lineage, survives lost executors and tells the planner its size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
