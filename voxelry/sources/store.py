"""Caches: feature tables, their CSV form, and models with their feature names."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cached_features(spark: SparkSession, path: str, names: list[str], rows: int, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path`` if it has the named columns and as many rows, else what ``make`` gives, written there."""
    found = None if force else _table(spark, path)
    if found is not None and set(names) <= set(found.columns) and found.count() == rows:
        return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_feature_csv(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").csv(path, header=True)


def read_feature_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The named features, label and path; the schema is stated, not inferred."""
    return spark.read.csv(path, header=True, schema=", ".join([*[f"`{n}` double" for n in names], "label int", "path string"]))


def save_model(model: PipelineModel, path: str, names: list[str], mode: int) -> None:
    """The model and, beside it, its feature names and mode."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(names, mode)], "names array<string>, mode int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], int]:
    meta = spark.read.schema("names array<string>, mode int").json(f"{path}/meta").first()
    return PipelineModel.load(f"{path}/model"), list(meta["names"]), meta["mode"]


def cacheable(found: DataFrame) -> DataFrame:
    """Classified clusters in the form that is kept: without probabilities and heights above ground."""
    return found.drop("proba", "z_above_ground")


def write_results(found: DataFrame, path: str) -> None:
    """Writes the clusters of all frames, a frame's together."""
    cacheable(found).repartition("frame_id").sortWithinPartitions("frame_id", "cluster_id").write.mode("overwrite").parquet(path)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached_results(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The results at ``path`` if there are any, else what ``make`` gives, written there."""
    found = None if force else _table(spark, path)
    if found is None:
        write_results(make(), path)
        found = spark.read.parquet(path)
    return found


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys; null equals null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def kept_by_frame(spark: SparkSession, path: str, parameters: dict, frames: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of ``frames`` (the columns that name a frame, one row each), of which only those that are not kept yet are computed.

    ``make`` gets the missing frames and gives their rows, which name their frame by the same columns. What is kept is told apart
    by ``parameters``, so a changed one computes anew. Each run writes its results under a name of its own and then, as the last
    step, the list of its frames; results that no list names, as a run that failed leaves them, are never read. Frames
    without results are kept as well.
    """
    keys = frames.columns
    place = f"{path}/{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:32]}"
    done = _table(spark, f"{place}/frames")
    missing = frames if done is None else frames.join(done, same_key(frames, done, keys), "left_anti")
    if not missing.isEmpty():
        run = uuid.uuid4().hex
        # The list is written apart first, so that frames and results agree even if ``frames`` gives others when it is read again.
        missing.write.parquet(f"{place}/asked/{run}")
        missing = spark.read.schema(frames.schema).parquet(f"{place}/asked/{run}")
        make(missing).write.parquet(f"{place}/results/run={run}")
        missing.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{place}/frames")
    done = spark.read.parquet(f"{place}/frames")
    wanted = done.join(frames, same_key(done, frames, keys), "left_semi").withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed("run", "__run")
    runs = [r["run"] for r in done.select("run").distinct().collect()]  # a row a run
    rows = spark.read.option("basePath", f"{place}/results").parquet(*[f"{place}/results/run={r}" for r in runs])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("run") == F.col("__run"))
    return rows.join(wanted, same, "left_semi").drop("run")
