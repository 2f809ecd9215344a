"""Times of stages: measured while a stage's result is written, and their summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxelry.operators import quantiles
from voxelry.session import written


def timed(df: DataFrame, name: str) -> tuple[DataFrame, int, float]:
    """``df`` written and read again, its number of rows, and the milliseconds that took; rows are counted on the way, not by a second pass.

    What came before ``df`` and was not written itself is part of the time.
    """
    seen, began = Observation(f"stage {name}"), time.perf_counter()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, seen.get["rows"], (time.perf_counter() - began) * 1000


def summary(times: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """keys, n, mean, median, p95, most: how long each stage took.

    p95 is the time at the floor of 0.95 (n - 1) in rising order, the median is interpolated; both are exact for any number
    of rows. Times that are null or not finite are left out, and stages that have no others; a null stage is one of its own.
    """
    v = F.col(value).cast("double")
    rows = times.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    total, own = F.col("total"), [f"__{k}" for k in keys]
    places = {"p95": F.floor(0.95 * (total - 1)), "low": F.floor((total - 1) / 2), "high": F.floor(total / 2)}
    at = quantiles.ranks(rows, keys, "v", list(places.values()))
    found = at.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == place, F.col("v"))).alias(k) for k, place in places.items()]).withColumnsRenamed(dict(zip(keys, own, strict=True)))
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    same = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        same &= F.col(k).eqNullSafe(F.col(o))
    return means.join(found, same).select(*keys, "n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "most")
