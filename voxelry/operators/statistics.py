"""Statistics of labelled objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.operators.quantiles import quantiles
from voxelry.schemas import classes
from voxelry.session import written

METRICS = ("n_points", "z_range", "xy_spread", "density")
#: Pairs of classes that are compared.
PAIRS = ((3, 1), (2, 0))
BINS = 29


def class_counts(clouds: DataFrame) -> DataFrame:
    """class_name, n, share for each class, zero counts included."""
    found = clouds.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    all_classes = F.broadcast(classes(clouds.sparkSession)).join(found, F.col("class_id") == F.col("label"), "left")
    n = F.coalesce("n", F.lit(0))
    return all_classes.select("class_name", n.alias("n"), (n / F.sum(n).over(Window.partitionBy())).alias("share"))


def shapes(clouds: DataFrame) -> DataFrame:
    """sample_id, label and the metrics of each cloud, along the coordinate axes."""
    def side(k: str) -> Column:
        v = F.transform("pts", lambda p: p[k])
        return F.array_max(v) - F.array_min(v)

    sides = clouds.select("sample_id", "label", F.size("pts").cast("double").alias("n_points"), side("x").alias("dx"), side("y").alias("dy"), side("z").alias("z_range"))
    x, y = F.col("dx"), F.col("dy")
    return sides.select("sample_id", "label", "n_points", "z_range", F.sqrt(x * x + y * y).alias("xy_spread"), (F.col("n_points") / F.greatest(x * y * F.col("z_range"), F.lit(1e-6))).alias("density"))


def _long(clouds: DataFrame) -> DataFrame:
    return shapes(clouds).unpivot(["sample_id", "label"], list(METRICS), "metric", "v")


def class_metrics(clouds: DataFrame) -> DataFrame:
    """mean, std (population), median, p10, p90 of each metric by class."""
    values = written(_long(clouds).select("label", "metric", "v"), "metrics")
    means = values.groupBy("label", "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    found = quantiles(values, ["label", "metric"], "v", {"median": 0.5, "p10": 0.1, "p90": 0.9}).withColumnsRenamed({"label": "of", "metric": "by"})
    return means.join(found, means["label"].eqNullSafe(found["of"]) & (means["metric"] == found["by"]), "left").drop("of", "by")


def class_overlap(clouds: DataFrame, pairs: tuple[tuple[int, int], ...] = PAIRS) -> DataFrame:
    """Share of each class's objects within the range that both classes of a pair have; null without such a range."""
    values = _long(clouds)
    ends = values.groupBy("label", "metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    a, b = ends.alias("a"), ends.alias("b")
    wanted = F.lit(False)
    for p, q in pairs:
        wanted |= (F.col("a.label") == p) & (F.col("b.label") == q)
    both = a.join(b, (F.col("a.metric") == F.col("b.metric")) & wanted).select(
        F.col("a.metric").alias("metric"), F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), F.greatest("a.lo", "b.lo").alias("from"), F.least("a.hi", "b.hi").alias("to")
    )
    joined = values.join(F.broadcast(both), "metric").where((F.col("label") == F.col("label_a")) | (F.col("label") == F.col("label_b")))  # both: a row by pair and metric
    inside = F.when(F.col("to") > F.col("from"), F.col("v").between(F.col("from"), F.col("to")).cast("int"))
    share = lambda c: F.avg(F.when(F.col("label") == F.col(c), inside))
    return joined.groupBy("metric", "label_a", "label_b").agg(share("label_a").alias("share_a"), share("label_b").alias("share_b"))


def height_gaps(clouds: DataFrame, bins: int = BINS) -> DataFrame:
    """sample_id, n_max, n_sparse, n_gaps of each cloud's height histogram, by array functions without a shuffle.

    A bin is sparse below a fifth of the mean or one point; a gap is a run of sparse bins that a full
    bin ends. The last bin holds its right edge.
    """
    z = F.transform("pts", lambda p: p["z"])
    a = clouds.withColumn("z0", F.array_min(z)).withColumn("zr", F.array_max(z) - F.array_min(z))
    bin_of = F.transform(z, lambda v: F.least(F.floor((v - F.col("z0")) / F.col("zr") * bins), F.lit(bins - 1)))
    a = a.withColumn("bin", bin_of).withColumn("counts", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter("bin", lambda b: b == i)).cast("bigint")))
    a = a.withColumn("sparse", F.transform("counts", lambda n: n < F.greatest(F.size("pts") / F.lit(float(bins)) * 0.2, F.lit(1.0))))
    ends = F.filter(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.get("sparse", i - 1) & ~F.get("sparse", i))
    count = lambda c: F.size(c).cast("bigint")
    return a.select("sample_id", F.array_max("counts").alias("n_max"), count(F.filter("sparse", lambda s: s)).alias("n_sparse"), count(ends).alias("n_gaps"))
