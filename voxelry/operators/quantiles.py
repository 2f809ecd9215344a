"""Exact order statistics of large groups by histograms, and steps between neighbours of a distributed order.

No group is gathered or sorted. Values are counted in bins between their ends; of each wanted rank only the bin that
holds it is looked at again, in bins between its own ends, until few rows are left there. Each round reads the
values once and shuffles counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.session import written

#: Bins of a range in each round, and the rows of a range that are ordered in one task.
BINS, KEPT = 4096, 65536


def _met(left: DataFrame, right: DataFrame, keys: list[str], more: Column) -> DataFrame:
    """The rows of both with equal keys, null keys too, where ``more`` holds; other names are different."""
    theirs = [f"__{k}" for k in keys]
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)])
    return left.join(right.withColumnsRenamed(dict(zip(keys, theirs, strict=True))), same & more).drop(*theirs)


def ranks(values: DataFrame, keys: list[str], value: str, wanted: list[Column], bins: int = BINS, kept: int = KEPT) -> DataFrame:
    """keys, rank, total, v: the value at each of the 0-based ranks ``wanted``, expressions over ``total``, the group's size.

    Nulls, NaN and infinite values are left out; a group without others gives no row. Null keys are a group. ``values``
    is written once, so that it is not computed in each round.
    """
    v = F.col(value).cast("double")
    rows = written(values.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), "values")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = ends.withColumn("rank", F.explode(F.array_distinct(F.array(*[w.cast("bigint") for w in wanted]))))
    state = written(state.withColumns({"n": F.col("total"), "below": F.lit(0).cast("bigint")}), "ranges")
    wide, part, columns = (F.col("lo") < F.col("hi")) & (F.col("n") > kept), [*keys, "lo", "hi"], state.columns
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    while state.where(wide).limit(1).count():
        met = _met(rows, state.where(wide).select(*part).distinct(), keys, inside)
        at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = met.groupBy(*part, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*part).orderBy("bin")) - F.col("c"))
        nth = F.col("rank") - F.col("below")
        found = _met(state.where(wide), counts, part, (nth >= F.col("before")) & (nth < F.col("before") + F.col("c")))
        found = found.select(*keys, "total", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("c").alias("n"), (F.col("below") + F.col("before")).alias("below"))
        state = written(found.select(columns).unionByName(state.where(~wide)), "ranges")
    left = state.where("lo < hi")
    nth = _met(rows, left.select(*part).distinct(), keys, inside).withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy("v")) - 1)
    last = _met(left, nth, part, F.col("rank") - F.col("below") == F.col("nth")).select(*keys, "rank", "total", "v")
    return last.unionByName(state.where("lo = hi").select(*keys, "rank", "total", F.col("lo").alias("v")))


def quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS, kept: int = KEPT) -> DataFrame:
    """keys and a column by name of ``shares``: the exact interpolated quantiles of each group, as ``percentile`` has them."""
    own = keys or ["__all"]
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    wanted = [f(place(q)) for q in shares.values() for f in (F.floor, F.ceil)]
    found = ranks(values if keys else values.withColumn("__all", F.lit(0)), own, value, wanted, bins, kept)

    def share(q: float) -> Column:
        at = lambda f: F.max(F.when(F.col("rank") == f(place(q)), F.col("v")))
        part = F.max(place(q) - F.floor(place(q)))
        return at(F.floor) * (1 - part) + at(F.ceil) * part

    return found.groupBy(*own).agg(*[share(q).alias(name) for name, q in shares.items()]).drop("__all")


def steps(values: DataFrame, value: Column) -> DataFrame:
    """d: the difference of each value, but the first, from the one before it in rising order.

    Values are dealt by ranges; the last one of each range meets the next range that has any, which is one row a range.
    """
    dealt = values.select(value.alias("v")).where("v IS NOT NULL").repartitionByRange("v").sortWithinPartitions("v").withColumn("range", F.spark_partition_id())
    rows = written(dealt, "ordered")
    ends = rows.groupBy("range").agg(F.max("v").alias("last"))
    earlier = ends.select("range", F.lag("last").over(Window.orderBy("range")).alias("before"))
    own = F.lag("v").over(Window.partitionBy("range").orderBy("v"))
    return rows.withColumn("own", own).join(earlier, "range").select((F.col("v") - F.coalesce("own", "before")).alias("d")).where("d IS NOT NULL")
