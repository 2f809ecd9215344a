"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import forget, new_path, salted, with_all_salts, written

#: Each two rounds at least halve the longest way to a centre, so this many are never needed; then an error is raised.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = salted(both.where("b > a"), "b").join(with_all_salts(least), ["a", "salt"])
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them; edges run from larger to smaller."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = salted(down, "b").join(with_all_salts(least), ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b), without loops.

    Each round is written to the shared folder, and the one before it removed; only a count and a sum
    reach the driver. A node of many edges is dealt to several tasks. An edge table that has no rows
    gives an empty result.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges = written(edges.select("a", "b").where("a <> b"), "edges", path)
    before = None
    for _ in range(MOST_ROUNDS):
        last, path = path, new_path(spark, "stars")
        edges = written(_small_star(_large_star(edges)), "stars", path)
        forget(spark, last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
