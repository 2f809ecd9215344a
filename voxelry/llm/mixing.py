"""Mixing sources to target weights by Pareto order sampling.

Each source's target is a capped share of the whole. Whole copies that are certain are given to every
document; the remaining words come from a Pareto order sample with unequal inclusion probabilities:
longer documents are likelier, in proportion to the number of binary digits of their size, scaled so
that the expected words meet the source's remainder. Size classes whose probability would reach 1 are
certain, and the scale is solved anew without them. Documents are ranked by their random odds divided
by their inclusion odds, and the lowest are taken until the remainder is met. Where the cut falls is
found from word counts by source and rank cell, so no task ever orders a source; only the documents of
one cell are put in order. What is taken then depends on a few numbers by source, so texts are never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.common import WORD, text_or_empty, written

#: By rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: All words together that the mix takes, as a share of all words; copies of a document at most.
SHARE, MOST_COPIES = 1.5, 2
#: Rank cells by source: one for so many documents of the table, within these bounds.
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 4096, 4096, 1 << 20
SEED = 20


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number between 0 and 1 that depends on the key and the seed only."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(
        float(1 << 52)
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from (source, size): one row per source.

    Sources rank by code point, null last. Shares over ``most`` times a source's size are cut there and
    the excess goes to the others by weight, again and again; sorted by cap over weight, those cut are
    a prefix, so running sums give the fixed point at once.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    each = each.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("w"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
    )
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    level = each.withColumn("cap", cap).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards)
    )
    cut = F.col("cap") <= F.col("w") * F.col("level")
    level = level.withColumn("cut", cut).withColumn("line", F.max(F.when(~F.col("cut"), F.col("level"))).over(everything))
    return level.select("source", "source_size", F.when(F.col("cut"), F.col("cap")).otherwise(F.col("w") * F.col("line")).alias("target"))


def size_class(size: Column) -> Column:
    """Number of binary digits of the size, the measure that inclusion probabilities are proportional to; 1 for 0."""
    return F.length(F.bin(size)).cast("bigint")


def inclusion(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole, scale, certain_above, rest for each source of ``goals``.

    A document of class k is in the sample with probability ``scale`` times k if k is at most
    ``certain_above``, and for certain otherwise; ``rest`` words are left for the former. With the
    classes from k upwards certain, the scale is the words left over the sum of class times words below;
    the largest class whose probability stays below 1 is the last that is not certain. There are a few
    dozen classes by source, so windows by source are short.
    """
    by = sized.groupBy("source", size_class(F.col("size")).alias("k")).agg(F.sum("size").cast("double").alias("words")).withColumnRenamed("source", "its_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(rate)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    each = by.join(goals, F.col("its_source").eqNullSafe(F.col("source")))
    down = Window.partitionBy("source").orderBy(F.desc("k"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = F.sum(F.col("k") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("left", F.col("need") - above).withColumn("mass", below)
    open_class = F.when((F.col("need") > 0) & (F.col("mass") > 0) & (F.col("k") * F.col("left") < F.col("mass")), F.struct("k", "left", "mass"))
    found = each.groupBy("source", "source_size", "target", "whole").agg(F.max(open_class).alias("c"), F.max("need").alias("need"))
    none = F.when(F.col("need") > 0, F.lit(0)).otherwise(F.lit(64))
    return found.select(
        "source", "source_size", "target", "whole", F.coalesce(F.col("c.left") / F.col("c.mass"), F.lit(0.0)).alias("scale"),
        F.coalesce("c.k", none).cast("bigint").alias("certain_above"), F.coalesce("c.left", F.lit(0.0)).alias("rest"),
    )


def _ranked(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """``sized`` with the numbers of its source, its inclusion probability and rank; no rank where that is 0 or 1."""
    u, p, k = F.col("u"), F.col("inclusion"), size_class(F.col("size"))
    odds = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    return (
        sized.withColumnRenamed("source", "its_source")
        .join(by_source, F.col("its_source").eqNullSafe(F.col("source")))
        .withColumn("inclusion", F.when(k > F.col("certain_above"), F.lit(1.0)).otherwise(F.col("scale") * k))
        .withColumn("odds", F.when((p > 0) & (p < 1), odds))
        .withColumn("rank", F.col("odds") / (F.lit(1.0) + F.col("odds")))
    )


def _place() -> Column:
    """What documents of one source are ordered by."""
    return F.struct(F.col("rank").alias("rank"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))


def cut_points(sized: DataFrame, goals: DataFrame, cells: int | None = None) -> DataFrame:
    """What :func:`inclusion` gives, and ``last``, the place of the last document that its source takes; null if none is.

    Documents are taken in order while that brings the words nearer to the source's remainder. One pass
    counts words by source and cell, a second one orders the cell in which the remainder is met.
    """
    if cells is None:
        cells = min(max(sized.count() // CELL_ROWS, LEAST_CELLS), MOST_CELLS)
    by_source = written(inclusion(sized, goals).coalesce(1), "inclusion")
    ranked = _ranked(sized, by_source).withColumn("cell", F.floor(F.col("rank") * cells).cast("int")).where("cell IS NOT NULL")
    by_cell = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.max(_place()).alias("last"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    by_cell = written(by_cell.withColumn("upto", upto), "cells")
    before = F.max(F.when(F.col("upto") < F.col("rest"), F.struct("cell", "upto", "last")))
    at = F.min(F.when(F.col("upto") >= F.col("rest"), F.col("cell")))
    cuts = by_cell.groupBy("source").agg(before.alias("before"), at.alias("cut_cell"))
    cuts = written(cuts.select(F.col("source").alias("cut_source"), "cut_cell", F.coalesce("before.upto", F.lit(0)).alias("before"), F.col("before.last").alias("last_before")).coalesce(1), "cuts")
    inside = ranked.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("cell") == F.col("cut_cell")))
    order = Window.partitionBy("source").orderBy(_place()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("before") + F.sum("size").over(order)
    inside = inside.withColumn("reached", reached).where(F.lit(2) * F.col("reached") - F.col("size") <= F.lit(2) * F.col("rest"))
    inside = inside.groupBy("cut_source").agg(F.max(_place()).alias("last_inside"))
    ends = cuts.select("cut_source", "last_before").join(inside.withColumnRenamed("cut_source", "source_inside"), F.col("cut_source").eqNullSafe(F.col("source_inside")), "left")
    ends = ends.select("cut_source", F.coalesce("last_inside", "last_before").alias("last"))
    return by_source.join(ends, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")


def taken(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """``sized`` with what :func:`cut_points` gives of its source, inclusion, copies and taken, without a shuffle of its rows."""
    first = F.when(F.col("rank").isNull(), F.col("inclusion") >= 1).otherwise(F.coalesce(_place() <= F.col("last"), F.lit(False))).cast("int")
    out = _ranked(sized, by_source).withColumn("copies", F.col("whole") + first)
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("its_source", "certain_above", "scale", "rest", "last", "odds", "rank", "whole", "u")


def pareto_mix(sized: DataFrame, goals: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, inclusion, copies, taken for each row of ``sized`` (doc_id, source, size, u).

    ``goals`` is what :func:`targets` gives. A document's expected copies are the whole part of target /
    source_size, which is certain, and its inclusion probability. Documents are ordered by rank, id and
    size, so reruns agree; those that agree in all three are taken together.
    """
    return taken(sized, written(cut_points(sized, goals, cells).coalesce(1), "ends"))


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), text)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """Sizes, targets and what the mix takes, one row per document; see :func:`pareto_mix`.

    Null texts have size 0 and null sources are a source of their own, ranked last. An empty table
    gives an empty result; columns other than id, text and source are ignored. Repeated ids share a
    random number; null ids have that of their text. A document is taken whole, so a source's words
    differ from its target by less than half of one document. There is one row a source in
    unpartitioned windows, so sources may be some millions, not more.
    """
    sized = written(_sized(docs, F.col(id_col), seed), "sizes")
    goals = written(targets(sized).coalesce(1), "targets")
    return pareto_mix(sized, goals, **options)


def _sized(docs: DataFrame, doc_id: Column, seed: int, *more: Column) -> DataFrame:
    return docs.select(doc_id.alias("doc_id"), F.col("source"), _size(text_or_empty()).alias("size"), uniform(_key(doc_id, text_or_empty()), seed).alias("u"), *more)


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows taken zero times go; all columns kept.

    Texts are read twice and never shuffled. Null and empty texts have no words; whether they stay does
    not change a source's words. Repeated rows are taken together. An empty table gives an empty result.
    """
    sized = written(_sized(docs, F.col("doc_id"), seed), "sizes")
    goals = written(targets(sized).coalesce(1), "targets")
    ends = written(cut_points(sized, goals).coalesce(1), "ends")
    rows = taken(_sized(docs, F.col("doc_id"), seed, F.struct(*[docs[c] for c in docs.columns]).alias("row")), ends)
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return rows.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
         2 * source_size::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), c AS (
  SELECT *, cap <= w * level AS cut FROM l
), t AS (
  SELECT source, source_size, CASE WHEN cut THEN cap ELSE w * max(CASE WHEN NOT cut THEN level END) OVER () END AS target FROM c
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), m AS (
  SELECT *, target - whole * source_size AS need FROM g
), k AS (
  SELECT source, length(bin(size)) AS k, sum(size)::DOUBLE AS words FROM d GROUP BY ALL
), o AS (
  SELECT m.*, k.k, need - coalesce(sum(words) OVER (PARTITION BY m.source ORDER BY k.k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(k.k * words) OVER (PARTITION BY m.source ORDER BY k.k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass
  FROM m JOIN k ON m.source IS NOT DISTINCT FROM k.source
), i AS (
  SELECT source, source_size, target, whole, need, coalesce(max(k) FILTER (need > 0 AND mass > 0 AND k * room < mass), CASE WHEN need > 0 THEN 0 ELSE 64 END) AS top,
         coalesce(arg_max(room / mass, k) FILTER (need > 0 AND mass > 0 AND k * room < mass), 0) AS scale,
         coalesce(arg_max(room, k) FILTER (need > 0 AND mass > 0 AND k * room < mass), 0) AS rest
  FROM o GROUP BY source, source_size, target, whole, need
), r AS (
  SELECT d.doc_id, d.size, d.u, i.*, CASE WHEN length(bin(d.size)) > top THEN 1.0 ELSE scale * length(bin(d.size)) END AS p
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source
), q AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM r
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds), doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM q
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN p >= 1 OR (odds IS NOT NULL AND 2 * reached + size <= 2 * rest) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""
