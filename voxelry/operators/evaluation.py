"""Evaluation of predictions: folds, confusion, precision and recall, confidence, and two-stage routing."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.operators.quantiles import quantiles
from voxelry.session import written

# Stage 1's confidence for background, stage 2's least confidence, and the folds.
SAFETY, RECOVERY, FOLDS, SEED = 0.70, 0.50, 5, 42


#: Leading hexadecimal digits of a hash that rows are dealt out by where they are ranked.
_DIGITS = 3


def hash_rank(rows: DataFrame, by: str, key: Column, ties: list[str]) -> DataFrame:
    """Adds ``nth``, from 1, by ``key`` (an MD5 in hexadecimal digits) within ``by``, and orders no group in one task.

    Rows are ordered within ranges of the key; the ranges before them are only counted.
    """
    keyed = rows.withColumn("__key", key).withColumn("__cell", F.substring("__key", 1, _DIGITS))
    counts = keyed.groupBy(by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__cell")) - F.col("__n")
    offsets = counts.select(F.col(by).alias("__by"), F.col("__cell").alias("__at"), before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy(by, "__cell").orderBy("__key", *ties)) + F.col("__before")
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__cell") == F.col("__at"))  # rows of null ``by`` are ranked too
    return keyed.join(offsets, same).withColumn("nth", nth).drop("__key", "__cell", "__before", "__by", "__at")


#: Kinds of groups that one task deals out.
KINDS = 4096


def _least(load: np.ndarray, held: np.ndarray, weights: np.ndarray, free: list[int]) -> int:
    """Of the free folds the one whose class shares spread least once ``held`` is added to its load, the first of equal ones.

    The sum over folds of squared shares grows by the same amount everywhere, but for twice this product. Terms are
    added class by class, so SQL finds the same sums.
    """
    costs = [sum(int(h) * int(n) / float(w) for h, n, w in zip(held, load[f], weights, strict=True)) for f in free]
    return free[costs.index(min(costs))]


def group_folds(samples: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """group_id, group_fold: groups stay whole, and each class is shared out over the folds as evenly as a greedy deal can.

    Groups with equal counts of every class are one kind. Of each kind, as many groups as ``folds`` divides are dealt in
    turn by the hash of their id, which is even whatever the kind. Those that are left, fewer than ``folds`` of a kind, are
    taken by size, largest first, each to the fold where the squared shares of the classes then sum to least. One task
    deals out :data:`KINDS` kinds or so; where there are more, tasks deal kinds of their own, by hash, and the folds of
    each task are matched to the whole's folds by the same rule. Rows of null group_id or label are a group or class
    like any other; an empty table gives no rows.
    """
    label = F.regexp_replace(F.coalesce(F.col("label").cast("string"), F.lit("")), r"([\\:,])", r"\\$1")  # kinds stay apart whatever the names
    counts = samples.groupBy("group_id", label.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    groups = written(counts.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("held")).withColumn("kind", F.array_join(F.transform("held", lambda h: F.concat_ws(":", h["c"], h["n"])), ",")), "groups")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("group_id").cast("string"), F.lit(""))))
    kinds = groups.groupBy("kind").agg(F.any_value("held").alias("held"), F.count(F.lit(1)).alias("m"))
    # One row a class, so the driver holds the classes and their counts.
    totals = {r["c"]: r["n"] for r in groups.select(F.explode("held").alias("h")).groupBy("h.c").agg(F.sum("h.n").alias("n")).collect()}
    classes = sorted(totals)
    weights = np.array([float(totals[c]) * float(totals[c]) for c in classes])
    parts = 1 + kinds.count() // KINDS

    def vector(held: Iterable) -> np.ndarray:
        by = {h["c"]: h["n"] for h in held}
        return np.array([by.get(c, 0) for c in classes], np.int64)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        units = [(-v.sum(), kind, nth, v) for kind, left, v in zip(pdf.kind, pdf.left, map(vector, pdf.held), strict=True) for nth in range(left)]
        load, out = np.zeros((folds, len(classes)), np.int64), []
        for _, kind, nth, v in sorted(units, key=lambda u: u[:3]):
            fold = _least(load, v, weights, list(range(folds)))
            load[fold] += v
            out.append((int(pdf.part.iloc[0]), kind, nth, fold))
        return pd.DataFrame(out, columns=["part", "kind", "nth", "fold"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each part's folds to the whole's, one to one, the largest first; a part has a row a fold."""
        load, out = np.zeros((folds, len(classes)), np.int64), []
        for part, rows in pdf.groupby("part"):
            own = np.zeros((folds, len(classes)), np.int64)
            for r in rows.itertuples():
                own[r.fold] = vector(r.held)
            free = list(range(folds))
            for fold in sorted(range(folds), key=lambda f: (-own[f].sum(), f)):
                to = _least(load, own[fold], weights, free)
                free.remove(to)
                out.append((int(part), fold, to))
            for _, fold, to in out[-folds:]:
                load[to] += own[fold]
        return pd.DataFrame(out, columns=["part", "fold", "to"])

    left = kinds.select("kind", "held", (F.col("m") % folds).cast("int").alias("left"), F.pmod(F.xxhash64("kind"), F.lit(parts)).cast("int").alias("part")).where("left > 0")
    dealt = left.groupBy("part").applyInPandas(deal, "part int, kind string, nth int, fold int")
    if parts > 1:
        dealt = written(dealt, "dealt")
        held = dealt.join(left.select("kind", F.explode("held").alias("h")), "kind").groupBy("part", "fold", "h.c").agg(F.sum("h.n").alias("n"))
        held = held.groupBy("part", "fold").agg(F.collect_list(F.struct("c", "n")).alias("held"))
        # One row for each part and fold: a few for KINDS kinds.
        dealt = dealt.join(held.groupBy(F.lit(0).alias("all")).applyInPandas(match, "part int, fold int, to int"), ["part", "fold"]).withColumn("fold", F.col("to"))
    ranked = hash_rank(groups.select("group_id", "kind"), "kind", key, ["group_id"]).join(kinds.select("kind", "m"), "kind")
    even = F.col("m") - F.col("m") % folds
    ranked = ranked.withColumn("nth", F.col("nth") - 1)
    ranked = ranked.withColumn("left_nth", F.when(F.col("nth") >= even, F.col("nth") - even).cast("int"))
    dealt = dealt.select("kind", F.col("nth").alias("left_nth"), "fold")
    found = ranked.join(dealt, ["kind", "left_nth"], "left")
    return found.select("group_id", F.coalesce("fold", F.col("nth") % folds).cast("int").alias("group_fold"))


def with_folds(samples: DataFrame, folds: int = FOLDS, seed: int = SEED, id_col: str = "sample_id") -> DataFrame:
    """Adds ``fold``, stratified by label, and ``group_fold``, equal for rows of one group_id and balanced by class (:func:`group_folds`)."""
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    out = hash_rank(samples, "label", hashed, [id_col]).withColumn("fold", ((F.col("nth") - 1) % folds).cast("int")).drop("nth")
    groups = group_folds(samples, folds, seed).withColumnRenamed("group_id", "__group")
    return out.join(groups, F.col("group_id").eqNullSafe(F.col("__group"))).select(*samples.columns, "fold", "group_fold")


def confusion(preds: DataFrame, k: int = 4) -> DataFrame:
    """truth, n_0.., share_0..: counts by prediction, and their shares of the row."""
    counts = preds.groupBy("truth").pivot("pred", list(range(k))).count().na.fill(0)
    total = sum((F.col(str(i)) for i in range(1, k)), F.col("0"))
    return counts.select("truth", *[F.col(str(i)).alias(f"n_{i}") for i in range(k)], *[(F.col(str(i)) / total).alias(f"share_{i}") for i in range(k)])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall(preds: DataFrame, k: int = 4) -> DataFrame:
    """class_id, support, precision, recall, f1, macro_f1; 0 where a denominator is 0. One pass, one shuffle of k rows a task."""
    marked = preds.withColumn("c", F.explode(F.array_distinct(F.array("truth", "pred"))))
    by = marked.groupBy(F.col("c").alias("class_id")).agg(
        F.count_if((F.col("truth") == F.col("c")) & (F.col("pred") == F.col("c"))).alias("hit"), F.count_if(F.col("truth") == F.col("c")).alias("support"), F.count_if(F.col("pred") == F.col("c")).alias("said")
    )
    scored = by.withColumns({"precision": _ratio(F.col("hit"), F.col("said")), "recall": _ratio(F.col("hit"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    scored = scored.withColumn("f1", _ratio(2 * p * r, p + r))
    return scored.select("class_id", "support", "precision", "recall", "f1", F.avg("f1").over(Window.partitionBy()).alias("macro_f1"))


def confidence_gap(preds: DataFrame) -> DataFrame:
    """truth, n_right, n_wrong and the mean confidence of either."""
    right = F.col("truth") == F.col("pred")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("conf"))), F.lit(0.0))
    return preds.groupBy("truth").agg(F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_wrong"), mean(right).alias("conf_right"), mean(~right).alias("conf_wrong"))


def ranked(preds: DataFrame, by: list[str], order: list[Column], n: int | Column) -> DataFrame:
    """Adds ``nth`` within ``by`` and keeps the first ``n``; a literal n is pushed below the shuffle."""
    w = Window.partitionBy(*by)
    return preds.withColumn("nth", F.row_number().over(w.orderBy(*order))).where(F.col("nth") <= n)


def top_misclassified(preds: DataFrame, n: int = 40) -> DataFrame:
    """Of each kind of error the most confident."""
    return ranked(preds.where("truth <> pred"), ["truth", "pred"], [F.desc("conf"), F.asc("doc_id")], n)


def least_confident(preds: DataFrame, n: int = 40) -> DataFrame:
    """Of each class the correct rows of least confidence."""
    return ranked(preds.where("truth = pred"), ["truth"], [F.asc("conf"), F.asc("doc_id")], n)


def most_confident(preds: DataFrame, n: int = 40) -> DataFrame:
    """Of each class the correct rows of most confidence, a quarter of n but five at least."""
    return ranked(preds.where("truth = pred"), ["truth"], [F.desc("conf"), F.asc("doc_id")], max(n // 4, 5))


def evaluate(preds: DataFrame) -> dict[str, DataFrame]:
    """Everything that is reported of predictions (truth, pred, conf): the class-wise report, confusions and confidences."""
    return {"report": precision_recall(preds), "confusion": confusion(preds), "confidence": confidence_gap(preds), "pairs": confusion_pairs(preds)}


#: The confusions that are reported.
CONFUSIONS = {"car_as_background": (2, 0), "background_as_car": (0, 2), "pedestrian_as_bicyclist": (3, 1), "bicyclist_as_pedestrian": (1, 3)}


def confusion_pairs(preds: DataFrame) -> DataFrame:
    """pair, n, rate for each reported confusion: how many rows of the true class are taken for the other."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(t).alias("t"), F.lit(p).alias("p")) for k, (t, p) in CONFUSIONS.items()]))
    rows = preds.withColumn("x", named).where(F.col("truth") == F.col("x.t"))
    wrong = F.col("pred") == F.col("x.p")
    return rows.groupBy(F.col("x.pair").alias("pair")).agg(F.count_if(wrong).alias("n"), F.avg(wrong.cast("int")).alias("rate"))


def route(stages: DataFrame, safety: float = SAFETY, recovery: float = RECOVERY) -> DataFrame:
    """Adds ``pred``, ``conf`` and ``uncertain`` from s1_background, s1_conf, s2_class, s2_conf.

    Confident background stays; other background goes to stage 2 and returns to background, with stage
    1's confidence, unless stage 2 is sure enough. Such rows count as uncertain either way.
    """
    unsure = F.col("s1_background") & (F.col("s1_conf") < safety)
    second = ~F.col("s1_background") | (unsure & (F.col("s2_conf") >= recovery))
    return stages.withColumns({"pred": F.when(second, F.col("s2_class")).otherwise(0), "conf": F.when(second, F.col("s2_conf")).otherwise(F.col("s1_conf")), "uncertain": unsure})


def safety_net(routed: DataFrame) -> DataFrame:
    """By true class: rows sent on, recovered, given a wrong class, or rejected, and quantiles of the recovered rows' confidence."""
    u = routed.where("uncertain")
    right, wrong = F.col("pred") == F.col("truth"), (F.col("pred") > 0) & (F.col("pred") != F.col("truth"))
    hit = right & (F.col("truth") > 0)
    counts = u.groupBy("truth").agg(F.count(F.lit(1)).alias("n_routed"), F.count_if(hit).alias("n_recovered"), F.count_if(wrong).alias("n_wrong"), F.count_if(F.col("pred") == 0).alias("n_rejected"))
    return counts.join(quantiles(u.where(hit), ["truth"], "conf", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "truth", "left")


def miss_rates(routed: DataFrame) -> DataFrame:
    """By object class: rows, confident misses, all misses, and the rate of the confident ones."""
    missed = F.col("pred") == 0
    by = routed.where("truth > 0").groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(missed & ~F.col("uncertain")).alias("n_hard"), F.count_if(missed).alias("n_missed"))
    return by.withColumn("hard_rate", F.col("n_hard") / F.col("n"))


#: Physical limits by class: least and largest width, least height above ground, largest height. A missing
#: height above ground is taken for a large one.
LIMITS = {3: (None, 1.4, 0.7, 2.2), 1: (0.8, 2.6, 0.7, 2.2), 2: (None, 7.0, 0.5, 2.3)}
NO_HEIGHT = 999.0


def sanity_demotion(pred: Column, xy: Column, zag: Column, zr: Column) -> Column:
    """The class after the physical limits, 0 if they are broken."""
    h = F.coalesce(zag, F.lit(NO_HEIGHT))
    out = pred
    for label, (narrow, wide, low, tall) in LIMITS.items():
        broken = (xy > wide) | (h < low) | (zr > tall)
        broken = broken if narrow is None else broken | (xy < narrow)
        out = F.when((pred == label) & broken, F.lit(0)).otherwise(out)
    return out


def demoted(pred: int, xy: float, zag: float | None, zr: float) -> int:
    """The same of one cluster, for use inside grouped functions."""
    if pred not in LIMITS:
        return pred
    narrow, wide, low, tall = LIMITS[pred]
    h = NO_HEIGHT if zag is None or zag != zag else zag
    return 0 if xy > wide or h < low or zr > tall or (narrow is not None and xy < narrow) else pred
