"""Random forests: training, prediction, two stages, folds and ablation."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions import features as feats
from voxelry.operators import evaluation, forests
from voxelry.session import shared_folder, written

# The forests' sizes and the penalties tried for a missed object.
TREES, STAGE_TREES, DEPTH, LEAF, SEED, MAX_BINS = 100, 300, 20, 5, 42, 128
PENALTIES = (2.0, 3.0, 5.0)


def _forest(names: list[str], trees: int, label: str = "label", depth: int = DEPTH, seed: int = SEED) -> Pipeline:
    rf = RandomForestClassifier(
        labelCol=label, featuresCol="__x", weightCol="__w", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF, maxBins=MAX_BINS, featureSubsetStrategy="sqrt", seed=seed,
        probabilityCol="__p", predictionCol="__y", rawPredictionCol="__raw", cacheNodeIds=True,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__x"), rf])


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds the weight n / (classes * n of the class). The table of classes has a row for each."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    counts = per.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    w = per.crossJoin(F.broadcast(counts)).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("__w"))  # counts: one row
    return rows.join(F.broadcast(w), label)  # w: a row by class


def train(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Single-stage forest with balanced weights."""
    return _forest(names, trees, depth=depth).fit(balanced(rows))


#: Trees of one fit, fits at once, and the rows of one of a fit's tasks. Each task lays out the counts of every node of a
#: pass, however few rows a node has, so a forest of deep trees is fitted as several smaller ones with few tasks each.
FIT_TREES, FITS_AT_ONCE, FIT_ROWS = 10, 10, 1 << 17


def train_by_trees(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH) -> list[PipelineModel]:
    """The forest of :func:`train` as several forests of some trees each, fitted side by side on all rows with seeds of their own; see :class:`Forest`."""
    weighted = balanced(rows)
    weighted = weighted.coalesce(-(-max(weighted.count(), 1) // FIT_ROWS))

    def fit(first: int) -> PipelineModel:
        return _forest(names, min(FIT_TREES, trees - first), depth=depth, seed=SEED + first).fit(weighted)

    starts = range(0, trees, FIT_TREES)
    with ThreadPool(min(FITS_AT_ONCE, len(starts))) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(fit), starts, 1)


def train_stage1(rows: DataFrame, names: list[str], penalty: float = 3.0, trees: int = STAGE_TREES, depth: int = DEPTH) -> PipelineModel:
    """Object or background; a missed object costs ``penalty``."""
    y = (F.col("label") > 0).cast("int")
    return _forest(names, trees, "__b", depth).fit(rows.withColumn("__b", y).withColumn("__w", F.when(y == 1, float(penalty)).otherwise(1.0)))


def train_stage2(rows: DataFrame, names: list[str], trees: int = STAGE_TREES, depth: int = DEPTH) -> PipelineModel:
    """The class of objects only."""
    return _forest(names, trees, "__c", depth).fit(balanced(rows.where("label > 0").withColumn("__c", F.col("label") - 1), "__c"))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds pred, conf and proba (by class)."""
    out = model.transform(rows).withColumn("proba", vector_to_array("__p")).withColumn("pred", F.col("__y").cast("int"))
    return out.withColumn("conf", F.get("proba", F.col("pred"))).drop("__x", "__raw", "__p", "__y", "__w")


def second_class(proba: Column) -> Column:
    """(p, class) of the second most likely class."""
    return F.get(F.sort_array(F.transform(proba, lambda p, i: F.struct(p.alias("p"), i.alias("class"))), asc=False), 1)


def predict_two_stage(stage1: PipelineModel, stage2: PipelineModel, rows: DataFrame, safety: float = evaluation.SAFETY) -> DataFrame:
    """Adds pred, conf, uncertain by the routing of :func:`evaluation.route`."""
    one = predict(stage1, rows).select(*rows.columns, (F.col("pred") == 0).alias("s1_background"), F.col("conf").alias("s1_conf"))
    two = predict(stage2, one).select(*one.columns, (F.col("pred") + 1).alias("s2_class"), F.col("conf").alias("s2_conf"))
    return evaluation.route(two, safety)


def _folds(rows: DataFrame, names: list[str], folds: int, trees: int, fold: str, label: Column | None = None, weights: tuple[float, ...] | None = None) -> list[forests.Plan]:
    """A forest for each fold, which learns from the others' rows."""
    of = F.col(fold)
    return [forests.Plan(names, F.when(of != k, F.col("label") if label is None else label), of == k, trees, weights) for k in range(folds)]


def cross_validate(rows: DataFrame, names: list[str], folds: int = evaluation.FOLDS, trees: int = TREES, fold: str = "fold", depth: int = DEPTH) -> DataFrame:
    """Predictions of each row by the forest that did not see its fold; ``fold`` may keep groups together."""
    got = forests.with_class(forests.held_out(rows, _folds(rows, names, folds, trees, fold), depth))
    return got.select("sample_id", "truth", F.col("plan").alias(fold), "pred", "conf")


def cross_validate_two_stage(rows: DataFrame, names: list[str], penalty: float = 3.0, folds: int = evaluation.FOLDS, trees: int = STAGE_TREES, depth: int = DEPTH) -> DataFrame:
    """The same with both stages; all forests are grown side by side."""
    label = F.col("label")
    one = _folds(rows, names, folds, trees, "fold", (label > 0).cast("int"), (1.0, float(penalty)))
    two = _folds(rows, names, folds, trees, "fold", F.when(label > 0, label - 1))
    got = forests.with_class(forests.held_out(rows, [*one, *two], depth)).withColumns({"fold": F.col("plan") % folds, "first": F.col("plan") < folds})
    took = lambda c, first: F.max(F.when(F.col("first") == first, F.col(c)))  # noqa: E731  of one row
    both = got.groupBy("id", "sample_id", "truth", "fold").agg((took("pred", True) == 0).alias("s1_background"), took("conf", True).alias("s1_conf"), (took("pred", False) + 1).alias("s2_class"), took("conf", False).alias("s2_conf"))
    return evaluation.route(both).select("sample_id", "truth", "fold", "pred", "conf", "uncertain")


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def _on_test(train_rows: DataFrame, test_rows: DataFrame, sets: list[list[str]], trees: int, depth: int) -> DataFrame:
    """plan, truth, pred, conf of the test rows, by a forest of each feature set."""
    columns = list(dict.fromkeys(["label", *(c for s in sets for c in s), *(c for c in ("sample_id",) if c in train_rows.columns and c in test_rows.columns)]))
    rows = train_rows.select(*columns, F.lit(False).alias("tested")).unionByName(test_rows.select(*columns, F.lit(True).alias("tested")))
    plans = [forests.Plan(s, F.when(~F.col("tested"), F.col("label")), F.col("tested"), trees) for s in sets]
    return forests.with_class(forests.held_out(rows, plans, depth))


def test_predictions(train_rows: DataFrame, test_rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """sample_id, truth, proba, pred, conf of rows that the forest never saw."""
    return _on_test(train_rows, test_rows, [names], trees, depth).drop("plan", "id")


def ablation(train_rows: DataFrame, test_rows: DataFrame, modes: tuple[int, ...] = (19, 23, 35), trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """mode and the class-wise report of each feature set on the test rows. Rows need the 35 named features."""
    got = written(_on_test(train_rows, test_rows, [feats.MODES[m] for m in modes], trees, depth).select("plan", "truth", "pred"), "tested")
    return reduce(DataFrame.unionByName, [evaluation.precision_recall(got.where(F.col("plan") == k).drop("plan")).withColumn("mode", F.lit(mode)) for k, mode in enumerate(modes)])


def evaluate_on_test(model: PipelineModel, rows: DataFrame) -> dict[str, DataFrame]:
    """What :func:`evaluation.evaluate` reports of the model's predictions of labelled rows."""
    return evaluation.evaluate(predict(model, rows).withColumnRenamed("label", "truth"))


def ablation_summary(train_rows: DataFrame, test_rows: DataFrame, modes: tuple[int, ...] = (19, 23, 35), trees: int = TREES, depth: int = DEPTH, folds: int = evaluation.FOLDS, tested: Callable[..., DataFrame] | None = None) -> DataFrame:
    """mode, n_features, cv_f1, cv_std, test_f1, conf_right, conf_wrong of each feature set, one row each.

    cv_f1 and cv_std are the mean and the spread of the folds' macro F1 over the training rows, which
    have a ``fold``. Test rows are predicted by the model of :func:`train`, which the driver holds, or by ``tested``, as
    :func:`test_predictions`, for which it holds no tree.
    """
    out = []
    for mode in modes:
        names = feats.MODES[mode]
        if tested is None:
            got = predict(train(train_rows, names, trees, depth), test_rows).withColumnRenamed("label", "truth")
        else:
            got = tested(train_rows, test_rows, names, trees, depth)
        got = written(got.select("truth", "pred", "conf"), "tested")
        right = F.col("truth") == F.col("pred")
        conf = got.agg(F.avg(F.when(right, F.col("conf"))), F.avg(F.when(~right, F.col("conf")))).first()
        seen = written(cross_validate(train_rows, names, folds, trees, "fold", depth), "folds")
        scores = [evaluation.precision_recall(seen.where(F.col("fold") == k)).first() for k in range(folds)]
        f1 = [r["macro_f1"] for r in scores if r]
        test = evaluation.precision_recall(got).first()
        out.append((mode, len(names), float(np.mean(f1)) if f1 else None, float(np.std(f1)) if f1 else None, test and test["macro_f1"], conf[0], conf[1]))
    return train_rows.sparkSession.createDataFrame(out, "mode int, n_features int, cv_f1 double, cv_std double, test_f1 double, conf_right double, conf_wrong double")


class Forest:
    """A fitted forest as arrays, for use inside grouped functions, sent with the task; several models count as one forest of all their trees.

    The nodes come from the tables that the models are saved as, in one pass; all trees' nodes are numbered through.
    """

    def __init__(self, *models: PipelineModel) -> None:
        rf, spark = models[0].stages[-1], SparkSession.getActiveSession()
        path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        with ThreadPool(min(FITS_AT_ONCE, len(models))) as pool:
            pool.map(inheritable_thread_target(spark)(lambda k: models[k].stages[-1].write().save(f"{path}/model={k}")), range(len(models)), 1)
        node = F.col("nodeData")
        parts = [spark.read.parquet(f"{path}/model={k}/data").withColumn("model", F.lit(k)) for k in range(len(models))]
        nodes = reduce(DataFrame.unionByName, parts).select(
            "model", "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), node["impurityStats"].alias("stats"),
        ).toPandas().sort_values(["model", "treeID", "id"], ignore_index=True)
        self.classes = rf.numClasses
        # A node's id is its place in its tree.
        self.roots = np.flatnonzero(nodes.id.to_numpy() == 0)
        start = np.repeat(self.roots, np.diff(self.roots, append=len(nodes)))
        leaf = nodes.left.to_numpy() < 0
        self.feature = np.where(leaf, -1, nodes.feature.to_numpy())
        self.threshold = nodes.threshold.fillna(0.0).to_numpy(float)
        self.left, self.right = np.where(leaf, 0, nodes.left.to_numpy() + start), np.where(leaf, 0, nodes.right.to_numpy() + start)
        stats = np.stack(nodes.stats.to_numpy())
        self.value = stats / np.maximum(stats.sum(1, keepdims=True), 1e-12)

    def digest(self) -> str:
        """Equal for forests of equal nodes."""
        return hashlib.sha256(b"".join(np.ascontiguousarray(a).tobytes() for a in (self.feature, self.threshold, self.left, self.right, self.value))).hexdigest()

    def proba(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Class probabilities; all trees go down a level at a time, some rows at once."""
        out = [np.zeros((0, self.classes))]
        for at in range(0, len(x), rows):
            some = x[at : at + rows]
            node, of = np.tile(self.roots, (len(some), 1)), np.arange(len(some))[:, None]
            while (inner := self.feature[node] >= 0).any():
                down = np.where(some[of, np.maximum(self.feature[node], 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            out.append(self.value[node].sum(1) / len(self.roots))
        return np.concatenate(out)
