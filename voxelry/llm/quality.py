"""Quality by positive-unlabelled learning.

A linear model over a text's surface statistics minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` over trusted positives and unlabelled texts, all
that are not held out: statistics are written once, and each Newton step sums losses, gradients and
curvature over them. Labelled negatives are never read. The class prior is estimated too: a first model
scores the half of the rows that it was not fitted on, and the prior is the least ratio of the shares of
unlabelled texts and of positives above a score, among scores where both are known well enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import small_batches, texts, written

FOLDS, FOLD = 3, 1
#: Newton steps at most, the penalty on squared weights, and the gain at which they end.
STEPS, DECAY, ENOUGH = 12, 1e-3, 1e-5
#: Cells of the scores' histogram, and the doubt that is allowed in the shares above a score.
CELLS, DOUBT = 1000, 0.1
_MARKS = [i for i in range(33, 127) if not chr(i).isalnum()]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float = 0.5


def statistics(text: str) -> np.ndarray:
    """Surface statistics of the whole text: shares of kinds of bytes and how much repeats. Finite for empty texts too."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    w, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    m = max(len(w), 1)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    pairs = len(set(zip(w, w[1:], strict=False)))
    shape = [
        np.log1p(len(raw)), np.log1p(len(w)), upper / max(upper + lower, 1), lower / n, digits / n, counts[128:].sum() / n, counts[[9, 10, 11, 12, 13, 32]].sum() / n,
        counts[:9].sum() / n, len(set(w)) / m, pairs / max(len(w) - 1, 1), len(set(lines)) / max(len(lines), 1), len(lines) / m, len(raw) / m / 10, max(map(len, w), default=0) / n,
    ]
    return np.concatenate([shape, np.sqrt(counts[_MARKS] / m)])


def expanded(x: np.ndarray, model: Model) -> np.ndarray:
    """Standardised and clipped statistics and their squares."""
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.concatenate([z, z * z / 6], axis=-1)


def _with_one(x: np.ndarray, model: Model) -> np.ndarray:
    return np.column_stack([expanded(x, model), np.ones(len(x))])


def sums(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over rows of log(1 + exp(w x)), its gradient and its second derivative."""
    f = x @ w
    s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
    return float(np.logaddexp(0.0, f).sum()), x.T @ s, (x * (s * (1 - s))[:, None]).T @ x


def risk(w: np.ndarray, prior: float, p: tuple, u: tuple) -> tuple[float, np.ndarray, np.ndarray, bool]:
    """The non-negative risk, its gradient and curvature, and whether the part for negatives counts.

    ``p`` and ``u`` are, of positives and unlabelled texts: how many, the sum of x, and what :func:`sums`
    gives. With log losses R_p(+) - R_p(-) is -w times the mean of x.
    """
    (np_, xp, lp, gp, _), (nu, _, lu, gu, hu) = p, u
    negative = lu / nu - prior * lp / np_
    ridge = DECAY * np.append(w[:-1], 0.0)
    value = prior * (lp - w @ xp) / np_ + max(0.0, negative) + 0.5 * ridge @ w
    gradient = prior * (gp - xp) / np_ + (gu / nu - prior * gp / np_ if negative >= 0 else 0.0) + ridge
    return float(value), gradient, hu / nu + DECAY * np.eye(len(w)), negative >= 0


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == FOLD


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(x) for x in texts(batch)], pa.list_(pa.float64()))], ["doc_id", "x"])


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of what ``of`` gives of a batch's statistics, positive flags and halves; None without rows.

    Each task sends one vector, and these are added up by place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                found = of(x, np.asarray(batch.column("good"), bool), np.asarray(batch.column("half"), int))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    added = rows.select("x", "good", "half").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    got = sorted((r["i"], r["v"]) for r in added.collect())  # one row by place of the vector
    return np.array([v for _, v in got]) if got else None


def _parts(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    value, gradient, second = sums(x, w)
    return np.concatenate([[len(x)], x.sum(0), [value], gradient, second.ravel()])


def _unpacked(v: np.ndarray, d: int) -> tuple:
    return v[0], v[1 : d + 1], v[d + 1], v[d + 2 : 2 * d + 2], v[2 * d + 2 :].reshape(d, d)


def fit(rows: DataFrame, model: Model, prior: float, half: int | None = None) -> Model:
    """Newton steps on the risk over ``rows`` (x, good, half), or those of one half; a step that does not lower it is halved.

    Where the part for negatives is below zero, it is walked back, as the non-negative estimator does.
    """
    d = 2 * len(model.mean) + 1
    w, step, best = np.zeros(d), np.zeros(d), (np.inf, None)
    for _ in range(STEPS):
        at = w + step

        def of(x: np.ndarray, good: np.ndarray, halves: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            x = _with_one(x, model)
            mine = np.full(len(x), True) if half is None else halves == half
            return np.concatenate([_parts(x[mine & good], at), _parts(x[mine], at)])

        v = _summed(rows, of)
        p, u = _unpacked(v[: len(v) // 2], d), _unpacked(v[len(v) // 2 :], d)
        if not p[0]:
            break
        value, gradient, second, counts = risk(at, prior, p, u)
        if value < best[0] - ENOUGH:
            back = gradient if counts else -(u[3] / u[0] - prior * p[3] / p[0])
            w, best, step = at, (value, second), -np.linalg.solve(second, back)
        elif value <= best[0] + ENOUGH and np.isfinite(best[0]) and np.abs(step).max() < 1e-2:
            break
        else:
            step = step / 2
    return Model(model.mean, model.scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the histograms of both by rising score.

    Above any score, the unlabelled hold at least the positives' part of their share; the estimate is
    the least ratio of the two shares, with an allowance for how many rows they are known from.
    """
    n, m = positive.sum(), unlabelled.sum()
    p, u = np.cumsum(positive[::-1]) / max(n, 1), np.cumsum(unlabelled[::-1]) / max(m, 1)
    if not n or not m:
        return 0.5
    doubt = np.sqrt(np.log(4 / DOUBT) / (2 * n)) + np.sqrt(np.log(4 / DOUBT) / (2 * m))
    at = int(np.argmin(np.where(p > 0, (u + 1.01 * doubt) / np.maximum(p, 1e-12), np.inf)))
    return float(min(max(u[at] / p[at], 0.05), 0.95))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all rows that are not held out; None without a trusted positive.

    Positives are the rows that a label calls good; every row is unlabelled besides. Rows without id or
    label are no positives; of repeated labels the smallest counts.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL").where(~held_out())
    made = rows.mapInArrow(_featured, "doc_id bigint, x array<double>").join(known.where("q > 0"), "doc_id", "left")
    made = written(made.select("x", F.col("q").isNotNull().alias("good"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half")), "statistics")
    v = _summed(made, lambda x, good, half: np.concatenate([[len(x), good.sum()], x.sum(0), (x * x).sum(0)]))
    if v is None or not v[1]:
        return None
    mean, square = v[2:].reshape(2, -1) / v[0]
    model = Model(mean, np.maximum(np.sqrt(np.maximum(square - mean * mean, 0.0)), 1e-6), np.zeros(2 * len(mean)), 0.0)
    first = fit(made, model, 0.5, half=0)

    def scores(x: np.ndarray, good: np.ndarray, half: np.ndarray) -> np.ndarray:
        cell = np.minimum(probability(x, first) * CELLS, CELLS - 1).astype(int)
        return np.concatenate([np.bincount(cell[(half == 1) & m], minlength=CELLS) for m in (good, np.full(len(x), True))])

    found = _summed(made, scores)
    return fit(made, model, estimated_prior(found[:CELLS], found[CELLS:]))


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(expanded(x, model) @ model.weights + model.bias, -50, 50)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; without a model the score is 0.5."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts(batch)])
            p = probability(x, model) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scored, "doc_id bigint, score double")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains and scores every row of ``docs``; see :func:`score`.

    Null and empty texts are scored like any other, from the statistics of an empty text; texts of any
    length are read whole. Null ids are neither trained on nor held out. Repeated rows count as often as
    they occur and are scored alike. Empty tables give empty results; other columns are ignored.
    """
    return score(docs, train(docs, labels))
