"""Random forests that are grown in tasks and never meet on the driver: folds, stages and feature sets side by side.

Rows become bins once. A forest's trees are dealt to tasks, some trees of one forest to each; where a forest has more rows than
a task takes, its trees are first grown level by level from histograms that tasks add up, until each node's rows fit. The task
that has grown its trees also predicts the rows that are held out, so predictions leave it, and trees only if they are wanted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.session import written

# Rows of a leaf at least, bins of a feature, and the seed of samples and features.
LEAF, MAX_BINS, SEED = 5, 128, 42
#: Rows that tell the features' bins, as in Spark's own forests; all rows are used to grow.
EDGE_ROWS = MAX_BINS * MAX_BINS
#: Rows and trees that one task grows at most.
TASK_ROWS, TASK_TREES = 1 << 17, 10
#: Partitions at most; there may be more nodes than that to grow.
MOST_PARTS = 1024
#: Sums of probabilities are whole numbers of this fraction, so their order does not matter.
UNIT = 1 << 40
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))


class Plan(NamedTuple):
    """One forest: its features, the class of a row (null: the row is not learnt from), which rows it predicts, and the classes' weights (None: balanced)."""

    names: list[str]
    label: Column
    tested: Column
    trees: int
    weights: tuple[float, ...] | None = None


class Tree(NamedTuple):
    """A node's feature (-1: a leaf), its last bin to the left, its left child (the right one is next) or a leaf's row of ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(place: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample (Poisson, mean 1): the same for a row wherever it is looked at."""
    key = _mixed(np.full(1, SEED * 1_000_003 + tree + 1, np.uint64))
    x = _mixed(_mixed(place.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ key)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.int64)


def _chosen(features: int, nodes: int, *seed: int) -> np.ndarray:
    """The features that each node looks at: the root of their number."""
    return np.argsort(np.random.default_rng([SEED, *seed]).random((nodes, features)), axis=1)[:, : int(np.ceil(features**0.5))]


def _best(node: np.ndarray, slot: np.ndarray, bin_: np.ndarray, left: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the cuts (node, slot, bin, counts to the left) each node's with the largest fall of Gini impurity: node, slot, bin, counts left, gain."""
    right = total[node] - left
    ok = (left.sum(1) >= LEAF) & (right.sum(1) >= LEAF)
    node, slot, bin_, left, right = node[ok], slot[ok], bin_[ok], left[ok], right[ok]
    a, b, t = left * weight, right * weight, total * weight
    whole = t.sum(1)
    pure = (a * a).sum(1) / a.sum(1) + (b * b).sum(1) / b.sum(1)
    gain = (pure - ((t * t).sum(1) / np.maximum(whole, 1e-300))[node]) / whole[node]
    most = np.full(len(total), 1e-12)
    np.maximum.at(most, node, gain)
    at = np.flatnonzero(gain == most[node])
    at = at[np.lexsort((bin_[at], slot[at], node[at]))]
    at = at[np.unique(node[at], return_index=True)[1]]
    return node[at], slot[at], bin_[at], left[at], gain[at]


def grow(x: np.ndarray, y: np.ndarray, times: np.ndarray, weight: np.ndarray, depth: int, *seed: int) -> Tree:
    """A tree over bins ``x`` and classes ``y``, each row as often as ``times`` says, level by level."""
    kept = times > 0
    x, y, times, at = x[kept], y[kept], times[kept], np.zeros(int(kept.sum()), np.int64)
    classes, features, n, base = len(weight), x.shape[1], 1, 0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    values, leaves = [], 0
    for level in range(depth + 1):
        counts = np.bincount(at * classes + y, times, n * classes).reshape(n, classes)
        feature, cut, left = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        size = counts.sum(1)
        open_ = (size >= 2 * LEAF) & (counts.max(1) < size) if level < depth else np.zeros(n, bool)
        split = np.empty(0, np.int64)
        if open_.any():
            use = open_[at]
            x, y, times, at = x[use], y[use], times[use], at[use]
            slots = _chosen(features, n, *seed, level)
            k = slots.shape[1]
            bins = np.take_along_axis(x, slots[at], 1).astype(np.int64)
            key = ((np.arange(k) * n + at[:, None]) * MAX_BINS + bins).astype(np.int32 if k * n * MAX_BINS * classes < 1 << 31 else np.int64)
            cells = (key * classes + y[:, None]).ravel()
            if k * n * MAX_BINS * classes <= 4 * len(cells):  # few nodes: a count for every bin
                held = np.bincount(cells, np.repeat(times, k), k * n * MAX_BINS * classes).reshape(-1, classes)
                there = np.flatnonzero(held.any(1))
                held = held[there]
            else:  # many nodes, most of them small: rows in order
                order = np.argsort(cells)
                cells, amounts = cells[order], times[order // k]
                first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                amounts, cells = np.add.reduceat(amounts, first), cells[first]
                bin_of = cells // classes
                first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
                there = bin_of[first]
                held = np.zeros((len(there), classes))
                held[np.repeat(np.arange(len(there)), np.diff(np.append(first, len(cells)))), cells - bin_of * classes] = amounts
            sums = np.cumsum(held, 0)
            cell, bin_ = there // MAX_BINS, there % MAX_BINS
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            before = np.vstack([np.zeros((1, classes)), sums])[starts]
            sums = sums - np.repeat(before, np.diff(np.append(starts, len(cell))), axis=0)
            split, slot, cuts, _, _ = _best(cell % n, cell // n, bin_, sums, counts, weight)
            feature[split], cut[split], left[split] = slots[split, slot], cuts, base + n + 2 * np.arange(len(split))
        ended = feature < 0
        left[ended] = leaves + np.arange(int(ended.sum()))
        w = counts[ended] * weight
        values.append(w / np.maximum(w.sum(1, keepdims=True), 1e-300))
        leaves += len(w)
        parts.append((feature, cut, left))
        if not len(split):
            break
        use = ~ended[at]
        x, y, times, at = x[use], y[use], times[use], at[use]
        at = left[at] - (base + n) + (x[np.arange(len(at)), feature[at]] > cut[at])
        base, n = base + n, 2 * len(split)
    return Tree(*(np.concatenate(c) for c in zip(*parts, strict=True)), np.concatenate(values).astype(np.float32))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The node at which each row of bins ends."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[tree.feature[node[rows]] >= 0]
        at = node[rows]
        node[rows] = tree.left[at] + (x[rows, tree.feature[at]] > tree.cut[at])
    return node


def _leaf(w: np.ndarray) -> Tree:
    """A tree of one leaf."""
    return Tree(np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), (w / max(w.sum(), 1e-300))[None].astype(np.float32))


class _Top(NamedTuple):
    """The upper levels of one tree. ``left`` of its ends is a place in ``counts``, the classes of the rows that reach it; ``grown`` says which are final."""

    tree: Tree
    counts: np.ndarray
    grown: np.ndarray
    depth: np.ndarray


def edges_of(rows: DataFrame, names: list[str], key: Column) -> list[np.ndarray]:
    """Upper ends of each feature's bins, a bin more than there are ends; from the rows of least hash, or all if they are few."""
    least = rows.select(*[F.col(c).cast("double") for c in names], F.xxhash64(key).alias("__h")).orderBy("__h", *names).limit(EDGE_ROWS)
    x = least.toPandas()[names].to_numpy(float)
    out = []
    for col in x.T:
        values, counts = np.unique(col[~np.isnan(col)], return_counts=True)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= MAX_BINS:
            share = np.cumsum(counts) / counts.sum()
            middle = middle[np.unique(np.searchsorted(share[:-1], np.arange(1, MAX_BINS) / MAX_BINS).clip(max=len(middle) - 1))]
        out.append(middle)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _key(rows: DataFrame) -> Column:
    """What a row's part in the trees' samples depends on."""
    return F.col("sample_id").cast("bigint") if "sample_id" in rows.columns else F.monotonically_increasing_id()


class _Rows(NamedTuple):
    """Rows as bins, written once: id, key, x (a byte a feature), ys and tests (by plan), truth."""

    table: DataFrame
    names: list[str]
    edges: list[np.ndarray]
    counts: list[np.ndarray]

    def of(self, plan: Plan) -> list[int]:
        return [self.names.index(c) for c in plan.names]


def _prepare(rows: DataFrame, plans: list[Plan]) -> _Rows:
    names = list(dict.fromkeys(c for p in plans for c in p.names))
    learnt = reduce(lambda a, b: a | b, [p.label.isNotNull() for p in plans])
    edges = edges_of(rows.where(learnt), names, _key(rows))
    truth = F.col("label").cast("bigint") if "label" in rows.columns else F.lit(-1).cast("bigint")
    told = rows.select(
        F.monotonically_increasing_id().alias("id"), _key(rows).alias("key"), F.coalesce(truth, F.lit(-1)).alias("truth"), F.array(*[F.coalesce(p.label.cast("int"), F.lit(-1)) for p in plans]).alias("ys"),
        F.array(*[F.coalesce(p.tested, F.lit(False)) for p in plans]).alias("tests"), F.array(*[F.col(c).cast("double") for c in names]).alias("v"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = binned(np.stack(pdf.v.to_numpy()), edges)
                yield pdf.drop(columns="v").assign(x=[r.tobytes() for r in x])

    table = written(told.mapInPandas(run, "id bigint, key bigint, truth bigint, ys array<int>, tests array<boolean>, x binary"), "bins")
    each = table.select(F.posexplode("ys").alias("plan", "y")).where("y >= 0").groupBy("plan", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = []
    for k, plan in enumerate(plans):
        seen = {r["y"]: r["n"] for r in each if r["plan"] == k}
        classes = max(len(plan.weights or ()), 1 + max(seen, default=0))
        counts.append(np.array([seen.get(c, 0) for c in range(classes)]))
    return _Rows(table, names, edges, counts)


def _weight(plan: Plan, counts: np.ndarray) -> np.ndarray:
    if plan.weights:
        return np.array(plan.weights, float)
    return np.where(counts > 0, counts.sum() / (np.maximum((counts > 0).sum(), 1) * np.maximum(counts, 1)), 0.0)


def _tops(rows: _Rows, k: int, plan: Plan, weight: np.ndarray, depth: int) -> list[_Top]:
    """The upper levels of a forest's trees, until the rows of each end fit a task. A round is one job; the driver holds ends only."""
    classes, of = len(weight), rows.of(plan)
    tops = [_Top(_leaf(np.zeros(classes)), np.zeros((1, classes)), np.zeros(1, bool), np.zeros(1, int)) for _ in range(plan.trees)]
    wide = {t: [0] for t in range(plan.trees)}  # ends by place in ``counts`` that have too many rows
    while wide:
        slots = {(t, e): _chosen(len(of), 1, t, e, int(tops[t].depth[e]), 1 << 20)[0] for t, ends in wide.items() for e in ends}
        spread = rows.table.sparkSession.sparkContext.broadcast((tops, wide, slots))

        def count(batches: Iterator[pd.DataFrame], spread=spread) -> Iterator[pd.DataFrame]:
            tops, wide, slots = spread.value
            sums: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                key, y, x, _ = _arrays(pdf, k, of)
                key, y, x = key[y >= 0], y[y >= 0], x[y >= 0]
                for t, ends in wide.items():
                    times, end = bag(key, t), tops[t].tree.left[leaf_of(tops[t].tree, x)]
                    for e in ends:
                        at = np.flatnonzero((end == e) & (times > 0))
                        bins = x[at][:, slots[t, e]].astype(np.int64)
                        cell = (np.arange(bins.shape[1]) * MAX_BINS + bins) * classes + y[at][:, None]
                        got = np.bincount(cell.ravel(), np.repeat(times[at], bins.shape[1]), len(slots[t, e]) * MAX_BINS * classes)
                        sums[t, e] = sums[t, e] + got if (t, e) in sums else got
            for (t, e), got in sums.items():
                yield pd.DataFrame({"t": [t], "e": [e], "sums": [got.astype(np.int64).tobytes()]})

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            got = np.sum([np.frombuffer(b, np.int64) for b in pdf.sums], 0).reshape(-1, MAX_BINS, classes).astype(float)
            total, left = got[0].sum(0), np.cumsum(got, 1).reshape(-1, classes)
            n = len(left)
            _, slot, cut, to_left, _ = _best(np.zeros(n, int), np.arange(n) // MAX_BINS, np.arange(n) % MAX_BINS, left, total[None], weight)
            found = (int(slot[0]), int(cut[0]), to_left[0].tolist()) if len(slot) else (-1, 0, [])
            return pd.DataFrame([(int(pdf.t.iloc[0]), int(pdf.e.iloc[0]), *found, total.tolist())], columns=["t", "e", "slot", "cut", "lefts", "total"])

        found = rows.table.mapInPandas(count, "t int, e int, sums binary").groupBy("t", "e").applyInPandas(choose, "t int, e int, slot int, cut int, lefts array<double>, total array<double>").collect()
        spread.unpersist()
        after: dict[int, list[int]] = {}
        for r in found:
            t, e, top = r["t"], r["e"], tops[r["t"]]
            total = np.array(r["total"])
            top.counts[e] = total
            if r["slot"] < 0:
                top.grown[e] = True
                continue
            node, n, m = int(np.flatnonzero((top.tree.feature < 0) & (top.tree.left == e))[0]), len(top.tree.feature), len(top.counts)
            feature, cut, left = (np.append(a, [v, v]) for a, v in zip(top.tree[:3], (np.int16(-1), np.uint8(0), np.int32(0)), strict=True))
            feature[node], cut[node], left[node], left[n:] = slots[t, e][r["slot"]], r["cut"], n, (e, m)
            lefts = np.array(r["lefts"])
            counts = np.vstack([top.counts, total - lefts])
            counts[e] = lefts
            below = top.depth[e] + 1
            deep = np.append(top.depth, below)
            deep[e] = below
            grown = np.append(top.grown, False)
            tops[t] = _Top(Tree(feature, cut, left, top.tree.value), counts, grown, deep)
            for end in (e, m):
                if below >= depth:
                    grown[end] = True
                elif counts[end].sum() > TASK_ROWS:
                    after.setdefault(t, []).append(end)
        wide = after
    return tops


def _arrays(pdf: pd.DataFrame, k: int, of: list[int]) -> tuple[np.ndarray, ...]:
    """key, y, x and tested of a batch for plan ``k``."""
    x = np.frombuffer(b"".join(pdf.x), np.uint8).reshape(len(pdf), -1)[:, of] if len(pdf) else np.zeros((0, len(of)), np.uint8)
    y = np.fromiter((v[k] for v in pdf.ys), np.int32, len(pdf))
    return pdf.key.to_numpy(np.int64), y, x, np.fromiter((v[k] for v in pdf.tests), bool, len(pdf))


class _Unit(NamedTuple):
    """What one task grows: some trees of a plan from their root, or one end of one tree."""

    plan: int
    trees: tuple[int, ...]
    end: int  # -1: the root


def _dealt(rows: _Rows, plans: list[Plan], depth: int, most: int) -> tuple[list[_Unit], dict[int, list[_Top]], list[np.ndarray]]:
    weights = [_weight(p, c) for p, c in zip(plans, rows.counts, strict=True)]
    units, tops = [], {}
    for k, plan in enumerate(plans):
        if rows.counts[k].sum() <= most:
            units += [_Unit(k, tuple(range(t, min(t + TASK_TREES, plan.trees))), -1) for t in range(0, plan.trees, TASK_TREES)]
        else:
            tops[k] = _tops(rows, k, plan, weights[k], depth)
            units += [_Unit(k, (t,), e) for t, top in enumerate(tops[k]) for e in range(len(top.counts))]
    return units, tops, weights


def _sent(rows: _Rows, plans: list[Plan], units: list[_Unit], tops: dict[int, list[_Top]]) -> DataFrame:
    """unit, held, rows (key and class; of those that are held out id, key and truth) and x as bytes, each unit in one partition, rows to grow from first."""
    by_plan: dict[int, list[int]] = {}
    for u, unit in enumerate(units):
        by_plan.setdefault(unit.plan, []).append(u)
    at = {(unit.plan, unit.trees[0], unit.end): u for u, unit in enumerate(units) if unit.end >= 0}
    of = [rows.of(p) for p in plans]
    spread = rows.table.sparkSession.sparkContext.broadcast(tops)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, columns = spread.value, ["unit", "held", "rows", "x"]
        for pdf in batches:
            for k, own in by_plan.items():
                key, y, x, tested = _arrays(pdf, k, of[k])
                for held, some in ((False, y >= 0), (True, tested)):
                    if not some.any():
                        continue
                    told = np.stack([pdf[c].to_numpy(np.int64) for c in ("id", "key", "truth")] if held else [key, y.astype(np.int64)], 1)
                    told, b = told[some], np.ascontiguousarray(x[some])
                    if k not in tops:
                        both = told.tobytes(), b.tobytes()
                        yield pd.DataFrame([(u, held, *both) for u in own], columns=columns)
                        continue
                    for t, top in enumerate(tops[k]):
                        end = top.tree.left[leaf_of(top.tree, b)]
                        use = np.ones(len(b), bool) if held else (bag(told[:, 0], t) > 0) & ~top.grown[end]
                        out = [(at[k, t, int(e)], held, told[s].tobytes(), b[s].tobytes()) for e in np.unique(end[use]) for s in [use & (end == e)]]
                        if out:
                            yield pd.DataFrame(out, columns=columns)

    parts = min(len(units), MOST_PARTS)
    sent = rows.table.mapInPandas(run, "unit int, held boolean, rows binary, x binary")
    return sent.repartitionById(parts, F.col("unit") % parts).sortWithinPartitions("unit", "held")


def _units(batches: Iterator[pd.DataFrame], grown: Callable[[int, list], list[Tree]]) -> Iterator[tuple[int, list[Tree], tuple | None]]:
    """Each unit's trees, once its rows have come, and after that the rows that are held out, one piece at a time (None if there are none)."""
    at, own, trees, held = None, [], None, False
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.unit != at:
                if at is not None and not held:
                    yield at, grown(at, own), None
                at, own, trees, held = r.unit, [], None, False
            if not r.held:
                own.append(r)
                continue
            if trees is None:
                trees, own = grown(at, own), []
            held = True
            yield at, trees, r
    if at is not None and not held:
        yield at, grown(at, own), None


def _growing(units: list[_Unit], weights: list[np.ndarray], tops: dict[int, list[_Top]], depth: int) -> Callable[[int, list], list[Tree]]:
    def grown(u: int, own: list) -> list[Tree]:
        unit = units[u]
        weight, top = weights[unit.plan], tops[unit.plan][unit.trees[0]] if unit.end >= 0 else None
        if not own:
            return [_leaf(top.counts[unit.end] * weight if top is not None else 0 * weight) for _ in unit.trees]
        told = np.frombuffer(b"".join(r.rows for r in own), np.int64).reshape(-1, 2)
        order = np.lexsort(told.T)
        x = np.frombuffer(b"".join(r.x for r in own), np.uint8).reshape(len(told), -1)[order]
        key, y = told[order].T
        left = depth - (int(top.depth[unit.end]) if top is not None else 0)
        return [grow(x, y, bag(key, t), weight, left, t, max(unit.end, 0), int(unit.end >= 0)) for t in unit.trees]

    return grown


def held_out(rows: DataFrame, plans: list[Plan], depth: int) -> DataFrame:
    """plan, id (of the row), sample_id, truth (label), proba: what each plan's forest says of each row that it tests. All plans share the bins, and the seed."""
    told = _prepare(rows, plans)
    units, tops, weights = _dealt(told, plans, depth, TASK_ROWS)
    spread = rows.sparkSession.sparkContext.broadcast((units, tops, weights))
    classes = max(len(w) for w in weights)
    columns = [f"p{c}" for c in range(classes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, tops, weights = spread.value
        for u, trees, r in _units(batches, _growing(units, weights, tops, depth)):
            if r is None:
                continue
            at, key, truth = np.frombuffer(r.rows, np.int64).reshape(-1, 3).T
            x = np.frombuffer(r.x, np.uint8).reshape(len(at), -1)
            got = sum(np.rint(t.value[t.left[leaf_of(t, x)]].astype(float) * UNIT).astype(np.int64) for t in trees)
            got = np.pad(got, ((0, 0), (0, classes - got.shape[1])))
            yield pd.DataFrame({"plan": units[u].plan, "id": at, "sample_id": key, "truth": truth, **dict(zip(columns, got.T, strict=True))})

    each = _sent(told, plans, units, tops).mapInPandas(run, f"plan int, id bigint, sample_id bigint, truth bigint, {', '.join(f'{c} bigint' for c in columns)}")
    total = F.nullif(reduce(lambda a, b: a + b, [F.col(c) for c in columns]), F.lit(0))
    sums = each.groupBy("plan", "id", "sample_id", "truth").agg(*[F.sum(c).alias(c) for c in columns])
    sizes = F.array(*[F.lit(len(w)) for w in weights])
    proba = F.slice(F.array(*[F.col(c) / total for c in columns]), F.lit(1), F.get(sizes, F.col("plan")))
    return sums.select("plan", "id", "sample_id", F.when(F.col("truth") >= 0, F.col("truth")).cast(rows.schema["label"].dataType if "label" in rows.columns else "bigint").alias("truth"), proba.alias("proba"))


def with_class(found: DataFrame) -> DataFrame:
    """Adds pred, the first of the likeliest classes, and conf."""
    pred = (F.array_position("proba", F.array_max("proba")) - 1).cast("int")
    return found.withColumns({"pred": pred, "conf": F.array_max("proba")})


def fitted(rows: DataFrame, plan: Plan, depth: int) -> Grown:
    """The forest of one plan as arrays: some bytes a node, and a leaf's probabilities."""
    told = _prepare(rows, [plan._replace(tested=F.lit(False))])
    units, tops, weights = _dealt(told, [plan], depth, TASK_ROWS)
    spread = rows.sparkSession.sparkContext.broadcast((units, tops, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, tops, weights = spread.value
        for u, trees, _ in _units(batches, _growing(units, weights, tops, depth)):
            for t, tree in zip(units[u].trees, trees, strict=True):
                yield pd.DataFrame([(t, units[u].end, *(a.tobytes() for a in tree))], columns=["t", "e", "feature", "cut", "left", "value"])

    found = _sent(told, [plan], units, tops).mapInPandas(run, "t int, e int, feature binary, cut binary, left binary, value binary")
    classes, parts = len(weights[0]), {}
    for r in written(found, "trees").toLocalIterator():
        parts[r["t"], r["e"]] = Tree(np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8), np.frombuffer(r["left"], np.int32), np.frombuffer(r["value"], np.float32).reshape(-1, classes))
    trees = []
    for t in range(plan.trees):
        if 0 not in tops:
            trees.append(parts.get((t, -1)) or _leaf(np.zeros(classes)))
            continue
        top = tops[0][t]
        feature, cut, left, values, leaves = [top.tree.feature.copy()], [top.tree.cut.copy()], [top.tree.left.copy()], [], 0
        n = len(feature[0])
        for e in range(len(top.counts)):
            part = parts.get((t, e)) or _leaf(top.counts[e] * weights[0])
            node = int(np.flatnonzero((top.tree.feature < 0) & (top.tree.left == e))[0])
            # The part's root takes the end's place; its other nodes follow.
            moved = np.where(part.feature < 0, part.left + leaves, part.left - 1 + n).astype(np.int32)
            feature[0][node], cut[0][node], left[0][node] = part.feature[0], part.cut[0], moved[0]
            feature.append(part.feature[1:])
            cut.append(part.cut[1:])
            left.append(moved[1:])
            n, leaves = n + len(moved) - 1, leaves + len(part.value)
            values.append(part.value)
        trees.append(Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(values)))
    return Grown(trees, told.edges)


class Grown:
    """A forest's trees as arrays, numbered through, and the ends of the features' bins. Once :meth:`sent`, tasks share one copy of the arrays."""

    def __init__(self, trees: list[Tree], edges: list[np.ndarray]) -> None:
        nodes = np.cumsum([0, *(len(t.feature) for t in trees)])
        leaves = np.cumsum([0, *(len(t.value) for t in trees)])
        left = [np.where(t.feature < 0, t.left + leaves[k], t.left + nodes[k]).astype(np.int32) for k, t in enumerate(trees)]
        self.edges, self._at = edges, None
        self._arrays = (nodes[:-1], np.concatenate([t.feature for t in trees]), np.concatenate([t.cut for t in trees]), np.concatenate(left), np.concatenate([t.value for t in trees]))

    def sent(self, spark) -> Grown:
        """The same forest, whose arrays go to the executors once and not with every task."""
        self._at = spark.sparkContext.broadcast(self._arrays)
        return self

    def __getstate__(self) -> dict:
        return {"edges": self.edges, "_at": self._at, "_arrays": None if self._at is not None else self._arrays}

    @property
    def arrays(self) -> tuple[np.ndarray, ...]:
        return self._arrays if self._arrays is not None else self._at.value

    @property
    def classes(self) -> int:
        return self.arrays[-1].shape[1]

    def digest(self) -> str:
        """Equal for forests of equal nodes."""
        return hashlib.sha256(b"".join(np.ascontiguousarray(a).tobytes() for a in (*self.arrays, *self.edges))).hexdigest()

    def proba(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Class probabilities; all trees go down a level at a time, some rows at once."""
        roots, feature, cut, left, value = self.arrays
        out = [np.zeros((0, value.shape[1]))]
        for at in range(0, len(x), rows):
            some = binned(np.asarray(x[at : at + rows], float), self.edges)
            node, of = np.tile(roots, (len(some), 1)), np.arange(len(some))[:, None]
            while (inner := feature[node] >= 0).any():
                node = np.where(inner, left[node] + (some[of, np.maximum(feature[node], 0)] > cut[node]), node)
            got = value[left[node]].astype(float).sum(1)
            out.append(got / np.maximum(got.sum(1, keepdims=True), 1e-300))
        return np.concatenate(out)
