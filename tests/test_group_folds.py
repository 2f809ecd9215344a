"""Balanced group folds: against a plain deal, against dealing by main label, and on awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.operators import evaluation

SCHEMA = "sample_id bigint, label int, group_id bigint"


def _samples(seed, groups, hot=0):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        size = hot if hot and g == 0 else int(rng.zipf(1.6)) % 60 + 1
        main = rng.choice(4, p=[0.55, 0.25, 0.15, 0.05])
        rows += [(len(rows) + i, int(main if rng.random() < 0.8 else rng.integers(4)), g) for i in range(size)]
    return rows


def _spread(rows, fold_of, folds=5):
    """Standard deviation over folds of each class's shares, meant over classes."""
    table = np.zeros((folds, 4))
    for _, label, g in rows:
        table[fold_of[g], label] += 1
    return (table / table.sum(0)).std(0).mean()


def _plain(rows, folds=5, seed=42):
    """The rule of the docstring on one machine, for fewer kinds than a task deals out."""
    from hashlib import md5

    held = {}
    for _, label, g in rows:
        held.setdefault(g, [0] * 4)[label] += 1
    totals, kinds, out = np.sum(list(held.values()), 0), {}, {}
    for g, h in held.items():
        kinds.setdefault(",".join(f"{c}:{n}" for c, n in enumerate(h) if n), []).append(g)
    units = []
    for kind, of in kinds.items():
        of.sort(key=lambda g: (md5(f"{seed}:{g}".encode()).hexdigest(), g))
        even = len(of) - len(of) % folds
        out |= {g: i % folds for i, g in enumerate(of[:even])}
        units += [(-sum(held[g]), kind, i, g) for i, g in enumerate(of[even:])]
    load = [[0] * 4 for _ in range(folds)]
    for *_, g in sorted(units):
        cost = [sum(h * n / float(t * t) for h, n, t in zip(held[g], at, totals, strict=True) if t) for at in load]
        out[g] = cost.index(min(cost))
        load[out[g]] = [a + b for a, b in zip(load[out[g]], held[g], strict=True)]
    return out


def _by_main(rows, folds=5):
    """Groups dealt by main label, sizes ignored."""
    held, out, dealt = {}, {}, [0] * 4
    for _, label, g in rows:
        held.setdefault(g, [0] * 4)[label] += 1
    for g, h in held.items():
        out[g] = dealt[int(np.argmax(h))] % folds
        dealt[int(np.argmax(h))] += 1
    return out


@pytest.mark.parametrize(("seed", "groups", "hot"), [(0, 40, 0), (1, 300, 0), (2, 300, 900)])
def test_folds_are_those_of_a_plain_deal_and_spread_less_than_by_main_label(spark, seed, groups, hot):
    rows = _samples(seed, groups, hot)
    got = {r[0]: r[1] for r in evaluation.group_folds(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _plain(rows)
    assert _spread(rows, got) < _spread(rows, _by_main(rows))


def test_many_kinds_are_dealt_by_several_tasks(spark, monkeypatch):
    rows = _samples(3, 400)
    one = {r[0]: r[1] for r in evaluation.group_folds(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(evaluation, "KINDS", 20)
    got = {r[0]: r[1] for r in evaluation.group_folds(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(one) and set(got.values()) == set(range(5)) and got != one
    assert _spread(rows, one) <= _spread(rows, got) < _spread(rows, _by_main(rows)) / 2


def test_nulls_empty_tables_and_fewer_groups_than_folds(spark):
    assert evaluation.with_folds(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, 1, None), (1, None, None), (2, 1, 7), (2, 1, 7)]
    got = evaluation.with_folds(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and len({r["group_fold"] for r in got if r["group_id"] is None}) == 1
    assert len({(r["group_id"], r["group_fold"]) for r in got}) == 2 and len({r["group_fold"] for r in got}) == 2
    same = spark.createDataFrame([(i, 0, i) for i in range(13)], SCHEMA)
    sizes = evaluation.group_folds(same).groupBy("group_fold").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == [2, 2, 3, 3, 3]
