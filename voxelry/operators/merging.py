"""Merging clusters into those whose boxes hold them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = 0.5


def boxes(labelled: DataFrame) -> DataFrame:
    """frame_id, label, n and the box of each label's points."""
    ends = [f(a).alias(f"{a}_{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return labelled.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), *ends)


def candidates(found: DataFrame) -> DataFrame:
    """Pairs of boxes of a frame of which the outer holds the inner and has more than twice its points.

    A frame's clusters are few: its boxes are gathered once, and each is tested against the others.
    """
    box = F.struct("label", "n", *[f"{x}_{e}" for x in "xyz" for e in ("min", "max")])
    frames = found.groupBy("frame_id").agg(F.collect_list(box).alias("boxes")).select("frame_id", "boxes", F.explode("boxes").alias("a"))

    def inside(b: Column) -> Column:
        test = (b["label"] != F.col("a.label")) & (b["n"] < F.col("a.n") * HALF)
        for x in "xyz":
            test &= (b[f"{x}_min"] >= F.col(f"a.{x}_min")) & (b[f"{x}_max"] <= F.col(f"a.{x}_max"))
        return test

    pairs = frames.select("frame_id", "a", F.explode(F.filter("boxes", inside)).alias("b"))
    return pairs.select("frame_id", F.col("a.label").alias("outer_label"), F.col("b.label").alias("inner_label"), F.col("a.n").alias("outer_n"), F.col("b.n").alias("inner_n"))


def fold(sizes: dict[int, int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Owner by taken-in label: outer labels in order take in what they hold, if it is below half of what they have by then.

    A label that was taken in neither takes in nor is taken in again.
    """
    owner: dict[int, int] = {}
    now = dict(sizes)
    for outer, inner in sorted(pairs):
        if outer not in owner and inner not in owner and now[inner] < HALF * now[outer]:
            owner[inner] = outer
            now[outer] += now[inner]
    return owner


def absorbed(found: DataFrame) -> DataFrame:
    """frame_id, label, owner, owner_n for each cluster: owner is its own label unless it was taken in.

    Frames are folded on their own. Sizes only grow, so pairs that are too large at first may pass
    later; boxes alone limit the pairs here.
    """
    def of_frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label").reset_index(drop=True)
        low, high = pdf[["x_min", "y_min", "z_min"]].to_numpy(), pdf[["x_max", "y_max", "z_max"]].to_numpy()
        labels, sizes = pdf.label.tolist(), dict(zip(pdf.label.tolist(), pdf.n.tolist(), strict=True))
        pairs = []
        for i, label in enumerate(labels):
            inside = (low >= low[i]).all(1) & (high <= high[i]).all(1)
            inside[i] = False
            pairs += [(label, labels[j]) for j in inside.nonzero()[0]]
        owner = fold(sizes, pairs)
        owners = [owner.get(x, x) for x in labels]
        total = pd.Series([sizes[x] for x in labels]).groupby(owners).sum()
        return pd.DataFrame({"frame_id": pdf.frame_id, "label": labels, "owner": owners, "owner_n": [int(total[x]) for x in owners]})

    return found.groupBy("frame_id").applyInPandas(of_frame, "frame_id bigint, label bigint, owner bigint, owner_n bigint")
