"""Bird's-eye-view clustering: cells, connected components, clusters and their rejects.

Frames are told apart by frame_id, and by sensor_id where the points have one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.geometry import axis2, float_cell
from voxelry.schemas import frame_key
from voxelry.session import written

# Cell size, occupancy, and the reject limits in the order they are tested.
CELL, OCCUPIED = 0.15, 2
MIN_POINTS, MAX_POINTS, MAX_HEIGHT, MAX_WIDTH = 20, 15000, 5.0, 15.0
TRIM_GATE, TRIM_RANGE = 0.25, 0.5
#: Cell ids are cx * STRIDE + cy.
STRIDE = 1 << 20


def with_cells(points: DataFrame, cell: float = CELL, single: bool = False) -> DataFrame:
    """Adds cx, cy: cells from the frame's least x and y; ``single`` bins in 32-bit arithmetic.

    The least x and y are an aggregate with one row a frame, so no task gets a whole frame. ``points`` is read twice.
    """
    key = frame_key(points)
    least = points.groupBy(*key).agg(F.min("x").alias("x0"), F.min("y").alias("y0")).withColumnsRenamed({k: f"__{k}" for k in key})
    joined = points.join(least, _same(key, "__"))
    at = (lambda v, o: float_cell(F.col(v).cast("float"), F.col(o).cast("float"), cell)) if single else (lambda v, o: F.floor((F.col(v) - F.col(o)) / F.lit(cell)).cast("bigint"))
    return joined.withColumn("cx", at("x", "x0").cast("bigint")).withColumn("cy", at("y", "y0").cast("bigint")).drop("x0", "y0", *[f"__{k}" for k in key])


def _same(names: list[str], mark: str) -> Column:
    """Whether the named columns equal those with ``mark`` in front; nulls equal each other."""
    found = F.lit(True)
    for c in names:
        found &= F.col(c).eqNullSafe(F.col(f"{mark}{c}"))
    return found


def bev_cells(celled: DataFrame, occupied: int = OCCUPIED) -> DataFrame:
    """frame_id, cx, cy, n, z_min, z_max, height, occupied."""
    cells = celled.groupBy(*frame_key(celled), "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return cells.withColumn("height", F.col("z_max") - F.col("z_min")).withColumn("occupied", F.col("n") >= occupied)


def component_labels(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Least cell id of each cell's 4-connected component; cells are distinct.

    Labels take the least label across every edge and then that label's own, until nothing changes.
    """
    ids = np.asarray(cx, np.int64) * STRIDE + np.asarray(cy, np.int64)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    edges = []
    for step in (1, STRIDE):
        at = np.minimum(np.searchsorted(ordered, ordered + step), len(ordered) - 1)
        met = np.flatnonzero(ordered[at] == ordered + step)
        edges.append(np.stack([met, at[met]]))
    a, b = np.concatenate(edges, axis=1) if len(ordered) else np.zeros((2, 0), int)
    label = np.arange(len(ordered))
    while True:
        least = label.copy()
        np.minimum.at(least, label[a], label[b])
        np.minimum.at(least, label[b], label[a])
        least = least[least]
        while (least != (then := least[least])).any():
            least = then
        least = least[label]
        if (least == label).all():
            break
        label = least
    out = np.empty_like(ids)
    out[order] = ordered[label]
    return out


def components(cells: DataFrame) -> DataFrame:
    """frame_id, cx, cy, label of the occupied cells; labels are the component's least cell id.

    A frame is one scan, so its cells are bounded; frames are independent.
    """
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=component_labels(pdf.cx.to_numpy(), pdf.cy.to_numpy()))

    key = frame_key(cells)
    return cells.where("occupied").select(*key, "cx", "cy").groupBy(*key).applyInPandas(label, ", ".join(f"{c} bigint" for c in (*key, "cx", "cy", "label")))


def with_labels(celled: DataFrame, occupied: int = OCCUPIED, sizes: bool = False) -> DataFrame:
    """The points of occupied cells with cx, cy and their component's label, and on demand ``n_label``, the points of that label.

    Cells are counted and labelled, and points meet their cell's label by a join, so Python sees cells only, whose number is
    bounded by the frame's area. ``celled`` is read twice.
    """
    key = frame_key(celled)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf.assign(label=component_labels(pdf.cx.to_numpy(), pdf.cy.to_numpy()))
        return found.assign(n_label=found.groupby("label").n.transform("sum"))[[*key, "cx", "cy", "label", "n_label"]]

    cells = bev_cells(celled, occupied).where("occupied").select(*[F.col(k).cast("bigint").alias(k) for k in key], "cx", "cy", "n")
    labels = written(cells.groupBy(*key).applyInPandas(label, ", ".join(f"{c} bigint" for c in (*key, "cx", "cy", "label", "n_label"))), "labels")
    rows = celled.select(*[F.col(c).cast("bigint").alias(c) for c in key], *[F.col(c).cast("double").alias(c) for c in "xyz"], "cx", "cy")
    of = [*key, "cx", "cy"]
    return rows.join(labels.withColumnsRenamed({c: f"__{c}" for c in of}), _same(of, "__")).select(*key, "x", "y", "z", "cx", "cy", "label", *["n_label"] * sizes)


# Frames that are larger than a task


def cells_from(points: DataFrame, cell: float = CELL) -> DataFrame:
    """As :func:`with_cells`, for frames of any size: their least x and y are aggregates, one row a frame."""
    key = frame_key(points)
    least = points.groupBy(*key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = lambda v: F.floor((F.col(v) - F.col(f"{v}0")) / F.lit(cell)).cast("bigint")
    return points.join(least, key).withColumn("cx", at("x")).withColumn("cy", at("y")).drop("x0", "y0")


def _border_links(cells: DataFrame, tile: int) -> DataFrame:
    """The frame's key, a, b: labels (``local``) of cells that touch across a border between tiles. Only cells at a border are joined."""
    key = frame_key(cells)
    found = None
    for x, y in ((1, 0), (0, 1)):
        last = F.pmod("cx" if x else "cy", F.lit(tile))
        before = cells.where(last == tile - 1).select(*key, (F.col("cx") + x).alias("cx"), (F.col("cy") + y).alias("cy"), F.col("local").alias("a"))
        after = cells.where(last == 0).select(*key, "cx", "cy", F.col("local").alias("b"))
        links = before.join(after, [*key, "cx", "cy"]).select(*key, "a", "b")
        found = links if found is None else found.unionByName(links)
    return found.distinct()


def linked_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct labels of a graph's edges, and the least label of each one's component."""
    labels, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = of[: len(a)], of[len(a) :], np.arange(len(labels))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        while (least != (then := least[least])).any():
            least = then
        least = least[root]
        if (least == root).all():
            return labels, labels[root]
        root = least


def tiled_components(cells: DataFrame, tile: int) -> DataFrame:
    """The rows of :func:`components`, for frames of any size: components by tile of ``tile`` x ``tile`` cells, merged across borders.

    A tile's cells are labelled in one group, of ``tile`` squared cells at most. Labels that meet across a border form a graph
    of at most two edges for each cell at a border, which is solved by frame; the labels it changes are joined back.
    """
    key = frame_key(cells)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(local=component_labels(pdf.cx.to_numpy(), pdf.cy.to_numpy()))[[*key, "cx", "cy", "local"]]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, root = linked_labels(pdf.a.to_numpy(), pdf.b.to_numpy())
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, "local": labels, "merged": root})

    longs = lambda names: ", ".join(f"{c} bigint" for c in names)
    tiles = [F.floor(F.col(c) / tile).alias(t) for c, t in (("cx", "tx"), ("cy", "ty"))]
    local = cells.where("occupied").select(*[F.col(k).cast("bigint").alias(k) for k in key], "cx", "cy", *tiles)
    local = written(local.groupBy(*key, "tx", "ty").applyInPandas(label, longs([*key, "cx", "cy", "local"])), "tiles")
    merged = _border_links(local, tile).groupBy(*key).applyInPandas(merge, longs([*key, "local", "merged"]))
    return local.join(merged, [*key, "local"], "left").select(*key, "cx", "cy", F.coalesce("merged", "local").alias("label"))


def tiled_labels(celled: DataFrame, tile: int, occupied: int = OCCUPIED) -> DataFrame:
    """The rows of :func:`with_labels`, for frames of any size; points meet their cell's label by a join. ``celled`` is read twice."""
    key = [*frame_key(celled), "cx", "cy"]
    labels = tiled_components(bev_cells(celled, occupied), tile)
    rows = celled.select(*[F.col(c).cast("bigint").alias(c) for c in key[:-2]], *[F.col(c).cast("double").alias(c) for c in "xyz"], "cx", "cy")
    return rows.join(labels, key).select(*key[:-2], "x", "y", "z", "cx", "cy", "label")


def trimmed(labelled: DataFrame, ground_height: float) -> DataFrame:
    """Drops the low skirt of clusters near the ground: keeps z above the floor-rank 5th percentile."""
    by = Window.partitionBy(*frame_key(labelled), "label")
    stats = labelled.withColumns({"n": F.count(F.lit(1)).over(by), "z_lo": F.min("z").over(by), "z_hi": F.max("z").over(by), "at": F.row_number().over(by.orderBy("z")) - 1})
    k = F.floor(F.lit(0.05) * (F.col("n") - 1))
    stats = stats.withColumn("p5", F.max(F.when(F.col("at") == k, F.col("z"))).over(by))
    low = (F.col("z_lo") - ground_height < TRIM_GATE) & (F.col("z_hi") - F.col("z_lo") > TRIM_RANGE)
    return stats.where(~low | (F.col("z") > F.col("p5"))).withColumnRenamed("n", "n_before").drop("at", "p5", "z_lo", "z_hi")


def reject_reason(min_points: int = MIN_POINTS, max_points: int = MAX_POINTS, max_height: float = MAX_HEIGHT, max_width: float = MAX_WIDTH) -> Column:
    """``small``, ``large``, ``tall`` or ``wide``, the first that holds, else null."""
    return (
        F.when((F.col("n_before") < min_points) | (F.col("n_points") < min_points), "small").when(F.col("n_before") > max_points, "large")
        .when(F.col("z_range") > max_height, "tall").when(F.col("xy_spread") > max_width, "wide")
    )


def clusters(labelled: DataFrame, ground_height: float, min_points: int = MIN_POINTS, max_points: int = MAX_POINTS, with_points: bool = False) -> DataFrame:
    """One row per label, with its reject reason and on demand its points; sizes before the trim decide ``large``.

    Columns n_points, centroid, z range and widths along the axes of the horizontal scatter. Windows and
    the final grouping are by frame and label, so all of it shares one shuffle.
    """
    group = [*frame_key(labelled), "label"]
    by = Window.partitionBy(*group)
    points = trimmed(labelled, ground_height)
    points = points.withColumns({
        "n_points": F.count(F.lit(1)).over(by), "mx": F.avg("x").over(by), "my": F.avg("y").over(by), "mz": F.avg("z").over(by), "z_min": F.min("z").over(by), "z_max": F.max("z").over(by),
        "cxx": F.var_pop("x").over(by), "cxy": F.covar_pop("x", "y").over(by), "cyy": F.var_pop("y").over(by),
    })
    ax, ay = axis2(F.col("cxx"), F.col("cxy"), F.col("cyy"))
    points = points.withColumns({"ax": ax, "ay": ay})
    u, v = F.col("x") * F.col("ax") + F.col("y") * F.col("ay"), F.col("y") * F.col("ax") - F.col("x") * F.col("ay")
    same = [F.first(c).alias(c) for c in ("n_before", "n_points", "mx", "my", "mz", "z_min", "z_max")]
    pts = [F.sort_array(F.collect_list(F.struct("x", "y", "z"))).alias("pts")] if with_points else []
    found = points.groupBy(*group).agg(*same, (F.max(u) - F.min(u)).alias("x_range"), (F.max(v) - F.min(v)).alias("y_range"), *pts)
    found = found.withColumns({"z_range": F.col("z_max") - F.col("z_min"), "xy_spread": F.sqrt(F.col("x_range") * F.col("x_range") + F.col("y_range") * F.col("y_range")), "z_above_ground": F.col("z_max") - ground_height})
    return found.withColumn("reject_reason", reject_reason(min_points, max_points))


def cluster_points(labelled: DataFrame, ground_height: float, min_points: int = MIN_POINTS, max_points: int = MAX_POINTS) -> DataFrame:
    """The clusters that pass, with their points as an array of at most ``max_points``.

    ``labelled`` has ``n_label``, by which labels of too many points are left out before any points are shuffled.
    """
    small = labelled.where(F.col("n_label").between(min_points, max_points)).drop("n_label")
    return clusters(small, ground_height, min_points, max_points, with_points=True).where("reject_reason IS NULL")


def cluster_frame(points: DataFrame, ground_height: float, cell: float = CELL, min_points: int = MIN_POINTS, max_points: int = MAX_POINTS, single: bool = False) -> DataFrame:
    """Cells, components, labels and clusters of non-ground points, which are read several times and so are best written."""
    return cluster_points(with_labels(with_cells(points, cell, single), sizes=True), ground_height, min_points, max_points)


#: The corners that each of a box's 12 edges joins, as (x, y, z) picks of low (0) or high (1).
EDGES = [(a, b) for a in range(8) for b in (1, 2, 4) if not a & b]


def bbox_edges(boxes: DataFrame) -> DataFrame:
    """edge, x1..z2 for each of the 12 edges of boxes with x_min..z_max; other columns are kept."""
    def corner(bits: int) -> list[Column]:
        return [F.col(f"{axis}_{'max' if bits >> i & 1 else 'min'}") for i, axis in enumerate("xyz")]

    rows = [F.struct(F.lit(k).alias("edge"), *[c.alias(f"{n}1") for n, c in zip("xyz", corner(a), strict=True)], *[c.alias(f"{n}2") for n, c in zip("xyz", corner(a | b), strict=True)]) for k, (a, b) in enumerate(EDGES)]
    return boxes.withColumn("e", F.explode(F.array(*rows))).select(*[c for c in boxes.columns if c[2:] not in ("min", "max")], "e.*")
