"""Geometric features of point clouds.

A cloud is one row with its points as an array, bounded by the largest cluster, so features need no shuffle.
They are computed on Arrow batches: shapes by array operations over the points of many clouds at once
(:mod:`voxelry.functions.ragged`), neighbours, hulls and density components cloud by cloud.
Names and formulas differ by mode where noted; select columns by name, never by position.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.functions.geometry import finite
from voxelry.functions.ragged import Ragged, shape_features

# Feature names by mode, in the order that models expect.
COMPACT = (
    "num_points xy_spread xy_area z_range height_to_footprint density z_25 z_75 z_std xy_aspect_ratio scattering linearity planarity "
    "layer_frac_0 layer_frac_1 layer_frac_2 layer_frac_3 layer_frac_4 cross_section_var"
).split()
EXTENDED = [*COMPACT, "nn_dist_std", "cross_section_mean", "z_range_cleaned", "hull_point_ratio"]
FULL = (
    "num_points x_range y_range z_range xy_spread xy_area bbox_volume height_to_footprint density z_std z_median z_25 z_75 ev_norm_0 ev_norm_1 ev_norm_2 "
    "linearity planarity scattering vertical_uniformity cross_section_var cross_section_mean layer_frac_0 layer_frac_1 layer_frac_2 layer_frac_3 layer_frac_4 "
    "nn_dist_std xy_aspect_ratio bottom_to_top_ratio hull_point_ratio n_components largest_component_ratio ground_gap_ratio z_range_cleaned"
).split()
MODES = {19: COMPACT, 23: EXTENDED, 35: FULL}
LOCAL_NAMES = {"nn_dist_std", "hull_point_ratio", "n_components", "largest_component_ratio"}


def _leaves(xyz: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A k-d tree's leaves of ``most`` points at most: the points' order, and where each leaf starts, with the end at last.

    Boxes are halved by rank along their longest side, so repeated points are divided too.
    """
    order, starts, todo = np.arange(len(xyz)), [], [(0, len(xyz))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
            continue
        inside = xyz[order[a:b]]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(inside[:, np.argmax(np.ptp(inside, axis=0))], half)]
        todo += [(a, a + half), (a + half, b)]
    return order, np.array(sorted(starts) + [len(xyz)])


class _Tree:
    """Points in leaves, with the leaves' boxes. Distances between boxes bound those between their points."""

    def __init__(self, xyz: np.ndarray, most: int = 16) -> None:
        self.order, self.starts = _leaves(xyz, most)
        self.xyz = xyz[self.order]
        self.low, self.high = np.minimum.reduceat(self.xyz, self.starts[:-1]), np.maximum.reduceat(self.xyz, self.starts[:-1])

    def __len__(self) -> int:
        return len(self.low)

    def apart(self, leaf: int) -> np.ndarray:
        """The squared distance of each leaf's box from this leaf's."""
        gap = np.maximum(np.maximum(self.low - self.high[leaf], self.low[leaf] - self.high), 0.0)
        return (gap * gap).sum(1)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in leaves])

    def squares(self, leaf: int, rows: np.ndarray) -> np.ndarray:
        """Squared distances of this leaf's points from those in ``rows``."""
        own, other, out = self.xyz[self.starts[leaf] : self.starts[leaf + 1]], self.xyz[rows], 0.0
        for axis in range(3):
            step = own[:, None, axis] - other[None, :, axis]
            out = out + step * step
        return out


def neighbour_distances(xyz: np.ndarray, k: int) -> np.ndarray:
    """(n, k) distances to the nearest other points, in rising order; there are more than k points.

    Each leaf looks at a few leaves around it first; the farthest of the k found there bounds the leaves that can hold a
    nearer point, and only these are looked at again. A little slack covers rounding in the boxes' distances.
    """
    tree, out = _Tree(xyz), np.empty((len(xyz), k))
    few = -(-2 * (k + 1) // max(1, len(xyz) // len(tree))) + 4
    for leaf in range(len(tree)):
        apart = tree.apart(leaf)
        if len(tree) > few:
            rows = tree.rows(np.argpartition(apart, few)[:few])
            # A point's k nearest here, itself among them, are no nearer than its k nearest of all.
            bound = np.partition(tree.squares(leaf, rows), k, axis=1)[:, k].max()
            rows = tree.rows(np.flatnonzero(apart <= bound * (1 + 1e-9)))
        else:
            rows = np.arange(len(xyz))
        d = np.partition(tree.squares(leaf, rows), k, axis=1)[:, : k + 1]
        out[tree.order[tree.starts[leaf] : tree.starts[leaf + 1]]] = np.sqrt(np.sort(d, axis=1)[:, 1:])
    return out


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the sets of each pair together; the least member stands for a set."""
    while len(a):
        x, y = parent[a], parent[b]
        while ((then := parent[x]) != x).any():
            x = then
        while ((then := parent[y]) != y).any():
            y = then
        apart = x != y
        a, b = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(parent, b, a)


def density_components(xyz: np.ndarray, eps: float, least: int = 3) -> np.ndarray:
    """DBSCAN labels from 0, -1 for noise: core points within ``eps`` of each other share a label.

    Labels count by the first core point of each component; a point at the edge takes the least label around it.
    Repeated points are looked at once. Pairs are met leaf by leaf and never held all at once.
    """
    points, first, of, times = np.unique(xyz, axis=0, return_index=True, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    by_first = np.argsort(first, kind="stable")  # so that the least number of a set is that of its first point
    points, times = points[by_first], times[by_first]
    of = np.argsort(by_first)[of]
    tree, n = _Tree(points), np.zeros(len(points), np.int64)
    near = [np.flatnonzero(tree.apart(leaf) <= eps * eps * (1 + 1e-9)) for leaf in range(len(tree))]
    weight = times[tree.order]
    for leaf in range(len(tree)):
        rows = tree.rows(near[leaf])
        n[tree.order[tree.starts[leaf] : tree.starts[leaf + 1]]] = (tree.squares(leaf, rows) <= eps * eps) @ weight[rows]
    core = n >= least
    parent, edge = np.arange(len(points)), np.full(len(points), len(points))
    pairs = []
    for leaf in range(len(tree)):
        rows = tree.rows(near[leaf])
        i, j = np.nonzero(tree.squares(leaf, rows) <= eps * eps)
        a, b = tree.order[tree.starts[leaf] + i], tree.order[rows[j]]
        both = core[a] & core[b] & (a < b)
        _joined(parent, a[both], b[both])
        outer = ~core[a] & core[b]
        pairs.append((a[outer], b[outer]))  # fewer than ``least`` for each point
    root = parent
    while ((then := root[root]) != root).any():
        root = then
    for a, b in pairs:
        np.minimum.at(edge, a, root[b])
    label = np.where(core, root, edge)
    found = np.unique(label[label < len(points)])
    return np.where(label < len(points), np.searchsorted(found, label), -1)[of]


def hull_vertices(xyz: np.ndarray) -> int | None:
    """Number of vertices of the 3-D convex hull, by growing a simplex; None if the points are flat."""
    pts = xyz - xyz.mean(0)
    size = np.abs(pts).max() or 1.0
    eps = 1e-9 * size
    a = int(np.argmin(pts[:, 0]))
    b = int(np.argmax(((pts - pts[a]) ** 2).sum(1)))
    line = pts[b] - pts[a]
    if np.linalg.norm(line) <= eps:
        return None
    off = np.linalg.norm(np.cross(pts - pts[a], line), axis=1)
    c = int(np.argmax(off))
    if off[c] <= eps * np.linalg.norm(line):
        return None
    normal = np.cross(line, pts[c] - pts[a])
    height = np.abs((pts - pts[a]) @ normal)
    d = int(np.argmax(height))
    if height[d] <= eps * np.linalg.norm(normal):
        return None
    return _grown(pts, (a, b, c, d), eps)


def _grown(pts: np.ndarray, simplex: tuple[int, int, int, int], eps: float) -> int:
    """Vertices of the hull that the simplex grows to. Extreme points come first; points inside by then are skipped at once."""
    p = pts.tolist()
    ox, oy, oz = pts[list(simplex)].mean(0).tolist()

    def face(i: int, j: int, k: int) -> tuple:
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = p[i], p[j], p[k]
        ux, uy, uz, vx, vy, vz = bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az
        nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
        norm = (nx * nx + ny * ny + nz * nz) ** 0.5 or 1.0
        nx, ny, nz = nx / norm, ny / norm, nz / norm
        off = nx * ax + ny * ay + nz * az
        return (i, j, k, nx, ny, nz, off) if nx * ox + ny * oy + nz * oz <= off else (i, k, j, -nx, -ny, -nz, -off)

    faces = [face(*(v for v in simplex if v != w)) for w in simplex]

    def add(i: int) -> None:
        nonlocal faces
        x, y, z = p[i]
        seen = [f for f in faces if f[3] * x + f[4] * y + f[5] * z > f[6] + eps]
        if seen:
            edges = {e for f in seen for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
            hidden = set(map(id, seen))
            faces = [f for f in faces if id(f) not in hidden] + [face(u, v, i) for u, v in edges if (v, u) not in edges]

    directions = np.random.default_rng(0).normal(size=(32, 3))
    for i in dict.fromkeys(np.argmax(pts @ directions.T, axis=0).tolist()):
        add(i)
    plane = np.array([f[3:] for f in faces])
    outside = np.flatnonzero((pts @ plane[:, :3].T > plane[:, 3] + eps).any(1))
    for i in outside[np.argsort(-(pts[outside] ** 2).sum(1), kind="stable")].tolist():
        add(i)
    return len({v for f in faces for v in f[:3]})


def neighbour_spread(xyz: np.ndarray) -> float:
    """Spread of the mean distance to the five nearest neighbours; 0 for up to six points."""
    return float(neighbour_distances(xyz, 5).mean(1).std()) if len(xyz) > 6 else 0.0


#: Clouds of no more points are looked at together by :func:`neighbour_spreads`, so many distances at a time; larger ones need a tree.
SMALL, SQUARES = 128, 1 << 21


def neighbour_spreads(clouds: list[np.ndarray]) -> np.ndarray:
    """:func:`neighbour_spread` of each cloud. Small ones are stacked by rising size, with places without point infinitely far."""
    out, sizes = np.zeros(len(clouds)), np.array([len(c) for c in clouds], np.int64)
    for i in np.flatnonzero(sizes > SMALL):
        out[i] = neighbour_spread(clouds[i])
    left = np.flatnonzero((sizes > 6) & (sizes <= SMALL))
    left = left[np.argsort(sizes[left], kind="stable")]
    while len(left):
        # As many as fit at the size of the largest of them, one at least.
        fits = np.arange(1, len(left) + 1) * sizes[left] ** 2 <= SQUARES
        now, left = left[: (k := max(1, int(fits.sum())))], left[k:]
        n, most = sizes[now], int(sizes[now[-1]])
        there = np.arange(most) < n[:, None]
        stacked = np.zeros((len(now), most, 3))
        stacked[there] = np.concatenate([clouds[i] for i in now])
        squares = 0.0
        for axis in range(3):
            step = stacked[:, :, None, axis] - stacked[:, None, :, axis]
            squares = squares + step * step
        squares[np.broadcast_to(~there[:, None, :], squares.shape)] = np.inf
        means = np.sqrt(np.sort(np.partition(squares, 5, axis=2)[:, :, :6], axis=2)[:, :, 1:]).mean(2)
        mean = np.where(there, means, 0.0).sum(1) / n
        out[now] = np.sqrt(np.where(there, (means - mean[:, None]) ** 2, 0.0).sum(1) / n)
    return out


def hull_ratio(xyz: np.ndarray) -> float:
    """Share of the points that are vertices of the hull; 1 for up to ten points and flat clouds."""
    return (hull_vertices(xyz) or len(xyz)) / len(xyz) if len(xyz) > 10 else 1.0


def component_values(xyz: np.ndarray) -> tuple[float, float]:
    """Number of density components and the share of the largest; 1, 1 for up to ten points or without any."""
    if len(xyz) <= 10:
        return 1.0, 1.0
    label = density_components(xyz, 2.5 * float(np.median(neighbour_distances(xyz, 2)[:, 0])))
    sizes = np.bincount(label[label >= 0])
    return (float(len(sizes)), float(sizes.max() / len(xyz))) if len(sizes) else (1.0, 1.0)


# What each of these functions gives for a list of clouds, a column each.
LOCAL = {
    ("nn_dist_std",): lambda clouds: [neighbour_spreads(clouds)], ("hull_point_ratio",): lambda clouds: [[hull_ratio(c) for c in clouds]],
    ("n_components", "largest_component_ratio"): lambda clouds: list(zip(*map(component_values, clouds), strict=True)),
}
#: Points that are looked at together, but for larger clouds; bounds the arrays of a task.
TOGETHER = 1 << 18


def table(xyz: np.ndarray, sizes: np.ndarray, names: list[str], mode: int) -> dict[str, np.ndarray]:
    """The named features, a value a cloud. ``xyz`` (n, 3) holds the clouds' points one after another; empty clouds give 0."""
    out = {k: np.zeros(len(sizes)) for k in names}
    full = np.flatnonzero(sizes > 0)
    at = np.concatenate([[0], np.cumsum(sizes[full])])
    heavy = [(of, f) for of, f in LOCAL.items() if set(of) & set(names)]
    first = 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(at, at[first] + TOGETHER, side="right")) - 1)
        rows, points = full[first:last], xyz[at[first] : at[last]]
        with np.errstate(all="ignore"):
            found = shape_features(Ragged(points, at[first : last + 1] - at[first]), mode) if set(names) - LOCAL_NAMES else {}
        for k in names:
            if k in found:
                out[k][rows] = found[k]
        apart = np.split(points, at[first + 1 : last] - at[first]) if heavy else []
        for of, f in heavy:
            for k, v in zip(of, f(apart), strict=True):
                if k in out:
                    out[k][rows] = v
        first = last
    return out


def matrix(clouds: list[np.ndarray], mode: int) -> np.ndarray:
    """(clouds, features): the mode's features in the mode's order, 0 where a value is not finite; for use inside tasks."""
    xyz = np.concatenate(clouds) if clouds else np.zeros((0, 3))
    found = table(xyz, np.array([len(c) for c in clouds], np.int64), MODES[mode], mode)
    return np.nan_to_num(np.column_stack([found[k] for k in MODES[mode]]), nan=0.0, posinf=0.0, neginf=0.0)


def _with(clouds: DataFrame, names: list[str], mode: int) -> DataFrame:
    """``clouds`` plus the named features, from Arrow arrays: points go to NumPy as they are, never as Python objects."""
    @F.arrow_udf(", ".join(f"{k} double" for k in names))
    def found(pts: pa.Array) -> pa.Array:
        points = pts.flatten()
        xyz = np.column_stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False).astype(float) for k in "xyz"])
        sizes = pc.fill_null(pc.list_value_length(pts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = table(xyz, sizes, names, mode)
        return pa.StructArray.from_arrays([pa.array(values[k]) for k in names], names=names)

    return clouds.withColumn("__found", found("pts")).select(*[c for c in clouds.columns if c not in names], *[F.col("__found")[k].alias(k) for k in names])


def native_features(clouds: DataFrame, mode: int = 19) -> DataFrame:
    """``clouds`` (with pts) plus every feature that needs no neighbours, hull or components, those of mode 35 in all modes.

    Modes 19 and 23 set height_to_footprint by xy_spread, mode 35 by the root of xy_area. Null and empty clouds give 0,
    columns of ``clouds`` that are named like a feature are replaced.
    """
    if mode not in MODES:
        raise ValueError(f"the mode is 19, 23 or 35, not {mode}")
    return _with(clouds, [k for k in FULL if k not in LOCAL_NAMES], mode)


def local_features(clouds: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``clouds`` plus the named features (by default all) of nn_dist_std, hull_point_ratio, n_components and
    largest_component_ratio; only the named ones are computed, and those that come with them."""
    wanted = [k for of in LOCAL if names is None or set(of) & set(names) for k in of]
    return _with(clouds, wanted, 23) if wanted else clouds


def features(clouds: DataFrame, mode: int = 23) -> DataFrame:
    """``clouds`` plus the features of the mode, NaN and infinite values as 0; null and empty clouds give 0."""
    if mode not in MODES:
        raise ValueError(f"the mode is 19, 23 or 35, not {mode}")
    made = _with(clouds, MODES[mode], mode)
    return made.select(*[c for c in clouds.columns if c not in MODES[mode]], *[finite(F.col(c)).alias(c) for c in MODES[mode]])


def ablation_variants(clouds: DataFrame) -> DataFrame:
    """density by box volume, height_to_footprint by xy_spread, and density by axis-aligned volume."""
    a = native_features(clouds, 35)
    side = lambda k: F.array_max(F.transform("pts", lambda p: p[k])) - F.array_min(F.transform("pts", lambda p: p[k]))
    volume = reduce(lambda x, y: x * y, [side(k) for k in "xyz"])
    return a.select(
        *[c for c in clouds.columns if c != "pts"], (F.col("num_points") / F.col("bbox_volume")).alias("density"),
        (F.col("z_range") / F.greatest("xy_spread", F.lit(1e-6))).alias("height_to_footprint"), (F.col("num_points") / F.greatest(volume, F.lit(1e-6))).alias("density_aligned"),
    )
