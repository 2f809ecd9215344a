"""Shape features of many clouds at once, as ragged arrays.

The points of all clouds stand one after another; every step is one array operation over all of them, so a
cloud costs no Python call. Clouds are not empty here; callers leave empty ones out.
"""

from __future__ import annotations

import numpy as np

TINY, SLICES = 1e-9, 5


class Ragged:
    """``xyz`` (n, 3) of all clouds, and where each cloud starts, with the end at last."""

    def __init__(self, xyz: np.ndarray, starts: np.ndarray) -> None:
        self.xyz, self.starts = xyz, starts
        self.n = np.diff(starts)
        self.of = np.repeat(np.arange(len(self.n)), self.n)

    def __len__(self) -> int:
        return len(self.n)

    def sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts[:-1])

    def ends(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value of each cloud."""
        return np.minimum.reduceat(v, self.starts[:-1]), np.maximum.reduceat(v, self.starts[:-1])

    def extent(self, v: np.ndarray) -> np.ndarray:
        low, high = self.ends(v)
        return high - low

    def scatter(self) -> dict[str, np.ndarray]:
        """Sums of products of coordinates about each cloud's mean."""
        d = self.xyz - (self.sum(self.xyz) / self.n[:, None])[self.of]
        return {a + b: self.sum(d[:, i] * d[:, j]) for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j}

    def shares(self, part: np.ndarray) -> np.ndarray:
        """(clouds, SLICES): the share of each cloud's points in each part; those beyond the last part count for none."""
        counts = np.bincount(self.of * (SLICES + 1) + part, minlength=len(self) * (SLICES + 1))
        return counts.reshape(-1, SLICES + 1)[:, :SLICES] / self.n[:, None]

    def widths(self, part: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(clouds, SLICES): the diagonal of each part's extents, 0 where it has fewer than three points."""
        key = self.of * (SLICES + 1) + part
        order = np.argsort(key, kind="stable")
        found, first, count = np.unique(key[order], return_index=True, return_counts=True)
        side = [np.maximum.reduceat(w[order], first) - np.minimum.reduceat(w[order], first) for w in (u, v)]
        out = np.zeros(len(self) * (SLICES + 1))
        out[found] = np.where(count > 2, np.sqrt(side[0] * side[0] + side[1] * side[1]), 0.0)
        return out.reshape(-1, SLICES + 1)[:, :SLICES]


def _reached(z: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """How many of the upper edges each point reaches."""
    return sum((z >= e).astype(np.int64) for e in edges)


def _long_axis(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of [[a, b], [b, c]], larger first, and the unit axis of the larger one; the longer coordinate axis if b is 0."""
    mid, off = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b * b)
    flat = np.abs(b) < 1e-12
    x, y = np.where(flat, np.where(a >= c, 1.0, 0.0), b), np.where(flat, np.where(a >= c, 0.0, 1.0), mid + off - a)
    size = np.sqrt(x * x + y * y)
    return mid + off, mid - off, x / size, y / size


def shape_features(r: Ragged, mode: int) -> dict[str, np.ndarray]:
    """Every feature that needs no neighbours, hull or components, one value a cloud.

    Modes 19 and 23 set height_to_footprint by xy_spread, mode 35 by the root of xy_area. Points that are not numbers
    give values that are not; callers put 0 for them.
    """
    x, y, z = r.xyz.T
    n, s = r.n, r.scatter()
    low, high = r.ends(z)
    zr = high - low
    big, small, ax, ay = _long_axis(s["xx"] / n, s["xy"] / n, s["yy"] / n)
    plain = n <= 3
    ax, ay = np.where(plain, 1.0, ax)[r.of], np.where(plain, 0.0, ay)[r.of]
    u, v = x * ax + y * ay, y * ax - x * ay
    xs, ys = r.extent(u), r.extent(v)
    spread, area = np.sqrt(xs * xs + ys * ys), np.maximum(xs * ys, TINY)
    sample = np.nan_to_num(np.stack([s[k] for k in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")], axis=1) / np.maximum(n - 1, 1)[:, None], nan=0.0, posinf=0.0, neginf=0.0)
    e = np.maximum(np.linalg.eigvalsh(sample.reshape(-1, 3, 3)), TINY)
    total = e.sum(1)
    lo, tall = low[r.of], zr[r.of]
    level = (z - lo) / np.where(tall > 0.01, tall, 1.0)
    layers = np.where((zr > 0.01)[:, None], r.shares(_reached(level, [i / SLICES for i in range(1, SLICES + 1)])), 1 / SLICES)
    widths = r.widths(_reached(z, [lo + i * tall / SLICES for i in range(1, SLICES + 1)]), u, v)
    wide = (zr > 0.1) & (n > 20)
    zs, first = z[np.lexsort((z, r.of))], r.starts[:-1]
    rank = lambda q: zs[first + np.floor(q * (n - 1)).astype(np.int64)]
    foot = np.sqrt(area) if mode == 35 else spread
    return {
        "num_points": n.astype(float), "x_range": xs, "y_range": ys, "z_range": zr, "xy_spread": spread, "xy_area": area, "bbox_volume": np.maximum(area * zr, TINY),
        "height_to_footprint": zr / np.maximum(foot, 1e-6), "density": n / np.maximum(area * np.sqrt(zr + 1e-6), 1e-6), "z_std": np.sqrt(s["zz"] / n),
        "z_median": (zs[first + (n - 1) // 2] + zs[first + n // 2]) / 2, "z_25": rank(0.25), "z_75": rank(0.75),
        **{f"ev_norm_{i}": e[:, i] / total for i in range(3)}, "linearity": (e[:, 2] - e[:, 1]) / e[:, 2], "planarity": (e[:, 1] - e[:, 0]) / e[:, 2], "scattering": e[:, 0] / e[:, 2],
        "vertical_uniformity": layers.std(1), "cross_section_var": np.where(wide, widths.std(1), 0.0), "cross_section_mean": np.where(wide, widths.mean(1), 0.0),
        **{f"layer_frac_{i}": layers[:, i] for i in range(SLICES)}, "xy_aspect_ratio": np.where(plain, 1.0, np.maximum(big, TINY) / np.maximum(small, TINY)),
        "bottom_to_top_ratio": layers[:, 0] / np.maximum(layers[:, -1], 1e-6), "ground_gap_ratio": np.where(zr > 0.1, (rank(0.10) - rank(0.05)) / np.where(zr > 0.1, zr, 1.0), 0.0),
        "z_range_cleaned": np.where(n > 10, rank(0.95) - rank(0.05), zr),
    }
