"""Queries over clouds: features, data-set statistics, fullness, cuts and folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions import features as feats
from voxelry.operators import augmentation, evaluation, splitting, statistics
from voxelry.plans.registry import query
from voxelry.sources.adapters import CLOUDS_SQL, clouds


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


_EIGEN = f"""{CLOUDS_SQL}, m AS (
  SELECT sample_id, label, count(*)::DOUBLE AS n, min(z) AS z_lo, max(z) - min(z) AS z_range, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c, stddev_pop(z) AS z_std, median(z) AS z_median,
         covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz, list_sort(list(z)) AS zs
  FROM cloud GROUP BY sample_id, label
), e AS (
  SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2, (xx + yy + zz) / 3 AS q FROM m
), f AS (
  SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e
), g AS (
  SELECT *, acos(least(greatest(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p), -1), 1)) / 3 AS phi FROM f
), h AS (
  SELECT *, greatest(q + 2 * p * cos(phi), 1e-9) AS e2, greatest(q + 2 * p * cos(phi + 2 * pi() / 3), 1e-9) AS e0, greatest(3 * q - 2 * q - 2 * p * cos(phi) - 2 * p * cos(phi + 2 * pi() / 3), 1e-9) AS e1 FROM g
), uv AS (
  SELECT cl.sample_id, cl.z, (cl.x * b + cl.y * (l1 - a)) / sqrt(b * b + (l1 - a) ** 2) AS u, (cl.y * b - cl.x * (l1 - a)) / sqrt(b * b + (l1 - a) ** 2) AS v FROM cloud cl JOIN e USING (sample_id)
), w AS (
  SELECT sample_id, max(u) - min(u) AS x_range, max(v) - min(v) AS y_range FROM uv GROUP BY sample_id
), layer AS (
  SELECT sample_id, i, count(*) FILTER (s >= i / 5.0::DOUBLE AND s < (i + 1) / 5.0::DOUBLE) / any_value(n) AS frac
  FROM (SELECT cl.sample_id, m.n, (cl.z - m.z_lo) / m.z_range AS s FROM cloud cl JOIN m USING (sample_id)), range(5) r(i) GROUP BY sample_id, i
), sw AS (
  SELECT sample_id, i, CASE WHEN count(*) > 2 THEN sqrt((max(u) - min(u)) ** 2 + (max(v) - min(v)) ** 2) ELSE 0 END AS width
  FROM uv JOIN m USING (sample_id), range(5) r(i) WHERE uv.z >= m.z_lo + i * m.z_range / 5 AND uv.z < m.z_lo + (i + 1) * m.z_range / 5 GROUP BY sample_id, i
), cs AS (
  SELECT sample_id, stddev_pop(coalesce(width, 0)) AS cross_section_var, avg(coalesce(width, 0)) AS cross_section_mean
  FROM (SELECT sample_id, i FROM m, range(5) r(i)) LEFT JOIN sw USING (sample_id, i) GROUP BY sample_id
), lf AS (
  SELECT sample_id, max(frac) FILTER (i = 0) AS f0, max(frac) FILTER (i = 1) AS f1, max(frac) FILTER (i = 2) AS f2, max(frac) FILTER (i = 3) AS f3, max(frac) FILTER (i = 4) AS f4, stddev_pop(frac) AS vertical_uniformity
  FROM layer GROUP BY sample_id
), feat AS (
  SELECT h.*, x_range, y_range, sqrt(x_range * x_range + y_range * y_range) AS xy_spread, greatest(x_range * y_range, 1e-9) AS xy_area, f0, f1, f2, f3, f4, vertical_uniformity, cross_section_var, cross_section_mean
  FROM h JOIN w USING (sample_id) JOIN lf USING (sample_id) JOIN cs USING (sample_id)
)"""
_RANK = "zs[1 + floor({q}::DOUBLE * (n - 1))::BIGINT]"
_TERMS = {
    "num_points": "n", "xy_spread": "xy_spread", "x_range": "x_range", "y_range": "y_range", "xy_area": "xy_area", "z_range": "z_range", "bbox_volume": "greatest(xy_area * z_range, 1e-9)",
    "density": "n / greatest(xy_area * sqrt(z_range + 1e-6), 1e-6)", "z_25": _RANK.format(q=0.25), "z_75": _RANK.format(q=0.75), "z_std": "z_std", "z_median": "z_median",
    "xy_aspect_ratio": "greatest(l1, 1e-9) / greatest(l2, 1e-9)", "scattering": "e0 / e2", "linearity": "(e2 - e1) / e2", "planarity": "(e1 - e0) / e2",
    "ev_norm_0": "e0 / (e0 + e1 + e2)", "ev_norm_1": "e1 / (e0 + e1 + e2)", "ev_norm_2": "e2 / (e0 + e1 + e2)", **{f"layer_frac_{i}": f"f{i}" for i in range(5)},
    "vertical_uniformity": "vertical_uniformity", "cross_section_var": "cross_section_var", "cross_section_mean": "cross_section_mean", "bottom_to_top_ratio": "f0 / greatest(f4, 1e-6)",
    "ground_gap_ratio": f"CASE WHEN z_range > 0.1 THEN ({_RANK.format(q=0.10)} - {_RANK.format(q=0.05)}) / z_range ELSE 0 END", "z_range_cleaned": f"{_RANK.format(q=0.95)} - {_RANK.format(q=0.05)}",
}


def _feature_sql(names: list[str], foot: str, digits: int = 5) -> str:
    terms = _TERMS | {"height_to_footprint": f"z_range / greatest({foot}, 1e-6)"}
    return f"WITH {_EIGEN} SELECT sample_id, label, {', '.join(f'round({terms[k]}, {digits}) AS {k}' for k in names)} FROM feat"


def _rounded(made: DataFrame, names: list[str], digits: int = 5) -> DataFrame:
    return made.select("sample_id", "label", *[_r(k, digits).alias(k) for k in names])


@query(_feature_sql(feats.COMPACT, "xy_spread"))
def feat_compact_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 19 compact features."""
    return _rounded(feats.features(clouds(spark, sf_dir), 19), feats.COMPACT)


_FULL_NATIVE = [k for k in feats.FULL if k not in feats.LOCAL_NAMES]


@query(_feature_sql(_FULL_NATIVE, "sqrt(xy_area)"))
def feat_full_35_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of mode 35 that need no neighbours, hull or components."""
    return _rounded(feats.native_features(clouds(spark, sf_dir), 35), _FULL_NATIVE)


@query(_feature_sql(["z_range_cleaned", "cross_section_mean"], "xy_spread"))
def feat_zclean_xsection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust height and the mean cross-section of mode 23."""
    return _rounded(feats.native_features(clouds(spark, sf_dir), 23), ["z_range_cleaned", "cross_section_mean"])


_NEAREST = """apart AS (
  SELECT a.sample_id, a.j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.sample_id, a.j ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS k
  FROM cloud a JOIN cloud b ON a.sample_id = b.sample_id AND a.j <> b.j
), nearest AS (
  SELECT sample_id, stddev_pop(m) AS nn_dist_std FROM (SELECT sample_id, j, avg(d) AS m FROM apart WHERE k <= 5 GROUP BY ALL) GROUP BY sample_id
)"""


@query(f"WITH {CLOUDS_SQL}, {_NEAREST} SELECT sample_id, round(nn_dist_std, 6) AS nn_dist_std FROM nearest")
def feat_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the mean distance to the five nearest neighbours."""
    return feats.local_features(clouds(spark, sf_dir), ["nn_dist_std"]).select("sample_id", _r("nn_dist_std").alias("nn_dist_std"))


@query(f"""WITH {_EIGEN}, box AS (SELECT sample_id, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS v FROM cloud GROUP BY sample_id)
SELECT sample_id, label, round(n / greatest(xy_area * z_range, 1e-9), 4) AS density, round(z_range / greatest(xy_spread, 1e-6), 5) AS height_to_footprint, round(n / greatest(v, 1e-6), 4) AS density_aligned
FROM feat JOIN box USING (sample_id)""")
def feat_ablation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of density and height_to_footprint."""
    a = feats.ablation_variants(clouds(spark, sf_dir))
    return a.select("sample_id", "label", _r("density", 4).alias("density"), _r("height_to_footprint", 5).alias("height_to_footprint"), _r("density_aligned", 4).alias("density_aligned"))


#: Points of a cloud that are corners of a triangle with all others on one side of it.
_HULL = """tri AS (
  SELECT a.sample_id, a.j AS a, b.j AS b, c.j AS c, a.x, a.y, a.z, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny,
         (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
  FROM cloud a JOIN cloud b ON a.sample_id = b.sample_id AND b.j > a.j JOIN cloud c ON a.sample_id = c.sample_id AND c.j > b.j
), face AS (
  SELECT t.sample_id, t.a, t.b, t.c FROM tri t JOIN cloud d ON d.sample_id = t.sample_id AND d.j NOT IN (t.a, t.b, t.c)
  GROUP BY ALL HAVING min((d.x - t.x) * nx + (d.y - t.y) * ny + (d.z - t.z) * nz) >= 0 OR max((d.x - t.x) * nx + (d.y - t.y) * ny + (d.z - t.z) * nz) <= 0
), corner AS (
  SELECT sample_id, count(DISTINCT j) AS corners FROM (SELECT sample_id, unnest([a, b, c]) AS j FROM face) GROUP BY sample_id
), hull AS (
  SELECT sample_id, coalesce(any_value(corners), 0) / count(*) AS hull_point_ratio FROM cloud LEFT JOIN corner USING (sample_id) GROUP BY sample_id
)"""


@query(f"WITH {CLOUDS_SQL}, {_HULL} SELECT sample_id, round(hull_point_ratio, 6) AS hull_point_ratio FROM hull")
def feat_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the points that are vertices of the convex hull."""
    return feats.local_features(clouds(spark, sf_dir), ["hull_point_ratio"]).select("sample_id", _r("hull_point_ratio").alias("hull_point_ratio"))


@query(f"""WITH RECURSIVE {CLOUDS_SQL}, d AS (
  SELECT a.sample_id, a.j AS a, b.j AS b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM cloud a JOIN cloud b USING (sample_id)
), nn AS (
  SELECT sample_id, a, min(sqrt(d2)) FILTER (a <> b) AS m FROM d GROUP BY ALL
), e AS (
  SELECT sample_id, 2.5 * median(m) AS eps FROM nn GROUP BY sample_id
), near AS (
  SELECT sample_id, a, b FROM d JOIN e USING (sample_id) WHERE d2 <= eps * eps
), core AS (
  SELECT sample_id, a FROM near GROUP BY ALL HAVING count(*) >= 3
), link AS (
  SELECT n.* FROM near n JOIN core c ON c.sample_id = n.sample_id AND c.a = n.a JOIN core k ON k.sample_id = n.sample_id AND k.a = n.b
), reach(sample_id, a, b) AS (
  SELECT * FROM link UNION SELECT r.sample_id, r.a, l.b FROM reach r JOIN link l ON l.sample_id = r.sample_id AND l.a = r.b
), root AS (
  SELECT sample_id, a, min(b) AS root FROM reach GROUP BY ALL
), member AS (
  SELECT sample_id, a, root FROM root
  UNION ALL SELECT n.sample_id, n.a, min(r.root) FROM near n JOIN root r ON r.sample_id = n.sample_id AND r.a = n.b WHERE (n.sample_id, n.a) NOT IN (SELECT sample_id, a FROM core) GROUP BY ALL
), size AS (
  SELECT sample_id, root, count(*) AS n FROM member GROUP BY ALL
), s AS (
  SELECT sample_id, count(*) AS n, max(n) AS most FROM size GROUP BY ALL
) SELECT sample_id, coalesce(n, 1)::DOUBLE AS n_components, round(coalesce(most / 21, 1), 6)::DOUBLE AS largest_component_ratio FROM e LEFT JOIN s USING (sample_id)""")
def feat_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density components and the share of the largest."""
    return feats.local_features(clouds(spark, sf_dir), ["n_components"]).select("sample_id", "n_components", _r("largest_component_ratio").alias("largest_component_ratio"))


_ALL_23 = _TERMS | {"height_to_footprint": "z_range / greatest(xy_spread, 1e-6)", "nn_dist_std": "nn_dist_std", "hull_point_ratio": "hull_point_ratio"}


@query(f"""WITH {_EIGEN}, {_NEAREST}, {_HULL} SELECT sample_id, label, {', '.join(f'round({_ALL_23[k]}, 5) AS {k}' for k in feats.EXTENDED)}
FROM feat JOIN nearest USING (sample_id) JOIN hull USING (sample_id)""")
def feat_extended_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of mode 23."""
    return _rounded(feats.features(clouds(spark, sf_dir), 23), feats.EXTENDED)


_NAMES = "VALUES (0, 'background'), (1, 'bicyclist'), (2, 'car'), (3, 'pedestrian')"


@query(f"WITH {CLOUDS_SQL}, c(label, class_name) AS ({_NAMES}), s AS (SELECT DISTINCT sample_id, label FROM cloud) SELECT class_name, count(sample_id) AS n, round(count(sample_id) / (SELECT count(*) FROM s), 6) AS share FROM c LEFT JOIN s USING (label) GROUP BY class_name")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by class, classes without any included."""
    return statistics.class_counts(clouds(spark, sf_dir)).select("class_name", "n", _r("share").alias("share"))


_SHAPE = f"""{CLOUDS_SQL}, shape AS (
  SELECT sample_id, label, count(*)::DOUBLE AS n_points, max(z) - min(z) AS z_range, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS xy_spread,
         count(*) / greatest((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 1e-6) AS density FROM cloud GROUP BY sample_id, label
), tall AS (UNPIVOT shape ON n_points, z_range, xy_spread, density INTO NAME metric VALUE v)"""


@query(f"""WITH {_SHAPE} SELECT label, metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.9), 4) AS p90
FROM tall GROUP BY label, metric""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, height, width and density by class."""
    found = statistics.class_metrics(clouds(spark, sf_dir))
    return found.select("label", "metric", *[_r(k, 4).alias(k) for k in ("mean", "std", "median", "p10", "p90")])


@query(f"""WITH {_SHAPE}, r AS (SELECT label, metric, min(v) AS lo, max(v) AS hi FROM tall GROUP BY ALL),
p AS (SELECT a.metric, a.label AS a, b.label AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM r a JOIN r b USING (metric) WHERE (a.label, b.label) IN ((3, 1), (2, 0)))
SELECT p.metric, a AS label_a, b AS label_b, round(CASE WHEN hi > lo THEN avg((t.v >= lo AND t.v <= hi)::INT) FILTER (t.label = a) END, 6) AS share_a,
       round(CASE WHEN hi > lo THEN avg((t.v >= lo AND t.v <= hi)::INT) FILTER (t.label = b) END, 6) AS share_b
FROM p JOIN tall t ON t.metric = p.metric AND t.label IN (a, b) GROUP BY p.metric, a, b, lo, hi""")
def class_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of two classes' objects that lie in the range that both have."""
    found = statistics.class_overlap(clouds(spark, sf_dir))
    return found.select("metric", "label_a", "label_b", _r("share_a").alias("share_a"), _r("share_b").alias("share_b"))


@query(f"""WITH {CLOUDS_SQL}, o AS (SELECT sample_id, min(z) AS z0, max(z) - min(z) AS zr FROM cloud GROUP BY sample_id), bin AS (
  SELECT sample_id, least(floor((z - z0) / zr * 29), 28)::BIGINT AS bin FROM cloud JOIN o USING (sample_id)
), c AS (SELECT s.sample_id, i, count(bin.bin) AS n FROM (SELECT sample_id, i FROM o, range(29) r(i)) s LEFT JOIN bin ON bin.sample_id = s.sample_id AND bin.bin = s.i GROUP BY ALL
), d AS (SELECT *, n < greatest(avg(n) OVER (PARTITION BY sample_id) * 0.2, 1) AS sparse FROM c
), e AS (SELECT *, coalesce(lag(sparse) OVER (PARTITION BY sample_id ORDER BY i), false) AS before FROM d)
SELECT sample_id, max(n) AS n_max, count(*) FILTER (sparse) AS n_sparse, count(*) FILTER (before AND NOT sparse) AS n_gaps FROM e GROUP BY sample_id""")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse bins of each cloud's height histogram, and the gaps among them that a full bin ends."""
    return statistics.height_gaps(clouds(spark, sf_dir))


@query(f"""WITH {CLOUDS_SQL}, o AS (SELECT sample_id, label, min(z) AS z_lo, max(z) - min(z) AS zr, count(*) AS n, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS xy FROM cloud GROUP BY ALL),
b AS (SELECT o.sample_id, i, count(*) FILTER ((z - z_lo) / zr >= i / 4.0::DOUBLE AND (z - z_lo) / zr < (i + 1) / 4.0::DOUBLE) > 0.05 * any_value(n) AS full FROM cloud JOIN o USING (sample_id), range(4) r(i) WHERE zr > 0.1 GROUP BY ALL),
s AS (SELECT o.*, coalesce(q.bins, 0) AS bins FROM o LEFT JOIN (SELECT sample_id, sum("full"::INT)::INT AS bins FROM b GROUP BY ALL) q USING (sample_id))
SELECT sample_id, label, bins AS occupied_bins, CASE label WHEN 2 THEN n >= 15 AND zr >= 0.08 AND xy >= 0.25 AND bins >= 3 WHEN 3 THEN n >= 9 AND zr >= 0.1 AND xy < 0.2 * 10 AND bins >= 3
WHEN 1 THEN n >= 7 AND zr >= 0.1 AND bins >= 3 ELSE false END AS is_full FROM s""")
def full_object_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are complete enough to be cut; limits are a tenth of the production ones, as these clouds are small."""
    return augmentation.fullness(clouds(spark, sf_dir), SMALL).select("sample_id", "label", "occupied_bins", "is_full")


#: Least points, height, least and largest width by class, scaled to the small clouds of the adapter.
SMALL = {2: (15, 0.08, 0.25, None), 3: (9, 0.1, None, 2.0), 1: (7, 0.1, None, None)}
_CUT = f"""{CLOUDS_SQL}, cut(label, cut, axis, lo, hi) AS (VALUES
  (2, 0, 'long', 0.0, 0.5), (2, 1, 'long', 0.5, 1.0), (2, 2, 'short', 0.0, 0.5), (2, 3, 'short', 0.5, 1.0), (2, 4, 'long', 0.0, 0.33), (2, 5, 'long', 0.67, 1.0),
  (2, 6, 'long', 0.0, 0.67), (2, 7, 'long', 0.33, 1.0), (2, 8, 'short', 0.0, 0.33), (2, 9, 'short', 0.67, 1.0), (2, 10, 'short', 0.0, 0.67), (2, 11, 'short', 0.33, 1.0),
  (3, 0, 'z', 0.33, 1.0), (3, 1, 'z', 0.0, 0.67), (1, 0, 'long', 0.0, 0.67), (1, 1, 'long', 0.33, 1.0), (1, 2, 'z', 0.3, 1.0), (1, 3, 'z', 0.0, 0.7)
), wide AS (
  SELECT *, max(x) OVER w - min(x) OVER w >= max(y) OVER w - min(y) OVER w AS x_long FROM cloud WINDOW w AS (PARTITION BY sample_id)
), v AS (
  SELECT sample_id, label, cut, lo::DOUBLE AS lo, hi::DOUBLE AS hi, CASE WHEN axis = 'z' THEN z WHEN (axis = 'long') = x_long THEN x ELSE y END AS v FROM wide JOIN cut USING (label)
), part AS (
  SELECT *, min(v) OVER w AS v0, max(v) OVER w - min(v) OVER w AS r FROM v WINDOW w AS (PARTITION BY sample_id, cut)
), c AS (
  SELECT sample_id, label, cut, count(*) AS n FROM part WHERE r >= 0.1 AND v >= v0 + lo * r AND v < v0 + hi * r GROUP BY sample_id, label, cut HAVING count(*) >= 5
)"""


#: Along the eigenvector of the least eigenvalue: the longest of the cross products of two rows of the matrix less that value.
_HEIGHT_CUT = f"""ev AS (
  SELECT h.sample_id, h.label, xx - e0 AS p, yy - e0 AS q, zz - e0 AS r, xy, xz, yz FROM h
), cross3 AS (
  SELECT sample_id, label, unnest([
    {{'x': xy * yz - xz * q, 'y': xz * xy - p * yz, 'z': p * q - xy * xy}}, {{'x': xy * r - xz * yz, 'y': xz * xz - p * r, 'z': p * yz - xy * xz}}, {{'x': q * r - yz * yz, 'y': yz * xz - xy * r, 'z': xy * yz - q * xz}}]) AS v FROM ev
), ax AS (
  SELECT sample_id, label, arg_max(v, v.x * v.x + v.y * v.y + v.z * v.z) AS v FROM cross3 GROUP BY ALL
), al AS (
  SELECT cl.sample_id, cl.label, CASE WHEN v.z >= 0 THEN 1 ELSE -1 END * ((x - avg(x) OVER w) * v.x + (y - avg(y) OVER w) * v.y + (z - avg(z) OVER w) * v.z) / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS v
  FROM cloud cl JOIN ax USING (sample_id) WINDOW w AS (PARTITION BY cl.sample_id)
), he AS (
  SELECT *, min(v) OVER w AS v0, max(v) OVER w AS v1, max(v) OVER w - min(v) OVER w AS r FROM al WINDOW w AS (PARTITION BY sample_id)
), hc AS (
  SELECT sample_id, label, cut, count(*) AS n FROM he, (VALUES (2, 12, 0.67::DOUBLE, 1::DOUBLE), (2, 13, 0::DOUBLE, 0.67::DOUBLE), (2, 14, 0.5::DOUBLE, 1::DOUBLE), (2, 15, 0::DOUBLE, 0.5::DOUBLE)) k(class, cut, lo, hi)
  WHERE label = class AND r >= 0.1 AND v >= v0 + lo * r AND v < CASE WHEN hi < 1 THEN v0 + hi * r ELSE v1 END GROUP BY sample_id, label, cut HAVING count(*) >= 5
)"""


@query(f"WITH {_CUT} SELECT sample_id, label, cut, n FROM c")
def axis_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each axis-aligned cut of each object."""
    return augmentation.axis_cuts(clouds(spark, sf_dir), min_points=5).select("sample_id", "label", "cut", F.size("pts").cast("bigint").alias("n"))


@query(f"""WITH {_CUT}, k AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id || ':' || cut), sample_id, cut) AS nth FROM c
), size AS (
  SELECT label, count(DISTINCT sample_id) AS most FROM cloud GROUP BY label
) SELECT sample_id, label, cut, n FROM k JOIN size USING (label) WHERE nth <= most""")
def augment_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts kept so that no class gains more objects than it had; the original is the group."""
    kept = augmentation.capped(augmentation.axis_cuts(clouds(spark, sf_dir), min_points=5), clouds(spark, sf_dir))
    return kept.select(F.col("group_id").alias("sample_id"), "label", "cut", F.size("pts").cast("bigint").alias("n"))


@query(f"""WITH {_EIGEN}, {_CUT.removeprefix(CLOUDS_SQL).lstrip(', ')}, {_HEIGHT_CUT}, every AS (
  SELECT * FROM c UNION ALL SELECT * FROM hc
), k AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id || ':' || cut), sample_id, cut) AS nth FROM every
), size AS (
  SELECT label, count(DISTINCT sample_id) AS most FROM cloud GROUP BY label
) SELECT sample_id, label, cut, n FROM k JOIN size USING (label) WHERE nth <= most""")
def augment_capped_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every cut that :func:`augmentation.augment` makes, those by height too."""
    kept = augmentation.capped(augmentation.all_cuts(clouds(spark, sf_dir), min_points=5), clouds(spark, sf_dir))
    return kept.select(F.col("group_id").alias("sample_id"), "label", "cut", F.size("pts").cast("bigint").alias("n"))


@query(f"WITH {_EIGEN}, {_HEIGHT_CUT} SELECT sample_id, label, cut, n FROM hc")
def pca_height_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts along the axis of least scatter."""
    return augmentation.height_cuts(clouds(spark, sf_dir), min_points=5).select("sample_id", "label", "cut", F.size("pts").cast("bigint").alias("n"))


#: Groups of one to seven samples.
_GROUP_SQL = "sample_id - sample_id % 64 + (sample_id % 64) // (1 + sample_id // 64 % 7)"


@query(f"""WITH RECURSIVE {CLOUDS_SQL}, s AS (
  SELECT DISTINCT sample_id, label, {_GROUP_SQL} AS group_id FROM cloud
), total AS (
  SELECT {', '.join(f'count(*) FILTER (label = {c})::DOUBLE AS t{c}' for c in range(4))} FROM s
), c AS (
  SELECT group_id, label, count(*) AS n FROM s GROUP BY ALL
), g AS (
  SELECT group_id, string_agg(label || ':' || n, ',' ORDER BY label) AS kind, {', '.join(f'coalesce(sum(n) FILTER (label = {c}), 0)::BIGINT AS h{c}' for c in range(4))}, sum(n)::BIGINT AS size FROM c GROUP BY group_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || group_id), group_id) - 1 AS nth, count(*) OVER (PARTITION BY kind) AS m FROM g
), u AS (
  SELECT *, row_number() OVER (ORDER BY size DESC, kind, nth) AS k FROM r WHERE nth >= m - m % 5
), d AS (
  SELECT 0::BIGINT AS k, [{', '.join(['0::BIGINT'] * 20)}] AS held, 0 AS fold
  UNION ALL
  SELECT k, [{', '.join(f'held[{i + 1}] + CASE WHEN fold = {i // 4} THEN h{i % 4} ELSE 0 END' for i in range(20))}], fold FROM (
    SELECT *, (list_position(costs, list_min(costs)) - 1)::INT AS fold FROM (
      SELECT u.k, u.h0, u.h1, u.h2, u.h3, d.held, [{', '.join(' + '.join(f'CASE WHEN t{c} > 0 THEN h{c} * held[{4 * f + c + 1}] / (t{c} * t{c}) ELSE 0 END' for c in range(4)) for f in range(5))}] AS costs FROM d JOIN u ON u.k = d.k + 1, total))
) SELECT s.sample_id, s.label, ((row_number() OVER (PARTITION BY s.label ORDER BY md5('42:' || s.sample_id), s.sample_id) - 1) % 5)::INT AS fold, coalesce(d.fold, r.nth % 5)::INT AS group_fold
FROM s JOIN r USING (group_id) LEFT JOIN u USING (group_id) LEFT JOIN d ON d.k = u.k""")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified folds, and balanced folds that keep groups of uneven sizes together."""
    i = F.col("sample_id")
    group = i - i % 64 + F.floor((i % 64) / (1 + F.floor(i / 64) % 7))
    samples = clouds(spark, sf_dir).select("sample_id", "label").withColumn("group_id", group.cast("bigint"))
    return evaluation.with_folds(samples).select("sample_id", "label", "fold", "group_fold")


@query(f"""WITH {CLOUDS_SQL}, o AS (
  SELECT sample_id, min(x) AS lo, (max(x) - min(x)) / 29 AS step, max(x) AS hi, count(*) AS n FROM cloud GROUP BY sample_id
), edge AS (
  SELECT sample_id, n, i::INT AS i, CASE WHEN i = 29 THEN hi ELSE lo + i * step END AS at FROM o, range(30) r(i)
), bin AS (
  SELECT a.sample_id, a.i, a.n, (a.at + b.at) / 2 AS centre, count(c.x) AS held
  FROM edge a JOIN edge b ON a.sample_id = b.sample_id AND b.i = a.i + 1 LEFT JOIN cloud c ON c.sample_id = a.sample_id AND c.x >= a.at AND (c.x < b.at OR (a.i = 28 AND c.x <= b.at)) GROUP BY ALL
), flag AS (
  SELECT *, held < greatest(n / 29.0::DOUBLE * 0.2::DOUBLE, 1) AS sparse FROM bin
), run AS (
  SELECT *, max(CASE WHEN NOT sparse THEN i END) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_before,
         lag(sparse) OVER (PARTITION BY sample_id ORDER BY i) AS after_sparse FROM flag
), cut AS (
  SELECT sample_id, i AS ends, (coalesce(full_before, -1) + 1 + i) // 2 AS middle FROM run WHERE NOT sparse AND after_sparse
) SELECT c.sample_id, c.ends, round(b.centre, 8) + 0.0 AS threshold FROM cut c JOIN bin b ON b.sample_id = c.sample_id AND b.i = c.middle""")
def split_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the gaps of each cloud's projection on x would split it, by the bin that ends the gap."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = np.array([p["x"] for p in r.pts], float)
                edges = splitting.bin_edges(x)
                out += [(r.sample_id, ends, at) for at, ends in splitting.gaps(np.histogram(x, bins=edges)[0], edges)]
            yield pd.DataFrame(out, columns=["sample_id", "ends", "threshold"])

    found = clouds(spark, sf_dir).select("sample_id", "pts").mapInPandas(cut, "sample_id bigint, ends int, threshold double")
    return found.select("sample_id", "ends", _r("threshold", 8).alias("threshold"))
