"""Queries over points: clipping, ground, cells, clusters, boxes and scene statistics."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelry.functions.geometry import rotated, rotation_to_vertical
from voxelry.operators import clustering, ground, merging, splitting, views
from voxelry.operators.ground import Calibration
from voxelry.plans.registry import query
from voxelry.session import shared_folder, written
from voxelry.sources import clouds
from voxelry.sources.adapters import POINTS_SQL, TIMED_SQL, points, timed_points
from voxelry.streaming import frames

#: A slightly tilted sensor; the same numbers stand in the SQL.
CALIBRATION = Calibration(rotation_to_vertical((0.02, -0.015, 1.0)), -0.55)
CELL, MIN_POINTS = 2.0, 20
#: 0.15 as a 32-bit number.
SINGLE_CELL = 0.15000000596046448
#: Planes to score: heights in steps of 0.25, with three tilts.
PLANES = [(i * 3 + j, 0.01 * (j - 1), 0.0, 1.0, -(-1.0 + 0.25 * i)) for i in range(16) for j in range(3)]


def _f(v: float) -> str:
    return f"({v!r})::DOUBLE"


def _rot(k: int) -> str:
    a, b, c = CALIBRATION.rotation[k]
    return f"x * {_f(float(a))} + y * {_f(float(b))} + z * {_f(float(c))}"


_GH = _f(CALIBRATION.ground_height)
ROTATED = f"{POINTS_SQL}, rot AS (SELECT *, {_rot(0)} AS rx, {_rot(1)} AS ry, {_rot(2)} AS rz FROM points)"
CLIPPED = f"{ROTATED}, clipped AS (SELECT * FROM rot WHERE sqrt(rx * rx + ry * ry) <= 80 AND rz - {_GH} <= 3 AND rz - {_GH} >= -1)"
CELLS = f"""{CLIPPED}, binned AS (
  SELECT *, floor(sqrt(rx * rx + ry * ry) / 5::DOUBLE)::BIGINT AS r_bin, floor((atan2(ry, rx) + {_f(math.pi)}) / {_f(math.radians(5.0))})::BIGINT AS theta_bin FROM clipped
), ranked AS (
  SELECT frame_id, r_bin, theta_bin, rz, count(*) OVER (PARTITION BY frame_id, r_bin, theta_bin) AS n,
         row_number() OVER (PARTITION BY frame_id, r_bin, theta_bin ORDER BY rz) - 1 AS pos FROM binned
), local AS (
  SELECT frame_id, r_bin, theta_bin, max(n) AS n, max(CASE WHEN n >= 5 AND pos = greatest(1, floor(n * 0.05::DOUBLE)) THEN rz END) AS local FROM ranked GROUP BY ALL
), cells AS (
  SELECT *, coalesce(abs(local - {_GH}) <= least(0.5::DOUBLE + 0.08::DOUBLE * (r_bin + 0.5::DOUBLE) * 5.0::DOUBLE, 2.0::DOUBLE), false) AS accepted FROM local
), grounded AS (
  SELECT b.*, CASE WHEN accepted THEN local ELSE {_GH} END AS g FROM binned b JOIN cells USING (frame_id, r_bin, theta_bin)
), masked AS (
  SELECT *, rz >= g - 0.1::DOUBLE AND rz <= g + 0.15::DOUBLE AS is_ground FROM grounded
)"""
BEV = f"""{CELLS}, ng AS (SELECT frame_id, x, y, z FROM masked WHERE NOT is_ground), celled AS (
  SELECT *, floor((x - min(x) OVER (PARTITION BY frame_id)) / {_f(CELL)})::BIGINT AS cx, floor((y - min(y) OVER (PARTITION BY frame_id)) / {_f(CELL)})::BIGINT AS cy FROM ng
), bev AS (
  SELECT frame_id, cx, cy, count(*) AS n, min(z) AS z_min, max(z) AS z_max FROM celled GROUP BY ALL
)"""
LABELS = f"""{BEV}, occ AS (SELECT frame_id, cx, cy, cx * 1048576 + cy AS id FROM bev WHERE n >= 2), edge AS (
  SELECT a.frame_id, a.id AS a, b.id AS b FROM occ a JOIN occ b ON a.frame_id = b.frame_id AND ((a.cx = b.cx AND abs(a.cy - b.cy) = 1) OR (a.cy = b.cy AND abs(a.cx - b.cx) = 1))
), cc(frame_id, id, label) USING KEY (frame_id, id) AS (
  SELECT frame_id, id, id FROM occ
  UNION
  SELECT e.frame_id, e.b, min(cc.label) FROM cc JOIN edge e ON e.frame_id = cc.frame_id AND e.a = cc.id JOIN recurring.cc r ON r.frame_id = e.frame_id AND r.id = e.b
  WHERE cc.label < r.label GROUP BY e.frame_id, e.b
), labelled AS (
  SELECT c.*, cc.label FROM celled c JOIN cc ON c.frame_id = cc.frame_id AND c.cx * 1048576 + c.cy = cc.id
)"""
CLUSTERS = f"""{LABELS}, lz AS (
  SELECT *, count(*) OVER w AS n_before, min(z) OVER w AS z_lo, max(z) OVER w AS z_hi, row_number() OVER (PARTITION BY frame_id, label ORDER BY z) - 1 AS pos FROM labelled
  WINDOW w AS (PARTITION BY frame_id, label)
), p5 AS (
  SELECT *, max(CASE WHEN pos = floor(0.05::DOUBLE * (n_before - 1)) THEN z END) OVER (PARTITION BY frame_id, label) AS p5 FROM lz
), kept AS (
  SELECT * FROM p5 WHERE NOT (z_lo - {_GH} < 0.25 AND z_hi - z_lo > 0.5) OR z > p5
), mom AS (
  SELECT frame_id, label, max(n_before) AS n_before, count(*) AS n_points, min(z) AS z_min, max(z) AS z_max, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
         covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM kept GROUP BY ALL
), ax AS (
  SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS big FROM mom
), vec AS (
  SELECT *, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 1.0 ELSE 0.0 END ELSE b END AS vx, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 0.0 ELSE 1.0 END ELSE big - a END AS vy FROM ax
), uv AS (
  SELECT k.frame_id, k.label, (k.x * vx + k.y * vy) / sqrt(vx * vx + vy * vy) AS u, (k.y * vx - k.x * vy) / sqrt(vx * vx + vy * vy) AS v FROM kept k JOIN vec USING (frame_id, label)
), wid AS (
  SELECT frame_id, label, max(u) - min(u) AS x_range, max(v) - min(v) AS y_range FROM uv GROUP BY ALL
), clusters AS (
  SELECT mom.*, z_max - z_min AS z_range, sqrt(x_range * x_range + y_range * y_range) AS xy_spread,
         CASE WHEN n_before < {MIN_POINTS} OR n_points < {MIN_POINTS} THEN 'small' WHEN n_before > 15000 THEN 'large' WHEN z_max - z_min > 5 THEN 'tall'
              WHEN sqrt(x_range * x_range + y_range * y_range) > 15 THEN 'wide' END AS reject_reason
  FROM mom JOIN wid USING (frame_id, label)
)"""
BOXES = f"{LABELS}, box AS (SELECT frame_id, label, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM labelled GROUP BY ALL)"


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.clip(points(spark, sf_dir), CALIBRATION)


def _celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_cells(written(ground.non_ground(points(spark, sf_dir).select("frame_id", "x", "y", "z"), CALIBRATION), "other"), CELL)


def _labelled(spark: SparkSession, sf_dir: str, sizes: bool = False) -> DataFrame:
    return clustering.with_labels(_celled(spark, sf_dir), sizes=sizes)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_labelled(spark, sf_dir), CALIBRATION.ground_height, MIN_POINTS)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.boxes(_labelled(spark, sf_dir))


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


@query(f"""WITH {ROTATED}, why AS (
  SELECT frame_id, CASE WHEN sqrt(rx * rx + ry * ry) > 80 THEN 'far' WHEN rz - {_GH} > 3 THEN 'high' WHEN rz - {_GH} < -1 THEN 'low' END AS why FROM rot)
SELECT frame_id, count(*) AS n_points, count(*) FILTER (why IS NULL) AS n_kept, count(*) FILTER (why = 'far') AS n_far, count(*) FILTER (why = 'high') AS n_high,
       count(*) FILTER (why = 'low') AS n_low FROM why GROUP BY frame_id""")
def frame_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each frame that the clip keeps, and those it drops by reason."""
    why = ground.with_rotated(points(spark, sf_dir), CALIBRATION).select("frame_id", ground.clip_reason(CALIBRATION).alias("why"))
    counts = [F.count_if(F.col("why") == k).alias(f"n_{k}") for k in ("far", "high", "low")]
    return why.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("why").isNull()).alias("n_kept"), *counts)


@query(f"WITH {POINTS_SQL} SELECT frame_id, count(*) AS n_valid, count(*) FILTER (sqrt(x * x + y * y) < 10) AS n_near FROM points WHERE z > -10 AND z < 30 GROUP BY frame_id")
def calib_near_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of plausible height, and those near the sensor."""
    return ground.calibration_points(points(spark, sf_dir)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_valid"), F.count_if("near").alias("n_near"))


@query(f"""WITH {POINTS_SQL}, planes(hyp, nx, ny, nz, d) AS (VALUES {', '.join(f'({h}, {_f(a)}, {_f(b)}, {_f(c)}, {_f(d)})' for h, a, b, c, d in PLANES)}), counts AS (
  SELECT hyp, count(*) FILTER (abs(x * nx + y * ny + z * nz + d) < 0.3) AS n_inliers FROM points, planes WHERE z > -10 AND z < 30 AND sqrt(x * x + y * y) < 10 GROUP BY hyp)
SELECT hyp, n_inliers, row_number() OVER (ORDER BY n_inliers DESC, hyp) = 1 AS best FROM counts""")
def ransac_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inliers of each plane hypothesis, and the winner: most inliers, of equal ones the first."""
    near = ground.calibration_points(points(spark, sf_dir)).where("near")
    counts = ground.inlier_counts(near, PLANES)
    return counts.withColumn("best", F.row_number().over(Window.orderBy(F.desc("n_inliers"), "hyp")) == 1)


@query(f"""WITH {ROTATED}, v AS (SELECT * FROM rot WHERE z > -10 AND z < 30), h AS (SELECT quantile_cont(rz, 0.05) AS g FROM v)
SELECT round(g, 6) AS ground_height, round(avg(CASE WHEN abs(rz - g) < 0.2 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_near FROM v, h GROUP BY g""")
def calib_ground_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interpolated 5th percentile of the rotated heights, and the share of points within 0.2 of it."""
    valid = ground.calibration_points(points(spark, sf_dir))
    height = ground.ground_height(valid, CALIBRATION.rotation)
    _, _, rz = rotated(CALIBRATION.rotation, F.col("x"), F.col("y"), F.col("z"))
    joined = valid.crossJoin(F.broadcast(height))  # one row
    share = F.avg(F.when(F.abs(rz - F.col("ground_height")) < 0.2, 1.0).otherwise(0.0))
    return joined.agg(_r(F.max("ground_height")).alias("ground_height"), _r(share).alias("share_near"))


_SEED, _DRAWS = 0, 1000
_HEX = "('0x' || substr(h, {}, {}))::BIGINT"
#: The same points and triples are drawn: both depend on MD5 alone.
_PLANES = f"""{POINTS_SQL}, valid AS (SELECT frame_id, x, y, z, sqrt(x * x + y * y) < 10 AS near FROM points WHERE z > -10 AND z < 30
), hashed AS (
  SELECT DISTINCT frame_id, floor(x * 1e6::DOUBLE)::BIGINT AS qx, floor(y * 1e6::DOUBLE)::BIGINT AS qy, floor(z * 1e6::DOUBLE)::BIGINT AS qz FROM valid WHERE near
), slotted AS (
  SELECT *, ('0x' || substr(md5('{_SEED}:' || qx || ':' || qy || ':' || qz), 1, 15))::BIGINT AS h FROM hashed
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY frame_id, h % 4096 ORDER BY h) AS nth FROM slotted
), drawn AS (
  SELECT frame_id, qx / 1e6::DOUBLE AS x, qy / 1e6::DOUBLE AS y, qz / 1e6::DOUBLE AS z, row_number() OVER (PARTITION BY frame_id ORDER BY h, h % 4096) - 1 AS place, count(*) OVER (PARTITION BY frame_id) AS m FROM kept WHERE nth = 1
), number AS (
  SELECT hyp, {_HEX.format(1, 8)} AS h1, {_HEX.format(9, 8)} AS h2, {_HEX.format(17, 8)} AS h3 FROM (SELECT range AS hyp, md5('{_SEED}:' || range) AS h FROM range({_DRAWS}))
), two AS (
  SELECT frame_id, m, hyp, h1 % m AS a, (h1 % m + 1 + h2 % (m - 1)) % m AS b, h3 % (m - 2) AS c FROM number, (SELECT DISTINCT frame_id, m FROM drawn WHERE m >= 3)
), skip AS (SELECT frame_id, hyp, a, b, c + (c >= least(a, b))::INT AS c FROM two
), three AS (SELECT frame_id, hyp, a, b, c + (c >= greatest(a, b))::INT AS c FROM skip
), cross_ AS (
  SELECT t.frame_id, hyp, a.x AS ax, a.y AS ay, a.z AS az, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS cx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS cz
  FROM three t JOIN drawn a ON a.frame_id = t.frame_id AND a.place = t.a JOIN drawn b ON b.frame_id = t.frame_id AND b.place = t.b JOIN drawn c ON c.frame_id = t.frame_id AND c.place = t.c
), unit AS (
  SELECT frame_id, hyp, ax, ay, az, cx / s AS nx, cy / s AS ny, cz / s AS nz FROM (SELECT *, CASE WHEN cz < 0 THEN -1 ELSE 1 END * sqrt(cx * cx + cy * cy + cz * cz) AS s FROM cross_) WHERE abs(s) >= 1e-10
), planes AS (SELECT frame_id, hyp, nx, ny, nz, -(nx * ax + ny * ay + nz * az) AS d FROM unit WHERE nz >= 0.7
), counts AS (
  SELECT p.frame_id, hyp, nx, ny, nz, d, count(*) FILTER (abs(x * nx + y * ny + z * nz + d) < 0.3) AS n_inliers FROM planes p JOIN valid v ON v.frame_id = p.frame_id AND near GROUP BY ALL
), best AS (
  SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n_inliers DESC, hyp) = 1
), made AS (
  SELECT frame_id, coalesce(nx, 0) AS nx, coalesce(ny, 0) AS ny, coalesce(nz, 1) AS nz, coalesce(d, -low, 0) AS d, coalesce(n_inliers, 0) AS n_inliers, nz IS NOT NULL AS fitted
  FROM (SELECT frame_id, quantile_cont(z, 0.2) FILTER (near) AS low FROM valid GROUP BY frame_id) LEFT JOIN best USING (frame_id)
)"""


@query(f"""WITH {_PLANES} SELECT frame_id, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, round(d, 6) + 0.0 AS d, n_inliers, fitted,
round(quantile_cont(x * nx + y * ny + z * nz, 0.05), 6) + 0.0 AS ground_height FROM made JOIN valid USING (frame_id) GROUP BY frame_id, nx, ny, nz, d, n_inliers, fitted""")
def calib_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of each frame from end to end: drawn planes, the best one, and the height of the ground along it."""
    found = ground.calibrations(points(spark, sf_dir), _DRAWS, seed=_SEED)
    return found.select("frame_id", *[_r(c).alias(c) for c in ("nx", "ny", "nz", "d")], "n_inliers", "fitted", _r("ground_height").alias("ground_height"))


@query(f"WITH {CELLS} SELECT frame_id, r_bin, theta_bin, n, round(local, 6) AS local, accepted, round(CASE WHEN accepted THEN local ELSE {_GH} END, 6) AS ground FROM cells")
def polar_cell_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground height of each polar cell, with the fallback to the calibrated height."""
    cells = ground.polar_cells(_clipped(spark, sf_dir), CALIBRATION)
    return cells.select("frame_id", "r_bin", "theta_bin", "n", _r("local").alias("local"), "accepted", _r("ground").alias("ground"))


@query(f"WITH {CELLS} SELECT frame_id, count(*) FILTER (is_ground) AS n_ground, count(*) FILTER (NOT is_ground) AS n_other, round(avg(is_ground::INT), 6) AS ground_share FROM masked GROUP BY frame_id")
def ground_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground and other points of each frame."""
    masked = ground.with_ground(_clipped(spark, sf_dir), CALIBRATION).groupBy("frame_id")
    return masked.agg(F.count_if("is_ground").alias("n_ground"), F.count_if(~F.col("is_ground")).alias("n_other"), _r(F.avg(F.col("is_ground").cast("int"))).alias("ground_share"))


@query(f"WITH {BEV} SELECT frame_id, cx, cy, n, round(z_min, 6) AS z_min, round(z_max, 6) AS z_max, round(z_max - z_min, 6) AS height, n >= 2 AS occupied FROM bev")
def bev_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the bird's-eye view."""
    cells = clustering.bev_cells(_celled(spark, sf_dir))
    return cells.select("frame_id", "cx", "cy", "n", _r("z_min").alias("z_min"), _r("z_max").alias("z_max"), _r("height").alias("height"), "occupied")


@query(f"WITH RECURSIVE {LABELS} SELECT frame_id, label, count(*) AS n_cells FROM cc GROUP BY ALL")
def bev_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-connected components of the occupied cells."""
    return clustering.components(clustering.bev_cells(_celled(spark, sf_dir))).groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n_cells"))


#: Cells of a tile's side; a frame of the tables has 20 such tiles.
TILE = 16


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in cells, read from a written table, as frames of any size are read several times."""
    return clustering.cells_from(written(ground.non_ground(points(spark, sf_dir).select("frame_id", "x", "y", "z"), CALIBRATION), "other"), CELL)


@query(f"WITH RECURSIVE {LABELS} SELECT frame_id, label, count(*) AS n_cells FROM cc GROUP BY ALL")
def bev_components_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-connected components of the occupied cells, by tile and merged across borders."""
    return clustering.tiled_components(clustering.bev_cells(_tiled(spark, sf_dir)), TILE).groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n_cells"))


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT frame_id, label, n_before, n_points, round(mx, 8) + 0.0 AS mx, round(my, 8) + 0.0 AS my, round(mz, 8) + 0.0 AS mz, round(z_range, 8) AS z_range,
round(xy_spread, 8) AS xy_spread, reject_reason FROM clusters""")
def cluster_extract_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of frames that no task holds whole: cells and components by tile."""
    rounded = [_r(c, 8).alias(c) for c in ("mx", "my", "mz", "z_range", "xy_spread")]
    found = clustering.clusters(clustering.tiled_labels(_tiled(spark, sf_dir), TILE), CALIBRATION.ground_height, MIN_POINTS)
    return found.select("frame_id", "label", "n_before", "n_points", *rounded, "reject_reason")


@query(f"WITH RECURSIVE {LABELS} SELECT frame_id, label, count(*) AS n_points, round(avg(z), 8) + 0.0 AS mean_z FROM labelled GROUP BY ALL")
def point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by the label of their cell."""
    return _labelled(spark, sf_dir).groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n_points"), _r(F.avg("z"), 8).alias("mean_z"))


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT frame_id, label, n_before, n_points, round(mx, 8) + 0.0 AS mx, round(my, 8) + 0.0 AS my, round(mz, 8) + 0.0 AS mz, round(z_range, 8) AS z_range,
round(xy_spread, 8) AS xy_spread, reject_reason FROM clusters""")
def cluster_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after the ground trim, with what rejects them."""
    rounded = [_r(c, 8).alias(c) for c in ("mx", "my", "mz", "z_range", "xy_spread")]
    return _clusters(spark, sf_dir).select("frame_id", "label", "n_before", "n_points", *rounded, "reject_reason")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT frame_id, coalesce(reject_reason, 'kept') AS outcome, count(*) AS n FROM clusters GROUP BY ALL")
def cluster_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each frame by outcome."""
    return _clusters(spark, sf_dir).groupBy("frame_id", F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_CORNERS = ", ".join(f"({k}, {a}, {a | b})" for k, (a, b) in enumerate(clustering.EDGES))


def _pick(axis: str, bits: str, value: int) -> str:
    return f"round(CASE WHEN {bits} & {value} = {value} THEN {axis}_max ELSE {axis}_min END, 6)"


@query(f"""WITH RECURSIVE {BOXES}, e(edge, p, q) AS (VALUES {_CORNERS})
SELECT frame_id, label, edge, {', '.join(f"{_pick(a, s, v)} AS {a}{i}" for i, s in ((1, 'p'), (2, 'q')) for a, v in (('x', 1), ('y', 2), ('z', 4)))} FROM box, e WHERE n >= {MIN_POINTS}""")
def bbox_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 edges of each cluster's box."""
    edges = clustering.bbox_edges(_boxes(spark, sf_dir).where(F.col("n") >= MIN_POINTS))
    return edges.select("frame_id", "label", "edge", *[_r(f"{a}{i}").alias(f"{a}{i}") for i in (1, 2) for a in "xyz"])


@query(f"""WITH RECURSIVE {BOXES} SELECT a.frame_id, a.label AS outer_label, b.label AS inner_label, a.n AS outer_n, b.n AS inner_n FROM box a JOIN box b ON a.frame_id = b.frame_id AND a.label <> b.label
AND b.x_min >= a.x_min AND b.x_max <= a.x_max AND b.y_min >= a.y_min AND b.y_max <= a.y_max AND b.z_min >= a.z_min AND b.z_max <= a.z_max AND b.n < 0.5 * a.n""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters of which one's box holds the other's, of less than half its points."""
    return merging.candidates(_boxes(spark, sf_dir)).select("frame_id", "outer_label", "inner_label", "outer_n", "inner_n")


def _grown(x: str) -> str:
    """A label's points by now: its own and those of the labels it took in."""
    return f"({x}_n + coalesce(list_sum([t.n for t in taken if t.owner = {x}_label]), 0))"


@query(f"""WITH RECURSIVE {BOXES}, p AS (
  SELECT a.frame_id, a.label AS outer_label, b.label AS inner_label, a.n AS outer_n, b.n AS inner_n, row_number() OVER (PARTITION BY a.frame_id ORDER BY a.label, b.label) AS k
  FROM box a JOIN box b ON a.frame_id = b.frame_id AND a.label <> b.label AND b.x_min >= a.x_min AND b.x_max <= a.x_max AND b.y_min >= a.y_min AND b.y_max <= a.y_max AND b.z_min >= a.z_min AND b.z_max <= a.z_max
), pass AS (
  SELECT frame_id, 0::BIGINT AS k, []::STRUCT("owner" BIGINT, label BIGINT, n BIGINT)[] AS taken FROM (SELECT DISTINCT frame_id FROM box)
  UNION ALL
  SELECT frame_id, p.k, CASE WHEN len([t for t in taken if t.label = outer_label OR t.label = inner_label]) = 0 AND {_grown('inner')} < 0.5 * {_grown('outer')}
    THEN list_append(taken, {{'owner': outer_label::BIGINT, 'label': inner_label::BIGINT, 'n': inner_n::BIGINT}}) ELSE taken END
  FROM pass JOIN p USING (frame_id) WHERE p.k = pass.k + 1
), t AS (
  SELECT frame_id, unnest(taken) AS t FROM (SELECT frame_id, arg_max(taken, k) AS taken FROM pass GROUP BY frame_id)
), o AS (
  SELECT box.frame_id, box.label, box.n, coalesce(t.t.owner, box.label) AS owner FROM box LEFT JOIN t ON t.frame_id = box.frame_id AND t.t.label = box.label
) SELECT frame_id, label, owner, (sum(n) OVER (PARTITION BY frame_id, owner))::BIGINT AS owner_n FROM o""")
def merge_engulfed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster and the one that takes it in, by the greedy pass."""
    boxes = _boxes(spark, sf_dir)
    return merging.absorbed(boxes).select("frame_id", "label", "owner", "owner_n")


@query(f"""WITH RECURSIVE {CLUSTERS}, m AS (
  SELECT frame_id, label, any_value(c.n_points) AS n_points, any_value(c.z_max - c.z_min) AS zr, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz
  FROM kept JOIN clusters c USING (frame_id, label) WHERE reject_reason IS NULL GROUP BY frame_id, label
), q AS (
  SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM m
), phi AS (
  SELECT *, acos(least(greatest(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p), -1), 1)) / 3 AS phi FROM q
), ev AS (
  SELECT *, q + 2 * p * cos(phi) AS e2, q + 2 * p * cos(phi + 2 * pi() / 3) AS e0 FROM phi
), lin AS (
  SELECT *, (e2 - (3 * q - e2 - e0)) / (3 * q + 1e-12) AS linearity, sqrt(((e2 - xx) * (e2 - yy) - xy * xy) / ((e2 - (3 * q - e2 - e0)) * (e2 - e0))) AS z_weight FROM ev
) SELECT frame_id, label, n_points, zr BETWEEN 1.0 AND 2.2 AND n_points BETWEEN 100 AND 2000 AND n_points > 150 AND z_weight <= 0.5 AND linearity > 0.3 AS candidate, round(linearity, 6) AS linearity FROM lin""")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that look like pedestrians side by side."""
    found = clustering.cluster_points(_labelled(spark, sf_dir, sizes=True), CALIBRATION.ground_height, min_points=MIN_POINTS)
    return splitting.candidates(found).select("frame_id", "label", "n_points", "candidate", _r("linearity").alias("linearity"))


@query()
def split_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after splitting along the principal axis."""
    found = clustering.cluster_points(_labelled(spark, sf_dir, sizes=True), CALIBRATION.ground_height, min_points=MIN_POINTS)
    return splitting.split(splitting.as_clusters(found)).select("frame_id", "label_id", "cluster_id", "n_points", "was_split", _r("z_range", 8).alias("z_range"))


@query()
def split_track_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after splitting between known tracks; here two beside each cluster's centre."""
    found = splitting.as_clusters(clustering.cluster_points(_labelled(spark, sf_dir, sizes=True), CALIBRATION.ground_height, min_points=MIN_POINTS))
    beside = lambda by: F.struct(F.lit("pedestrian").alias("class_label"), (F.col("centroid.x") + by).alias("x"), F.col("centroid.y").alias("y"), F.col("centroid.z").alias("z"))
    tracks = found.select("frame_id", F.explode(F.array(beside(-0.4), beside(0.4))).alias("t")).select("frame_id", "t.*")
    return splitting.split(found, tracks).select("frame_id", "label_id", "cluster_id", "n_points", "was_split", "track_guided")


@query(f"""WITH {POINTS_SQL} SELECT frame_id, count(*) AS n_points, {', '.join(f'round(min({a}), 8) AS {a}_min, round(max({a}), 8) AS {a}_max, round(max({a}) - min({a}), 8) AS {a}_span' for a in 'xyz')},
round(avg(intensity), 8) AS mean_intensity, round(min(intensity), 8) AS min_intensity, round(max(intensity), 8) AS max_intensity, count(DISTINCT ring) AS n_rings,
round(count(*) / greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-6::DOUBLE), 8) AS per_area FROM points GROUP BY frame_id""")
def scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, extents and densities of each frame."""
    ends = [e for a in "xyz" for e in (_r(F.min(a), 8).alias(f"{a}_min"), _r(F.max(a), 8).alias(f"{a}_max"), _r(F.max(a) - F.min(a), 8).alias(f"{a}_span"))]
    area = F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), F.lit(1e-6))
    return points(spark, sf_dir).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_points"), *ends, _r(F.avg("intensity"), 8).alias("mean_intensity"), _r(F.min("intensity"), 8).alias("min_intensity"), _r(F.max("intensity"), 8).alias("max_intensity"),
        F.count_distinct("ring").alias("n_rings"), _r(F.count(F.lit(1)) / area, 8).alias("per_area"),
    )


@query(f"""WITH {POINTS_SQL}, s AS (SELECT frame_id, count(*) AS n, min(z) AS lo, max(z) AS hi FROM points GROUP BY frame_id)
SELECT count(*) AS n_frames, min(n) AS n_min, max(n) AS n_max, round(avg(n), 8) AS n_mean, round(min(lo), 8) AS z_min_least, round(max(lo), 8) AS z_min_most, round(min(hi), 8) AS z_max_least,
       round(max(hi), 8) AS z_max_most, max(lo) - min(lo) < 0.5 AS ground_consistent FROM s""")
def cross_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the frames differ."""
    s = points(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    ends = [_r(f(c), 8).alias(f"z_{n}_{e}") for c, n in (("lo", "min"), ("hi", "max")) for f, e in ((F.min, "least"), (F.max, "most"))]
    return s.agg(F.count(F.lit(1)).alias("n_frames"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), _r(F.avg("n"), 8).alias("n_mean"), *ends, (F.max("lo") - F.min("lo") < 0.5).alias("ground_consistent"))


@query(f"""WITH {POINTS_SQL} SELECT frame_id, CASE WHEN z < 0 THEN 'low' WHEN z < 2 THEN 'middle' ELSE 'high' END AS band, count(*) AS n,
round(avg(least(greatest((z - -1.0::DOUBLE) / 4.0::DOUBLE, 0), 1)), 8) AS mean_colour FROM points WHERE sqrt(x * x + y * y) < 60 GROUP BY ALL""")
def height_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer shows: points within 60 m by height band, with their mean place on the colour scale."""
    from voxelry.functions.geometry import affine_colour, horizontal_range

    z = F.col("z")
    band = F.when(z < 0, "low").when(z < 2, "middle").otherwise("high").alias("band")
    shown = points(spark, sf_dir).where(horizontal_range(F.col("x"), F.col("y")) < 60)
    return shown.groupBy("frame_id", band).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(affine_colour(z, -1.0, 3.0)), 8).alias("mean_colour"))


@query(f"""WITH RECURSIVE {LABELS}, p AS (SELECT m.*, l.label FROM masked m LEFT JOIN (SELECT DISTINCT frame_id, x, y, z, label FROM labelled) l USING (frame_id, x, y, z))
SELECT frame_id, mode, count(*) FILTER (CASE mode WHEN 'all' THEN true WHEN 'ground' THEN is_ground WHEN 'other' THEN NOT is_ground WHEN 'clusters' THEN label IS NOT NULL
  WHEN 'objects' THEN label % 4 = 1 WHEN 'tracked' THEN label % 8 = 1 ELSE least(greatest((z + 1::DOUBLE) / 4.0::DOUBLE, 0), 1) > 0.3 END) AS n
FROM p, (VALUES ('all'), ('ground'), ('other'), ('clusters'), ('objects'), ('tracked'), ('opaque')) v(mode) GROUP BY ALL""")
def viewer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that each viewer mode shows; which clusters are objects and tracked is made up from their labels."""
    from voxelry.functions.geometry import affine_colour

    masked = ground.with_ground(_clipped(spark, sf_dir), CALIBRATION)
    labels = _labelled(spark, sf_dir).select("frame_id", "x", "y", "z", "label").distinct()
    p = masked.join(labels, ["frame_id", "x", "y", "z"], "left")
    of_label = lambda m: F.coalesce(F.col("label") % m == 1, F.lit(False))
    p = p.withColumns({"is_object": of_label(4), "is_tracked": of_label(8), "alpha": affine_colour(F.col("z"), -1.0, 3.0)})
    modes = ("all", "ground", "other", "clusters", "objects", "tracked", "opaque")
    counts = p.groupBy("frame_id").agg(*[F.count_if(views.shown(m)).alias(m) for m in modes])
    return counts.unpivot("frame_id", list(modes), "mode", "n")


#: Classes and flags are made up from labels; the largest cluster of a frame is the selected one.
_CLASS_OF = "CASE label % 5 WHEN 0 THEN 'car' WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'bicyclist' WHEN 3 THEN 'background' ELSE 'tram' END"


@query(f"""WITH RECURSIVE {BOXES}, e(edge, p, q) AS (VALUES {_CORNERS}), chosen AS (
  SELECT *, {_CLASS_OF} AS class_label, label % 7 = 0 AS was_split, label % 11 = 0 AS guided, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, label) = 1 AS selected FROM box WHERE n >= {MIN_POINTS}
), c AS (
  SELECT *, CASE WHEN selected THEN [1, 1, 1, 1] WHEN guided THEN [0, 1, 1, 0.25] WHEN was_split THEN [1, 0, 1, 0.25] WHEN class_label = 'car' THEN [0.2, 0.6, 1, 0.25]
    WHEN class_label = 'pedestrian' THEN [1, 0.3, 0.3, 0.25] WHEN class_label = 'bicyclist' THEN [1, 0.8, 0, 0.25] ELSE [0.7, 0.7, 0.7, 0.175] END AS rgba FROM chosen WHERE class_label <> 'background'
) SELECT frame_id, label, class_label, edge, {', '.join(f"{_pick(a, s, v)} AS {a}{i}" for i, s in ((1, 'p'), (2, 'q')) for a, v in (('x', 1), ('y', 2), ('z', 4)))},
  {', '.join(f'rgba[{i}]::DOUBLE AS {k}' for i, k in enumerate(('r', 'g', 'b', 'alpha'), 1))} FROM c, e""")
def bbox_wireframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each object's box in the colour of its class, of how it was split, or of the selection."""
    boxes = _boxes(spark, sf_dir).where(F.col("n") >= MIN_POINTS)
    largest = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("n"), "label")) == 1
    marked = boxes.withColumns({"class_label": F.expr(_CLASS_OF), "was_split": F.col("label") % 7 == 0, "track_guided": F.col("label") % 11 == 0, "is_largest": largest})
    edges = views.wireframe(marked, F.col("is_largest"))
    return edges.select("frame_id", "label", "class_label", "edge", *[_r(f"{a}{i}").alias(f"{a}{i}") for i in (1, 2) for a in "xyz"], "r", "g", "b", "alpha")


@query(f"""WITH RECURSIVE {LABELS}, p AS (
  SELECT m.frame_id, m.is_ground, l.label, {_CLASS_OF} AS class_label FROM masked m LEFT JOIN (SELECT DISTINCT frame_id, x, y, z, label FROM labelled) l USING (frame_id, x, y, z)
), every AS (
  SELECT frame_id, palette, CASE WHEN is_ground THEN [0.1, 0.8, 0.1, CASE palette WHEN 'tracks' THEN 0.5 ELSE 0.6 END]
    WHEN label IS NULL THEN CASE palette WHEN 'tracks' THEN [0.15, 0.15, 0.15, 0.2] ELSE [0.2, 0.2, 0.2, 0.3] END
    WHEN class_label = 'car' THEN [0.2, 0.6, 1, 1] WHEN class_label = 'pedestrian' THEN [1, 0.3, 0.3, 1] WHEN class_label = 'bicyclist' THEN [1, 0.8, 0, 1]
    WHEN class_label = 'background' THEN [0.7, 0.7, 0.7, CASE palette WHEN 'tracks' THEN 0.7 ELSE 1 END] ELSE [0.5, 0.5, 0.5, 1] END AS c
  FROM p, (VALUES ('tracks'), ('clusters')) v(palette)
) SELECT frame_id, palette, {', '.join(f'c[{i}]::DOUBLE AS {k}' for i, k in enumerate(('r', 'g', 'b', 'alpha'), 1))}, count(*) AS n FROM every GROUP BY ALL""")
def point_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each frame by the colour that they have in either palette."""
    masked = ground.with_ground(_clipped(spark, sf_dir), CALIBRATION)
    labels = _labelled(spark, sf_dir).select("frame_id", "x", "y", "z", "label").distinct()
    p = masked.join(labels, ["frame_id", "x", "y", "z"], "left").withColumn("class_label", F.when(F.col("label").isNotNull(), F.expr(_CLASS_OF)))
    colours = [F.struct(F.lit(k).alias("palette"), views.point_colour(F.col("is_ground"), F.col("label").isNotNull(), F.col("class_label"), k).alias("c")) for k in views.PALETTES]
    rows = p.select("frame_id", F.explode(F.array(*colours)).alias("v")).select("frame_id", "v.palette", "v.c.*")
    return rows.groupBy("frame_id", "palette", "r", "g", "b", "alpha").agg(F.count(F.lit(1)).alias("n"))


#: The production cell in 32-bit arithmetic, over a scene in the size of a street.
_STREET_CELLS = f"""{CELLS}, single AS (
  SELECT frame_id, (x * 0.12::DOUBLE)::FLOAT AS x, (y * 0.12::DOUBLE)::FLOAT AS y, z FROM masked WHERE NOT is_ground
), least AS (SELECT frame_id, min(x) AS x0, min(y) AS y0 FROM single GROUP BY frame_id
), street AS (
  SELECT frame_id, trunc(((x - x0)::DOUBLE / {_f(SINGLE_CELL)})::FLOAT)::BIGINT AS cx, trunc(((y - y0)::DOUBLE / {_f(SINGLE_CELL)})::FLOAT)::BIGINT AS cy, z
  FROM single JOIN least USING (frame_id)
)"""


@query(f"WITH {_STREET_CELLS} SELECT frame_id, cx, cy, count(*) AS n, round(max(z) - min(z), 6) AS height, count(*) >= 2 AS occupied FROM street GROUP BY frame_id, cx, cy")
def bev_cells_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 0.15 m in 32-bit arithmetic, as the pipeline bins frames."""
    street = written(ground.non_ground(points(spark, sf_dir).select("frame_id", "x", "y", "z"), CALIBRATION).withColumns({"x": (F.col("x") * 0.12).cast("float"), "y": (F.col("y") * 0.12).cast("float")}), "street")
    cells = clustering.bev_cells(clustering.with_cells(street, clustering.CELL, single=True))
    return cells.select("frame_id", "cx", "cy", "n", _r("height").alias("height"), "occupied")


@query(f"WITH {POINTS_SQL} SELECT frame_id, count(*) AS n FROM points WHERE sqrt((x - 10) ** 2 + (y - 5) ** 2) < 6 GROUP BY frame_id")
def selected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around a selected place."""
    return views.selected(points(spark, sf_dir), 10.0, 5.0, 6.0).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TIMED_SQL} SELECT frame_ns, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, intensity::DOUBLE AS intensity, ring::INT AS ring FROM timed")
def frames_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of frames that are written as files in two parts and taken up by one stream, which stops between them."""
    made, folder = timed_points(spark, sf_dir), f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    middle = (made.agg(F.max("frame_ns")).first()[0] or 0) // 2
    clouds.write_frames(made.where(F.col("frame_ns") <= middle), f"{folder}/files")
    frames.take_up(spark, f"{folder}/files", f"{folder}/kept")
    clouds.write_frames(made.where(F.col("frame_ns") > middle), f"{folder}/files")
    kept = frames.take_up(spark, f"{folder}/files", f"{folder}/kept")
    return kept.select("frame_ns", *[F.col(k).cast("double").alias(k) for k in ("x", "y", "z", "intensity")], F.col("ring").cast("int").alias("ring"))
