"""Queries over predictions and detections: evaluation, routing, gating and tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelry.operators import assignment, evaluation, latency, tracks, views
from voxelry.plans.registry import query
from voxelry.sources.adapters import DETECTIONS_SQL, PREDS_SQL, detections, predictions
from voxelry.streaming import timed, tracker


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


@query(f"""WITH {PREDS_SQL}, c AS (SELECT truth, {', '.join(f'count(*) FILTER (pred = {i}) AS n_{i}' for i in range(4))} FROM preds GROUP BY truth)
SELECT truth, n_0, n_1, n_2, n_3, {', '.join(f'round(n_{i} / (n_0 + n_1 + n_2 + n_3), 6) AS share_{i}' for i in range(4))} FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by true and predicted class, and their shares of the row."""
    c = evaluation.confusion(predictions(spark, sf_dir))
    return c.select("truth", *[f"n_{i}" for i in range(4)], *[_r(f"share_{i}").alias(f"share_{i}") for i in range(4)])


@query(f"""WITH {PREDS_SQL}, k(class_id) AS (SELECT truth FROM preds UNION SELECT pred FROM preds), c AS (
  SELECT class_id, count(*) FILTER (truth = class_id) AS support, count(*) FILTER (truth = class_id AND pred = class_id) AS hit, count(*) FILTER (pred = class_id) AS said FROM k, preds GROUP BY class_id
), s AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM s)
SELECT class_id::INT AS class_id, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(avg(f) OVER (), 6) AS macro_f1 FROM f""")
def prf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by class, and their mean."""
    found = evaluation.precision_recall(predictions(spark, sf_dir))
    return found.select("class_id", "support", *[_r(k).alias(k) for k in ("precision", "recall", "f1", "macro_f1")])


@query(f"""WITH {PREDS_SQL} SELECT truth, count(*) FILTER (truth = pred) AS n_right, count(*) FILTER (truth <> pred) AS n_wrong, round(coalesce(avg(conf) FILTER (truth = pred), 0), 6) AS conf_right,
round(coalesce(avg(conf) FILTER (truth <> pred), 0), 6) AS conf_wrong FROM preds GROUP BY truth""")
def confidence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of right and wrong predictions by class."""
    found = evaluation.confidence_gap(predictions(spark, sf_dir))
    return found.select("truth", "n_right", "n_wrong", _r("conf_right").alias("conf_right"), _r("conf_wrong").alias("conf_wrong"))


def _ranked_sql(where: str, by: str, order: str, n: int) -> str:
    return f"WITH {PREDS_SQL}, k AS (SELECT *, (row_number() OVER (PARTITION BY {by} ORDER BY conf {order}, doc_id))::INT AS nth FROM preds WHERE {where}) SELECT doc_id, truth, pred, conf, nth FROM k WHERE nth <= {n}"


@query(_ranked_sql("truth <> pred", "truth, pred", "DESC", 40))
def topn_misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident errors of each kind."""
    return evaluation.top_misclassified(predictions(spark, sf_dir)).select("doc_id", "truth", "pred", "conf", "nth")


@query(_ranked_sql("truth = pred", "truth", "ASC", 40))
def topn_low_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least confident correct rows of each class."""
    return evaluation.least_confident(predictions(spark, sf_dir)).select("doc_id", "truth", "pred", "conf", "nth")


@query(_ranked_sql("truth = pred", "truth", "DESC", 10))
def topn_high_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident correct rows of each class."""
    return evaluation.most_confident(predictions(spark, sf_dir)).select("doc_id", "truth", "pred", "conf", "nth")


@query(f"""WITH {PREDS_SQL}, p(pair, t, q) AS (VALUES {', '.join(f"('{k}', {t}, {q})" for k, (t, q) in evaluation.CONFUSIONS.items())})
SELECT pair, count(*) FILTER (pred = q) AS n, round(avg((pred = q)::INT), 6) AS rate FROM preds JOIN p ON truth = t GROUP BY pair""")
def ablation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the confusions that matter."""
    return evaluation.confusion_pairs(predictions(spark, sf_dir)).select("pair", "n", _r("rate").alias("rate"))


_ROUTED = f"""{PREDS_SQL}, st AS (SELECT doc_id, truth, pred % 2 = 0 AS s1_background, bg_proba AS s1_conf, (pred % 3 + 1)::INT AS s2_class, conf AS s2_conf FROM preds), routed AS (
  SELECT *, s1_background AND s1_conf < 0.7 AS uncertain, NOT s1_background OR (s1_background AND s1_conf < 0.7 AND s2_conf >= 0.5) AS second FROM st
), ro AS (SELECT doc_id, truth, uncertain, CASE WHEN second THEN s2_class ELSE 0 END AS pred, CASE WHEN second THEN s2_conf ELSE s1_conf END AS conf FROM routed)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    stages = p.select("doc_id", "truth", (F.col("pred") % 2 == 0).alias("s1_background"), F.col("bg_proba").alias("s1_conf"), (F.col("pred") % 3 + 1).alias("s2_class"), F.col("conf").alias("s2_conf"))
    return evaluation.route(stages)


@query(f"WITH {_ROUTED} SELECT doc_id, pred, conf, uncertain FROM ro")
def two_stage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions after the two stages."""
    return _routed(spark, sf_dir).select("doc_id", F.col("pred").cast("int").alias("pred"), "conf", "uncertain")


@query(f"""WITH {_ROUTED}, u AS (SELECT *, CASE WHEN pred = truth AND truth > 0 THEN conf END AS hit FROM ro WHERE uncertain)
SELECT truth, count(*) AS n_routed, count(hit) AS n_recovered, count(*) FILTER (pred > 0 AND pred <> truth) AS n_wrong, count(*) FILTER (pred = 0) AS n_rejected,
round(quantile_cont(hit, 0.25), 6) AS q25, round(quantile_cont(hit, 0.5), 6) AS q50, round(quantile_cont(hit, 0.75), 6) AS q75 FROM u GROUP BY truth""")
def safety_net_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the rows that the safety net sent on."""
    found = evaluation.safety_net(_routed(spark, sf_dir))
    return found.select("truth", "n_routed", "n_recovered", "n_wrong", "n_rejected", *[_r(k).alias(k) for k in ("q25", "q50", "q75")])


@query(f"""WITH {_ROUTED} SELECT truth, count(*) AS n, count(*) FILTER (pred = 0 AND NOT uncertain) AS n_hard, count(*) FILTER (pred = 0) AS n_missed,
round(count(*) FILTER (pred = 0 AND NOT uncertain) / count(*), 6) AS hard_rate FROM ro WHERE truth > 0 GROUP BY truth""")
def miss_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that were missed, and those missed with confidence."""
    return evaluation.miss_rates(_routed(spark, sf_dir)).select("truth", "n", "n_hard", "n_missed", _r("hard_rate").alias("hard_rate"))


@query(f"""WITH {PREDS_SQL}, s AS (SELECT doc_id, pred, conf * 8 AS xy, CASE WHEN doc_id % 5 > 0 THEN bg_proba * 3 END AS zag, conf * 3 AS zr FROM preds)
SELECT doc_id, pred, CASE WHEN (pred = 3 AND (xy > 1.4 OR coalesce(zag, 999) < 0.7 OR zr > 2.2)) OR (pred = 1 AND (xy > 2.6 OR xy < 0.8 OR coalesce(zag, 999) < 0.7 OR zr > 2.2))
OR (pred = 2 AND (xy > 7 OR coalesce(zag, 999) < 0.5 OR zr > 2.3)) THEN 0 ELSE pred END AS final FROM s""")
def sanity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes after the physical limits."""
    zag = F.when(F.col("doc_id") % 5 > 0, F.col("bg_proba") * 3)
    final = evaluation.sanity_demotion(F.col("pred"), F.col("conf") * 8, zag, F.col("conf") * 3)
    return predictions(spark, sf_dir).select("doc_id", "pred", final.cast("int").alias("final"))


@query("""SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(list_sort(list(value))[1 + floor(0.95::DOUBLE * (count(*) - 1))::BIGINT], 6) AS p95,
round(max(value), 6) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long stages took; here an event's value is its time, its type the stage."""
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    found = latency.summary(times, ["stage"])
    return found.select("stage", "n", *[_r(k).alias(k) for k in ("mean", "median", "p95", "most")])


@query("""WITH t AS (SELECT DISTINCT ts FROM events), d AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS d FROM t) SELECT round(median(d) / 1000000, 6) AS dt FROM d""")
def frame_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median time between frames."""
    stamps = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts").distinct()
    return tracks.median_step(stamps, F.unix_micros(F.col("ts").cast("timestamp"))).select(_r(F.col("dt") / 1_000_000).alias("dt"))


@query(f"""WITH {DETECTIONS_SQL}, p AS (SELECT a.det_id, b.det_id AS track_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM detections a JOIN detections b ON b.frame_id = a.frame_id - 1
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 2.0), k AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY d, track_id) AS nth FROM p)
SELECT det_id, track_id, round(d, 6) AS distance FROM k WHERE nth = 1""")
def nearest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's nearest one of the frame before, within 2 m."""
    d = detections(spark, sf_dir)
    before = d.select(F.col("det_id").alias("track_id"), (F.col("frame_id") + 1).alias("frame_id"), "x", "y", "z", "class_label")
    return tracks.nearest(d, before, 2.0).select("det_id", "track_id", _r("distance").alias("distance"))


@query(f"""WITH {DETECTIONS_SQL}, s(v) AS (VALUES (0.5::DOUBLE + 10.0::DOUBLE * 0.01::DOUBLE + 0.5::DOUBLE + 0.3::DOUBLE)), e AS (
SELECT a.det_id, b.det_id AS track_id, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / v AS d2 FROM s, detections a JOIN detections b ON b.frame_id = a.frame_id - 1 AND a.class_label = b.class_label)
SELECT det_id, track_id, round(sqrt(d2), 6) AS cost FROM e WHERE d2 <= 7.81""")
def gating_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a new track and a detection of the next frame that pass the gate, with their cost."""
    d = detections(spark, sf_dir)
    before = d.select(F.col("det_id").alias("track_id"), (F.col("frame_id") + 1).alias("frame_id"), "x", "y", "z", "class_label")
    return tracks.gated(d, before, tracker.first_innovation(0.1)).select("det_id", "track_id", _r("cost").alias("cost"))


#: Gates join detections of one class and of near places, so edges are dealt out by class and by bands of so many metres.
BAND, BANDS = 64.0, ("class_label", "band")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, det_id, track_id, cost of :func:`gating_edges`, with the detection's class and band."""
    d = detections(spark, sf_dir)
    before = d.select(F.col("det_id").alias("track_id"), (F.col("frame_id") + 1).alias("frame_id"), "x", "y", "z", "class_label")
    found = tracks.gated(d, before, tracker.first_innovation(0.1), keep=("frame_id", "class_label", "y"))
    return found.select("frame_id", "det_id", "track_id", _r("cost").alias("cost"), "class_label", F.floor(F.col("y") / BAND).alias("band"))


@query(f"""WITH RECURSIVE {DETECTIONS_SQL}, s(v) AS (VALUES (0.5::DOUBLE + 10.0::DOUBLE * 0.01::DOUBLE + 0.5::DOUBLE + 0.3::DOUBLE)), e AS (
  SELECT 2 * a.det_id AS d, 2 * b.det_id + 1 AS t FROM s, detections a JOIN detections b ON b.frame_id = a.frame_id - 1 AND a.class_label = b.class_label
  WHERE ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / v <= 7.81
), l AS (SELECT d AS a, t AS b FROM e UNION ALL SELECT t, d FROM e), n AS (SELECT DISTINCT a AS id FROM l), c(id, least) USING KEY (id) AS (
  SELECT id, id FROM n
  UNION
  (SELECT DISTINCT ON (u.id) u.id, v.least FROM recurring.c u JOIN l ON u.id = l.a JOIN c v ON l.b = v.id WHERE v.least < u.least ORDER BY u.id, v.least)
), k AS (
  SELECT least, count(*) FILTER (id % 2 = 0) AS n_detections, count(*) FILTER (id % 2 = 1) AS n_tracks, min(id // 2) FILTER (id % 2 = 0) AS first_det FROM c GROUP BY least
), m AS (
  SELECT c.least, count(*) AS n_edges FROM e JOIN c ON c.id = e.d GROUP BY c.least
) SELECT first_det, n_detections, n_tracks, n_edges FROM k JOIN m USING (least)""")
def gate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected groups of detections and tracks that gates join, by their first detection."""
    found = assignment.members(_gated(spark, sf_dir), by=BANDS).groupBy("group_node")
    return found.agg(F.min("det_id").alias("first_det"), F.count("det_id").alias("n_detections"), F.count_distinct(F.when(F.col("det_id").isNull(), F.col("node"))).alias("n_tracks"), F.sum("n_edges").alias("n_edges")).drop("group_node")


@query()
def assigned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and tracks that are paired: as many as gates allow, at the least total cost, group by group."""
    return assignment.assigned(_gated(spark, sf_dir), by=BANDS).select("frame_id", "det_id", "track_id", "cost")


@query(f"""WITH RECURSIVE {DETECTIONS_SQL}, o AS (SELECT frame_id, avg(x) AS v, row_number() OVER (ORDER BY frame_id) AS k FROM detections GROUP BY frame_id), f AS (
  SELECT k, frame_id, v AS p, 0.0::DOUBLE AS s, 0.5::DOUBLE AS a, 0.0::DOUBLE AS b, 10.0::DOUBLE AS c FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, o.frame_id, pp + (pa / (pa + 0.3)) * (o.v - pp), s + (pb / (pa + 0.3)) * (o.v - pp), pa - pa * pa / (pa + 0.3), pb - pa * pb / (pa + 0.3), pc - pb * pb / (pa + 0.3)
  FROM (SELECT *, p + s * 0.1 AS pp, a + 2 * 0.1 * b + 0.01 * c + 0.5 AS pa, b + 0.1 * c AS pb, c + 2.0 AS pc FROM f) g JOIN o ON o.k = g.k + 1
) SELECT frame_id, round(p, 4) AS position, round(s, 4) AS velocity FROM f""")
def kalman_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track through the mean detection of each frame, along x."""
    observed = detections(spark, sf_dir).groupBy("frame_id").agg(F.avg("x").alias("x"))
    state = tracks.filter_along(observed.withColumn("track_id", F.lit(0)), 0.1)
    return state.select("frame_id", _r("position", 4).alias("position"), _r("velocity", 4).alias("velocity"))


#: Events are dealt to so many sensors; at sf0.1 a frame then has about as many detections as a street scene.
SENSORS = 16
#: Frames behind the last one, more than any track outlives.
SILENT = 5


def _sensor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.select((F.col("det_id") % SENSORS).alias("sensor_id"), "frame_id", "det_id", "x", "y", "z", "class_label", F.lit(0.9).alias("class_confidence"), F.lit(100).cast("bigint").alias("n_points"))


@query()
def track_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of every sensor, all frames at once."""
    return tracker.track(_sensor_frames(spark, sf_dir))


@query()
def track_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks from a stream of frames, run to its end."""
    return tracker.track_streamed(_sensor_frames(spark, sf_dir))


@query()
def track_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks from a stream with timers, with the misses behind each sensor's last frame, by which all of them die."""
    frames = _sensor_frames(spark, sf_dir)
    last = frames.agg(F.max("frame_id")).first()[0] or 0
    return timed.track_timed_streamed(frames, last + SILENT)


@query()
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique tracks, and confirmed ones in the last frame by class."""
    return tracks.summary(tracker.track(_sensor_frames(spark, sf_dir)))


_GATE_SQL = f"""{DETECTIONS_SQL}, s(v) AS (VALUES (0.5::DOUBLE + 10.0::DOUBLE * 0.01::DOUBLE + 0.5::DOUBLE + 0.3::DOUBLE)), e AS (
SELECT DISTINCT a.det_id FROM s, detections a JOIN detections b ON b.frame_id = a.frame_id - 1 AND a.class_label = b.class_label WHERE ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / v <= 7.81)"""


@query(f"WITH {_GATE_SQL} SELECT det_id, frame_id, class_label FROM detections WHERE det_id NOT IN (SELECT det_id FROM e)")
def unmatched_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that no track of the frame before may take: they start tracks."""
    return detections(spark, sf_dir).join(gating_edges(spark, sf_dir), "det_id", "left_anti").select("det_id", "frame_id", "class_label")


@query(f"WITH {DETECTIONS_SQL}, c(class_label) AS (VALUES ('bicyclist'), ('car'), ('pedestrian')) SELECT frame_id, {', '.join(f"count(*) FILTER (class_label = '{k}') AS n_{k}" for k in ('bicyclist', 'car', 'pedestrian'))} FROM detections GROUP BY frame_id")
def frame_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of each frame by class."""
    by = [F.count_if(F.col("class_label") == k).alias(f"n_{k}") for k in ("bicyclist", "car", "pedestrian")]
    return detections(spark, sf_dir).groupBy("frame_id").agg(*by)


@query(f"""WITH {PREDS_SQL}, k AS (
SELECT 'wrong' AS bucket, doc_id, (row_number() OVER (PARTITION BY truth, pred ORDER BY conf DESC, doc_id))::INT AS nth, 40 AS most FROM preds WHERE truth <> pred
UNION ALL SELECT 'unsure', doc_id, (row_number() OVER (PARTITION BY truth ORDER BY conf, doc_id))::INT, 40 FROM preds WHERE truth = pred
UNION ALL SELECT 'sure', doc_id, (row_number() OVER (PARTITION BY truth ORDER BY conf DESC, doc_id))::INT, 10 FROM preds WHERE truth = pred)
SELECT bucket, doc_id, nth FROM k WHERE nth <= most""")
def visual_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an error analysis shows: confident errors, unsure hits and sure hits."""
    p = predictions(spark, sf_dir)
    buckets = {"wrong": evaluation.top_misclassified, "unsure": evaluation.least_confident, "sure": evaluation.most_confident}
    out = None
    for name, f in buckets.items():
        rows = f(p).select(F.lit(name).alias("bucket"), "doc_id", "nth")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {PREDS_SQL} SELECT doc_id, truth FROM preds ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows drawn without replacement by a seeded hash."""
    key = F.md5(F.concat_ws(":", F.lit(42), F.col("doc_id").cast("string")))
    return predictions(spark, sf_dir).orderBy(key, "doc_id").limit(100).select("doc_id", "truth")


@query()
def track_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tracks of each sensor's last frame, as a viewer lists them."""
    rows = tracker.track(_sensor_frames(spark, sf_dir))
    last = rows.withColumn("last", F.max("frame_id").over(Window.partitionBy("sensor_id"))).where("frame_id = last").drop("last")
    return views.track_list(last)
