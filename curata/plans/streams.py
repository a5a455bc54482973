"""Queries: ordered prediction streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import folds, frames
from curata.plans import views as v
from curata.plans.registry import query

KEY, ORDER = ["session"], ["time", "seq"]
W = "PARTITION BY session ORDER BY time, seq"


def _majority(window: int) -> str:
    """The most frequent label of the last rows, of equals the first in the window."""
    return (
        f"l AS (SELECT *, list(label) OVER ({W} ROWS {window - 1} PRECEDING) AS seen FROM pred), "
        "mj AS (SELECT *, list_sort(list_transform(list_distinct(seen), lambda x: {'n': -len(list_filter(seen, lambda y: y = x)), 'at': list_position(seen, x), 'label': x}))[1] AS top FROM l)"
    )


@query(f"""WITH {v.PRED}, {_majority(5)}
SELECT session, seq, top.label AS majority, len(seen)::INT AS window_size, -top.n::DOUBLE / len(seen) AS consistency, -top.n::DOUBLE / len(seen) >= 0.6 AS consistent,
  round(avg(confidence) OVER ({W} ROWS 4 PRECEDING), 8) AS mean_confidence, min(confidence) OVER ({W} ROWS 4 PRECEDING) AS min_confidence, max(confidence) OVER ({W} ROWS 4 PRECEDING) AS max_confidence
FROM mj""")
def vote_windows(spark, sf_dir):
    d = frames.vote(v.predictions(spark, sf_dir), KEY, ORDER)
    return d.select("session", "seq", "majority", "window_size", "consistency", "consistent", F.round("mean_confidence", 8).alias("mean_confidence"), "min_confidence", "max_confidence")


EMA = f"""x AS (SELECT *, list(confidence) OVER ({W} ROWS UNBOUNDED PRECEDING) AS c FROM pred),
em AS (SELECT session, seq, time, label, confidence, list_reduce(c, lambda a, b: 0.2::DOUBLE * b + (1.0::DOUBLE - 0.2::DOUBLE) * a) AS ema FROM x)"""


@query(f"WITH {v.PRED}, {EMA} SELECT session, seq, round(ema, 8) AS ema FROM em")
def ema_confidence(spark, sf_dir):
    return frames.ema(v.predictions(spark, sf_dir), KEY, ORDER).select("session", "seq", F.round("ema", 8).alias("ema"))


@query(f"""WITH RECURSIVE {v.PRED}, {_majority(15)}, {EMA},
n AS (SELECT session, seq, label, row_number() OVER ({W}) AS r FROM pred),
f AS (
  SELECT session, seq, r, label AS locked, 0 AS cnt, false AS pending FROM n WHERE r = 1
  UNION ALL
  SELECT n.session, n.seq, n.r, CASE WHEN n.label <> f.locked AND f.cnt + 1 >= 5 THEN n.label ELSE f.locked END,
         CASE WHEN n.label = f.locked OR f.cnt + 1 >= 5 THEN 0 ELSE f.cnt + 1 END, n.label <> f.locked AND f.cnt + 1 < 5
  FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1)
SELECT f.session, f.seq, CASE WHEN f.pending THEN f.locked ELSE mj.top.label END AS stable_label, mj.top.label AS majority, f.pending AS is_locked, f.cnt::INT AS lock_count,
       round(em.ema, 8) AS ema, em.ema < 0.7 AS is_uncertain
FROM f JOIN mj ON f.seq = mj.seq JOIN em ON f.seq = em.seq""")
def stabilized(spark, sf_dir):
    """EMA, majority of 15 and a lock of 5 frames, in one pass over each session."""
    d = folds.fold_batch(v.predictions(spark, sf_dir), KEY, ORDER, folds.Stabilizer)
    return d.select("session", "seq", "stable_label", "majority", "is_locked", "lock_count", F.round("ema", 8).alias("ema"), "is_uncertain")


def _fold(extra: str, state: str, seed: str, step: str, gives: str) -> str:
    """SQL of a fold: rows ``n`` (with r, their number in a session) go one by one through ``step`` over the state ``f``."""
    return f"""WITH RECURSIVE {v.PRED}, n AS (SELECT *{extra}, row_number() OVER ({W}) AS r FROM pred),
f AS (
  SELECT session, 0::BIGINT AS r, NULL::BIGINT AS seq, {seed} FROM (SELECT DISTINCT session FROM n)
  UNION ALL
  SELECT session, r, seq, {state} FROM ({step}))
SELECT session, seq, {gives} FROM f WHERE r > 0"""


@query(_fold(
    "", "CASE WHEN far THEN smooth ELSE coalesce(smooth + (v - smooth) / 3.0::DOUBLE, v) END AS smooth, CASE WHEN far THEN ring ELSE list_append(ring, v)[-5:] END AS ring, far, v",
    "NULL::DOUBLE AS smooth, []::DOUBLE[] AS ring, false AS far, 0.0::DOUBLE AS v",
    """SELECT n.session, n.r, n.seq, f.smooth, f.ring, n.confidence::DOUBLE AS v,
    len(f.ring) > 1 AND coalesce(list_aggregate(f.ring, 'var_pop'), 0) > 1e-18 AND pow(n.confidence - list_avg(f.ring), 2) > 4 * list_aggregate(f.ring, 'var_pop') AS far FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1""",
    "round(CASE WHEN len(ring) < 3 THEN v ELSE smooth END, 8) AS smoothed, far AS is_outlier",
))
def smoothed_confidence(spark, sf_dir):
    """Outlier-rejecting EMA: what is accepted depends on what was."""
    d = folds.fold_batch(v.predictions(spark, sf_dir), KEY, ORDER, folds.OutlierSmoother)
    return d.select("session", "seq", F.round("smoothed", 8).alias("smoothed"), "is_outlier")


@query(_fold(
    ", seq % 3 > 0 AS ok", "CASE WHEN NOT due OR right_mean IS NULL OR wrong_mean IS NULL OR len(seen) < 10 THEN th WHEN right_mean < th THEN greatest(0.3, th - 0.01) WHEN wrong_mean > th THEN least(0.9, th + 0.01) ELSE th END AS th, CASE WHEN due THEN time ELSE last END AS last, seen, c",
    "0.5::DOUBLE AS th, NULL::DOUBLE AS last, []::STRUCT(c DOUBLE, ok BOOLEAN)[] AS seen, 0.0::DOUBLE AS c",
    """SELECT *, list_avg(list_transform(list_filter(seen, lambda x: x.ok), lambda x: x.c)) AS right_mean, list_avg(list_transform(list_filter(seen, lambda x: NOT x.ok), lambda x: x.c)) AS wrong_mean
    FROM (SELECT n.session, n.r, n.seq, f.th, f.last, n.time, n.confidence::DOUBLE AS c, list_append(f.seen, {'c': n.confidence::DOUBLE, 'ok': n.ok})[-20:] AS seen, f.last IS NULL OR n.time - f.last >= 5 AS due FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1)""",
    "round(th, 8) AS threshold, round(list_avg(list_transform(seen, lambda x: x.c)), 8) AS mean_confidence, round(list_avg(list_transform(seen, lambda x: x.ok::INT)), 8) AS accuracy",
))
def adaptive_threshold(spark, sf_dir):
    d = v.predictions(spark, sf_dir).withColumn("is_correct", F.col("seq") % 3 > 0)
    found = folds.fold_batch(d, KEY, ORDER, folds.AdaptiveThreshold)
    return found.select("session", "seq", *[F.round(c, 8).alias(c) for c in ("threshold", "mean_confidence", "accuracy")])


@query(_fold(
    ", time / 500000 AS t", """CASE WHEN go THEN t ELSE last END AS last,
    CASE rule WHEN 'soon' THEN steady WHEN 'steady' THEN steady + 1 WHEN 'settled' THEN CASE WHEN go THEN 0 ELSE steady + 1 END ELSE 0 END AS steady, CASE WHEN rule = 'new' THEN label ELSE known END AS known, go""",
    "NULL::DOUBLE AS last, 0 AS steady, NULL::VARCHAR AS known, false AS go",
    """SELECT *, rule <> 'soon' AND (rule <> 'settled' OR since >= 200) AS go FROM (SELECT *, CASE WHEN since < 100 THEN 'soon' WHEN since >= 1000 THEN 'overdue' WHEN confidence < 0.7 THEN 'unsure' WHEN label IS NOT NULL AND label IS DISTINCT FROM known THEN 'new' WHEN steady + 1 >= 3 THEN 'settled' ELSE 'steady' END AS rule
    FROM (SELECT n.session, n.r, n.seq, n.t, n.label, n.confidence, f.last, f.steady, f.known, coalesce((n.t - f.last) * 1000.0, 1e300) AS since FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1))""",
    "go AS classify",
))
def cadence(spark, sf_dir):
    d = v.predictions(spark, sf_dir).withColumn("time", F.col("time") / 500000)  # intervals of some tenths of a second
    return folds.fold_batch(d, KEY, ORDER, folds.Cadence).select("session", "seq", "classify")


@query(_fold(
    ", seq % 10 / 10.0::DOUBLE AS classifier", "CASE WHEN fused < 0.5 AND known IS NOT NULL THEN known ELSE label END AS known, time AS last, fused, change",
    "NULL::VARCHAR AS known, NULL::DOUBLE AS last, 0.0::DOUBLE AS fused, 0.0::DOUBLE AS change",
    """SELECT *, least(1.0, greatest(0.0, 0.3::DOUBLE * confidence + 0.7::DOUBLE * classifier + change)) AS fused
    FROM (SELECT n.session, n.r, n.seq, n.time, n.label, n.confidence, n.classifier, f.known, CASE WHEN f.last IS NULL THEN 0.0 WHEN n.label = f.known THEN 0.05::DOUBLE * greatest(0.0, 1.0 - (n.time - f.last)) ELSE -0.3::DOUBLE END AS change FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1)""",
    "known AS fused_label, round(fused, 8) AS fused, round(change, 8) AS bonus",
))
def stable_fusion(spark, sf_dir):
    d = v.predictions(spark, sf_dir).withColumns({"detector": F.col("confidence"), "classifier": (F.col("seq") % 10) / 10.0})
    found = folds.fold_batch(d, KEY, ORDER, folds.StableFusion)
    return found.select("session", "seq", "fused_label", F.round("fused", 8).alias("fused"), F.round("bonus", 8).alias("bonus"))


@query(_fold(
    ", seq % 60 AS x", "CASE WHEN steady >= 2 THEN NULL ELSE label END AS known, CASE WHEN steady >= 2 THEN NULL ELSE x END AS place, CASE WHEN steady >= 2 THEN 0 ELSE steady END AS count, steady",
    "NULL::VARCHAR AS known, NULL::DOUBLE AS place, 0 AS count, 0 AS steady",
    """SELECT n.session, n.r, n.seq, n.label, n.x::DOUBLE AS x, CASE WHEN n.label = f.known AND sqrt(2 * pow(n.x - f.place, 2)) <= 0.2::DOUBLE * sqrt(20000::DOUBLE) THEN f.count + 1 ELSE 1 END AS steady
    FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1""",
    "steady >= 2 AS capture, steady::INT AS steady",
))
def capture_gate(spark, sf_dir):
    p = F.col("seq") % 60
    d = v.predictions(spark, sf_dir).withColumns({"x1": p, "y1": p, "x2": p + 100, "y2": p + 100})
    return folds.fold_batch(d, KEY, ORDER, lambda: folds.CaptureGate(frames=2)).select("session", "seq", "capture", "steady")


@query(_fold(
    "", "CASE WHEN due THEN time ELSE last END AS last, due", "NULL::DOUBLE AS last, false AS due",
    "SELECT n.session, n.r, n.seq, n.time, f.last, f.last IS NULL OR n.time - f.last >= 432000 AS due FROM f JOIN n ON n.session = f.session AND n.r = f.r + 1", "due AS passes",
))
def rate_limited(spark, sf_dir):
    """At most one row of a session in five days."""
    return folds.fold_batch(v.predictions(spark, sf_dir), KEY, ORDER, lambda: folds.RateLimit(432000.0)).select("session", "seq", "passes")


@query(f"""WITH {v.PRED}, i AS (SELECT *, time - lag(time) OVER ({W}) AS itv FROM pred)
SELECT session, seq, round(itv, 3) AS "interval", round(1.0 / nullif(avg(itv) OVER ({W} ROWS 29 PRECEDING), 0), 9) AS fps, round(1.0 / nullif(max(itv) OVER ({W} ROWS 29 PRECEDING), 0), 9) AS min_fps FROM i""")
def rolling_rate(spark, sf_dir):
    d = frames.rolling_rate(v.predictions(spark, sf_dir), KEY, ORDER, "time")
    return d.select("session", "seq", F.round("interval", 3).alias("interval"), F.round("fps", 9).alias("fps"), F.round("min_fps", 9).alias("min_fps"))


@query(f"WITH {v.PRED}, c AS (SELECT session, coalesce(label <> lag(label) OVER ({W}), false)::INT AS c FROM pred) SELECT session, count(*) AS n_rows, sum(c)::BIGINT AS n_switches FROM c GROUP BY session")
def transitions(spark, sf_dir):
    return frames.transitions(v.predictions(spark, sf_dir), KEY, ORDER)


@query(f"WITH {v.PRED} SELECT session, label, round(max(time) - min(time), 3) AS duration FROM pred GROUP BY ALL HAVING count(*) > 1")
def track_durations(spark, sf_dir):
    return frames.durations(v.predictions(spark, sf_dir), ["session", "label"], "time").withColumn("duration", F.round("duration", 3))


@query(f"""WITH {v.PRED}, s AS (SELECT *, coalesce(label <> lag(label) OVER ({W}), true)::INT AS s FROM pred),
r AS (SELECT *, sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT session, label, min(time) AS first, max(time) AS last, count(*) AS n FROM r GROUP BY session, run, label""")
def label_islands(spark, sf_dir):
    return frames.islands(v.predictions(spark, sf_dir), KEY, ORDER)


@query(f"""WITH {v.PRED}, r AS (SELECT *, row_number() OVER ({W}) AS r FROM pred), k AS (SELECT *, r = 1 OR r % 3 = 0 AS runs FROM r)
SELECT session, seq, runs, last_value(CASE WHEN runs THEN label END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS carried FROM k""")
def every_third(spark, sf_dir):
    return frames.every_nth(v.predictions(spark, sf_dir), KEY, ORDER, "label").select("session", "seq", "runs", "carried")


@query(f"WITH {v.PRED} SELECT session, seq, coalesce(abs(confidence * 255 - lag(confidence * 255) OVER ({W})) / 255.0 > 0.05, false) AS moved FROM pred")
def motion_gate(spark, sf_dir):
    d = v.predictions(spark, sf_dir).withColumn("level", F.col("confidence") * 255)
    return frames.motion_gate(d, KEY, ORDER, "level").select("session", "seq", "moved")


@query(f"""WITH {v.PRED}, l AS (SELECT session, seq, time FROM pred WHERE label = 'purchase'), r AS (SELECT session, time, max(confidence) AS confidence FROM pred WHERE label <> 'purchase' GROUP BY ALL)
SELECT l.session, l.seq, r.confidence AS asof_confidence FROM l ASOF LEFT JOIN r ON l.session = r.session AND l.time >= r.time""")
def as_of_confidence(spark, sf_dir):
    d = v.predictions(spark, sf_dir)
    left = d.filter("label = 'purchase'").select("session", "seq", "time")
    right = d.filter("label <> 'purchase'").groupBy("session", "time").agg(F.max("confidence").alias("confidence"))
    return frames.as_of(left, right, ["session"], "time", ["confidence"]).select("session", "seq", "asof_confidence")


@query(f"""WITH {v.PRED}, b AS (SELECT session, seq, 1 - confidence AS loss, row_number() OVER ({W}) AS epoch FROM pred),
i AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY session ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM b),
s AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY session ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM i),
st AS (SELECT session, min(CASE WHEN since >= 5 THEN epoch END) AS stop_epoch FROM s GROUP BY session)
SELECT s.session, max(epoch) AS best_epoch, round(min(loss), 8) AS best_loss, any_value(stop_epoch) AS stop_epoch
FROM s JOIN st USING (session) WHERE better AND (stop_epoch IS NULL OR epoch <= stop_epoch) GROUP BY s.session""")
def early_stopping(spark, sf_dir):
    from pyspark.sql import Window

    d = v.predictions(spark, sf_dir).withColumn("epoch", F.row_number().over(Window.partitionBy("session").orderBy(*ORDER)).cast("long")).withColumn("loss", 1 - F.col("confidence"))
    return frames.best_epoch(d, KEY, "epoch", "loss").withColumn("best_loss", F.round("best_loss", 8)).select("session", "best_epoch", "best_loss", "stop_epoch")


def _frames(spark, sf_dir):
    """Frames of a minute with parallel arrays of predictions, confidences and tracks."""
    d = v.predictions(spark, sf_dir).withColumns({"frame_number": F.floor(F.col("time") / 86400).cast("long"), "state": F.when(F.col("seq") % 4 == 0, "rotten").when(F.col("seq") % 4 == 1, "stale").otherwise("fresh")})
    rows = d.groupBy("session", "frame_number").agg(F.array_sort(F.collect_list(F.struct("seq", "label", "state", "confidence"))).alias("r"))
    return rows.select(
        "session", "frame_number", F.col("frame_number").cast("double").alias("timestamp"), F.transform("r", lambda x: F.struct(x["label"].alias("fruit_name"), x["state"].alias("freshness_class"))).alias("predictions"),
        F.transform("r", lambda x: x["confidence"]).alias("confidences"), F.transform("r", lambda x: x["seq"] % 3).alias("tracking_ids"), F.struct((F.col("frame_number") % 300).cast("double").alias("blur_score")).alias("quality_metrics"),
    )


@query(f"""WITH {v.PRED}, f AS (SELECT session, seq, label, confidence, floor(time / 86400)::BIGINT AS fr, CASE seq % 4 WHEN 0 THEN 'rotten' WHEN 1 THEN 'stale' ELSE 'fresh' END AS st, seq % 3 AS track FROM pred),
fr AS (SELECT session, fr, count(*) AS n, count(DISTINCT st) AS states FROM f GROUP BY ALL),
a AS (SELECT session, (max(fr) - min(fr))::DOUBLE AS duration_seconds, count(*) AS total_frames, round(avg(least(1.0, (fr % 300) / 200.0)), 6) AS avg_image_quality, count(*) FILTER (n > 1 AND states > 1) AS unstable_detections FROM fr GROUP BY session),
d AS (SELECT session, count(*) AS total_detections, count(DISTINCT track) AS unique_tracks, count(*) FILTER (st = 'fresh') AS fresh_count, count(*) FILTER (st = 'stale') AS stale_count, count(*) FILTER (st = 'rotten') AS rotten_count,
  round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, 0::BIGINT AS uncertain_count FROM f GROUP BY session),
w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY confidence, fr, seq) AS lo, row_number() OVER (PARTITION BY session ORDER BY (1 - confidence) * CASE st WHEN 'rotten' THEN 2.0::DOUBLE WHEN 'stale' THEN 1.0 ELSE 0.0 END DESC, fr, seq) AS hi FROM f),
x AS (SELECT session, max(CASE WHEN lo = 1 THEN concat_ws('/', label, st, fr) END) AS lowest, max(CASE WHEN hi = 1 THEN concat_ws('/', label, st, fr) END) AS riskiest, max(CASE WHEN hi = 1 THEN confidence END) AS riskiest_confidence FROM w GROUP BY session),
s AS (SELECT session, sum(c)::BIGINT AS class_switches FROM (SELECT session, coalesce(st <> lag(st) OVER (PARTITION BY session, track ORDER BY fr, seq), false)::INT AS c FROM f) GROUP BY session),
t AS (SELECT session, round(avg(d), 6) AS avg_track_duration FROM (SELECT session, track, (max(fr) - min(fr))::DOUBLE AS d FROM f GROUP BY ALL HAVING count(*) > 1) GROUP BY session)
SELECT * FROM a JOIN d USING (session) JOIN s USING (session) JOIN x USING (session) JOIN (SELECT session, coalesce(avg_track_duration, 0) AS avg_track_duration FROM d LEFT JOIN t USING (session)) USING (session)""")
def session_summary(spark, sf_dir):
    s = frames.session_summary(_frames(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("avg_image_quality", "avg_confidence", "avg_track_duration")}
    row = lambda c: F.concat_ws("/", f"{c}.fruit_name", f"{c}.freshness_class", F.col(f"{c}.frame_number").cast("string"))
    extremes = {"lowest": row("lowest_confidence"), "riskiest": row("highest_risk"), "riskiest_confidence": F.col("highest_risk.confidence")}
    return s.withColumns(rounded | extremes).select(
        *extremes, "uncertain_count", "session", "duration_seconds", "total_frames", "avg_image_quality", "unstable_detections", "total_detections", "unique_tracks", "fresh_count", "stale_count", "rotten_count", "avg_confidence", "min_confidence", "max_confidence", "class_switches", "avg_track_duration"
    )


@query(f"""WITH {v.PRED} SELECT session, count(*) AS n, count(DISTINCT label) AS labels, round(avg(confidence), 4) AS avg_confidence, round(avg((seq % 50)::DOUBLE), 2) AS avg_latency FROM pred GROUP BY session""")
def session_statistics(spark, sf_dir):
    return frames.session_statistics(v.predictions(spark, sf_dir).withColumn("latency", (F.col("seq") % 50).cast("double")))


@query(f"""WITH {v.PRED} SELECT 'confidence' AS metric, count(confidence) AS n, round(avg(confidence), 8) AS mean, round(stddev_pop(confidence), 8) AS std, min(confidence)::DOUBLE AS least, max(confidence)::DOUBLE AS most FROM pred
UNION ALL SELECT 'odd', count(o), round(avg(o), 8), round(stddev_pop(o), 8), min(o)::DOUBLE, max(o)::DOUBLE FROM (SELECT CASE WHEN seq % 2 = 1 THEN confidence END AS o FROM pred)""")
def diagnostics_summary(spark, sf_dir):
    d = v.predictions(spark, sf_dir).withColumn("odd", F.when(F.col("seq") % 2 == 1, F.col("confidence")))
    return frames.diagnostics_summary(d, "confidence", "odd").withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})
