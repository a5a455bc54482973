"""Queries: Structured Streaming over the events, and round trips through sinks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import scalar as s
from curata.operators import folds
from curata.plans import detection, streams
from curata.plans import views as v
from curata.plans.registry import ORACLES, query
from curata.session import shared_dir
from curata.sources import frames, readers, sinks
from curata.streaming import stateful

#: Bytes of files in a micro-batch, about: each batch opens and commits every state store, so their number must not be that of the files.
PER_BATCH = 256 << 20
DAY = 86400


def _events(spark, sf_dir):
    """The events as a stream of files."""
    table = v.table(spark, sf_dir, "events")
    return spark.readStream.schema(table.schema).option("maxBytesPerTrigger", PER_BATCH).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file


def _predictions(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("time"), F.col("event_type").alias("label"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("confidence"))


@query("""WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT epoch(window_start)::BIGINT AS start, event_type, n FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_daily_counts(spark, sf_dir):
    """Days that the watermark has closed."""
    d = stateful.run_to_table(stateful.windowed_counts(_events(spark, sf_dir), "ts", ["event_type"]), "daily")
    return d.select(F.col("window_start").cast("long").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM o), g AS (SELECT user_id, k, min(ts) AS a, max(ts) + INTERVAL 2 DAY AS b, count(*) AS n FROM r GROUP BY user_id, k)
SELECT user_id, round(epoch(a), 3) AS start, round(epoch(b), 3) AS stop, n FROM g WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf_dir):
    """Sessions of a user that end after two days without an event, as far as the watermark has closed them."""
    d = stateful.run_to_table(stateful.session_windows(_events(spark, sf_dir), "ts", ["user_id"], "2 days"), "sessions")
    return d.select("user_id", F.round(F.col("session_start").cast("double"), 3).alias("start"), F.round(F.col("session_end").cast("double"), 3).alias("stop"), "n")


@query(ORACLES["stabilized"])
def stream_stabilized(spark, sf_dir):
    """The fold of ``stabilized`` with its state kept by a stream."""
    d = stateful.run_to_table(stateful.fold_stream(_predictions(spark, sf_dir), streams.KEY, streams.ORDER, folds.Stabilizer), "stabilized")
    return d.select("session", "seq", "stable_label", "majority", "is_locked", "lock_count", F.round("ema", 8).alias("ema"), "is_uncertain")


def _box_stream(spark, sf_dir):
    table = v.table(spark, sf_dir, "lineitem")
    return detection.track_rows(spark, sf_dir, spark.readStream.schema(table.schema).option("maxBytesPerTrigger", PER_BATCH).parquet(f"{sf_dir}/lineite[m].parquet"))


@query(ORACLES["tracked_boxes"])
def stream_tracks(spark, sf_dir):
    """The tracks of ``tracked_boxes``, with the live ones of each session kept by a stream."""
    return stateful.run_to_table(stateful.track_stream(_box_stream(spark, sf_dir), keep=["session", "frame", "box_id"]), "tracks")


@query(f"""WITH RECURSIVE {detection.TRACKS}, spans AS (SELECT session, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_boxes FROM g WHERE r > 0 GROUP BY session, track_id)
SELECT * FROM spans WHERE last_frame + 16 <= (SELECT max(frame) FROM t)""")
def stream_ended_tracks(spark, sf_dir):
    """Tracks that event-time timers have ended, a frame being a second: no box for 16 frames."""
    timed = _box_stream(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("frame") + DAY))  # the first watermark is the epoch
    d = stateful.run_to_table(stateful.ended_tracks(timed, "at", 16.0), "ended")
    frame = lambda c: F.col(c).cast("long") - DAY
    return d.select("session", "track_id", frame("first_seen").alias("first_frame"), frame("last_seen").alias("last_frame"), "n_boxes")


@query(ORACLES["motion_gate"])
def stream_motion(spark, sf_dir):
    """The rows of ``motion_gate``, from a stream that keeps the last level of each session."""
    p = _predictions(spark, sf_dir).withColumn("level", F.col("confidence") * 255)
    return stateful.run_to_table(stateful.fold_stream(p, streams.KEY, streams.ORDER, folds.MotionGate), "motion").select("session", "seq", "moved")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_events(spark, sf_dir):
    """One event of each user and type within the watermark, which spans the table."""
    d = stateful.run_to_table(stateful.drop_repeats(_events(spark, sf_dir), "ts", ["user_id", "event_type"], "3650 days"), "firsts")
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_joined(spark, sf_dir):
    """Clicks with purchases of their user within a day."""
    e = _events(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.col("event_id").alias("click"))
    bought = _events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase"))
    return stateful.run_to_table(stateful.join_streams(clicks, bought, ["user_id"], "clicked", "bought", "1 day"), "joined").select("click", "purchase")


@query(f"WITH {v.PRED} SELECT session, count(*) AS n, round(avg(confidence), 8) AS avg_confidence FROM pred GROUP BY session")
def session_log_totals(spark, sf_dir):
    """A log written batch by batch, and its totals by session."""
    log, summary = shared_dir(spark, "log"), shared_dir(spark, "summary")
    sinks.session_log(_predictions(spark, sf_dir), log, summary, shared_dir(spark, "log-checkpoint")).awaitTermination()
    return sinks.session_totals(spark, summary).withColumn("avg_confidence", F.round("avg_confidence", 8))


@query("""SELECT page_id, strlen(coalesce(html, '')) AS n_bytes, sha256(coalesce(html, '')) AS digest, 'device' || page_id % 4 AS device FROM pages""")
def streamed_frames(spark, sf_dir):
    """Pages written as frame logs of four devices, whose time is the page's number, and streamed back by the frame source."""
    folder = shared_dir(spark, "frame-log")
    p = v.table(spark, sf_dir, "pages")
    shots = p.select(F.concat(F.lit("device"), (F.col("page_id") % 4).cast("string")).alias("device"), F.timestamp_micros("page_id").alias("time"), F.col("html").cast("binary").alias("bytes"))
    # a segment is one task's work: about 1000 frames
    frames.write_frames(shots, folder, segments=p.count() // 4000 + 1).write.format("noop").mode("overwrite").save()
    d = stateful.run_to_table(frames.frame_log(spark, folder), "frames")
    return d.select(F.unix_micros("time").alias("page_id"), F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("digest"), "device")


@query(f"WITH {v.MANIFEST} SELECT image_id, image_path, fruit_type, freshness_label, physical_fruit_id, capture_session_id, capture_timestamp, trim(camera_id) AS camera_id, days_since_purchase, annotation_confidence, '' AS annotator FROM m")
def manifest_round_trip(spark, sf_dir):
    """A manifest written as CSV and read again; columns that it lacks are empty."""
    path = shared_dir(spark, "manifest")
    sinks.write_manifest_csv(v.manifest_rows(spark, sf_dir), path)
    names = ["image_id", "image_path", "fruit_type", "freshness_label", "physical_fruit_id", "capture_session_id", "capture_timestamp", "camera_id", "days_since_purchase", "annotation_confidence", "annotator"]
    return readers.manifest_csv(spark, path).select(*names).withColumn("camera_id", F.trim("camera_id"))


@query(f"""WITH {v.BOXES}, y AS (SELECT CASE frame % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, 'img' || frame % 25 AS stem, row_number() OVER (PARTITION BY frame % 3, frame % 25 ORDER BY box_id, frame) AS line_no,
printf('%d %.6f %.6f %.6f %.6f', box_id % 9, (x1 + x2) / 2.0::DOUBLE / 300.0, (y1 + y2) / 2.0::DOUBLE / 250.0, (x2 - x1) / 300.0::DOUBLE, (y2 - y1) / 250.0::DOUBLE) AS raw FROM t) SELECT split, stem, line_no, raw FROM y""")
def label_file_round_trip(spark, sf_dir):
    """Boxes written as label files and their lines read again."""
    from pyspark.sql import Window

    t = v.truth_boxes(spark, sf_dir)
    f = F.col("frame")
    y = s.to_yolo(s.box("x1", "y1", "x2", "y2"), F.lit(300.0), F.lit(250.0)).alias("y")
    rows = t.select(F.when(f % 3 == 0, "train").when(f % 3 == 1, "valid").otherwise("test").alias("split"), F.concat(F.lit("img"), (f % 25).cast("string")).alias("stem"), "box_id", f, (F.col("box_id") % 9).alias("class_id"), y).select("*", "y.*")
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("split", "stem").orderBy("box_id", "frame")))
    path = shared_dir(spark, "labels")
    sinks.write_label_lines(rows, path)
    parts = F.split("file", "/")
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    lines = text.select(*[F.regexp_replace(F.element_at(parts, at), "^.*=", "").alias(c) for at, c in ((-3, "split"), (-2, "stem"))], F.posexplode(F.split("value", "\n")).alias("at", "raw"))
    return lines.filter("raw <> ''").select("split", "stem", (F.col("at") + 1).cast("long").alias("line_no"), "raw")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def dataset_round_trip(spark, sf_dir):
    """A partitioned dataset written, read and counted."""
    path = shared_dir(spark, "dataset")
    sinks.write_dataset(v.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), path, "lang")
    return spark.read.parquet(path).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
