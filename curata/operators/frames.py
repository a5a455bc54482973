"""Ordered prediction streams in batch: windows, session summaries, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.scalar import majority
from curata.operators.folds import Ema, fold_batch


def _rows(keys: list[str], order: list[str], before: int | None = None):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w if before is None else w.rowsBetween(-before, 0)


def vote(df: DataFrame, keys: list[str], order: list[str], label: str = "label", confidence: str = "confidence", window: int = 5, min_share: float = 0.6) -> DataFrame:
    """``df`` with majority, consistency, window_size and the confidences' mean, least and most over the last rows; ties go to
    the label that is first in the window."""
    w = _rows(keys, order, window - 1)
    df = df.withColumn("_seen", F.collect_list(label).over(w))
    df = df.withColumn("majority", majority(F.col("_seen"))).withColumn("window_size", F.size("_seen"))
    top = F.size(F.filter("_seen", lambda x: x == F.col("majority")))
    return df.withColumns(
        {"consistency": top / F.col("window_size"), "mean_confidence": F.avg(confidence).over(w), "min_confidence": F.min(confidence).over(w), "max_confidence": F.max(confidence).over(w)}
    ).withColumn("consistent", F.col("consistency") >= min_share).drop("_seen")


def ema(df: DataFrame, keys: list[str], order: list[str], value: str = "confidence", alpha: float = 0.2) -> DataFrame:
    """``df`` with ``ema``; the first value seeds it. Rows of a key are streamed through a fold, which holds one number."""
    return fold_batch(df.withColumn("_value", F.col(value)), keys, order, lambda: Ema(alpha)).drop("_value")


def rolling_rate(df: DataFrame, keys: list[str], order: list[str], time: str, window: int = 30) -> DataFrame:
    """``df`` with ``interval``, and fps (1 / mean), min_fps (1 / longest) over the last intervals; null where there is none."""
    df = df.withColumn("interval", F.col(time) - F.lag(time).over(_rows(keys, order)))
    w = _rows(keys, order, window - 1)
    return df.withColumns({"fps": F.try_divide(F.lit(1.0), F.avg("interval").over(w)), "min_fps": F.try_divide(F.lit(1.0), F.max("interval").over(w))})


def transitions(df: DataFrame, keys: list[str], order: list[str], label: str = "label") -> DataFrame:
    """(keys, n_rows, n_switches, duration is not part): how often a label differs from the one before."""
    changed = F.col(label) != F.lag(label).over(_rows(keys, order))
    return df.withColumn("_c", F.coalesce(changed, F.lit(False)).cast("int")).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("_c").alias("n_switches"))


def durations(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, duration) of keys with more than one row."""
    return df.groupBy(*keys).agg((F.max(time) - F.min(time)).alias("duration"), F.count("*").alias("n")).filter("n > 1").drop("n")


def islands(df: DataFrame, keys: list[str], order: list[str], label: str = "label") -> DataFrame:
    """(keys, label, first, last, n): runs of equal labels."""
    start = F.coalesce(F.col(label) != F.lag(label).over(_rows(keys, order)), F.lit(True)).cast("int")
    run = F.sum("_s").over(_rows(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_s", start).withColumn("_run", run)
    return marked.groupBy(*keys, "_run", label).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("_run")


def every_nth(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 3) -> DataFrame:
    """``df`` with ``runs`` (the first row and each n-th) and ``carried``: the value of the last row that ran."""
    r = F.row_number().over(_rows(keys, order))
    df = df.withColumn("runs", (r == 1) | (r % n == 0))
    w = _rows(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried", F.last(F.when(F.col("runs"), F.col(value)), ignorenulls=True).over(w))


def motion_gate(df: DataFrame, keys: list[str], order: list[str], level: str, threshold: float = 5.0) -> DataFrame:
    """``df`` with ``moved``: the level differs from the row before by more than threshold / 100 of its range of 255."""
    change = F.abs(F.col(level) - F.lag(level).over(_rows(keys, order))) / 255.0
    return df.withColumn("moved", F.coalesce(change > threshold / 100.0, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last right row at or before its time (null if none), by one window over both."""
    names = [c for c in left.columns]
    a = left.select(*names, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (*keys, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    return both.select(*names, "_side", *[F.last(f"_{v}", ignorenulls=True).over(w).alias(f"asof_{v}") for v in values]).filter("_side = 1").drop("_side")


def best_epoch(df: DataFrame, keys: list[str], epoch: str, loss: str, patience: int = 5) -> DataFrame:
    """(keys, best_epoch, best_loss, stop_epoch): stop_epoch is the first with ``patience`` epochs since the last strict
    improvement, null if there is none."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(loss) < before)
    df = df.withColumn("_better", better).withColumn("_n", F.row_number().over(w))
    since = F.col("_n") - F.max(F.when(F.col("_better"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_since", since)
    stops = F.min(F.when(F.col("_since") >= patience, F.col(epoch)))
    out = df.groupBy(*keys).agg(stops.alias("stop_epoch"))
    upto = df.join(out, keys).filter(F.col("_better") & (F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch"))))
    best = upto.groupBy(*keys).agg(F.max(epoch).alias("best_epoch"), F.min(loss).alias("best_loss"))
    return best.join(out, keys)


def risk(label: Column, confidence: Column) -> Column:
    """(1 - confidence) weighted by state."""
    return (1 - confidence) * F.when(label == "rotten", 2.0).when(label == "stale", 1.0).otherwise(0.0)


def explode_frames(frames: DataFrame) -> DataFrame:
    """One row a prediction from frames with parallel arrays; a missing confidence is 0."""
    keep = ["session", "frame_number", "timestamp"]
    each = frames.select(*keep, F.posexplode("predictions").alias("pos", "prediction"), "confidences", "tracking_ids")
    return each.select(*keep, "pos", "prediction.*", F.coalesce(F.get("confidences", F.col("pos")), F.lit(0.0)).alias("confidence"), F.get("tracking_ids", F.col("pos")).alias("track_id"))


def session_summary(frames: DataFrame) -> DataFrame:
    """One row a session: frames, detections, tracks, states, confidences, quality, switches and the two extreme rows. Ties go
    to the first row. Frames without predictions count."""
    n = F.size("predictions")
    states = F.size(F.array_distinct(F.transform("predictions", lambda p: p["freshness_class"])))
    quality = F.least(F.lit(1.0), F.col("quality_metrics.blur_score") / 200.0)
    base = frames.groupBy("session").agg(
        (F.max("timestamp") - F.min("timestamp")).alias("duration_seconds"), F.count("*").alias("total_frames"), F.sum((n > 0).cast("int")).alias("frames_with_detections"),
        F.coalesce(F.avg(quality), F.lit(0.0)).alias("avg_image_quality"), F.sum(((n > 1) & (states > 1)).cast("int")).alias("unstable_detections"),
    )
    rows = explode_frames(frames)
    place = F.struct(-F.col("frame_number"), -F.col("pos"))
    count = lambda s: F.sum((F.coalesce("freshness_class", F.lit("uncertain")) == s).cast("int")).alias(f"{s}_count")
    row = F.struct("fruit_name", "freshness_class", "confidence", "frame_number")
    det = rows.groupBy("session").agg(
        F.count("*").alias("total_detections"), F.count_distinct("track_id").alias("unique_tracks"), *[count(s) for s in ("fresh", "stale", "rotten", "uncertain")],
        F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.max_by(row, F.struct(-F.col("confidence"), place)).alias("lowest_confidence"), F.max_by(row, F.struct(risk(F.col("freshness_class"), F.col("confidence")), place)).alias("highest_risk"),
    )
    tracked = rows.filter("track_id IS NOT NULL")
    switches = transitions(tracked, ["session", "track_id"], ["frame_number", "pos"], "freshness_class").groupBy("session").agg(F.sum("n_switches").alias("class_switches"))
    lasting = durations(tracked, ["session", "track_id"], "timestamp").groupBy("session").agg(F.avg("duration").alias("avg_track_duration"))
    out = base.join(det, "session", "left").join(switches, "session", "left").join(lasting, "session", "left")
    return out.na.fill(0).na.fill(0.0)


def session_statistics(df: DataFrame, session: str = "session") -> DataFrame:
    """Counts and rounded means of a session's log rows (label, confidence, latency)."""
    return df.groupBy(session).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.avg("latency"), 2).alias("avg_latency"))


def diagnostics_summary(df: DataFrame, *values: str) -> DataFrame:
    """(metric, n, mean, std, least, most): nulls are left out."""
    aggs = [F.struct(F.lit(v).alias("metric"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).cast("double").alias("least"), F.max(v).cast("double").alias("most")) for v in values]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
