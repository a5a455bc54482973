"""Folds, tracks and streams: 64-bit keys, null keys and null readings, expiry, restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from curata.operators import arrow, boxes, folds, frames
from curata.streaming import stateful

BIG = 2**53
READINGS = {"label": [None, "a", "b"], "confidence": [None, 0.2, 0.9, float("nan")], "is_correct": [None, True, False], "detector": [None, 0.4], "classifier": [None, 0.8], "level": [None, 3.0, 200.0], "x1": [None, 1.0, 40.0], "y1": [2.0], "x2": [50.0], "y2": [60.0, None]}
FOLDS = [folds.Stabilizer, folds.OutlierSmoother, folds.AdaptiveThreshold, folds.Cadence, folds.StableFusion, folds.RateLimit, folds.MotionGate, lambda: folds.CaptureGate(frames=2)]


def awkward_rows(n=300, seed=3):
    """Sessions of neighbouring 64-bit ids and none, with null readings of every kind."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((rng.choice([BIG, BIG + 1, None, 7]), 2**60 + i, rng.choice([None, i / 3, i / 3]), *(rng.choice(v) for v in READINGS.values())))
    return out


def frame_of(spark, rows):
    kinds = {"label": "string", "is_correct": "boolean"}
    return spark.createDataFrame(rows, "session long, seq long, time double, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in READINGS))


@pytest.mark.parametrize("fold", FOLDS)
def test_fold_batch_keeps_long_ids_and_nulls(spark, fold):
    rows = awkward_rows()
    df = frame_of(spark, rows)
    names = [f.name for f in stateful._fields(fold().gives)]
    want = {}
    for key in {r[0] for r in rows}:
        machine = fold()
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            values = dict(zip(df.columns, r, strict=True))
            want[r[1]] = (r[0], *machine.step(*folds.readings(values[c] for c in machine.reads)))
    found = folds.fold_batch(df, ["session"], ["seq"], fold, partitions=3).collect()
    assert {r.seq: (r.session, *(r[c] for c in names)) for r in found} == want and len(found) == len(rows)


def test_neighbouring_sessions_stay_apart(spark):
    df = spark.createDataFrame([(BIG, 2**60 + 1, 0.1), (BIG + 1, 2, 0.9), (None, 3, 1.0), (None, 4, 0.0)], "session long, seq long, confidence double")
    got = {r.seq: round(r.ema, 6) for r in frames.ema(df, ["session"], ["seq"]).collect()}
    assert got == {2**60 + 1: 0.1, 2: 0.9, 3: 1.0, 4: 0.8}


def test_empty_and_nested_columns_pass(spark):
    df = spark.createDataFrame([("s", 1, 0.5, [1, None], dt.date(2024, 1, 2)), ("s", 2, None, None, None)], "session string, seq int, confidence double, tags array<int>, day date")
    found = folds.fold_batch(df, ["session"], ["seq"], folds.OutlierSmoother)
    assert [(r.seq, r.tags, r.day, r.smoothed, r.is_outlier) for r in sorted(found.collect())] == [(1, [1, None], dt.date(2024, 1, 2), 0.5, False), (2, None, None, None, False)]
    assert folds.fold_batch(df.filter("false"), ["session"], ["seq"], folds.Stabilizer).count() == 0


def test_whole_groups_cross_batches():
    import pyarrow as pa

    batches = [pa.record_batch({"k": k}) for k in ([1, 1], [1], [1, None], [None], [], [float("nan")], [float("nan"), 2])]
    batches = [b.cast(pa.schema([("k", pa.float64())])) for b in batches]
    assert [len(keys) for _, keys in arrow.whole_groups(batches, ["k"])] == [4, 2, 2, 1]


def box_rows(seed=2, sessions=(BIG, BIG + 1, None)):
    rng = random.Random(seed)
    rows = []
    for s in sessions:
        for f in range(40):
            for b in range(rng.randint(0, 3)):
                x, y = rng.randrange(300), rng.randrange(300)
                rows.append((s, f + (25 if f > 20 else 0), 2**60 + b, rng.choice([None, 0.1, 0.9]), None if rng.random() < 0.1 else x, y, x + 40, y + 40, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=f + (25 if f > 20 else 0))))
    rows.append((7, None, 1, 0.5, 1, 1, 9, 9, dt.datetime(2024, 1, 1)))
    return rows


BOXES = "session long, frame long, box_id long, confidence double, x1 long, y1 long, x2 long, y2 long, at timestamp"


def test_tracks_of_long_and_null_sessions(spark):
    rows = box_rows()
    got = {(r.session, r.frame, r.box_id): r.track_id for r in boxes.track(spark.createDataFrame(rows, BOXES).repartition(3)).collect()}
    want = {}
    for session in {r[0] for r in rows}:
        tracker = boxes.Tracker()
        mine = [r for r in rows if r[0] == session]
        for frame in sorted({r[1] for r in mine}, key=lambda f: -1 if f is None else f):
            found = sorted((r for r in mine if r[1] == frame), key=lambda r: r[2])
            for r, i in zip(found, tracker.step(frame, [r[3:8] for r in found]), strict=True):
                want[r[0], r[1], r[2]] = i
    assert got == want
    assert got[7, None, 1] is None and any(i is None for (s, _, _), i in got.items() if s == BIG) and any(i for i in got.values())


def files(df, path, by):
    """One file a value of ``by``, in order."""
    for (n,) in sorted(tuple(r) for r in df.select(F.expr(by)).distinct().collect()):
        df.filter(f"{by} = {n}").coalesce(1).write.mode("append").parquet(path)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fold", [folds.Stabilizer, folds.AdaptiveThreshold, folds.RateLimit])
def test_fold_stream_equals_batch(spark, tmp_path, fold):
    df = frame_of(spark, awkward_rows()).drop("confidence").withColumn("confidence", F.rand(1))
    df = spark.createDataFrame(df.collect(), df.schema)
    files(df, str(tmp_path / "in"), "(seq - 1152921504606846976) div 100")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.run_to_memory(stateful.fold_stream(stream, ["session"], ["seq"], fold), f"f{abs(hash(fold))}", str(tmp_path / "ck"))
    assert ordered(got) == ordered(folds.fold_batch(df, ["session"], ["seq"], fold))


def run_once(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Files arrive between two runs over one checkpoint: state is taken up, and no row comes twice."""
    df = spark.createDataFrame(box_rows(), BOXES)
    source, schema = str(tmp_path / "in"), df.schema

    def both():
        stream = spark.readStream.schema(schema).parquet(source)
        run_once(stateful.track_stream(stream), str(tmp_path / "tracks"), str(tmp_path / "ck1"))
        run_once(stateful.fold_stream(stream, ["session"], ["frame", "box_id"], folds.OutlierSmoother), str(tmp_path / "smooth"), str(tmp_path / "ck2"))

    df.filter("frame < 12 OR frame IS NULL").coalesce(1).write.mode("append").parquet(source)
    both()
    df.filter("frame >= 12").coalesce(1).write.mode("append").parquet(source)
    both()
    assert ordered(spark.read.parquet(str(tmp_path / "tracks"))) == ordered(boxes.track(df))
    assert ordered(spark.read.parquet(str(tmp_path / "smooth"))) == ordered(folds.fold_batch(df, ["session"], ["frame", "box_id"], folds.OutlierSmoother))


def test_tracks_end_without_a_new_row(spark, tmp_path):
    """The first session has no row after its last track; another session's rows move the watermark on."""
    df = spark.createDataFrame([r for r in box_rows() if r[1] is not None and (r[0] != BIG or r[1] < 15)], BOXES)
    late = spark.createDataFrame([(99, 1, 1, 0.5, 0, 0, 9, 9, dt.datetime(2024, 1, 2))], BOXES)
    files(df, str(tmp_path / "in"), "frame div 15")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.run_to_memory(stateful.ended_tracks(stream, "at", 16.0), "ended", str(tmp_path / "ck"))
    want = boxes.track_spans(boxes.track(df), "at")
    assert ordered(got) == ordered(want.select(got.columns)) and got.filter(f"session = {BIG}").count() > 1
