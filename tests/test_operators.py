"""Literal expectations and invariants of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from curata.functions import scalar as s
from curata.operators import boxes, dedup, folds, frames, metrics, rules, splits, tables
from curata.operators.graph import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_geometry(spark):
    a, b = s.box(*map(F.lit, (0, 0, 10, 10))), s.box(*map(F.lit, (5, 0, 15, 10)))
    assert one(spark, s.iou(a, b)) == pytest.approx(1 / 3)
    assert one(spark, s.iou(a, s.box(*map(F.lit, (0, 0, 0, 0))))) == 0
    assert one(spark, s.center_distance(a, b)) == 5
    assert one(spark, s.drift(a, b)) == pytest.approx(5 / 200**0.5)
    y = s.to_yolo(b, F.lit(20.0), F.lit(20.0))
    assert tuple(one(spark, y)) == (0.5, 0.25, 0.5, 0.5)
    assert tuple(one(spark, s.from_yolo(y, F.lit(20.0), F.lit(20.0)))) == (5, 0, 15, 10)
    assert tuple(one(spark, s.expand(b, 0.5, F.lit(18), F.lit(18)))) == (0, 0, 18, 15)
    assert tuple(one(spark, s.scale_from_letterbox(s.box(*map(F.lit, (0.0, 80.0, 640.0, 560.0))), 640, F.lit(1280), F.lit(960)))) == (0, 0, 1280, 960)
    assert tuple(one(spark, s.polygon_box(F.array(F.lit(3), F.lit(1)), F.array(F.lit(2), F.lit(9))))) == (1, 2, 3, 9)


def test_text_and_numbers(spark):
    parse = lambda x: tuple(one(spark, s.parse_state_class(F.lit(x))))
    assert parse("apple_fresh") == ("fresh", "apple") and parse("rotten_banana") == ("rotten", "banana") and parse("freshapples") == ("fresh", "apple") and parse("kiwi") == (None, "kiwi")
    assert one(spark, s.tokens(F.lit("Fresh-Apple_01 x"))) == ["fresh", "apple", "01", "x"]
    assert one(spark, s.stem(F.lit("a/b.c/d.tar.gz"))) == "d.tar" and one(spark, s.extension(F.lit("A/B.JPG"))) == ".jpg"
    assert one(spark, s.hamming_text(F.lit("0101"), F.lit("0110"))) == 2 and one(spark, s.hamming_text(F.lit("01"), F.lit("0110"))) == 4
    assert one(spark, s.sanitize_confidence(F.lit(float("nan")))) is None and one(spark, s.sanitize_confidence(F.lit(99.0))) == 1 and one(spark, s.sanitize_confidence(F.lit(-2.5))) == 0
    assert one(spark, s.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert sum(one(spark, s.softmax(F.array(F.lit(1.0), F.lit(2.0))))) == pytest.approx(1)
    assert one(spark, s.parse_time(F.lit("2024-01-02T03:04:05"))) is not None and one(spark, s.parse_time(F.lit("2024-01-02T03:04:05.5"))) is None
    assert one(spark, s.class_ids(F.lit("3/7/x"))) == [3, 7]
    assert one(spark, s.majority(F.array(*map(F.lit, "abba")))) == "a" and one(spark, s.votes(F.array(*map(F.lit, "aba")))) == {"a": 2, "b": 1}
    assert one(spark, s.storage_condition(F.lit(None))) == "ambient"
    with pytest.raises(Exception, match="unsupported storage"):
        one(spark, s.storage_condition(F.lit("oven")))
    assert s.apportion(10, (0.7, 0.15, 0.15)) == [7, 2, 1] and s.apportion(3, (0.9, 0.05, 0.05)) == [1, 1, 1] and s.apportion(0, (1, 1, 1)) == [0, 0, 0]


def bits(*places):
    return sum(1 << p for p in places)


def test_near_pairs_and_stars(spark):
    d = spark.createDataFrame([("far1", bits(8)), ("far2", bits(*range(10, 18)))], "id string, h long")
    assert dedup.hamming_pairs(d, "h", "id", 6).count() == 0
    chain = [("a", bits(10, 11, 12, 13)), ("b", bits(10, 11, 12, 14)), ("c", bits(10, 11, 12, *range(14, 20)))]
    pairs = dedup.hamming_pairs(spark.createDataFrame(chain, "id string, h long"), "h", "id", 6)
    assert {(r.a, r.b) for r in pairs.collect()} == {("a", "b"), ("b", "c")}
    assert {(r.id, r.anchor) for r in dedup.star_clusters(pairs).collect()} == {("a", "a"), ("b", "a")}
    assert {r.group_id for r in dedup.components(pairs).collect()} == {"a"}


@pytest.mark.parametrize("order", ["root_first", "random"])
def test_components_of_long_chains(spark, order):
    n = 2000
    ids = [0, *range(n - 1, 0, -1)]  # a smaller label that enters at one end reaches the other hop by hop
    if order == "random":
        random.Random(1).shuffle(ids)
    edges = [*zip(ids, ids[1:], strict=False), (n + 7, n + 5), (n + 5, n + 6), (n + 9, n + 9), (n + 1, None)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    want = {**dict.fromkeys(range(n), 0), **dict.fromkeys((n + 5, n + 6, n + 7), n + 5), n + 9: n + 9}
    rows = got.collect()
    assert len(rows) == len(want) and {r["node"]: r.component for r in rows} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_stars_equal_the_sequential_form(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, want = set(), set()
    for a in sorted(near):
        if a in taken:
            continue
        members = {b for b in near[a] if b not in taken}
        taken |= members | {a}
        if members:
            want |= {(x, a) for x in members | {a}}
    pairs = spark.createDataFrame(sorted(edges), "a int, b int")
    assert {(r.id, r.anchor) for r in dedup.star_clusters(pairs).collect()} == want


def test_group_split(spark):
    rows = [(f"g{i % 40}", "xyz"[i % 40 % 3] if i % 40 < 30 else "w", i) for i in range(400)]
    out = splits.group_split(spark.createDataFrame(rows, "g string, c string, i int"), "g", "c").collect()
    assert len(out) == 40
    for c in "wxyz":
        n = [sum(r.modal == c and r.split == x for r in out) for x in splits.SPLITS]
        assert n == s.apportion(sum(n), splits.RATIOS)


def test_scores(spark):
    rows = [("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    m = metrics.confusion(spark.createDataFrame(rows, "true_class string, pred_class string"))
    r = metrics.summary(m).first()
    assert r.accuracy == 0.75 and r.macro_precision == pytest.approx(0.555556, abs=1e-6) and r.macro_recall == pytest.approx(0.666667, abs=1e-6)
    assert r.macro_f1 == pytest.approx(0.6) and r.weighted_f1 == pytest.approx(0.65) and m.count() == 9


def run(fold, rows):
    return [fold.step(*r) for r in rows]


def test_stabilizer():
    assert [r[1] for r in run(folds.Stabilizer(), [("a", 1.0), ("a", 0.5)])] == [1.0, 0.9]
    assert run(folds.Stabilizer(window=5), [("f", 1.0)] * 3 + [("s", 1.0)] * 2)[-1][2] == "f"
    got = run(folds.Stabilizer(lock_frames=3), [("fresh", 1.0)] + [("rotten", 1.0)] * 3)
    assert [(r[0], r[3], r[4]) for r in got] == [("fresh", False, 0), ("fresh", True, 1), ("fresh", True, 2), ("rotten", False, 0)]
    assert run(folds.Stabilizer(), [("a", 0.5)])[0][5]


def test_other_folds():
    assert [r[1] for r in run(folds.OutlierSmoother(), [(x,) for x in (0.5, 0.52, 0.51, 0.5, 5.0)])] == [False] * 4 + [True]
    gate = run(folds.CaptureGate(), [("a", 0, 0, 10, 10)] * 4 + [("a", 0, 0, 10, 10), ("b", 0, 0, 10, 10)])
    assert [g[0] for g in gate] == [False, False, False, True, False, False]
    assert [c[0] for c in run(folds.Cadence(), [(0.0, 0.9, "a"), (0.05, 0.9, "a"), (1.2, 0.9, "a")])] == [True, False, True]
    up = run(folds.AdaptiveThreshold(), [(float(i), 0.9, i % 2 == 1) for i in range(30)])
    assert up[-1][0] > 0.5
    label, fused, change = run(folds.StableFusion(), [(0.0, 0.9, 0.9, "a"), (0.1, 0.1, 0.2, "b")])[1]
    assert label == "a" and change == -0.3 and fused == 0.0


def test_stream_equals_batch(spark, tmp_path):
    from curata.streaming import stateful

    rng = random.Random(1)
    rows = [(f"s{i % 7}", i, rng.choice("ab"), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "session string, seq long, label string, confidence double")
    for n in range(3):
        df.filter(f"seq div 100 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.fold_stream(stream, ["session"], ["seq"], folds.Stabilizer)
    got = stateful.run_to_memory(out, "stab", str(tmp_path / "ck"))
    want = folds.fold_batch(df, ["session"], ["seq"], folds.Stabilizer)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(got) == key(want)


def test_track_stream_equals_batch(spark, tmp_path):
    from curata.streaming import stateful

    rng = random.Random(2)
    rows = [(f"s{f % 3}", f, b, rng.random(), *(x := rng.randrange(300), y := rng.randrange(300)), x + 40, y + 40) for f in range(60) for b in range(3)]
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows]
    df = spark.createDataFrame(rows, "session string, frame long, box_id long, confidence double, x1 long, y1 long, x2 long, y2 long")
    for n in range(2):
        df.filter(f"frame div 30 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.run_to_memory(stateful.track_stream(stream), "trk", str(tmp_path / "ck"))
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(got) == key(boxes.track(df))


def test_event_time_windows(spark, tmp_path):
    from curata.streaming import stateful

    df = spark.range(100).select((F.col("id") * 3600 + 864000).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = stateful.run_to_memory(stateful.windowed_counts(read(), "ts", ["k"]), "win", str(tmp_path / "c1"))
    assert {r.n for r in got.collect()} == {12}
    assert stateful.run_to_memory(stateful.drop_repeats(read(), "ts", ["k"]), "rep", str(tmp_path / "c2")).count() == 2
    joined = stateful.join_streams(read(), read().withColumnRenamed("ts", "ts2"), ["k"], "ts", "ts2", "30 minutes")
    assert stateful.run_to_memory(joined, "jn", str(tmp_path / "c3")).count() == 100


def test_boxes(spark):
    schema = "frame long, box_id long, class_name string, confidence double, x1 long, y1 long, x2 long, y2 long"
    t = spark.createDataFrame([(1, 1, "a", 1.0, 0, 0, 10, 10), (1, 2, "a", 1.0, 4, 0, 14, 10)], schema)
    p = spark.createDataFrame([(1, 7, "a", 0.9, 1, 0, 11, 10), (1, 8, "b", 0.8, 100, 100, 110, 110)], schema)
    assert [(r.truth_id, r.box_id) for r in boxes.one_to_one(t, p).collect()] == [(1, 7)]
    assert {(r.box_id, r.verdict) for r in boxes.best_matches(p, t).collect()} == {(7, "tp"), (8, "fp")}
    assert [r.box_id for r in boxes.suppress(t.withColumn("confidence", F.col("box_id") / 10), 0.3).collect()] == [2]
    assert boxes.merge_labels(t, 0.4).count() == 1 and boxes.merge_labels(t, 0.9).count() == 2
    assert {r.box_id for r in boxes.replace_boxes(t, p).collect()} == {7, 2, 8}
    ev = boxes.evidence(t, p, 1e4).withColumn("categories", F.array(F.lit("empty_labels")))
    r = boxes.review_score(ev).first()
    assert (r.matched, r.missing, r.extra, r.level) == (1, 1, 1, "HIGH") and r.score == 20 + 15 + 8 + 20


def test_rules(spark):
    d = spark.createDataFrame([(45.0, None)], "a double, b string")
    cases = [(0.45, "x", "x", None), (0.95, "x", "y", None), (0.5, "x", "x", None)]
    d = spark.createDataFrame([(c, p, t, None, None, 0.4, 0.9, None) for c, p, t, _ in cases], "confidence double, predicted_class string, true_class string, blur_score double, brightness double, detector_confidence double, classifier_confidence double, stability_score double")
    got = [r.reasons for r in rules.hard_case_reasons(d).collect()]
    assert got[0] == ["low_confidence_0.450", "detector_classifier_disagreement", "near_decision_boundary"] and got[1][0] == "high_confidence_error_0.950" and "near_decision_boundary" in got[2]
    gate = spark.createDataFrame([("r1", "i", "accepted", 0, "a", [0.0, 0.0, 5.0, 5.0], "me"), ("r2", "i", "uncertain", None, None, None, "me"), ("r3", "i", "corrected", 5, "zz", [0.0, 0.0, 0.0, 5.0], "me")], "record string, image string, decision string, final_class_id int, final_class string, final_box array<double>, reviewer string")
    assert {(r.ref, r.kind) for r in rules.review_gate(gate, ["a", "b"]).collect()} == {("r2", "uncertain"), ("r3", "invalid_box"), ("r3", "invalid_class_id"), ("r3", "invalid_class_name")}
    items = spark.createDataFrame([("i", "c", "drop", None), ("i", "c", "drop", None), ("k", "c", "fly", None)], "image string, category string, action string, box array<double>")
    kinds = {r.kind for r in rules.resolution_manifest(items, spark.createDataFrame([("i", "c")], "image string, category string"), {"c": ["drop"]}).collect()}
    assert kinds == {"repeated_item", "not_in_queue", "action_not_allowed"}
    v = rules.compare_hashes(spark.createDataFrame([("a", "1"), ("b", "1")], "name string, sha256 string"), spark.createDataFrame([("a", "2"), ("c", "1")], "name string, sha256 string"))
    assert {(r.name, r.verdict) for r in v.collect()} == {("a", "changed"), ("b", "missing"), ("c", "new")}


def test_shelf_life(spark):
    items = spark.createDataFrame([("apple", 14, 30)], "item string, typical_min int, typical_max int")
    asked = [("apple", "fresh", c, None) for c in (0.0, 0.5, 1.0, None, float("nan"), float("inf"), -2.5, 99.0)] + [("apple", "rotten", 0.9, None), ("apple", "stale", None, None), ("plum", "fresh", 1.0, None)]
    asked = [(i, *a) for i, a in enumerate(asked)]
    out = tables.shelf_life(spark.createDataFrame(asked, "id int, item string, freshness_class string, confidence double, storage string"), items).orderBy("id").collect()
    assert [r.days for r in out] == [1, 15, 30, None, None, None, 1, 30, 0, 0, None] and out[3].status == "uncertain" and out[-1].status == "unsupported"


def test_session_summary(spark):
    schema = "session string, frame_number long, timestamp double, predictions array<struct<fruit_name:string,freshness_class:string>>, confidences array<double>, tracking_ids array<long>, quality_metrics struct<blur_score:double>"
    states = ["fresh", "fresh", "stale", "stale", "rotten"]
    rows = [("a", i, float(i), [("apple", x)], [0.9], [1], (100.0,)) for i, x in enumerate(states)] + [("b", i, float(i), [], [], [], None) for i in range(5)]
    a, b = frames.session_summary(spark.createDataFrame(rows, schema)).orderBy("session").collect()
    assert (a.unique_tracks, a.class_switches, a.total_detections, a.duration_seconds, a.avg_image_quality) == (1, 2, 5, 4.0, 0.5)
    assert (b.total_frames, b.unique_tracks, b.frames_with_detections) == (5, 0, 0)
    assert a.highest_risk.freshness_class == "rotten"
