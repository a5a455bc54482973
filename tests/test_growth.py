"""Steps whose time or memory a task grew with the input: the same results, and plans that stay small."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from curata.operators import boxes, metrics, ranks, rules, tables
from curata.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_precision_curves_share_their_steps(spark, monkeypatch):
    written = []
    monkeypatch.setattr(metrics, "materialize", lambda df, name: written.append(df.localCheckpoint()) or written[-1])
    rng = random.Random(2)
    rows = [("ab"[i % 2], rng.randrange(40) / 40, rng.random()) for i in range(400)] + [("a", None, 0.9)]
    truths = spark.createDataFrame([("a", 250), ("b", 300), ("c", 3)], "class_name string, n long")
    found = {r["class"]: r for r in metrics.mean_average_precision(spark.createDataFrame(rows, "class_name string, confidence double, overlap double"), truths).collect()}
    assert {w.count() for w in written} == {80} and found["c"].ap50_95 == 0
    for name, n in (("a", 250), ("b", 300)):
        scores = sorted({c for k, c, _ in rows if k == name and c is not None}, reverse=True)
        means = []
        for bound in [(50 + 5 * i) / 100 for i in range(10)]:
            points = [([o >= bound for k, c, o in rows if k == name and c is not None and c >= s]) for s in scores]
            p, tp = [sum(x) / len(x) for x in points], [sum(x) for x in points]
            means.append(sum(max(p[i:]) * (tp[i] - (tp[i - 1] if i else 0)) / n for i in range(len(p))))
        assert found[name].ap50_95 == pytest.approx(statistics.mean(means)) and found[name].ap50 == pytest.approx(means[0])


def test_large_groups_are_not_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(ranks, "WHOLE", 5)
    monkeypatch.setattr(ranks, "LARGE", 50)
    rng = random.Random(1)
    rows = [(k, rng.randrange(1000)) for k, n in (("a", 301), ("b", 3), (None, 120), ("c", 40)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: r.m for r in ranks.value_at(df, ["k"], "v", 0.5, lambda n: F.floor((n + 1) / 2), "m").collect()}
    assert got == {k: statistics.median_low([v for x, v in rows if x == k]) for k in ("a", "b", None, "c")}


def test_fields_of_a_line_are_parsed_once(spark):
    lines = spark.createDataFrame([("train", "s", 1, " 1 0.5 0.5 0.1 0.1"), ("train", "s", 2, "1  0.5 0.5 0.1 0.1000000000001"), ("train", "s", 3, "x 1 2"), ("train", "s", 4, " "), ("train", "s", 5, "1 a 0 0 0")], "split string, stem string, line_no int, raw string")
    found, sound = rules.audit_label_lines(lines, 3)
    assert sorted((r.ref, r.kind) for r in found.collect()) == [("train:s:2", "duplicate_row"), ("train:s:3", "field_count"), ("train:s:5", "non_numeric")] and sound.count() == 2
    images = spark.createDataFrame([("s", True), ("t", False)], "image string, has_label boolean")
    checked = rules.annotation_directory(images, lines.withColumnRenamed("stem", "image"), 3)
    assert sorted((r.image, r.status, r.line_no, r.error) for r in checked.collect()) == [("s", "invalid", 3, "field_count"), ("t", "missing", None, None)]
    # findings and copies each parse the lines, and no rule is interpreted through a lambda
    assert plan(found).count("split(") == 2 and plan(checked).count("split(") == 1 and "lambda" not in plan(found) + plan(checked)


def test_overlaps_are_computed_from_plain_columns(spark):
    df = registry.QUERIES["overlapping_boxes"](spark, SF)
    (join,) = [line for line in plan(df).splitlines() if "Join Inner" in line]
    assert "tb#" not in join and "CASE WHEN" not in join


@pytest.mark.parametrize(("stretch", "pairs"), [(5, 20), (50, 300), (512, 10**6)])
def test_stretches_of_frames_track_like_single_frames(monkeypatch, stretch, pairs):
    monkeypatch.setattr(boxes, "STRETCH", stretch)
    monkeypatch.setattr(boxes, "ROW_PAIRS", pairs)
    rng, rows, frame = random.Random(5), [], 0
    while len(rows) < 900:
        frame += rng.choice([1, 1, 1, 2, 20])
        for _ in range(rng.randint(0, 8)):
            x, y, q = rng.randrange(200), rng.randrange(150), rng.randrange(50)
            rows.append((frame, (rng.choice([None, 0.2, 0.5, rng.random()]), x, y, x + 20 + q, rng.choice([None, float("nan"), *[y + 20 + q] * 30]))))
    one, many = boxes.Tracker(), boxes.Tracker()
    for part in (rows[:400], rows[400:], rows[:30], [(None, rows[0][1])]):
        frames = {}
        for number, box in part:
            frames.setdefault(number, []).append(box)
        want = [i for number, own in frames.items() for i in one.step(number, own)]
        assert many.steps([r[0] for r in part], [r[1] for r in part]) == want and many.state == one.state


def test_unmatched_keys_are_counted_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_KEYS", 10)
    a = spark.createDataFrame([(i % 50, "x") for i in range(200)] + [(None, "x")], "k long, j string")
    b = spark.createDataFrame([(i, "x") for i in range(40, 60)] + [(41, "y"), (None, "x")], "k long, j string")
    got = tables.unmatched(a, b, ["k", "j"])
    want = [(i, "x", "left_only") for i in range(40)] + [(i, "x", "right_only") for i in range(50, 60)] + [(41, "y", "right_only"), (None, "x", "left_only"), (None, "x", "right_only")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and "Join" not in plan(got)


def test_sessions_travel_packed(spark):
    """A stateful stream gets a row for each session and Arrow batch, not one a box; nulls and 64-bit ids come back as they were."""
    from curata.streaming import stateful

    rows = [(i % 3 if i % 7 else None, i // 6, 2**62 + i, None if i % 5 == 0 else i / 100, i % 9) for i in range(200)]
    df = spark.createDataFrame(rows, "session long, frame long, box_id long, confidence double, x1 long").coalesce(1)
    columns = ["session", "frame", "box_id", "confidence", "x1"]
    packed = stateful._packed(df, "session", columns)
    assert packed.count() == 4
    back = stateful._unpacked(packed, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    late = stateful._packed(df, "session", columns, "frame").collect()
    assert {r.session: r.frame for r in late} == {k: max(f for s, f, *_ in rows if s == k) for k in (0, 1, 2, None)}
