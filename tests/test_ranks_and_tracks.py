"""Ranks in stretches, tracks, matches and file listings against plain versions."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators import boxes, dedup, folds, metrics, ranks, splits
from curata.sources import readers


def test_values_at_ranks(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=5000).tolist(), "b": rng.integers(0, 3, 4000).astype(float).tolist(), "c": [1.0], "d": [2.0, 1.0], "e": [5.0] * 3000 + [1.0] * 2999, None: [3.0, 4.0, 9.0]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("z", None)], "g string, x double")
    got = {r.g: r.median for r in metrics.upper_median(df, "x", "g").collect()}
    assert got == {g: sorted(xs)[len(xs) // 2] for g, xs in groups.items()}
    lat = {r.g: (r.p50, r.p95) for r in metrics.latency(df, "x", "g").collect() if r.g}
    assert lat == {g: tuple(sorted(xs)[max(int(len(xs) * s), 1) - 1] for s in (0.5, 0.95)) for g, xs in groups.items() if g} | {"z": (None, None)}


def test_running_and_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if rng.random() > 0.1 else None, i, rng.randint(0, 9)) for i in rng.sample(range(100_000), 500)]
    df = spark.createDataFrame(rows, "p string, o long, n long").repartition(5)
    got = {r.o: (r.before, r.total) for r in ranks.running(df, "p", F.floor(F.col("o") / 777), ["o"], F.col("n"), "before", "total").collect()}
    for p, o, _ in rows:
        same = [r for r in rows if r[0] == p]
        assert got[o] == (sum(n for _, x, n in same if x < o), sum(n for *_, n in same))
    assert [r.at for r in ranks.numbered(df, ["o"], "at").orderBy("o").collect()] == list(range(500))
    assert splits.stride_sample(df, ["o"], 37).count() == 37 and splits.stride_sample(df, ["o"], 1000).count() == 500


@pytest.mark.parametrize("stretches", [None, 1, 2, 3, 5, 7])
def test_hamming_pairs_miss_none(spark, stretches):
    rng = random.Random(3)
    hashes = [rng.getrandbits(63) for _ in range(60)]
    for h in hashes[:40]:
        flipped = h
        for b in rng.sample(range(63), rng.randint(0, 5)):
            flipped ^= 1 << b
        hashes.append(flipped)
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 4}
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    assert {tuple(r) for r in dedup.hamming_pairs(df, "h", "id", 4, stretches=stretches).collect()} == want
    # more rows ask for longer stretches
    assert dedup.choose_stretches(10**9, 6, 63) < dedup.choose_stretches(1000, 6, 63)


def plain_tracks(frames, least=0.3, reach=120.0, patience=15):
    """{frame: ids} of frames, a list of (number, boxes), by looking back over the whole history."""
    last, seen, out, count = {}, {}, {}, 0

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    for number, found in frames:
        ids, free = {}, [t for t in last if number - seen[t] <= patience]
        for k in sorted(range(len(found)), key=lambda k: -found[k][0]):
            mine = found[k][1:]
            best = None
            for t in free:
                o = overlap(last[t], mine)
                c = [((b[0] + b[2]) // 2, (b[1] + b[3]) // 2) for b in (last[t], mine)]
                near = 1 - ((c[0][0] - c[1][0]) ** 2 + (c[0][1] - c[1][1]) ** 2) ** 0.5 / reach
                if (o >= least or near >= 0.5) and (best is None or max(o, near) > best[0]):
                    best = (max(o, near), t)
            if best is None:
                best = (0, count)
                count += 1
            else:
                free.remove(best[1])
            ids[k] = best[1]
        for k, t in ids.items():
            last[t], seen[t] = found[k][1:], number
        out[number] = [ids[k] for k in range(len(found))]
    return out


def test_tracks_age_by_frame(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for session in range(4):
        frames, number = [], 0
        for _ in range(60):
            number += rng.choice([1, 1, 1, 2, 5, 16, 17, 40])
            found = []
            for n in range(rng.randint(1, 4)):
                x, y = rng.randint(0, 300), rng.randint(0, 200)
                found.append((rng.random(), x, y, x + rng.randint(5, 60), y + rng.randint(5, 60)))
            frames.append((number, found))
            rows += [(session, number, n, *b) for n, b in enumerate(found)]
        want[session] = plain_tracks(frames)
    df = spark.createDataFrame(rows, "session long, frame long, box_id long, confidence double, x1 int, y1 int, x2 int, y2 int").repartition(7)
    got = {(r.session, r.frame, r.box_id): r.track_id for r in boxes.track(df).collect()}
    assert got == {(s, f, n): t for s, frames in want.items() for f, ids in frames.items() for n, t in enumerate(ids)}
    tracker = boxes.Tracker()
    assert tracker.step(1, [(0.9, 0, 0, 10, 10)]) == [0] and tracker.step(16, [(0.9, 0, 0, 10, 10)]) == [0] and tracker.step(32, [(0.9, 0, 0, 10, 10)]) == [1]


def test_doubles_are_false_positives(spark):
    t = spark.createDataFrame([(1, 1, "a", 0, 0, 10, 10), (1, 2, "a", 50, 50, 60, 60)], "frame long, box_id long, class_name string, x1 int, y1 int, x2 int, y2 int")
    p = spark.createDataFrame([(1, 10, "a", 0.9, 0, 0, 10, 10), (1, 11, "a", 0.8, 0, 0, 10, 10), (1, 12, "a", 0.7, 50, 50, 60, 60), (1, 13, "b", 0.9, 50, 50, 60, 60)], "frame long, box_id long, class_name string, confidence double, x1 int, y1 int, x2 int, y2 int")
    got = {r.box_id: r.overlap for r in boxes.assign(p, t).collect()}
    assert got == {10: 1.0, 11: 0.0, 12: 1.0, 13: 0.0}
    (row,) = metrics.mean_average_precision(boxes.assign(p, t), t.groupBy("class_name").agg(F.count("*").alias("n"))).collect()
    assert (row.precision, row.recall) == (pytest.approx(2 / 3), 1.0) and row.ap50 == pytest.approx(0.5 + 0.5 * 2 / 3) == row.ap50_95


def plain_smoother(values, window=5, limit=2.0, least=3):
    kept, smooth, out = [], None, []
    for v in values:
        ring = kept[-window:]
        mean = sum(ring) / len(ring) if ring else 0
        deviation = (sum((x - mean) ** 2 for x in ring) / len(ring)) ** 0.5 if ring else 0
        far = len(ring) >= 2 and deviation > 0 and abs(v - mean) / deviation > limit
        if not far:
            kept.append(v)
            smooth = v if smooth is None else v / 3 + smooth * 2 / 3
        out.append((v if len(kept[-window:]) < least else smooth, far))
    return out


def plain_cadence(rows):
    last, steady, known, out = -1e9, 0, None, []
    for time, confidence, label in rows:
        since = (time - last) * 1000
        if since < 100:
            out.append(False)
            continue
        if since >= 1000 or confidence < 0.7:
            steady, go = 0, True
        elif label is not None and label != known:
            steady, known, go = 0, label, True
        else:
            steady += 1
            go = steady < 3 or since >= 200
            steady = 0 if steady >= 3 and go else steady
        last = time if go else last
        out.append(go)
    return out


def test_folds_equal_their_plain_form():
    rng = random.Random(5)
    for _ in range(50):
        values = [rng.choice([0.5, 0.5, rng.random(), 3.0]) for _ in range(40)]
        fold = folds.OutlierSmoother()
        got = [fold.step(v) for v in values]
        assert [f for _, f in got] == [f for _, f in plain_smoother(values)] and [s for s, _ in got] == pytest.approx([s for s, _ in plain_smoother(values)])
        time, rows = 0.0, []
        for _ in range(80):
            time += rng.choice([0.03, 0.06, 0.11, 0.15, 0.25, 1.2])
            rows.append((time, rng.choice([0.6, 0.8, 0.9]), rng.choice(["a", "a", "a", "b", None])))
        fold = folds.Cadence()
        assert [fold.step(*r)[0] for r in rows] == plain_cadence(rows)


def test_file_listing_and_scan(spark, tmp_path):
    for split, kind in (("train", "fresh"), ("test", "rotten")):
        (tmp_path / split / kind).mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"rest"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 300, 200) + b"rest"
    (tmp_path / "train/fresh/a.png").write_bytes(png)
    (tmp_path / "train/fresh/b.jpg").write_bytes(jpeg)
    (tmp_path / "test/rotten/broken.png").write_bytes(b"nothing")
    (tmp_path / "test/rotten/empty.png").write_bytes(b"")
    (tmp_path / "test/rotten/.hidden").write_bytes(b"x")
    (tmp_path / "top.txt").write_bytes(b"xy")
    listed = {(r.name, r.length) for r in readers.file_listing(spark, str(tmp_path)).collect()}
    assert listed == {("a.png", len(png)), ("b.jpg", len(jpeg)), ("broken.png", 7), ("empty.png", 0), (".hidden", 1), ("top.txt", 2)}
    quality = spark.createDataFrame([(f"file:{tmp_path}/train/fresh/a.png", 120.0)], "path string, blur_score double")
    got = {r.path.split("/")[-1]: r for r in readers.dataset_scan(spark, str(tmp_path), quality).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].split, got["a.png"]["class"], got["a.png"].readable) == (640, 480, "train", "fresh", True)
    assert (got["b.jpg"].format, got["b.jpg"].width, got["b.jpg"].height) == ("jpeg", 200, 300) and not got["broken.png"].readable
    assert got["a.png"].blur_score == 120.0 and got["b.jpg"].blur_score is None


def test_refused_and_resolved(spark):
    d = spark.createDataFrame([(1, "train"), (2, "test"), (3, "valid")], "id long, split string")
    with pytest.raises(ValueError, match="queued more than once"):
        splits.exclude(d, spark.createDataFrame([(1,), (1,)], "id long"), "id")
    assert {r.id for r in splits.exclude(d, spark.createDataFrame([(1,), (2,)], "id long"), "id").collect()} == {2, 3}
    lookup = spark.createDataFrame([(1, "s"), (2, ""), (3, None)], "id long, session string")
    assert [(r.id, r.session) for r in splits.by_lookup(d, lookup, "id", "session").collect()] == [(1, "s")]
    one = splits.session_split(d.withColumn("s", F.lit("only")), "s").collect()
    assert [tuple(r) for r in one] == [("only", "train")]


def test_manifest_records_are_numbered_by_file(spark, tmp_path):
    for name, rows in (("a", 3), ("b", 2)):
        text = "image_id,image_path\n" + "".join(f"{name}{i},\"p\n{i}\"\n" if i != 1 else ",\n" for i in range(rows))
        (tmp_path / f"{name}.csv").write_text(text)
    got = {(r.image_id, r.row_number) for r in readers.manifest_csv(spark, str(tmp_path)).collect()}
    assert got == {("a0", 2), ("a2", 4), ("b0", 2)}
