"""Large JSON arrays read by several tasks, frontier listings, frame logs with retries."""

import datetime as dt
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from curata.sources import frames, json_arrays, readers
from curata.streaming import stateful


def records(n=150, seed=1):
    rng = random.Random(seed)
    odd = ["a}b", '{"x": [1}', 'q"}', "\\\\", "\\", "", '",}}]]', "é{", '"quoted"', "line\n}"]
    return [{"image_id": f"i{i}", "annotator": rng.choice(odd) + "x" * rng.randint(0, 300), "n": {"d": [{"e": 1}, [2]]}} for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def shapes(recs):
    other = [{"no": 1}] * 20
    return {
        "array": json.dumps(recs), "pretty": json.dumps(recs, indent=1, ensure_ascii=False), "object": json.dumps({"meta": other, "deep": {"records": other, "x": {"y": {"z": [{"w": 1}] * 20}}}, "records": recs, "after": other}), "last": json.dumps({"after": other, "records": recs}, indent=2),
        "empty": "[]", "none": '{"records": []}', "mixed": '[1, "}", {"a": 1}, [{"b": 2}], null]', "absent": json.dumps({"meta": other}), "one long": json.dumps([{"image_id": "}" * 5000}, {"image_id": "z"}]),
    }


@pytest.mark.parametrize("shape", list(shapes([])))
def test_records_of_arrays(spark, tmp_path, small_ranges, shape):
    text = shapes(records())[shape]
    path = tmp_path / "in.json"
    path.write_text(text)
    doc = json.loads(text)
    want = [x for x in (doc if isinstance(doc, list) else doc.get("records", [])) if isinstance(x, dict)]
    got = sorted((r.row_number, json.loads(r.value)) for r in json_arrays.json_records(spark, str(path)).collect())
    assert [k for k, _ in got] == list(range(1, len(want) + 1)) and [x for _, x in got] == want
    if len(want) > 100:
        tasks = json_arrays.pieces(spark, str(path)).select(F.spark_partition_id()).distinct().count()
        assert tasks > 20


def test_folder_of_manifests_and_diagnostics(spark, tmp_path, small_ranges):
    recs = records(40)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps(recs))
    (tmp_path / "m/b.json").write_text(json.dumps({"records": recs[:7]}))
    got = readers.manifest_json(spark, str(tmp_path / "m"), ["image_id", "annotator"]).collect()
    assert sorted((r.row_number, r.image_id, r.annotator) for r in got) == sorted((i + 1, r["image_id"], r["annotator"]) for part in (recs, recs[:7]) for i, r in enumerate(part))
    (tmp_path / "d.json").write_text(json.dumps({"frames": [{"a": 1}, {"a": None, "b": "x"}]}))
    assert sorted((r.a, r.b) for r in readers.diagnostics(spark, str(tmp_path / "d.json"), "a int, b string").collect() if r.a) == [(1, None)]


def test_listing_of_deep_folders(spark, tmp_path):
    deep = tmp_path
    for level in range(6):
        deep = deep / f"l{level}"
        deep.mkdir()
        (deep / f"f{level}.png").write_bytes(b"x" * level)
    (tmp_path / "l0/empty").mkdir()
    (tmp_path / "l0/.hid").write_bytes(b"")
    got = {(r.name, r.length) for r in readers.file_listing(spark, str(tmp_path)).collect()}
    assert got == {(f"f{i}.png", i) for i in range(6)} | {(".hid", 0)}
    (tmp_path / "void").mkdir()
    assert readers.file_listing(spark, str(tmp_path / "void")).count() == 0


def segment(rows):
    return b"".join(struct.pack(frames.HEAD, us, len(data)) + data for us, data in rows)


def run(spark, folder, out, checkpoint, **options):
    stream = frames.frame_log(spark, str(folder), pause=0.01, **options)
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frames.SCHEMA).parquet(str(out)).collect()


def test_frame_log_goes_on_where_it_was(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / frames.segment_name("cam-1", 0)).write_bytes(segment([(0, b"a"), (1_500_000, b"")]))
    (folder / frames.segment_name("cam-1", 2)).write_bytes(segment([(9, b"late")]))
    (folder / "notes.txt").write_bytes(b"x")
    got = run(spark, folder, tmp_path / "out", tmp_path / "ck")
    assert sorted((r.device, r.segment, r.frame, bytes(r.bytes), r.attempts) for r in got) == [("cam-1", 0, 0, b"a", 1), ("cam-1", 0, 1, b"", 1)]
    assert {r.time for r in got} == {dt.datetime.fromtimestamp(0), dt.datetime.fromtimestamp(1.5)}
    # the gap is filled and another device begins: only new segments come
    (folder / frames.segment_name("cam-1", 1)).write_bytes(segment([(8, b"b")]))
    (folder / frames.segment_name("two", 0)).write_bytes(segment([]))
    got = run(spark, folder, tmp_path / "out", tmp_path / "ck")
    assert sorted((r.device, r.segment, r.frame, bytes(r.bytes)) for r in got) == [("cam-1", 0, 0, b"a"), ("cam-1", 0, 1, b""), ("cam-1", 1, 0, b"b"), ("cam-1", 2, 0, b"late")]


def test_broken_segments(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / frames.segment_name("good", 0)).write_bytes(segment([(1, b"x")]))
    (folder / frames.segment_name("bad", 0)).write_bytes(segment([(1, b"xyz")])[:-1])
    got = run(spark, folder, tmp_path / "out", tmp_path / "ck", retries=2, skip_broken=True)
    assert sorted((r.device, r.attempts, r.error) for r in got) == [("bad", 3, "segment ends within a frame"), ("good", 1, None)]
    with pytest.raises(Exception, match="after 1 retries"):
        run(spark, folder, tmp_path / "out2", tmp_path / "ck2", retries=1)


def test_retries_reach_a_segment_that_comes_back(monkeypatch, tmp_path):
    path = tmp_path / frames.segment_name("d", 0)
    reader = frames.FrameReader({"path": str(tmp_path), "retries": "3", "pause": "0"})
    calls = []

    def later(_):
        calls.append(1)
        if len(calls) == 2:
            path.write_bytes(segment([(5, b"ok")]))

    monkeypatch.setattr(frames.time, "sleep", later)
    ((_, _, _, _, data, attempts, error),) = reader.read(frames.Segment("d", 0, str(path)))
    assert (data, attempts, error) == (b"ok", 3, None)


def test_written_frames_come_back(spark, tmp_path):
    rows = [(f"d{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), bytes([i]) * i) for i in range(60)]
    df = spark.createDataFrame(rows, "device string, time timestamp, bytes binary")
    n = frames.write_frames(df, str(tmp_path / "log")).collect()
    assert sorted((r.device, r.segment, r.n) for r in n) == [("d0", 0, 20), ("d1", 0, 20), ("d2", 0, 20)]
    got = stateful.run_to_memory(frames.frame_log(spark, str(tmp_path / "log")), "framesback", str(tmp_path / "ck")).collect()
    assert sorted((r.device, bytes(r.bytes)) for r in got) == sorted((d, b) for d, _, b in rows)
