"""Sources and sinks round trips."""

import json

from curata.operators import rules
from curata.sources import readers, sinks


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿image_id,fruit_type,extra\na,apple,1\n,,\nb,,2\n", encoding="utf-8")
    rows = readers.manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.image_id, r.fruit_type, r.camera_id) for r in rows] == [("a", "apple", ""), ("b", "", "")] and [r.row_number for r in rows] == [2, 4]
    for name, body in (("a.json", [{"image_id": "x"}]), ("b.json", {"records": [{"image_id": "x"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [r.image_id for r in readers.manifest(spark, str(tmp_path / name)).collect()] == ["x"]
    sinks.write_manifest_csv(readers.manifest(spark, str(tmp_path / "m.csv")), str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).columns == readers.MANIFEST_COLUMNS


def test_files_and_labels(spark, tmp_path):
    for name, data in (("train/apple/a.JPG", b"1"), ("train/apple/b.txt", b""), ("train/pear/a.jpg", b"1")):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    tree = readers.file_tree(spark, str(tmp_path / "tree"))
    assert {(r.name, r["class"]) for r in readers.class_folders(spark, str(tmp_path / "tree")).selectExpr("element_at(split(path,'/'),-1) name", "class").collect()} == {("a.JPG", "apple"), ("a.jpg", "pear")}
    assert readers.folder_layout(tree, str(tmp_path / "tree")).first().layout == "split"
    hashes = {r.sha256 for r in readers.hashed_files(spark, str(tmp_path / "tree")).collect()}
    assert len(hashes) == 1  # two equal files; Spark leaves the empty one out
    lab = tmp_path / "d/train/labels"
    lab.mkdir(parents=True)
    (lab / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1\n")
    found, boxes = rules.audit_label_lines(readers.label_lines(spark, str(tmp_path / "d")), 2)
    assert [r.kind for r in found.collect()] == ["field_count"] and boxes.count() == 1
    sinks.write_label_lines(boxes, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).first().value == "0 0.500000 0.500000 0.100000 0.100000"


def test_dimensions_and_json(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"Apple": {"typical_shelf_life_days": [14, 30]}, "Odd": {"typical_shelf_life_days": [9, 2]}}))
    assert {(r.item, r.fault) for r in readers.item_dimension(spark, str(tmp_path / "items.json")).collect()} == {("apple", None), ("odd", "order")}
    (tmp_path / "av.json").write_text(json.dumps({" Apple": {"availability": "yes", "class_id": "0/1", "source": "s"}}))
    assert readers.availability_dimension(spark, str(tmp_path / "av.json")).first().item == "apple"
    for text in ("nc: 2\nnames: [a, 'b']\n", "nc: 2\nnames:\n  0: a\n  1: b\n", "names:\n- a\n- b\n", '{"nc": 2, "names": ["a", "b"]}'):
        assert [r["name"] for r in readers.class_names(spark, text).orderBy("class_id").collect()] == ["a", "b"]
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "one.json").write_text(json.dumps({"sample_id": "1", "label": "a"}))
    (meta / "bad.json").write_text("{")
    (meta / "session_x.json").write_text("{}")
    rows = readers.sample_metadata(spark, str(meta)).select("file", "sample_id", "_corrupt").collect()
    assert {r.file for r in rows} == {"one.json", "bad.json"} and sum(r._corrupt is not None for r in rows) == 1
    (tmp_path / "f.json").write_text(json.dumps({"frames": [{"confidence": 0.5}]}))
    assert readers.diagnostics(spark, str(tmp_path / "f.json"), "confidence double").first().confidence == 0.5


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "split string, x int")
    sinks.write_dataset(d, str(tmp_path / "ds"), "split")
    assert spark.read.parquet(str(tmp_path / "ds")).filter("split = 'a'").count() == 1
    try:
        sinks.write_dataset(d, str(tmp_path / "ds"), "split")
        raise AssertionError("overwrote")
    except Exception as e:
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    assert sinks.write_version(d, str(tmp_path / "v"), "1").endswith("version=1")
    d.selectExpr("split session", "cast(x as double) confidence").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("session string, confidence double").parquet(str(tmp_path / "s"))
    sinks.session_log(stream, str(tmp_path / "log"), str(tmp_path / "sum"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
