"""Merge by action, manifests against files, calibration."""

import math

import pytest

from curata.operators import calibration, resolve, rules
from curata.sources import readers

RECORDS = "record long, image string, proposal_id string, decision string, action string, bbox array<double>, reviewer string, notes string"
MANIFEST = "image string, category string, action string, coordinates array<double>, proposal_ids array<string>, notes string"
ROW = [1.0, 0.5, 0.5, 0.2, 0.2]


def merged(spark, records, manifest):
    r, m = spark.createDataFrame(records, RECORDS), spark.createDataFrame(manifest, MANIFEST)
    out, log = resolve.merge(r, m, 3)
    return {x.record: x for x in out.collect()}, {x.image: (x.status, x.detail) for x in log.collect()}, resolve.changes(r, out)


def test_each_action_rewrites_its_fields(spark):
    old = [9.0] * 5
    records = [(i, f"i{i}", None, "open", "review", old, None, "n") for i in range(8)]
    records += [(10, "d", "p1", "uncertain", None, None, None, ""), (11, "d", "p2", "uncertain", None, None, None, ""), (20, "two", "a", "open", "x", old, None, ""), (21, "two", "b", "open", "y", None, None, "")]
    manifest = [
        ("i0", "A_EMPTY_LABEL", "MANUALLY_ANNOTATE", ROW, None, "by hand"), ("i1", "A_EMPTY_LABEL", "CONFIRM_BACKGROUND", None, None, None), ("i2", "A_EMPTY_LABEL", "MARK_UNCERTAIN", None, None, ""),
        ("i3", "C_TIGHTEN", "REPLACE", ROW, None, ""), ("i4", "B_MANUAL_REVIEW", "TIGHTEN", None, None, ""), ("i5", "B_MANUAL_REVIEW", "TIGHTEN", [1.0, 0.95, 0.5, 0.2, 0.2], None, ""), ("i6", "B_MANUAL_REVIEW", "ACCEPT_ALL", None, None, ""),
        ("i7", "X", "KEEP", None, None, ""), ("d", "D_UNCERTAIN", "CORRECT", None, ["p2", "p9"], ""), ("none", "A_EMPTY_LABEL", "CONFIRM_BACKGROUND", None, None, ""), ("two", "C_TIGHTEN", "KEEP", None, None, ""),
    ]
    out, log, changed = merged(spark, records, manifest)
    assert tuple(out[0])[3:] == ("annotate", "manual_annotation_supplied", ROW, "human", "by hand")
    assert tuple(out[1])[3:] == ("keep_empty", "no_change", None, "human", "human resolution")
    assert tuple(out[3])[3:6] == ("tighten", "manual_annotation_supplied", ROW)
    assert all(tuple(out[i]) == records[i] for i in (2, 4, 5, 6, 7)) and tuple(out[10]) == records[8]
    assert tuple(out[11])[3:] == ("corrected", None, None, "human", "human resolution")
    # the records of an image become its first one
    assert [tuple(out[i])[2:6] for i in (20, 21)] == [("a", "keep", "no_change", None)] * 2
    assert log == {"i0": ("applied", None), "i1": ("applied", None), "i2": ("skipped", "stays_blocked"), "i3": ("applied", None), "i4": ("refused", "no_coordinates"), "i5": ("refused", "outside_frame"), "i6": ("refused", "action_not_allowed"),
                   "i7": ("refused", "unknown_category"), "d": ("applied", None), "none": ("skipped", "no_record"), "two": ("applied", None)}
    listed = {(c.record, c.field): (c.before, c.after) for c in changed.collect()}
    assert listed[0, "bbox"] == ("9.0 9.0 9.0 9.0 9.0", "1.0 0.5 0.5 0.2 0.2") and listed[1, "bbox"][1] is None and (2, "decision") not in listed and listed[21, "proposal_id"] == ("b", "a")


def test_an_image_resolved_twice_is_refused(spark):
    out, log, changed = merged(spark, [(1, "i", None, "open", None, None, None, "")], [("i", "C_TIGHTEN", "KEEP", None, None, "")] * 2)
    assert out[1].decision == "open" and log["i"] == ("refused", "repeated") and changed.count() == 0


@pytest.mark.parametrize(("action", "want"), [("ACCEPT_SELECTED", ["accepted", "u"]), ("ACCEPT_ALL", ["accepted"] * 2), ("REJECT_SELECTED", ["rejected", "u"]), ("KEEP_ORIGINAL", ["kept"] * 2), ("UNCERTAIN", ["u", "u"])])
def test_proposals(spark, action, want):
    out, _, _ = merged(spark, [(1, "i", "p1", "u", None, None, None, ""), (2, "i", "p2", "u", None, None, None, "")], [("i", "D_UNCERTAIN", action, None, ["p1"], "")])
    assert [out[1].decision, out[2].decision] == want
    _, log, _ = merged(spark, [(1, "i", None, "u", None, None, None, "")], [("i", "D_UNCERTAIN", "ACCEPT_SELECTED", None, None, "")])
    assert log["i"] == ("skipped", "nothing_listed")


def test_manifest_against_a_folder(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for name, data in (("a", b"one"), ("b", b"one"), ("c", b"two"), ("unused", b"two")):
        (tmp_path / f"images/{name}.png").write_bytes(data)
    files = readers.hashed_files(spark, str(tmp_path)).selectExpr(f"substring_index(path, '{tmp_path}/', -1) AS path", "md5")
    manifest = spark.createDataFrame([(2, "images/a.png"), (3, "images/b.png"), (4, "images/a.png"), (5, "images/c.png"), (6, "images/gone.png"), (7, ""), (8, None)], "row_number long, image_path string")
    got = sorted((r.ref, r.kind, r.detail) for r in rules.manifest_files(manifest, files).collect())
    assert got == [("3", "duplicate_file", "images/a.png = images/b.png"), ("6", "missing_file", "images/gone.png")]


def test_temperature_finds_the_softening(spark):
    """Scores that are three times as sure as the shares of their labels."""
    rows = []
    for i in range(40):
        z = [i % 7 / 3, i % 5 / 2, 0.0]
        e = [math.exp(x) for x in z]
        for label, share in enumerate(x / sum(e) for x in e):
            rows += [([3 * x for x in z], label)] * round(100 * share)
    rows += [([1.0, None, 2.0], 0), ([float("inf"), 1.0, 1.0], 0), (None, 1), ([1.0, 2.0, 3.0], 7), ([1.0, 2.0, 3.0], None), ([1e300, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "logits array<double>, label int")
    found = calibration.fit_temperature(df)
    assert found["temperature"] == pytest.approx(3.0, rel=0.05) and found["loss"] < found["loss_before"] and found["n"] == len(rows) - 5
    assert calibration.fit_temperature(df.filter("false")) is None
    p = calibration.calibrated(df.limit(1), 3.0).first().probabilities
    assert sum(p) == pytest.approx(1.0)
    error = calibration.calibration_error(spark.createDataFrame([(0.95, True), (0.95, False), (1.0, True), (None, True)], "c double, ok boolean"), "c", "ok").first()
    assert error.n == 3 and error.error == pytest.approx(abs(2.9 / 3 - 2 / 3))


def test_repair_of_records(spark):
    kind = "record long, image string, decision string, width double, height double, proposals array<struct<class_name:string,x1:double,y1:double,x2:double,y2:double>>"
    good, near, wide, odd, free = ("a", 1.0, 1.0, 5.0, 5.0), ("a", 1.0001, 1.0, 5.0, 5.0), ("a", 0.0, 0.0, 50.0, 5.0), ("z", 1.0, 1.0, 5.0, 5.0), (None, 1.0, 1.0, 5.0, 5.0)
    rows = [
        (1, "i", "accepted", 10.0, 10.0, [good, wide]), (2, "i", "corrected", 10.0, 10.0, [near, near]), (3, "i", "rejected", 10.0, 10.0, [odd]), (4, "i", "accepted", 10.0, 10.0, [odd]), (5, "j", "accepted", None, None, [wide]),
        (6, "i", "accepted", 10.0, 10.0, None), (7, "i", "accepted", 10.0, 10.0, []), (8, "i", None, 10.0, 10.0, [odd]), (9, None, "accepted", None, None, [free]), (10, None, "accepted", None, None, [free]),
    ]
    got = {r.record: r for r in rules.repair_records(spark.createDataFrame(rows, kind), ["a"]).collect()}
    assert {k: r.dropped for k, r in got.items()} == {1: None, 2: "duplicate", 3: None, 4: "emptied", 5: None, 6: None, 7: "duplicate", 8: None, 9: None, 10: "duplicate"}
    assert [x.reason for x in got[1].removed] == ["outside_frame"] and [x.reason for x in got[4].removed] == ["class_name"] and len(got[5].proposals) == 1 and got[3].removed == [] and len(got[3].proposals) == 1


def test_fan_out_keeps_items_without_boxes(spark):
    kind = "image string, category string, action string, coordinates array<double>, boxes array<array<double>>"
    rows = [("a", "A_EMPTY_LABEL", "MANUALLY_ANNOTATE", None, [[1.0], [2.0]]), ("b", "A_EMPTY_LABEL", "MANUALLY_ANNOTATE", [9.0], []), ("c", "A_EMPTY_LABEL", "MANUALLY_ANNOTATE", None, None), ("d", "D_UNCERTAIN", "CORRECT", [3.0], [[4.0]]), ("e", None, None, None, None)]
    got = sorted((r.image, r.coordinates) for r in resolve.fan_out(spark.createDataFrame(rows, kind)).collect())
    assert got == [("a", [1.0]), ("a", [2.0]), ("b", None), ("c", None), ("d", [3.0]), ("e", None)]


def test_class_confusions(spark):
    from curata.operators import review

    rows = [(1, "x", "y"), (1, "y", "x"), (1, "x", "x"), (2, "y", "x"), (3, "x", "z"), (4, "x", "x")]
    got = {tuple(r.classes): r.n for r in review.class_confusions(spark.createDataFrame(rows, "frame long, truth_class string, class_name string")).collect()}
    assert got == {("x", "y"): 3, ("x", "z"): 1}


def test_source_profile(spark):
    from curata.operators import tables

    rows = [("/r/a/x.png", "x.png", ".png", "a", 1, True), ("/r/a/d/x.png", "x.png", ".png", "d", 0, False), ("/r/top.png", "top.png", ".png", "r", 2, None)]
    files = spark.createDataFrame(rows, "path string, name string, extension string, folder string, length long, readable boolean")
    labels = spark.createDataFrame([("a", "x", True), ("b", None, False), ("c", None, None)], "label string, class string, accepted boolean")
    got = {(r.facet, r.value): r.n for r in tables.profile(files, "/r", labels).collect()}
    want = {("class", "a"): 2, ("class", "."): 1, ("nested_files", "all"): 1, ("corrupt_files", "all"): 2, ("empty_files", "all"): 1, ("repeated_name", "x.png"): 2, ("accepted_label", "a"): 2, ("rejected_label", "b"): 0, ("rejected_label", "c"): 0, ("accepted_files", "all"): 2, ("rejected_files", "all"): 0}
    assert {k: n for k, n in got.items() if k[0] not in ("extension", "folder")} == want
