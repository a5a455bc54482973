"""Declarative rules: tables of conditions compiled into findings.

A finding is (ref, kind, severity, detail). Row rules are one projection that builds an array of
findings and explodes it; rules across rows use windows or sums over keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.scalar import parse_time

FINDING = "struct<kind:string,severity:string,detail:string>"


def finding(when: Column, kind: str, severity: str, detail: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))


def findings(df: DataFrame, ref: str, rules: list[Column]) -> DataFrame:
    """(ref, kind, severity, detail): one row for each rule that fires on a row."""
    # a lambda, as of ``array_compact``, would have all rules interpreted row by row
    every = df.select(F.col(ref).cast("string").alias("ref"), F.explode(F.array(*[r.cast(FINDING) for r in rules])).alias("f"))
    return every.filter("f IS NOT NULL").select("ref", "f.*")


@dataclass(frozen=True)
class Field:
    name: str
    required: bool = False
    allowed: tuple[str, ...] = ()
    number: bool = False
    low: float | None = None
    high: float | None = None
    time: bool = False


def _missing(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def field_rules(fields: list[Field]) -> list[Column]:
    """Missing required (error) and optional (warning) values, values outside a list (warning), numbers that don't parse or lie
    out of bounds (error), times of no accepted form (error)."""
    rules = []
    for f in fields:
        here, value = ~_missing(f.name), F.col(f.name).cast("string")
        rules.append(finding(_missing(f.name), "missing_required" if f.required else "missing_optional", "error" if f.required else "warning", f.name))
        if f.allowed:
            rules.append(finding(here & ~F.lower(F.trim(value)).isin(*f.allowed), "invalid_label", "warning", F.concat(F.lit(f.name + "="), value)))
        if f.number:
            parsed = value.try_cast("double")
            bad = parsed.isNull()
            if f.low is not None:
                bad = bad | (parsed < f.low)
            if f.high is not None:
                bad = bad | (parsed > f.high)
            rules.append(finding(here & bad, "invalid_value", "error", F.concat(F.lit(f.name + "="), value)))
        if f.time:
            rules.append(finding(here & parse_time(value).isNull(), "invalid_value", "error", F.concat(F.lit(f.name + "="), value)))
    return rules


def repeated_values(df: DataFrame, ref: str, key: str, order: str, kind: str, severity: str = "error") -> DataFrame:
    """Findings for the second and later rows of a key, in the given order, a number that no two rows share; empty keys are left
    out. Only the first of each key is looked up, so that a key of very many rows is no one task's work."""
    known = df.filter(~_missing(key))
    first = known.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = known.join(first, key)
    return findings(rows, ref, [finding(F.col(order) > F.col("_first"), kind, severity, F.concat(F.lit(key + "="), F.col(key).cast("string")))])


def conflicting_values(df: DataFrame, ref: str, key: str, value: str, order: str, kind: str) -> DataFrame:
    """Findings for rows whose value differs from that of the first row of their key."""
    leaders = df.filter(~_missing(key) & ~_missing(value)).groupBy(key).agg(F.min_by(value, order).alias("_lead"))
    rows = df.join(leaders, key)
    return findings(rows, ref, [finding(F.col(value) != F.col("_lead"), kind, "error", F.concat(F.col(key).cast("string"), F.lit(": "), F.col(value).cast("string"), F.lit(" vs "), F.col("_lead").cast("string")))])


def mixed_states(df: DataFrame, keys: list[str], state: str, kind: str) -> DataFrame:
    """Warnings for keys that hold more than one state."""
    seen = df.groupBy(*keys).agg(F.array_sort(F.collect_set(state)).alias("states")).filter(F.size("states") > 1)
    ref = seen.withColumn("_ref", F.concat_ws("/", *keys))
    return findings(ref, "_ref", [finding(F.lit(True), kind, "warning", F.concat_ws("+", "states"))])


def valid_rows(total: DataFrame, found: DataFrame, kinds: tuple[str, ...] = ("missing_required", "invalid_value")) -> DataFrame:
    """One row: total, invalid (distinct refs with a finding of these kinds), valid."""
    bad = found.filter(F.col("kind").isin(*kinds)).agg(F.count_distinct("ref").alias("invalid"))
    return total.agg(F.count("*").alias("total")).crossJoin(bad).withColumn("valid", F.col("total") - F.col("invalid"))


# The manifest's fields, vocabularies and bounds.
MANIFEST_FIELDS = [
    Field("image_id", True), Field("image_path", True), Field("fruit_type", True), Field("freshness_label", True, ("fresh", "stale", "rotten")), Field("physical_fruit_id", True),
    Field("capture_session_id", True), Field("capture_timestamp", True, time=True), Field("camera_id", True), Field("lighting_condition"), Field("background_type"), Field("viewing_angle"),
    Field("occlusion_level", number=True, low=0.0, high=1.0), Field("distance_category"), Field("storage_condition"), Field("days_since_purchase", number=True, low=0.0), Field("annotator"),
    Field("annotation_confidence", number=True, low=0.0, high=1.0),
]


def validate_manifest(df: DataFrame, fields: list[Field] = MANIFEST_FIELDS, ref: str = "row_number") -> DataFrame:
    """All findings of a manifest of text columns with ``row_number``."""
    row = findings(df, ref, field_rules(fields))
    sets = [
        repeated_values(df, ref, "image_id", ref, "duplicate_id"), repeated_values(df, ref, "image_path", ref, "duplicate_path"),
        conflicting_values(df, ref, "physical_fruit_id", "fruit_type", ref, "type_conflict"),
        mixed_states(df.filter(F.col("freshness_label").isin("fresh", "rotten")), ["capture_session_id", "physical_fruit_id"], "freshness_label", "impossible_combination"),
    ]
    for s in sets:
        row = row.unionByName(s)
    return row


def manifest_files(manifest: DataFrame, files: DataFrame, ref: str = "row_number", path: str = "image_path", file: str = "path", digest: str = "md5") -> DataFrame:
    """Findings of a manifest against a listing of files (path, digest), as ``readers.hashed_files`` gives it, its paths relative to the manifest's folder: rows whose
    file is missing, and rows whose file has the bytes of another file that an earlier row names. Rows that name one file twice are no byte
    duplicates of each other. Only the first path of each digest is looked up, so that many copies of a file are no one task's work."""
    rows = manifest.filter(~_missing(path)).select(F.col(ref).alias("_ref"), F.col(path).alias("_path"))
    known = files.select(F.col(file).alias("_path"), F.col(digest).alias("_digest")).groupBy("_path").agg(F.max("_digest").alias("_digest"))
    met = rows.join(known, "_path", "left")
    missing = findings(met, "_ref", [finding(F.col("_digest").isNull(), "missing_file", "error", F.col("_path"))])
    first = met.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.min_by("_path", "_ref").alias("_first"), F.count_distinct("_path").alias("_n")).filter("_n > 1").drop("_n")
    again = met.join(first, "_digest")
    return missing.unionByName(findings(again, "_ref", [finding(F.col("_path") != F.col("_first"), "duplicate_file", "error", F.concat_ws(" = ", "_first", "_path"))]))


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: conditions on a column of ``withColumn`` are carried to the source, where each mention
    of it computes it again; on one that is generated they stay behind it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


#: The first five fields of a label line as numbers, null where they are none.
NUMBERS = ("_n0", "_n1", "_n2", "_n3", "_n4")


def label_fields(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with ``parts``, their fields, and ``NUMBERS``."""
    rows = _computed(_computed(lines, _line=F.trim("raw")).filter("_line <> ''"), parts=F.split("_line", r"\s+")).drop("_line")
    return _computed(rows, **{name: F.get("parts", F.lit(i)).try_cast("double") for i, name in enumerate(NUMBERS)})


def label_line_rules(classes: int) -> tuple[list[Column], Column]:
    """(rules, usable) for rows of ``label_fields``: malformed lines are unusable, range faults are kept."""
    parts = F.col("parts")
    five, numeric = F.size(parts) == 5, F.size(parts) == 5
    for name in NUMBERS:
        numeric = numeric & F.col(name).isNotNull() & ~F.isnan(name)
    at = lambda i: F.col(NUMBERS[i])
    class_ok = numeric & (at(0) == F.floor(at(0))) & (at(0) >= 0) & (at(0) < classes)
    usable = class_ok
    rules = [
        finding(~five, "field_count", "error", F.concat(F.size(parts).cast("string"), F.lit(" fields"))),
        finding(five & ~numeric, "non_numeric", "error", "value"),
        finding(numeric & ~class_ok, "invalid_class", "error", F.get(parts, F.lit(0))),
        finding(class_ok & ((at(1) < 0) | (at(1) > 1) | (at(2) < 0) | (at(2) > 1)), "center_out_of_range", "error", "cx, cy"),
        finding(class_ok & ((at(3) <= 0) | (at(3) > 1) | (at(4) <= 0) | (at(4) > 1)), "size_out_of_range", "error", "w, h"),
        finding(class_ok & (at(3) * at(4) >= 0.95), "covers_almost_all", "warning", "w * h"),
    ]
    return rules, usable


def audit_label_lines(lines: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """(findings, boxes) from label lines (split, stem, line_no, raw). Blank lines are left out; a line that repeats an earlier one
    of its file to 1e-9 is a finding."""
    rows = label_fields(lines).withColumn("ref", F.concat_ws(":", "split", "stem", F.col("line_no").cast("string")))
    rules, usable = label_line_rules(classes)
    found = findings(rows, "ref", rules)
    boxes = rows.filter(usable).select("split", "stem", "line_no", "ref", *[F.col(n).alias(c) for n, c in zip(NUMBERS, ("class_id", "cx", "cy", "w", "h"), strict=True)]).withColumn("class_id", F.col("class_id").cast("int"))
    same = ["split", "stem", "class_id", *[F.round(F.col(c), 9) for c in ("cx", "cy", "w", "h")]]
    again = boxes.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("line_no")))
    return found.unionByName(findings(again, "ref", [finding(F.col("_r") > 1, "duplicate_row", "warning", "earlier line")])), boxes.drop("ref")


def first_error(conditions: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, or null."""
    out = F.lit(None).cast("string")
    for name, c in reversed(conditions):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def strict_box_error(cx: Column, cy: Column, w: Column, h: Column, eps: float = 1e-6) -> Column:
    """First fault of a normalised box, which has to lie in the frame; null for a sound one."""
    return first_error([
        ("missing", cx.isNull() | cy.isNull() | w.isNull() | h.isNull()), ("center_out_of_range", (cx < 0) | (cx > 1) | (cy < 0) | (cy > 1)), ("size_out_of_range", (w <= 0) | (w > 1) | (h <= 0) | (h > 1)),
        ("outside_frame", (cx - w / 2 < -eps) | (cx + w / 2 > 1 + eps) | (cy - h / 2 < -eps) | (cy + h / 2 > 1 + eps)),
    ])


def pixel_box_error(values: Column, frame_width: Column, frame_height: Column) -> Column:
    """First fault of an array of four pixel values."""
    v = lambda i: F.get(values, F.lit(i))
    return first_error([
        ("four_values", values.isNull() | (F.size(values) != 4) | F.exists(values, lambda x: x.isNull())), ("degenerate", (v(2) <= v(0)) | (v(3) <= v(1))),
        ("under_one_pixel", (v(2) - v(0) < 1) | (v(3) - v(1) < 1)), ("outside_frame", (v(0) < 0) | (v(1) < 0) | (v(2) > frame_width) | (v(3) > frame_height)),
    ])


def image_faults(brightness: Column, contrast: Column, blur: Column) -> dict[str, Column]:
    # fixed values: limits of a usable image
    return {"blurry": blur < 100, "too_dark": brightness < 40, "too_bright": brightness > 220, "low_contrast": contrast < 20}


def loader_gate(df: DataFrame, least_side: int = 224, blur: float = 100.0, dark: float = 40.0, bright: float = 220.0) -> DataFrame:
    """``df`` (readable, width, height, blur_score, brightness) with ``reasons`` for which a loader skips an image, and ``accepted``. One
    that can't be read is low in resolution, blurry and dark too."""
    unreadable = ~F.coalesce("readable", F.lit(False))
    low = lambda c, bound: unreadable | F.coalesce(F.col(c) < bound, F.lit(True))
    rules = [
        F.when(unreadable, "unreadable"), F.when(low("width", least_side) | low("height", least_side), "low_resolution"), F.when(low("blur_score", blur), "blurry"),
        F.when(low("brightness", dark), "underexposed"), F.when(~unreadable & (F.col("brightness") > bright), "overexposed"),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*rules))).withColumn("accepted", F.size("reasons") == 0)


def accepted_rows(df: DataFrame) -> DataFrame:
    return df.filter("accepted")


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.filter("NOT accepted")


def annotation_directory(images: DataFrame, lines: DataFrame, classes: int) -> DataFrame:
    """(image, status, line_no, error) of hand-drawn labels: images (image, has_label) and their lines (image, line_no, raw).

    An image without a label file is ``missing``; the first faulty line of a file makes it ``invalid``; blank lines are
    left out. Rows touch the frame's edge at most."""
    rows = label_fields(lines)
    c, x, y, w, h = map(F.col, NUMBERS)
    error = first_error([
        ("field_count", F.size("parts") != 5), ("non_numeric", c.isNull() | x.isNull() | y.isNull() | w.isNull() | h.isNull()), ("class_id", (c != F.floor(c)) | (c < 0) | (c >= classes)), ("out_of_range", (x < 0) | (x > 1) | (y < 0) | (y > 1)),
        ("zero_size", (w <= 0) | (h <= 0)), ("outside_frame", (x + w / 2 > 1) | (y + h / 2 > 1) | (x - w / 2 < 0) | (y - h / 2 < 0)),
    ])
    first = rows.withColumn("error", error).filter("error IS NOT NULL").groupBy("image").agg(F.min(F.struct("line_no", "error")).alias("bad"))
    status = F.when(~F.coalesce("has_label", F.lit(False)), "missing").when(F.col("bad").isNotNull(), "invalid").otherwise("valid")
    named = F.when(status == "invalid", F.col("bad"))
    return images.join(first, "image", "left").select("image", status.alias("status"), named["line_no"].alias("line_no"), named["error"].alias("error"))


def dataset_checks(files: DataFrame, manifest: DataFrame, metadata: DataFrame, mapping: DataFrame, classes: list[str], groups: DataFrame, hashes: tuple[DataFrame, DataFrame], splits=("train", "valid", "test")) -> DataFrame:
    """(check, passed, n) of a built dataset: every named check with its violations.

    files (path, split, class, length, readable, sha256); manifest (path, split, class, source, license, url, group); metadata
    (class, split, n); mapping (id, class); groups of near duplicates (group, path); hashes, a baseline and its current state
    (name, sha256). A class is missing from a split if it has no file there; a group leaks if its rows are of one class and
    of several splits; class lists that are empty fail."""
    spark = files.sparkSession
    listed = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "id int, class string")
    grid = listed.select("class").crossJoin(spark.createDataFrame([(s,) for s in splits], "split string"))
    here = files.select("class", "split").distinct()
    named = [(f"class_dirs_exist_{s}", grid.filter(F.col("split") == s).join(here, ["class", "split"], "left_anti")) for s in splits]
    off = mapping.select(F.col("id").cast("int").alias("id"), "class").exceptAll(listed).unionByName(listed.exceptAll(mapping.select(F.col("id").cast("int").alias("id"), "class")))
    shared = files.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    spans = groups.join(manifest.select("path", "class", "split"), "path").groupBy("group").agg(F.count_distinct("split").alias("s"), F.count_distinct("class").alias("c"))
    counted = files.groupBy("class", "split").agg(F.count("*").alias("found"))
    both = grid.join(metadata.select("class", "split", F.col("n").alias("recorded")), ["class", "split"], "left").join(counted, ["class", "split"], "left")
    verdicts = compare_hashes(*hashes)
    named += [
        ("class_mapping_correct", off), ("all_images_readable", files.filter(~F.coalesce("readable", F.lit(False)))), ("no_zero_byte", files.filter("length = 0")),
        ("no_cross_split_duplicates", shared), ("no_sha256_leakage", shared), ("near_duplicates_listed", spark.range(1).join(groups.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti")),
        ("no_near_duplicate_cross_split", spans.filter("s > 1 AND c = 1")), ("provenance_exists", manifest.filter(_missing("source"))), ("license_exists", manifest.filter(_missing("license"))),
        ("source_url_exists", manifest.filter(_missing("url"))), ("no_ambiguous_labels", manifest.filter(_missing("class"))),
        ("metadata_matches_files", both.filter(~F.col("recorded").eqNullSafe(F.coalesce("found", F.lit(0))))),
        ("manifest_matches_files", manifest.join(files.select("path"), "path", "left_anti")), ("manifest_has_rows", spark.range(1).join(manifest.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti")),
        ("recorded_files_unchanged", verdicts.filter("verdict = 'changed'")), ("recorded_files_present", verdicts.filter("verdict = 'missing'")), ("no_unrecorded_files", verdicts.filter("verdict = 'new'")),
    ]
    return checks(*named)


def quality_report(df: DataFrame) -> DataFrame:
    """``df`` (brightness, contrast, blur) with every fault as a flag, the first one in gate order, all as a list, and the share of
    checks passed."""
    faults = image_faults(F.col("brightness"), F.col("contrast"), F.col("blur"))
    out = df.withColumns(faults)
    return out.withColumns({
        "first_fault": first_error([(n, F.col(n)) for n in faults]), "faults": F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in faults])),
        "score": sum(((~F.col(n)).cast("double") for n in faults), F.lit(0.0)) / len(faults),
    })


def hard_case_reasons(df: DataFrame, low: float = 0.5, high: float = 0.9, blur: float = 100.0, dark: float = 40.0, bright: float = 220.0) -> DataFrame:
    """``df`` with ``reasons``: why a frame is hard, by parallel rules; null inputs never fire."""
    c = F.coalesce("confidence", F.lit(0.0))
    wrong = F.col("true_class").isNotNull() & ~F.col("predicted_class").eqNullSafe(F.col("true_class"))
    rules = [
        F.when(c < low, F.concat(F.lit("low_confidence_"), F.format_string("%.3f", c))), F.when(wrong & (c > high), F.concat(F.lit("high_confidence_error_"), F.format_string("%.3f", c))),
        F.when(wrong & (c <= high), F.lit("misclassified")), F.when(F.col("blur_score") < blur, F.concat(F.lit("blurry_"), F.format_string("%.1f", F.col("blur_score")))),
        F.when(F.col("brightness") < dark, F.lit("too_dark")), F.when(F.col("brightness") > bright, F.lit("too_bright")),
        F.when(F.abs(F.col("detector_confidence") - F.col("classifier_confidence")) > 0.3, F.lit("detector_classifier_disagreement")),
        F.when(F.col("stability_score") < 0.5, F.lit("temporally_unstable")), F.when((c > 0.4) & (c < 0.6), F.lit("near_decision_boundary")),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*rules)))


def reason_distribution(df: DataFrame) -> DataFrame:
    """(reason, n, percent of hard rows), the figures behind a reason cut off."""
    hard = df.filter(F.size("reasons") > 0)
    total = hard.agg(F.count("*").alias("total"))
    each = hard.select(F.explode("reasons").alias("r")).groupBy(F.regexp_replace("r", r"_\d+\.\d+$", "").alias("reason")).agg(F.count("*").alias("n"))
    return each.crossJoin(total).select("reason", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def range_fault(values: Column) -> Column:
    """First fault of a [low, high] range of whole numbers, 0 <= low <= high, high > 0."""
    lo, hi = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    return first_error([("two_values", values.isNull() | (F.size(values) != 2)), ("missing", lo.isNull() | hi.isNull()), ("negative", lo < 0), ("order", lo > hi), ("zero", hi <= 0)])


def missing_fields(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("missing", F.array_compact(F.array(*[F.when(_missing(n), F.lit(n)) for n in names])))


def compare_hashes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(name, verdict): unchanged, changed, missing or new, from (name, sha256) tables."""
    joined = baseline.select("name", F.col("sha256").alias("a")).join(current.select("name", F.col("sha256").alias("b")), "name", "full")
    return joined.select("name", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("verdict"))


def checks(*named: tuple[str, DataFrame]) -> DataFrame:
    """(check, passed, n): each named table of violations has to be empty."""
    out = None
    for name, bad in named:
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), "n")
        out = one if out is None else out.unionByName(one)
    return out


DECISIONS = ("accepted", "corrected", "rejected", "kept", "uncertain")


def review_gate(records: DataFrame, classes: list[str], frame_width: int = 10_000, frame_height: int = 10_000) -> DataFrame:
    """Findings that block a rebuild: records (image, decision, final_class_id, final_class, final_box, reviewer)."""
    decision = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    changes = decision.isin("accepted", "corrected")
    names = F.array(*[F.lit(c) for c in classes])
    ident = F.col("final_class_id")
    fault = pixel_box_error(F.col("final_box"), F.lit(frame_width), F.lit(frame_height))
    rules = [
        finding(_missing("image"), "malformed", "error", "image"), finding(decision == "", "undecided", "error", "decision"), finding((decision != "") & ~decision.isin(*DECISIONS), "unknown_decision", "error", decision),
        finding(decision == "uncertain", "uncertain", "error", "decision"), finding(decision.isin(*DECISIONS) & _missing("reviewer"), "no_reviewer", "error", "reviewer"),
        finding(changes & fault.isNotNull(), "invalid_box", "error", fault), finding(changes & (ident.isNull() | (ident < 0) | (ident >= len(classes))), "invalid_class_id", "error", ident.cast("string")),
        finding(changes & ~F.coalesce(F.get(names, ident) == F.col("final_class"), F.lit(False)), "invalid_class_name", "error", F.col("final_class")),
    ]
    return findings(records, "record", rules)


def repair_records(records: DataFrame, classes: list[str], order: str = "record") -> DataFrame:
    """``records`` (record, image, decision, width, height, proposals of (class_name, x1, y1, x2, y2)) with ``proposals`` cleaned, ``removed``, the proposals taken
    out with their reason, and ``dropped``, why a record goes: ``emptied`` or ``duplicate``; null for those that stay.

    Only accepted and corrected records are repaired. A proposal goes for a class name that isn't known (null is no name), or for a box that is empty or leaves an image of known
    size. Records of an image with equal sets of proposals, to 3 places, are one: the first in order stays, which is found by an aggregate, so many
    copies are no one task's work."""
    changes = F.coalesce(F.col("decision").isin("accepted", "corrected"), F.lit(False))
    known = F.array(*map(F.lit, classes))
    coordinates = ("x1", "y1", "x2", "y2")

    def fault(p):
        x1, y1, x2, y2 = (F.coalesce(p[c].cast("double"), F.lit(0.0)) for c in coordinates)
        sized = F.col("width").isNotNull() & F.col("height").isNotNull()
        outside = sized & ((x2 <= x1) | (y2 <= y1) | (x1 < 0) | (y1 < 0) | (x2 > F.col("width")) | (y2 > F.col("height")))
        return F.when(p["class_name"].isNotNull() & ~F.array_contains(known, p["class_name"]), "class_name").when(outside, "outside_frame")

    given = F.coalesce("proposals", F.array().cast(dict(records.dtypes)["proposals"]))
    rows = records.withColumn("proposals", given)
    bad = F.filter(F.transform("proposals", lambda p: F.struct(p.alias("proposal"), fault(p).alias("reason"))), lambda x: x["reason"].isNotNull())
    rows = rows.withColumns({"removed": F.when(changes, bad).otherwise(F.slice(bad, 1, 0)), "_before": F.size("proposals")})
    rows = rows.withColumn("proposals", F.when(changes, F.filter("proposals", lambda p: fault(p).isNull())).otherwise(F.col("proposals")))
    emptied = changes & (F.col("_before") > 0) & (F.size("proposals") == 0)
    sign = F.transform("proposals", lambda p: F.concat_ws(",", F.coalesce(p["class_name"], F.lit("?")), *[F.round(p[c].cast("double"), 3).cast("string") for c in coordinates]))
    rows = rows.withColumn("_sign", F.when(changes & ~emptied, F.array_join(F.array_sort(F.array_distinct(sign)), ";")))
    first = rows.filter("_sign IS NOT NULL").groupBy("image", "_sign").agg(F.min(order).alias("_first")).withColumnsRenamed({"image": "_image", "_sign": "_s"})
    met = rows.join(first, F.col("image").eqNullSafe(F.col("_image")) & (F.col("_sign") == F.col("_s")), "left")
    dropped = F.when(emptied, "emptied").when(F.col(order) > F.col("_first"), "duplicate")
    return met.withColumn("dropped", dropped).drop("_before", "_sign", "_image", "_s", "_first")


def recommendations(metrics: DataFrame) -> DataFrame:
    """(topic, advice) from one row (imbalance, affected_files, duplicates)."""
    rules = [
        F.when(F.col("imbalance") >= 5, F.struct(F.lit("imbalance").alias("topic"), F.lit("collect more of the rare classes").alias("advice"))),
        F.when(F.col("affected_files") > 0, F.struct(F.lit("labels").alias("topic"), F.lit("repair the affected label files").alias("advice"))),
        F.when(F.col("duplicates") > 0, F.struct(F.lit("duplicates").alias("topic"), F.lit("remove duplicate images").alias("advice"))),
    ]
    return metrics.select(F.explode(F.array_compact(F.array(*rules))).alias("x")).select("x.*")


def proposal_priority(n_proposals: Column, confidence: Column, disagrees: Column) -> Column:
    return F.when(disagrees | (n_proposals == 0), "HIGH").when(confidence < 0.5, "MEDIUM").otherwise("LOW")


def readiness(counts: DataFrame, least: int = 50, critical: int = 20, least_valid: int = 10, least_test: int = 10) -> DataFrame:
    """``counts`` (class, train, valid, test) with a verdict a class."""
    total = F.col("train") + F.col("valid") + F.col("test")
    verdict = F.when(total < critical, "critical").when(total < least, "insufficient").when((F.col("valid") < least_valid) | (F.col("test") < least_test), "thin_evaluation").otherwise("ready")
    return counts.withColumns({"total": total, "verdict": verdict})


def readiness_verdict(report: DataFrame) -> DataFrame:
    """One row (errors, leaks, groups, sessions, imbalance) with an ordered verdict."""
    v = (
        F.when(F.col("errors") > 0, "fix_errors").when(F.col("leaks") > 0, "leaking_splits").when(F.col("groups") < 3, "too_few_groups")
        .when(F.col("sessions") < 2, "too_few_sessions").when(F.col("imbalance") > 3.0, "imbalanced").otherwise("ready")
    )
    return report.withColumn("verdict", v)


def resolution_manifest(items: DataFrame, queue: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Findings of a resolution manifest (image, category, action, box): keys present, (image, category) once and in the queue, action
    allowed for its category, replace actions with a box."""
    known = queue.select("image", "category").distinct().withColumn("_q", F.lit(True))
    n = F.count("*").over(Window.partitionBy("image", "category"))
    rows = items.withColumn("_n", n).join(known, ["image", "category"], "left")
    ok = F.lit(False)
    for category, actions in allowed.items():
        ok = ok | ((F.col("category") == category) & F.col("action").isin(*actions))
    rules = [
        finding(_missing("image") | _missing("category"), "missing_key", "error", "image, category"), finding(F.col("_n") > 1, "repeated_item", "error", F.concat_ws("/", "image", "category")),
        finding(F.col("_q").isNull(), "not_in_queue", "error", F.concat_ws("/", "image", "category")), finding(~F.coalesce(ok, F.lit(False)), "action_not_allowed", "error", F.col("action")),
        finding((F.col("action") == "replace") & (F.col("box").isNull() | (F.size("box") != 4)), "missing_payload", "error", "box"),
    ]
    return findings(rows.withColumn("_ref", F.concat_ws("/", "image", "category", "action")), "_ref", rules)
