"""Resolutions of a review: each action of a manifest rewrites a record's decision, box, action word and notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.operators.review import CATEGORIES, yolo_row_error

EMPTY, MANUAL, TIGHTEN, UNCERTAIN = CATEGORIES


@dataclass(frozen=True)
class Rewrite:
    """What an action makes of a record. ``decision`` None: nothing, the record stays blocked. ``scope``: ``image`` makes all records of the image
    like its first one, ``all`` rewrites each, ``listed`` those of the named proposals. ``box``: ``row`` takes the manifest's coordinates, ``none`` clears it, ``same`` leaves
    it. ``word`` becomes the record's action word, if given."""

    decision: str | None = None
    scope: str = "image"
    box: str = "same"
    word: str | None = None
    note: str | None = None


# Actions by category, decisions and action words.
DRAWN = "manual_annotation_supplied"
REWRITES: dict[tuple[str, str], Rewrite] = {
    (EMPTY, "MANUALLY_ANNOTATE"): Rewrite("annotate", box="row", word=DRAWN),
    (EMPTY, "CONFIRM_BACKGROUND"): Rewrite("keep_empty", box="none", word="no_change"),
    (EMPTY, "MARK_UNCERTAIN"): Rewrite(),
    **{(c, "KEEP"): Rewrite("keep", box="none", word="no_change") for c in (MANUAL, TIGHTEN)},
    **{(c, a): Rewrite("tighten", box="row", word=DRAWN) for c in (MANUAL, TIGHTEN) for a in ("TIGHTEN", "REPLACE")},
    **{(c, "UNCERTAIN"): Rewrite() for c in (MANUAL, TIGHTEN)},
    (UNCERTAIN, "ACCEPT_SELECTED"): Rewrite("accepted", "listed"),
    (UNCERTAIN, "ACCEPT_ALL"): Rewrite("accepted", "all"),
    (UNCERTAIN, "REJECT_SELECTED"): Rewrite("rejected", "listed"),
    (UNCERTAIN, "KEEP_ORIGINAL"): Rewrite("kept", "all"),
    (UNCERTAIN, "CORRECT"): Rewrite("corrected", "listed"),
    (UNCERTAIN, "UNCERTAIN"): Rewrite(),
}
REVIEWER = "human"
DEFAULT_NOTE = "human resolution"

RECORD = ["record", "image", "proposal_id", "decision", "action", "bbox", "reviewer", "notes"]
FIELDS = ["decision", "action", "bbox", "reviewer", "notes"]


def _plan(rewrites: dict[tuple[str, str], Rewrite]) -> Column:
    """The rewrite of a manifest row's (category, action), a struct; null where the category has no such action."""
    kind = "struct<decision:string,scope:string,box:string,word:string>"
    plan = F.lit(None).cast(kind)
    for (category, action), r in rewrites.items():
        made = F.struct(*[F.lit(x).cast("string").alias(n) for n, x in (("decision", r.decision), ("scope", r.scope), ("box", r.box), ("word", r.word))])
        plan = F.when((F.col("category") == category) & (F.col("action") == action), made.cast(kind)).otherwise(plan)
    return plan


def judge(records: DataFrame, manifest: DataFrame, classes: int, rewrites: dict[tuple[str, str], Rewrite] = REWRITES) -> DataFrame:
    """The manifest's rows (image, category, action, coordinates, proposal_ids, notes) with their ``plan``, ``status`` and ``detail``.

    ``applied``; ``skipped`` for no_record, stays_blocked or nothing_listed (no proposal of the image is listed); ``refused`` for
    unknown_category, action_not_allowed, repeated (an image that the manifest resolves twice), no_coordinates or a fault of the coordinates."""
    listed = records.groupBy("image").agg(F.collect_set("proposal_id").alias("_has"))
    rows = manifest.join(listed, "image", "left").join(manifest.groupBy("image").agg(F.count("*").alias("_n")), "image")
    rows = rows.withColumn("plan", _plan(rewrites))
    drawn = F.col("plan.box") == "row"
    known = sorted({c for c, _ in rewrites})
    ids = F.coalesce("proposal_ids", F.array().cast("array<string>"))
    faults = [
        ("refused", "unknown_category", F.col("category").isNull() | ~F.col("category").isin(*known)), ("refused", "action_not_allowed", F.col("plan").isNull()), ("skipped", "no_record", F.col("_has").isNull()),
        ("refused", "repeated", F.col("_n") > 1), ("skipped", "stays_blocked", F.col("plan.decision").isNull()), ("refused", "no_coordinates", drawn & F.coalesce(F.size("coordinates") <= 0, F.lit(True))),
    ]
    status, detail = F.lit("applied"), F.lit(None).cast("string")
    wrong = yolo_row_error(F.col("coordinates"), classes)
    nothing = (F.col("plan.scope") == "listed") & ~F.arrays_overlap(ids, "_has")
    for s, d, c in [("skipped", F.lit("nothing_listed"), nothing), ("refused", wrong, drawn & wrong.isNotNull()), *[(s, F.lit(d), c) for s, d, c in reversed(faults)]]:
        status, detail = F.when(c, F.lit(s)).otherwise(status), F.when(c, d).otherwise(detail)
    return rows.withColumns({"status": status, "detail": detail}).drop("_has", "_n")


def merge(records: DataFrame, manifest: DataFrame, classes: int, rewrites: dict[tuple[str, str], Rewrite] = REWRITES) -> tuple[DataFrame, DataFrame]:
    """(merged, log): ``records`` (``RECORD``) after a manifest, and a row a manifest row: image, category, action, status, detail.

    Nothing is applied of a row that isn't ``applied``. Where any row is refused a caller that wants all or nothing keeps the old records: the
    log is known before the merged records are read."""
    judged = judge(records, manifest, classes, rewrites)
    todo = judged.filter("status = 'applied'").select("image", "plan", "coordinates", F.coalesce("proposal_ids", F.array().cast("array<string>")).alias("_ids"), F.coalesce(F.nullif("notes", F.lit("")), F.lit(DEFAULT_NOTE)).alias("_note"))
    first = records.groupBy("image").agg(F.min_by(F.struct(*RECORD), "record").alias("_first"))
    met = records.join(todo, "image", "left").join(first, "image")
    scope = F.col("plan.scope")
    hit = F.col("plan").isNotNull() & ((scope != "listed") | F.coalesce(F.array_contains("_ids", F.col("proposal_id")), F.lit(False)))
    base = lambda c: F.when(hit & (scope == "image"), F.col(f"_first.{c}")).otherwise(F.col(c))
    box = F.when(F.col("plan.box") == "row", F.col("coordinates")).when(F.col("plan.box") == "none", F.lit(None)).otherwise(F.col("bbox"))
    new = {"decision": F.col("plan.decision"), "action": F.coalesce("plan.word", "action"), "bbox": box, "reviewer": F.lit(REVIEWER), "notes": F.col("_note")}
    merged = met.select("record", "image", base("proposal_id").alias("proposal_id"), *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) for c in FIELDS])
    return merged.select(*RECORD), judged.select("image", "category", "action", "status", "detail")


def changes(records: DataFrame, merged: DataFrame) -> DataFrame:
    """(record, image, field, before, after): the dry run, a row a field that the merge changes; boxes as numbers joined by spaces."""
    text = lambda side, c: F.array_join(F.transform(f"{side}.{c}", lambda x: x.cast("string")), " ") if c == "bbox" else F.col(f"{side}.{c}").cast("string")
    both = records.alias("a").join(merged.alias("b"), F.col("a.record") == F.col("b.record"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), text("a", c).alias("before"), text("b", c).alias("after")) for c in ["proposal_id", *FIELDS]])
    each = both.select("a.record", "a.image", F.explode(pairs).alias("x")).select("record", "image", "x.*")
    return each.filter(~F.col("before").eqNullSafe(F.col("after")))


def fan_out(items: DataFrame) -> DataFrame:
    """``items`` (image, category, action, coordinates, boxes, ...) as rows of a manifest: an item of an empty label that was drawn by hand gives a row for each of its boxes,
    the box being its coordinates; one without boxes stays as it is, and so does every other item."""
    drawn = (F.col("category") == EMPTY) & (F.col("action") == "MANUALLY_ANNOTATE")
    rows = F.when(drawn & (F.size("boxes") > 0), F.col("boxes")).otherwise(F.array(F.when(~F.coalesce(drawn, F.lit(False)), F.col("coordinates"))))
    return items.withColumn("coordinates", F.explode(rows)).drop("boxes")
