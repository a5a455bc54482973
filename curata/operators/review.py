"""Review queues: filters, orders, counts, reports, the state of decisions and the merge of resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.rules import finding, findings, first_error
from curata.operators.tables import rank_order

# Categories of a queue in their order, and levels in theirs.
CATEGORIES = ("A_EMPTY_LABEL", "B_MANUAL_REVIEW", "C_TIGHTEN", "D_UNCERTAIN")
COUNT_NAMES = ("empty", "manual", "tighten", "uncertain")
LEVELS = ("HIGH", "MEDIUM", "LOW")


def _level(priority: str = "priority") -> Column:
    return F.upper(F.coalesce(F.col(priority), F.lit("MEDIUM")))


def filter_queue(items: DataFrame, resolved: DataFrame, keep: str = "all") -> DataFrame:
    """``items`` (image, split, category, priority) that are kept: ``all``, ``high``, ``resolved``, ``unresolved`` or one of
    ``COUNT_NAMES``. ``resolved`` lists (image, category)."""
    if keep in ("resolved", "unresolved"):
        return items.join(resolved.select("image", "category").distinct(), ["image", "category"], "left_semi" if keep == "resolved" else "left_anti")
    if keep == "high":
        return items.filter(_level() == "HIGH")
    return items if keep == "all" else items.filter(F.col("category") == CATEGORIES[COUNT_NAMES.index(keep)])


def queue_order(order: str = "priority") -> list[Column]:
    """Sort keys of a queue by ``priority``, ``category``, ``split`` or ``image``: ranks, then the image's name."""
    level, category = rank_order(_level(), list(LEVELS)), rank_order(F.col("category"), list(CATEGORIES))
    split, image = F.coalesce(F.col("split"), F.lit("")), F.coalesce(F.col("image"), F.lit(""))
    return {"priority": [level, category, image], "category": [category, level, image], "split": [split, level, image], "image": [image]}[order]


def blockers(items: DataFrame) -> DataFrame:
    """Queue items that a build leaves out: those of train and valid with an image; an absent split is train. Test never is."""
    split = F.lower(F.trim(F.coalesce(F.nullif(F.trim("split"), F.lit("")), F.lit("train"))))
    return items.withColumn("split", split).filter(F.col("split").isin("train", "valid") & (F.coalesce(F.col("image"), F.lit("")) != ""))


def queue_counts(items: DataFrame) -> DataFrame:
    """One row: items a category, and ``total``, the number of different images."""
    counts = [F.coalesce(F.sum((F.col("category") == c).cast("long")), F.lit(0)).alias(n) for c, n in zip(CATEGORIES, COUNT_NAMES, strict=True)]
    return items.agg(*counts, F.count_distinct("image").alias("total"))


def proposal_units(proposals: DataFrame, priorities: DataFrame) -> DataFrame:
    """One row an image: its proposals by falling confidence, and level and score from ``priorities`` (image, level, score); images without
    one, or with an unknown level, are MEDIUM at 0. Order it by ``unit_order``."""
    units = proposals.groupBy("image").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(-F.col("confidence"), "proposal_id"))).alias("p"))
    known = priorities.select("image", "level", "score")
    level = F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("MEDIUM")
    joined = units.join(known, "image", "left").withColumns({"level": level, "score": F.coalesce("score", F.lit(0.0))})
    return joined.select("image", "n", F.transform("p", lambda x: x["proposal_id"]).alias("proposals"), "level", "score")


def unit_order() -> list[Column]:
    return [rank_order(F.col("level"), list(LEVELS)), -F.col("score"), F.col("image")]


def priority_report(scored: DataFrame) -> DataFrame:
    """(facet, name, n, value) of scored evidence (level, categories, flags, matched, class_disagreements, proposals, truths, missing,
    confidence_mean): rows by level, category and flag, the agreement of classes among matched pairs, the mean
    confidence of rows with proposals, and the rows that need a box drawn. Shares are 0 where there is nothing."""
    none = F.lit(None).cast("double")
    by = lambda facet, c: scored.select(F.explode(c).alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "name", "n", none.alias("value"))
    has = F.col("proposals") > 0
    total = scored.agg(
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.col("matched") - F.col("class_disagreements")), F.lit(0)).alias("agree"), F.coalesce(F.sum(has.cast("long")), F.lit(0)).alias("with"),
        F.sum(F.when(has, F.col("confidence_mean"))).alias("confidence"), F.coalesce(F.sum(((F.col("truths") == 0) | (F.col("missing") > 0)).cast("long")), F.lit(0)).alias("draw"),
    )
    share = lambda a, b: F.round(F.coalesce(a, F.lit(0.0)) / F.greatest(F.lit(1), b), 4)
    row = lambda name, n, value: F.struct(F.lit("total").alias("facet"), F.lit(name).alias("name"), n.cast("long").alias("n"), value.alias("value"))
    facts = F.array(row("class_agreement", F.col("agree"), share(F.col("agree"), F.col("matched"))), row("mean_confidence", F.col("with"), share(F.col("confidence"), F.col("with"))), row("needs_box", F.col("draw"), none))
    totals = total.select(F.explode(facts).alias("x")).select("x.*")
    return by("level", F.array("level")).unionByName(by("category", F.col("categories"))).unionByName(by("flag", F.col("flags"))).unionByName(totals)


def class_confusions(pairs: DataFrame) -> DataFrame:
    """(classes, n) of matched pairs (frame, truth_class, class_name): the disagreements of the frames whose disagreeing pairs hold just these
    classes, in order."""
    apart = pairs.filter(F.col("truth_class") != F.col("class_name"))
    frames = apart.groupBy("frame").agg(F.count("*").alias("n"), F.collect_set("truth_class").alias("a"), F.collect_set("class_name").alias("b"))
    return frames.groupBy(F.array_sort(F.array_union("a", "b")).alias("classes")).agg(F.sum("n").alias("n"))


def yolo_row_error(row: Column, classes: int) -> Column:
    """First fault of an array [class, cx, cy, w, h] of numbers; null for a sound one."""
    v = lambda i: F.get(row, F.lit(i))
    x, y, w, h = v(1), v(2), v(3), v(4)
    return first_error([
        ("malformed", row.isNull() | (F.size(row) != 5)), ("non_numeric", F.exists(row, lambda n: n.isNull() | F.isnan(n))), ("class_id", (F.round(v(0)) < 0) | (F.round(v(0)) >= classes)),
        ("center", (x < 0) | (x > 1) | (y < 0) | (y > 1)), ("size", (w <= 0) | (w > 1) | (h <= 0) | (h > 1)), ("outside_frame", (x - w / 2 < 0) | (x + w / 2 > 1) | (y - h / 2 < 0) | (y + h / 2 > 1)),
    ])


def resolved_state(records: DataFrame, proposals: DataFrame, manual: DataFrame, classes: list[str], small_class: str = "", least_side: float = 0.02) -> DataFrame:
    """Findings of a resolved state, (ref, kind, severity, detail), in seven groups of checks:

    the gate (every record decided by a known word, none uncertain), proposal ids that don't exist, classes and
    coordinates of accepted proposals and adjudicated boxes, boxes without area, boxes of ``small_class`` with a side under
    ``least_side``, hand-drawn rows (stem, row), and records that repeat image, decision and proposals.

    Records: record, image, decision, class_name, row (array of numbers, null for proposal reviews), proposals (array of
    (proposal_id, class_id, class_name)). Proposal ids are joined, so their number has no bound."""
    decided = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    row, changes = F.col("row"), F.col("row").isNull() & decided.isin("accepted", "corrected")
    names = F.array(*map(F.lit, classes))
    side = lambda i: F.get(row, F.lit(i))
    fault = yolo_row_error(row, len(classes))
    wrong_name = F.exists("proposals", lambda p: p["class_name"].isNotNull() & ~F.array_contains(names, p["class_name"]))
    wrong_id = F.exists("proposals", lambda p: (p["class_id"] < 0) | (p["class_id"] >= len(classes)))
    rules = [
        finding(decided == "", "gate", "error", "undecided"), finding(decided == "uncertain", "gate", "error", "uncertain"),
        finding(changes & F.coalesce(wrong_name, F.lit(False)), "class_name", "error", F.col("image")), finding(changes & F.coalesce(wrong_id, F.lit(False)), "class_id", "error", F.col("image")),
        finding(row.isNotNull() & fault.isNotNull(), "coordinates", "error", fault),
        finding((F.size(row) >= 5) & ((side(3) <= 0) | (side(4) <= 0)), "zero_area", "error", F.col("image")),
        finding((F.col("class_name") == small_class) & (F.size(row) >= 5) & ((side(3) < least_side) | (side(4) < least_side)), "too_small", "error", F.col("image")),
    ]
    found = findings(records, "record", rules)
    named = records.select("record", F.explode("proposals").alias("p")).select("record", "p.proposal_id").filter("proposal_id IS NOT NULL")
    unknown = named.join(proposals.select("proposal_id").distinct(), "proposal_id", "left_anti")
    found = found.unionByName(findings(unknown, "record", [finding(F.lit(True), "unknown_proposal", "error", F.col("proposal_id").cast("string"))]))
    drawn = yolo_row_error(F.col("row"), len(classes))
    found = found.unionByName(findings(manual, "stem", [finding(drawn.isNotNull(), "manual_row", "error", drawn)]))
    same = Window.partitionBy("image", "_decided", "_proposals").orderBy("record")
    again = records.withColumns({"_decided": decided, "_proposals": F.to_json("proposals")}).withColumn("_r", F.row_number().over(same))
    return found.unionByName(findings(again, "record", [finding(F.col("_r") > 1, "repeated_record", "error", F.col("image"))]))


def merge_resolutions(records: DataFrame, manifest: DataFrame, outcomes: dict[tuple[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """(merged, log): the decisions of ``records`` (image, category, decision) after a manifest (image, category, action).

    The log has a row for each manifest row: applied, or skipped for no_record, repeated or action_not_allowed. Manifest rows
    that repeat (image, category) are all skipped, so no record is multiplied and none depends on their order. Read
    the log alone for a dry run."""
    allowed = F.lit(None).cast("string")
    for (category, action), outcome in outcomes.items():
        allowed = F.when((F.col("category") == category) & (F.col("action") == action), F.lit(outcome)).otherwise(allowed)
    key = ["image", "category"]
    known = records.select(*key).distinct().withColumn("_known", F.lit(True))
    repeats = manifest.groupBy(*key).agg(F.count("*").alias("_n"))
    judged = manifest.select(*key, "action").join(repeats, key).join(known, key, "left").withColumn("_outcome", allowed)
    reason = F.when(F.col("_known").isNull(), "no_record").when(F.col("_n") > 1, "repeated").when(F.col("_outcome").isNull(), "action_not_allowed")
    log = judged.select(*key, "action", "_outcome", F.coalesce(reason, F.lit("applied")).alias("status"))
    new = log.filter("status = 'applied'").select(*key, "_outcome")
    merged = records.join(new, key, "left").withColumn("decision", F.coalesce("_outcome", "decision")).drop("_outcome").select(records.columns)
    return merged, log.drop("_outcome")
