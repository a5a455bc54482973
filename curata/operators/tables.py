"""Joins and aggregates of dataset tables: lookups, contingency, comparison, queues, shelf life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.scalar import basename, sanitize_confidence, storage_condition


# ---- lookups and joins

def map_labels(df: DataFrame, mapping: DataFrame, label: str, reason: str = "unmapped_label") -> DataFrame:
    """``df`` with ``mapped`` and ``rejection`` from a mapping (label, mapped, rejection): labels that it lacks are rejected too."""
    m = mapping.select(F.col("label").alias(label), "mapped", "rejection", F.lit(True).alias("_known"))
    joined = df.join(m, label, "left")
    return joined.withColumn("rejection", F.when(F.col("_known").isNull(), F.lit(reason)).otherwise(F.col("rejection"))).drop("_known")


def match_keywords(df: DataFrame, text: str, keywords: list[tuple[str, str]], whole_words: bool = False) -> DataFrame:
    """``df`` with ``matched``: the class whose keywords (word, class) occur in the text, if it is just one; else null."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = [F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])") if whole_words else low.contains(word), F.lit(name)) for word, name in keywords]
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return df.withColumn("matched", F.when(F.size(found) == 1, F.element_at(found, 1)))


def contradicts(name: Column, state: Column, rot_words: list[str]) -> Column:
    """A rot word in the name of a fresh item, or a standalone ``fresh`` in that of a rotten one."""
    low = F.lower(name)
    words = F.split(F.regexp_replace(low, r"[-_.\s]+", " "), " ")
    rot = F.lit(False)
    for w in rot_words:
        rot = rot | low.contains(w)
    return (rot & (state == "fresh")) | (F.array_contains(words, "fresh") & (state == "rotten"))


#: Keys that one task of ``unmatched`` holds, about.
TASK_KEYS = 500_000


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys of one side without the other. Rows are dealt so that a task holds about ``TASK_KEYS`` of them at any size, first by key
    and origin, so that a frequent key isn't one task's, then by key. A null equals nothing."""
    both = left.select(*keys, F.lit(True).alias("_l"), F.lit(False).alias("_r")).unionByName(right.select(*keys, F.lit(False).alias("_l"), F.lit(True).alias("_r")))
    parts = both.count() // TASK_KEYS + 1
    met = both.withColumn("_from", F.spark_partition_id() % 16).repartition(parts, *keys, "_from").groupBy(*keys, "_from").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    met = met.repartition(parts, *keys).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    sides = F.array(F.when(F.col("_l") & (alone | ~F.col("_r")), F.lit("left_only")), F.when(F.col("_r") & (alone | ~F.col("_l")), F.lit("right_only")))
    return met.select(*keys, F.explode(sides).alias("side")).filter("side IS NOT NULL")


def undecided(queue: DataFrame, decided: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Queue rows without a decision and with a proposal."""
    return queue.join(decided.select(key).distinct(), key, "left_anti").join(proposals.select(key).distinct(), key, "left_semi")


def first_matching_key(df: DataFrame, target: DataFrame, candidates: list[str], key: str, value: str) -> DataFrame:
    """``df`` with ``value``: that of the first candidate column whose file name is a key of ``target``."""
    t = target.groupBy(basename(F.col(key)).alias("_k")).agg(F.min(value).alias("_v"))
    out = df
    for i, c in enumerate(candidates):
        out = out.join(t.withColumnsRenamed({"_k": f"_k{i}", "_v": f"_v{i}"}), basename(F.col(c)) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    names = [f"_v{i}" for i in range(len(candidates))]
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def ends_with_any(records: DataFrame, resolved: DataFrame, name: str, image: str) -> DataFrame:
    """Records whose name equals a resolved image name or ends with it after a separator: an equi-join on the last path part."""
    keys = resolved.select(basename(F.col(image)).alias("_k"), F.col(image).alias("_image"))
    hit = records.withColumn("_k", basename(F.col(name))).join(keys, "_k").filter(F.col(name).endswith(F.col("_image")))
    return records.join(hit.select(name).distinct(), name, "left_semi")


def twin_evidence(empty: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Empty-label images with labelled images of equal hash: (image, split, n_twins, twin_splits, verdict, cross_split)."""
    twins = labelled.groupBy(key).agg(F.count("*").alias("n_twins"), F.count_distinct("labels").alias("kinds"), F.array_sort(F.collect_set("split")).alias("twin_splits"))
    out = empty.join(twins, key, "left").withColumn("n_twins", F.coalesce("n_twins", F.lit(0)))
    verdict = F.when(F.col("n_twins") == 0, "no_twin").when(F.col("kinds") == 1, "apply").otherwise("needs_manual_review")
    cross = F.coalesce(F.exists("twin_splits", lambda s: s != F.col("split")), F.lit(False))
    return out.select("image", "split", "n_twins", verdict.alias("verdict"), cross.alias("cross_split"))


def compare_metrics(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value", tolerance: float = 0.005) -> DataFrame:
    """(keys, old, new, delta, verdict) over all keys of either side."""
    j = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full")
    d = F.col("new") - F.col("old")
    verdict = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(d > tolerance, "IMPROVED").when(d < -tolerance, "REGRESSED").otherwise("UNCHANGED")
    return j.withColumns({"delta": d, "verdict": verdict})


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; of equal versions that of the changes."""
    both = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_side").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_side")


def dangling(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a parent which isn't there; a null reference isn't one."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def ordered_union(*sources: DataFrame, rank: str = "source_rank") -> DataFrame:
    """All rows of the sources, which agree by column name, with the place of their source in ``rank``: sources that come first win ties."""
    out = sources[0].withColumn(rank, F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn(rank, F.lit(i)))
    return out


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): values of one side alone; none if the sets are equal."""
    return unmatched(left, right, [key])


def same_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (equal, left_only, right_only) of two sets of values."""
    side = lambda s: F.coalesce(F.sum((F.col("side") == s).cast("long")), F.lit(0)).alias(s)
    return set_difference(left, right, key).agg(side("left_only"), side("right_only")).select(((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"), "left_only", "right_only")


def overlaps(df: DataFrame, left: str, right: str) -> DataFrame:
    """``df`` with ``overlap``: whether two array columns share a value; false where one is null."""
    return df.withColumn("overlap", F.coalesce(F.arrays_overlap(F.array_compact(left), F.array_compact(right)), F.lit(False)))


# ---- counts

def contingency(df: DataFrame, rows: str, cols: str, values: list[str], names: DataFrame | None = None) -> DataFrame:
    """(rows, one column a value, total), zeros filled in, with a row for every name."""
    t = df.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1)))
    if names is not None:
        t = names.join(t, rows, "left")
    t = t.na.fill(0)
    return t.withColumn("total", sum((F.col(v) for v in values[1:]), F.col(values[0])))


def with_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys with all subtotals; ``level`` is 0 for full rows."""
    return df.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def split_shares(df: DataFrame, label: str, split: str) -> DataFrame:
    """(label, split, n, percent of its split)."""
    n = df.groupBy(label, split).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(split)), 1))


def imbalance(counts: DataFrame, n: str = "n", limit: float = 3.0) -> DataFrame:
    """One row: most, least, ratio (infinite if the least is 0), balanced, rarest (of equals the first by name), and among classes that
    occur the least and the ratio to it (0 if none does)."""
    low = F.min_by("class", F.struct(n, "class"))
    some = F.min(F.when(F.col(n) > 0, F.col(n)))
    a = counts.agg(F.max(n).alias("most"), F.min(n).alias("least"), low.alias("rarest"), some.alias("least_nonzero"))
    a = a.withColumn("ratio_nonzero", F.coalesce(F.round(F.col("most") / F.col("least_nonzero"), 3), F.lit(0.0)))
    ratio = F.when(F.col("least") > 0, F.col("most") / F.col("least")).otherwise(F.lit(float("inf")))
    return a.withColumn("ratio", ratio).withColumn("balanced", F.col("ratio") <= limit)


def profile(files: DataFrame, root: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(facet, value, n) of a file listing (path, name, extension, folder, length): by extension and folder, empty files, names that
    occur twice.

    With ``readable`` in the listing, files that can't be read (``corrupt_files``). With the ``root`` of their paths, files by the folder of the first level (``class``), of which ``.`` is
    the root itself, and files that lie deeper (``nested_files``). With ``labels`` (label, class, accepted) too, the files of each accepted and each rejected label, a label without
    files having 0, and both totals; a folder that no label names is in neither."""

    def by(facet: str, rows: DataFrame, value, least: int = 1) -> DataFrame:
        counts = rows.groupBy((F.col(value) if isinstance(value, str) else value).alias("value")).agg(F.count("*").alias("n"))
        return (counts.filter(F.col("n") >= least) if least > 1 else counts).select(F.lit(facet).alias("facet"), "value", "n")

    all_ = F.lit("all")
    parts = [by("extension", files, "extension"), by("folder", files, "folder"), by("empty_files", files.filter("length = 0"), all_), by("repeated_name", files, "name", 2)]
    if "readable" in files.columns:
        parts.append(by("corrupt_files", files.filter(~F.coalesce("readable", F.lit(False))), all_))
    if root is not None:
        below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
        top = F.when(F.size(below) > 1, F.get(below, F.lit(0))).otherwise(F.lit("."))
        placed = files.select(top.alias("class"), (F.size(below) > 2).alias("deep"))
        classes = by("class", placed, "class")
        parts += [classes, by("nested_files", placed.filter("deep"), all_)]
        if labels is not None:
            named = labels.select("label", F.coalesce("accepted", F.lit(False)).alias("accepted")).join(classes.select(F.col("value").alias("label"), "n"), "label", "left")
            kind = F.when(F.col("accepted"), "accepted")
            each = named.select(F.concat(F.coalesce(kind, F.lit("rejected")), F.lit("_label")).alias("facet"), F.col("label").alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
            total = each.groupBy(F.regexp_replace("facet", "label", "files").alias("facet")).agg(F.sum("n").alias("n")).select("facet", all_.alias("value"), "n")
            parts += [each, total]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issue_summary(found: DataFrame, samples: int = 10) -> DataFrame:
    """(kind, n, files, first refs): the count is whole, the list is capped by rank before it is gathered: first in 256 parts of a
    kind, then among what they leave."""
    counts = found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("ref").alias("files"))
    part, whole = Window.partitionBy("kind", "_part").orderBy("ref"), Window.partitionBy("kind").orderBy("ref")
    few = found.withColumn("_part", F.pmod(F.xxhash64("ref"), F.lit(256))).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= samples)
    few = few.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= samples).groupBy("kind").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return counts.join(few, "kind")


def top_rows(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def extremes(df: DataFrame, value: str, id_col: str, n: int = 6) -> DataFrame:
    """(end, rows): the n least and the n greatest rows by value."""
    low = df.orderBy(F.col(value).asc(), id_col).limit(n).withColumn("end", F.lit("least"))
    return low.unionByName(df.orderBy(F.col(value).desc(), id_col).limit(n).withColumn("end", F.lit("most")))


def rank_order(value: Column, order: list[str]) -> Column:
    """Place of a value in a list; values that it lacks come last."""
    out = F.lit(len(order))
    for i, v in enumerate(order):
        out = F.when(value == v, F.lit(i)).otherwise(out)
    return out


def acceptance(records: DataFrame, decision: str = "decision") -> DataFrame:
    """One row: records, one count a decision, share accepted or corrected of those decided."""
    from curata.operators.rules import DECISIONS

    c = lambda d: F.sum(F.when(F.col(decision) == d, 1).otherwise(0))
    out = records.agg(F.count("*").alias("total"), *[c(d).alias(d) for d in DECISIONS])
    done = sum((F.col(d) for d in DECISIONS[1:]), F.col(DECISIONS[0]))
    return out.withColumn("acceptance", F.when(done > 0, (F.col("accepted") + F.col("corrected")) / done).otherwise(F.lit(0.0)))


def availability(classes: DataFrame, name: str = "class") -> DataFrame:
    """(item, fresh, rotten, both) from class names that begin with a state."""
    state = F.regexp_extract(F.lower(name), r"^(fresh|rotten)[_-]?(.+)$", 1)
    item = F.regexp_extract(F.lower(name), r"^(fresh|rotten)[_-]?(.+)$", 2)
    has = lambda s: F.max(F.col("state") == s).alias(s)
    t = classes.select(state.alias("state"), item.alias("item")).filter("state <> ''").groupBy("item").agg(has("fresh"), has("rotten"))
    return t.withColumn("both", F.col("fresh") & F.col("rotten"))


# ---- shelf life

UNRELIABLE = ("data_not_available", "unsupported", "unknown", "uncertain")


def shelf_life(requests: DataFrame, items: DataFrame, enabled: bool = True) -> DataFrame:
    """``requests`` (item, freshness_class, confidence, storage) with status, days, typical_min, typical_max, basis and condition.

    ``items`` (item, typical_min, typical_max) is a small dimension. Fresh items have the typical maximum scaled by confidence, half
    rounded to even, within 1 and that maximum; stale and rotten ones have 0 days."""
    from curata.operators.rules import range_fault

    key = F.lower(F.trim(F.col("item")))
    dim = items.select(F.lower(F.trim("item")).alias("_item"), F.col("typical_min").alias("_lo"), F.col("typical_max").alias("_hi"), F.lit(True).alias("_has"))
    df = requests.join(dim, key == F.col("_item"), "left")
    c, cls = sanitize_confidence(F.col("confidence")), F.lower(F.trim(F.coalesce("freshness_class", F.lit("unknown"))))
    known, sound = F.coalesce("_has", F.lit(False)), range_fault(F.array("_lo", "_hi")).isNull()
    off = F.lit(not enabled)
    cascade = lambda *pairs, other: _cascade(pairs, other)
    status = cascade((off, "disabled"), (~known | ~sound, "unsupported"), (cls.isin("rotten", "stale"), "expired"), (cls.isin(*UNRELIABLE), cls), ((cls == "fresh") & c.isNull(), "uncertain"), (cls == "fresh", "estimated"), other="unavailable")
    basis = cascade(
        (off, "disabled"), (~known, "metadata_unavailable"), (~sound, "metadata_invalid"), (cls.isin("rotten", "stale"), "fruit_typical_range + freshness_state + freshness_confidence"),
        ((cls == "fresh") & c.isNull(), "freshness_confidence_unusable"), (cls == "fresh", "fruit_typical_range + freshness_state + freshness_confidence"), other="freshness_model_unsupported_or_uncertain",
    )
    days = F.when(status == "expired", F.lit(0)).when(status == "estimated", F.greatest(F.lit(1), F.least(F.col("_hi"), F.bround(F.col("_hi") * c).cast("int"))))
    given = (status != "disabled") & (status != "unsupported")
    out = df.withColumns({"status": status, "days": days.cast("int"), "basis": basis, "condition": storage_condition(F.col("storage")), "typical_min": F.when(given, F.col("_lo")), "typical_max": F.when(given, F.col("_hi"))})
    return out.drop("_item", "_lo", "_hi", "_has")


def _cascade(pairs, other) -> Column:
    out = F.lit(other)
    for c, v in reversed(pairs):
        out = F.when(c, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def lookup(df: DataFrame, dimension: DataFrame, key: str, columns: list[str], flag: str = "available") -> DataFrame:
    """``df`` with a dimension's columns by case-insensitive key, and whether it has the key. The dimension is broadcast by Spark if
    its size allows."""
    d = dimension.select(F.lower(F.trim(F.col(key))).alias("_k"), *columns, F.lit(True).alias("_has")).dropDuplicates(["_k"])
    return df.join(d, F.lower(F.trim(F.col(key))) == F.col("_k"), "left").withColumn(flag, F.coalesce("_has", F.lit(False))).drop("_k", "_has")
