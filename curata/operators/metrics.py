"""Evaluation metrics over (true, predicted) rows and over probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.ranks import running, value_at
from curata.session import materialize


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def class_list(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.select(F.col(true).alias("class")).union(df.select(F.col(pred).alias("class"))).filter("class IS NOT NULL").distinct()


def confusion(df: DataFrame, true: str = "true_class", pred: str = "pred_class", classes: DataFrame | None = None) -> DataFrame:
    """(true_class, pred_class, n) for all pairs of classes, zeros among them. The class list is small: rows are classes."""
    names = classes if classes is not None else class_list(df, true, pred)
    grid = names.select(F.col("class").alias("true_class")).crossJoin(names.select(F.col("class").alias("pred_class")))
    counts = df.groupBy(F.col(true).alias("true_class"), F.col(pred).alias("pred_class")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["true_class", "pred_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(matrix: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) from a confusion table; 0 where undefined."""
    rows = matrix.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)).alias("hits"))
    cols = matrix.groupBy(F.col("pred_class").alias("class")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, "class").withColumns({"precision": _ratio(F.col("hits"), F.col("predicted")), "recall": _ratio(F.col("hits"), F.col("support"))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return both.withColumn("f1", f1).select("class", "support", "precision", "recall", "f1", "hits")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro and weighted scores, balanced accuracy (over classes that occur)."""
    pc = per_class(matrix)
    n = F.sum("support")
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), n)
    return pc.agg(
        n.alias("n"), _ratio(F.sum("hits"), n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
    )


def misclassified(df: DataFrame, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    return df.filter(F.col(true) != F.col(pred))


def top_k_accuracy(probs: DataFrame, k: int, id_col: str = "sample_id") -> DataFrame:
    """One row (accuracy) from (sample_id, class, prob, true_class): the true class is among the k likeliest; of equals the
    first by name is likelier."""
    w = Window.partitionBy(id_col).orderBy(F.col("prob").desc(), "class")
    hit = probs.withColumn("r", F.row_number().over(w)).groupBy(id_col).agg(F.max(F.when((F.col("r") <= k) & (F.col("class") == F.col("true_class")), 1).otherwise(0)).alias("hit"))
    return hit.agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of values in [0, 1], every bin present, the last one closed."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, share): share of values below each threshold."""
    shares = df.agg(*[F.avg((F.col(value) < t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("share")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")


def percentile_floor(df: DataFrame, value: str, p: float = 0.05, floor: float = 0.3) -> DataFrame:
    """One row: the linearly interpolated percentile, and no less than the floor (null without values). The two values around it are found by rank,
    so no task holds all values."""
    place = lambda n: (n - 1) * F.lit(p)
    low = value_at(df, [], value, p, lambda n: F.floor(place(n)) + 1, "low")
    high = value_at(df, [], value, p, lambda n: F.ceil(place(n)) + 1, "high")
    n = df.agg(F.count(value).alias("n"))
    met = n.join(low, how="left").join(high, how="left")  # one row each
    part = place(F.col("n")) - F.floor(place(F.col("n")))
    return met.select(F.greatest(F.col("low") + part * (F.col("high") - F.col("low")), F.lit(floor)).alias("threshold"), "n")


#: Stretches of scores: a score's is the whole part of so many times it.
SCORE_STRETCHES = 4096


def _by_score(df: DataFrame, score: str, positive: str, group: str) -> DataFrame:
    """(grp, score, p, n): positives and negatives at each distinct score."""
    return df.groupBy(F.col(group).alias("grp"), F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.sum((~F.col(positive)).cast("int")).alias("n"))


def _score_stretch(falling: bool = False) -> Column:
    """Stretches in which the scores of a group, also continuous ones, are summed one after the other."""
    at = F.floor(F.col("score") * SCORE_STRETCHES)
    return -at if falling else at


def roc_auc(df: DataFrame, score: str, positive: str, group: str) -> DataFrame:
    """(group, auc): area under the ROC curve by ranks, ties shared; 0 where one of the classes is missing. Sums run over the
    distinct scores of a group, in stretches of scores."""
    steps = running(_by_score(df, score, positive, group), "grp", _score_stretch(), ["score"], F.col("n"), "below", "_all")
    area = steps.groupBy("grp").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return area.select(F.col("grp").alias(group), _ratio(F.col("wins"), F.col("p") * F.col("n")).alias("auc"))


def pr_auc(df: DataFrame, score: str, positive: str, group: str) -> DataFrame:
    """(group, auc): trapezoids under the precision-recall curve, from recall 0 at precision 1; 0 without positives. Sums run
    in stretches of scores; the step before a score's follows from what lies ahead of it."""
    down = [F.col("score").desc()]
    steps = running(_by_score(df, score, positive, group), "grp", _score_stretch(True), down, F.col("p"), "tp_before", "all")
    steps = running(steps, "grp", _score_stretch(True), down, F.col("n"), "fp_before", "_n")
    # a step without positives has no width, so the precision before one with them is that of all steps ahead
    ahead = F.col("tp_before") + F.col("fp_before")
    before = F.when(ahead == 0, F.lit(1.0)).otherwise(F.col("tp_before") / ahead)
    precision = (F.col("tp_before") + F.col("p")) / (ahead + F.col("p") + F.col("n"))
    slice_ = _ratio(F.col("p"), F.col("all")) * (precision + before) / 2
    return steps.groupBy(F.col("grp").alias(group)).agg(F.sum(slice_).alias("auc"))


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median): the middle value, the upper of two: an exact discrete percentile, not their mean."""
    return value_at(df, list(keys), value, 0.5, lambda n: F.floor(n / 2) + 1, "median")


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, p50, p95, mean, max): percentiles are the values at place floor(share * n) of the sorted ones, the first at least. Null keys are a
    group, and a group without any value has nulls."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        found = value_at(df, list(keys), value, share, lambda n, share=share: F.greatest(F.floor(n * share), F.lit(1)), name)
        found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(found, on, "left").drop(*[f"_{k}" for k in keys])
    return out.select(*keys, "p50", "p95", "mean", "max")


def _curves(matches: DataFrame, truths: DataFrame, label: str, hits: list[Column]) -> DataFrame:
    """(class, p0, r0, ap0, p1, ...): precision, recall and average precision for each of several conditions of a hit.

    The curves share their steps, one for each different confidence, so that a step is one row whatever their number. Sums and the best
    precision behind a step are taken in stretches of the confidence, then over one row a stretch."""
    every = range(len(hits))
    counts = [*(f"h{i}" for i in every), "rows"]
    steps = matches.filter("confidence IS NOT NULL").groupBy(F.col(label).alias("class"), F.col("confidence").alias("score")).agg(*[F.sum(h.cast("long")).alias(f"h{i}") for i, h in enumerate(hits)], F.count("*").alias("rows"))
    steps = materialize(steps.withColumn("stretch", _score_stretch()), "steps")
    ahead = Window.partitionBy("class").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("class", "stretch").agg(*[F.sum(c).alias(c) for c in counts])
    sums = sums.select("class", "stretch", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in counts])
    upto = Window.partitionBy("class", "stretch").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("*", *[F.sum(c).over(upto).alias(f"{c}_upto") for c in counts]).join(sums, ["class", "stretch"])
    steps = steps.join(truths.select(F.col(label).alias("class"), F.col("n").alias("n_true")), "class")
    upto_here = lambda c: F.col(f"{c}_upto") + F.col(f"{c}_ahead")
    steps = steps.select("class", "stretch", "score", "n_true", *counts, *[upto_here(f"h{i}").alias(f"tp{i}") for i in every], *[(upto_here(f"h{i}") / upto_here("rows")).alias(f"p{i}") for i in every])
    steps = materialize(steps, "steps")
    behind = Window.partitionBy("class").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = steps.groupBy("class", "stretch").agg(*[F.max(f"p{i}").alias(f"top{i}") for i in every]).select("class", "stretch", *[F.max(f"top{i}").over(behind).alias(f"beyond{i}") for i in every])
    within = Window.partitionBy("class", "stretch").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("*", *[F.max(f"p{i}").over(within).alias(f"within{i}") for i in every]).join(tops, ["class", "stretch"])
    out = [(F.min_by(f"p{i}", "score").alias(f"p{i}"), F.max(F.col(f"tp{i}") / F.col("n_true")).alias(f"r{i}"), F.sum(F.greatest(f"within{i}", f"beyond{i}") * F.col(f"h{i}") / F.col("n_true")).alias(f"ap{i}")) for i in every]
    return steps.groupBy("class").agg(*[c for each in out for c in each])


def average_precision(matches: DataFrame, truths: DataFrame, label: str = "class_name") -> DataFrame:
    """(class, precision, recall, ap) of detections (class, confidence, is_tp) against the number of true boxes (class, n).

    Detections of one confidence count together, so the curve has a step for each different confidence; precision is made to fall with recall,
    then summed over the steps."""
    return _curves(matches, truths, label, [F.col("is_tp")]).select("class", F.col("p0").alias("precision"), F.col("r0").alias("recall"), F.col("ap0").alias("ap"))


def mean_average_precision(assigned: DataFrame, truths: DataFrame, label: str = "class_name") -> DataFrame:
    """(class, precision, recall, ap50, ap50_95) of detections (class, confidence, overlap), each with the overlap of the true box that
    is its own, 0 without one: the mean of the average precisions at overlaps of 0.5, 0.55, ... 0.95."""
    bounds = [(50 + 5 * i) / 100 for i in range(10)]
    curves = _curves(assigned, truths, label, [F.col("overlap") >= b for b in bounds])
    known = truths.select(F.col(label).alias("class")).join(curves, "class", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean = sum((of(f"ap{i}") for i in range(1, len(bounds))), of("ap0")) / len(bounds)
    return known.select("class", of("p0").alias("precision"), of("r0").alias("recall"), of("ap0").alias("ap50"), mean.alias("ap50_95"))
