"""Temperature calibration of class scores, by aggregates over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Temperatures that one pass tries, and those between which the first pass looks.
GRID, LEAST, MOST = 17, 0.05, 50.0


def negative_log_likelihood(logits: Column, label: Column, temperature: float) -> Column:
    """-log of the softmax share of the label's logit at a temperature; the greatest logit is taken off first, so nothing overflows."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))
    return F.log(total) - (F.get(logits, label) - top) / temperature


def sound_logits(df: DataFrame, logits: str, label: str) -> DataFrame:
    """(z, y) of the rows that can be scored: finite logits, and a label that names one of them."""
    rows = df.select(F.col(logits).cast("array<double>").alias("z"), F.col(label).cast("int").alias("y"))
    finite = F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("z").isNotNull() & finite & (F.col("y") >= 0) & (F.col("y") < F.size("z")))


def fit_temperature(df: DataFrame, logits: str = "logits", label: str = "label", exact: float = 1e-4) -> dict[str, float] | None:
    """temperature, its mean negative log likelihood, that at temperature 1, and the rows scored; None without a row to score.

    The likelihood has one optimum over the temperature, so a pass takes the mean at ``GRID`` points, evenly spaced in logarithms, in one aggregate, and the
    next one looks between the neighbours of the best: the width falls to a share of 2 / (``GRID`` - 1) a pass, whatever the number of rows."""
    rows = sound_logits(df, logits, label)
    low, high, start, n = math.log(LEAST), math.log(MOST), None, 0
    while True:
        points = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        means = [F.avg(negative_log_likelihood(F.col("z"), F.col("y"), math.exp(p))).alias(f"m{i}") for i, p in enumerate(points)]
        found = rows.agg(F.count("*").alias("n"), F.avg(negative_log_likelihood(F.col("z"), F.col("y"), 1.0)).alias("one"), *means).first()
        if not found.n:
            return None
        start, n = found.one, found.n
        losses = list(found)[2:]
        best = min(range(GRID), key=lambda i: losses[i])
        low, high = points[max(best - 1, 0)], points[min(best + 1, GRID - 1)]
        if high - low < exact:
            return {"temperature": math.exp(points[best]), "loss": losses[best], "loss_before": start, "n": float(n)}


def calibrated(df: DataFrame, temperature: float, logits: str = "logits", made: str = "probabilities") -> DataFrame:
    """``df`` with the softmax of its logits at a temperature."""
    z = F.col(logits)
    e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return df.withColumn(made, F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row (error, n): the mean distance of confidence and accuracy over bins of the confidence, weighted by their rows."""
    place = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = df.filter(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(confidence) - F.avg(F.col(correct).cast("int"))).alias("gap"))
    return per.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("error"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
