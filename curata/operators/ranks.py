"""Ranks and running sums of groups of any size: a group is cut into stretches, so that no task holds a whole one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.session import materialize

#: Groups of at most so many rows are ranked as they are; from larger ones only a bracket around the wanted rank.
WHOLE = 1000
#: Groups of more rows have their bracket broadcast: there are at most so many of them as the rows divided by this.
LARGE = 1_000_000


def running(df: DataFrame, part: Column | str, stretch: Column, order: list[Column | str], amount: Column | None, before: str, total: str) -> DataFrame:
    """``df`` with ``before``, the amount (rows, if None) of a part's rows ahead of each row, and ``total``, that of the part.

    ``stretch`` has to grow with ``order``: rows are summed by stretch, and ordered within their stretch alone."""
    value = F.lit(1) if amount is None else amount
    cut = df.withColumns({"_part": part if isinstance(part, Column) else F.col(part), "_stretch": stretch, "_amount": value.cast("long")})
    ahead = Window.partitionBy("_part").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part", "_stretch").agg(F.sum("_amount").alias("_n"))
    sums = sums.withColumns({"_ahead": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), total: F.sum("_n").over(Window.partitionBy("_part"))})
    sums = sums.select(F.col("_part").alias("_p"), F.col("_stretch").alias("_s"), "_ahead", total)
    within = Window.partitionBy("_part", "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    met = placed.join(sums, F.col("_part").eqNullSafe(F.col("_p")) & F.col("_stretch").eqNullSafe(F.col("_s")))
    return met.withColumn(before, F.col("_ahead") + F.col("_within")).drop("_part", "_stretch", "_amount", "_p", "_s", "_ahead", "_within")


def numbered(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """``df`` with ``place``: 0, 1, ... in the given order over all rows. Rows are dealt by ranges of the order and written, each range
    is numbered by itself, and one row a range is summed."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}), "ranges")
    sizes = written.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_in").alias("_least"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("_range", "_least", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return written.join(F.broadcast(sizes), "_range").withColumn(place, F.col("_ahead") + F.col("_in") - F.col("_least")).drop("_range", "_in", "_least", "_ahead")


def value_at(df: DataFrame, keys: list[str], value: str, share: float, rank: Callable[[Column], Column], name: str) -> DataFrame:
    """(keys, name): the value of each group at ``rank(n)`` (from 1) of its n sorted values, which lies near ``share`` of them.

    Approximate percentiles on both sides bracket the rank with certainty; only values within the bracket are ranked, by
    their counts. Nulls are left out."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    wide = [max(0.0, share - 0.005), min(1.0, share + 0.005)]
    around = F.percentile_approx("_v", wide, 10_000)
    bounds = known.groupBy(*keys).agg(F.count("*").alias("_n"), around.alias("_b"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    small = F.col("_n") <= WHOLE
    bounds = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.when(small, F.col("_least")).otherwise(F.col("_b")[0]).alias("_lo"), F.when(small, F.col("_most")).otherwise(F.col("_b")[1]).alias("_hi"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # a join by key would sort a whole large group in one task
    bounds = materialize(bounds, "bounds")
    large = F.broadcast(bounds.filter(F.col("_n") > LARGE))
    near = known.join(large, on).unionByName(known.join(large, on, "left_anti").join(bounds.filter(F.col("_n") <= LARGE), on)).filter(F.col("_v") <= F.col("_hi"))
    # all values below the bracket are one row
    counts = near.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("_sum", F.sum("_c").over(upto)).filter(F.col("_sum") >= rank(F.col("_n")))
    return reached.groupBy(*keys).agg(F.min("_v").alias(name))
