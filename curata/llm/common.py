"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these characters.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(owner: str = "") -> dict:
    """What a Python worker keeps between tasks (tokenizers, word caches, tables of powers) for one owner: a worker that comes to another
    kind of task lets go of what it held, so that the stages of a pipeline don't add up in its memory."""
    state = sys.__dict__.setdefault("_curata_state", {})
    if state.get("owner") != owner:
        state.clear()
        state["owner"] = owner
    return state


def split_words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RE))


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, by which rows with equal texts are told from others; null for a null text."""
    return F.substring(F.unhex(F.sha2(text.cast("string").cast("binary"), 256)), 1, 16)


def prefix_sums(df: DataFrame, part: str, order: str, value: str, made: str, width: int = 1024) -> DataFrame:
    """``df`` with ``made``: the sum of ``value`` over the rows of ``part`` with a smaller ``order``, a whole number that a
    part holds once. Parts are summed in stretches of ``width`` places first, so that a task sorts one row a stretch of a
    part, and the rows of a stretch, but never a whole part."""
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width))
    sums = cut.groupBy(part, "_stretch").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(part).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, "_stretch", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(part, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return cut.join(sums.hint("merge"), [part, "_stretch"]).withColumn(made, (F.col("_ahead") + F.col("_within")).cast("long")).drop("_stretch", "_ahead", "_within")


def only(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[df[c] for c in wanted])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(batches, names: list[str]):
    """Arrow batches that are sorted by key columns, put together into tables that hold whole groups:
    each as (table, starts), where group g is the rows from starts[g] to starts[g + 1]."""
    import numpy as np
    import pyarrow as pa

    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        new = np.zeros(table.num_rows, dtype=bool)
        for name in names:
            x = table.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            last = int(cuts[-1])
            yield table.slice(0, last).combine_chunks(), [0, *cuts.tolist()]
            carry = table.slice(last)
        else:
            carry = table
    if carry is not None:
        yield carry.combine_chunks(), [0, carry.num_rows]
