"""Deterministic splits by hash rank. Groups are never divided; every row gets a split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.ranks import numbered, running

SPLITS = ("train", "valid", "test")
RATIOS = (0.7, 0.15, 0.15)


def hash_order(seed: int, key: Column) -> Column:
    """A pseudorandom order that any engine with SHA-256 reproduces."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def _by_rank(place: Column, total: Column, ratios, least_one: bool = False) -> Column:
    """The split of the row at ``place`` (units before it) of ``total`` units."""
    first, second = F.floor(total * ratios[0] + 0.5), F.floor(total * (ratios[0] + ratios[1]) + 0.5)
    if least_one:
        enough = total >= 3
        first = F.when(enough, F.least(F.greatest(first, F.lit(1)), total - 2)).otherwise(first)
        second = F.when(enough, F.least(F.greatest(second, first + 1), total - 1)).otherwise(second)
    return F.when(place < first, F.lit(SPLITS[0])).when(place < second, F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[2]))


def _stretch(order: Column) -> Column:
    """The leading digits of a hash, which grow with it: 65,536 stretches of about equal size."""
    return F.substring(order, 1, 4)


def stratified(df: DataFrame, stratum: str, id_col: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    """``df`` with ``split``: each stratum is divided by ratios, in hash order. Strata are ranked in stretches of the hash, so they may
    be of any size."""
    order = hash_order(seed, F.col(id_col))
    ranked = running(df.withColumn("_hash", order), stratum, _stretch(F.col("_hash")), ["_hash", id_col], None, "_place", "_total")
    return ranked.withColumn("split", _by_rank(F.col("_place"), F.col("_total"), ratios)).drop("_hash", "_place", "_total")


def by_hash(df: DataFrame, id_col: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    """``df`` with ``split`` from the hash of the id alone: no shuffle, shares right on average."""
    u = F.conv(F.substring(hash_order(seed, F.col(id_col)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < ratios[0], SPLITS[0]).when(u < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2]))


def grouped(df: DataFrame, stratum: str, id_col: str, group: str, seed: int = 42, ratios=RATIOS, least_one: bool = False) -> DataFrame:
    """``df`` with ``split``: whole groups (a null group is the row itself) are dealt in hash order within the stratum of their
    smallest id, by the running sum of their rows. With ``least_one`` a stratum of three rows or more has a row at least
    of each split to give, whatever the ratios."""
    unit = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    rows = df.withColumn("_unit", unit)
    units = rows.groupBy("_unit").agg(F.min_by(stratum, id_col).alias("_stratum"), F.count("*").alias("_rows"))
    order = hash_order(seed, F.col("_unit"))
    placed = running(units.withColumn("_hash", order), "_stratum", _stretch(F.col("_hash")), ["_hash", "_unit"], F.col("_rows"), "_place", "_total")
    named = placed.select("_unit", _by_rank(F.col("_place"), F.col("_total"), ratios, least_one).alias("split"))
    return rows.join(named, "_unit").drop("_unit")


def modal_class(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, modal, n): the most frequent label of each group; of equals the first by name."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max_by(F.col(label), F.struct(F.col("n"), _reverse(F.col(label)))).alias("modal"), F.max("n").alias("n"))


def _reverse(name: Column) -> Column:
    """A sort key that turns the order of names around: complements of their code points."""
    return F.transform(F.split(name, ""), lambda c: -F.ascii(c))


def group_split(df: DataFrame, group: str, label: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    """(group, modal, split): groups of a modal class are dealt by largest remainder, with one a split at least where there
    are three. Only group rows are ranked."""
    hashed = modal_class(df, group, label).select(group, "modal", hash_order(seed, F.col(group)).alias("_hash"))
    ranked = running(hashed, "modal", _stretch(F.col("_hash")), ["_hash", group], None, "place", "n")
    exact = [F.col("n") * F.lit(r / sum(ratios)) for r in ratios]
    base = [F.floor(e).cast("int") for e in exact]
    rest = F.col("n").cast("int") - sum(base[1:], base[0])
    ahead = [sum(((exact[j] - base[j] > exact[i] - base[i]) | ((exact[j] - base[j] == exact[i] - base[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i) for i in range(3)]
    parts = [base[i] + (ahead[i] < rest).cast("int") for i in range(3)]
    ranked = ranked.withColumns({f"p{i}": p for i, p in enumerate(parts)})
    # where a share is empty the largest gives one away
    empty = [(F.col("n") >= 3) & (F.col(f"p{i}") == 0) for i in range(3)]
    gives = sum((e.cast("int") for e in empty[1:]), empty[0].cast("int"))
    full = [F.when(empty[i], F.lit(1)).otherwise(F.col(f"p{i}") - F.when(F.array_position(F.array("p0", "p1", "p2"), F.greatest("p0", "p1", "p2")) == i + 1, gives).otherwise(F.lit(0))) for i in range(3)]
    ranked = ranked.withColumns({f"q{i}": q for i, q in enumerate(full)})
    split = F.when(F.col("place") < F.col("q0"), SPLITS[0]).when(F.col("place") < F.col("q0") + F.col("q1"), SPLITS[1]).otherwise(SPLITS[2])
    return ranked.select(group, "modal", split.alias("split"))


def held_back(df: DataFrame, label: str, id_col: str, share: float, test_share: float = 0.0, seed: int = 42, names: tuple[str, str] = (SPLITS[0], SPLITS[1])) -> DataFrame:
    """``df`` with ``split``: of rows that are left once a test share was taken, ``share`` / (1 - ``test_share``) is held back, rounded up.

    Facts of one aggregate choose the plan. The rows are stratified, with the held rows of each class by largest remainder, if every class has two rows and
    both parts can hold a row of each class; otherwise they are divided without regard to classes. Rows without a label are a class. Within a class, or the whole, the first in hash
    order are held back; groups are ranked in stretches of the hash."""
    ratio = share / (1.0 - test_share)
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    n, classes, least = counts.agg(F.sum("_n"), F.count("*"), F.min("_n")).first()
    held = math.ceil((n or 0) * ratio - 1e-9)
    rows = df.withColumn("_hash", hash_order(seed, F.col(id_col)))
    if n and least >= 2 and held >= classes and n - held >= classes:
        exact = counts.withColumns({"_floor": F.expr(f"_n * {held} div {n}"), "_rest": F.expr(f"_n * {held} % {n}")})
        # one row a class: the classes with the largest remainders take the rows that are left, of equals the first by name
        order = Window.orderBy(F.col("_rest").desc(), F.col("_label").asc_nulls_first())
        more = held - exact.agg(F.sum("_floor")).first()[0]
        quota = exact.withColumn("_take", F.col("_floor") + (F.row_number().over(order) <= more).cast("int"))
        ranked = running(rows, label, _stretch(F.col("_hash")), ["_hash", id_col], None, "_place", "_total")
        placed = ranked.join(quota.select("_label", "_take"), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    else:
        placed = running(rows, F.lit(0), _stretch(F.col("_hash")), ["_hash", id_col], None, "_place", "_total").withColumn("_take", F.lit(held))
    return placed.withColumn("split", F.when(F.col("_place") < F.col("_take"), names[1]).otherwise(names[0])).drop("_hash", "_place", "_total", "_take")


def check_partition(original: DataFrame, divided: DataFrame, id_col: str) -> DataFrame:
    """(check, passed): nothing lost, nothing twice, nothing new."""
    a, b = original.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("d")), divided.agg(F.count("*").alias("m"), F.count_distinct(id_col).alias("e"))
    both = a.crossJoin(b)  # one row each
    new = divided.join(original.select(id_col), id_col, "left_anti").agg((F.count("*") == 0).alias("passed")).select(F.lit("no_new_rows").alias("check"), "passed")
    return both.select(F.lit("row_count").alias("check"), (F.col("n") == F.col("m")).alias("passed")).union(both.select(F.lit("distinct_ids").alias("check"), (F.col("d") == F.col("e")).alias("passed"))).union(new)


def by_lookup(df: DataFrame, lookup: DataFrame, key: str, group: str) -> DataFrame:
    """``df`` with ``group`` from a lookup (key, group); rows that it doesn't resolve, or to nothing, are left out."""
    known = lookup.filter(F.col(group).isNotNull() & (F.col(group).cast("string") != "")).select(key, group)
    return df.join(known, key)


def session_split(df: DataFrame, session: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    """(session, split): whole sessions in hash order, train one at least. Only sessions are ranked, not rows."""
    sessions = df.filter(F.col(session).isNotNull()).select(session).distinct().withColumn("_hash", hash_order(seed, F.col(session)))
    placed = running(sessions, F.lit(0), _stretch(F.col("_hash")), ["_hash", session], None, "_place", "_total")
    train = F.greatest(F.lit(1), F.floor(F.col("_total") * ratios[0] + 0.5))
    valid = train + F.floor(F.col("_total") * ratios[1] + 0.5)
    return placed.select(session, F.when(F.col("_place") < train, SPLITS[0]).when(F.col("_place") < valid, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def repeated_exclusions(queued: DataFrame, id_col: str) -> DataFrame:
    """(id, n): queued items that come more than once, for which ``exclude`` refuses to build."""
    return queued.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def exclude(df: DataFrame, queued: DataFrame, id_col: str, split: str = "split", protected: str = "test") -> DataFrame:
    """``df`` without the queued rows of any split but the protected one. A queue that lists an item twice is refused."""
    if again := repeated_exclusions(queued, id_col).limit(1).collect():
        raise ValueError(f"queued more than once: {again[0][0]}")
    return df.filter(F.col(split) == protected).unionByName(df.filter(F.col(split) != protected).join(queued.select(id_col), id_col, "left_anti"))


def exclusion_counts(df: DataFrame, queued: DataFrame, id_col: str, split: str = "split", protected: str = "test") -> DataFrame:
    """(split, source, excluded, kept) of an exclusion, before it is built."""
    listed = queued.select(id_col).distinct().withColumn("_out", F.lit(1))
    out = F.when(F.col(split) == protected, F.lit(0)).otherwise(F.coalesce("_out", F.lit(0)))
    counts = df.join(listed, id_col, "left").groupBy(split).agg(F.count("*").alias("source"), F.sum(out).alias("excluded"))
    return counts.withColumn("kept", F.col("source") - F.col("excluded"))


def stride_sample(df: DataFrame, order: list[str], keep: int) -> DataFrame:
    """``keep`` rows at even distance in the given order: the rows at floor(i * n / keep)."""
    placed = numbered(df, order, "_place")
    n = placed.count()
    i = F.ceil(F.col("_place") * keep / n)
    return (placed.filter(F.floor(i * n / keep) == F.col("_place")) if n > keep else placed).drop("_place")
