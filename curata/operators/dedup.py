"""Exact and near duplicates by hash, clusters of pairs, leakage between splits."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.scalar import hamming
from curata.operators import arrow
from curata.operators.graph import connected_components
from curata.operators.metric_join import cells_of, first_apart, first_near, near_values, tile_work, tiled_values, total_work, worth_cutting
from curata.operators.ranks import numbered, running
from curata.session import materialize


def mark_copies(df: DataFrame, key: str, order: str, stretch: int = 1 << 20) -> DataFrame:
    """``df`` with ``copy_rank`` (1 = kept: the first of its key by ``order``, a number). A null or empty key is never a copy. A key's rows
    are ranked in stretches of the number, so that a key with very many copies is no one task's work."""
    usable = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    ranked = running(df.filter(usable), key, F.floor(F.col(order) / stretch), [order], None, "_before", "_all")
    return ranked.withColumn("copy_rank", F.col("_before") + 1).drop("_before", "_all").unionByName(df.filter(~usable).withColumn("copy_rank", F.lit(1).cast("long")))


def copy_stars(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(first_id, id): each later row of a key with the key's first: the links of ``equal_pairs`` without its squares."""
    first = df.groupBy(key).agg(F.min(id_col).alias("first_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return df.join(first, key).filter(F.col(id_col) != F.col("first_id")).select("first_id", F.col(id_col).alias("id"))


def cross_split_groups(df: DataFrame, key: str, id_col: str, split: str) -> DataFrame:
    """(key, split_a, first_a, n_a, split_b, first_b, n_b): for each key and two splits that share it the first row and the number of
    rows in both; n_a * n_b pairs in a row."""
    held = df.groupBy(key, split).agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    spans = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(split, "first", "n"))).alias("s")).filter(F.size("s") > 1)  # a row a split
    two = spans.select(key, F.explode("s").alias("a"), "s").select(key, "a", F.explode("s").alias("b")).filter(F.col(f"a.{split}") < F.col(f"b.{split}"))
    return two.select(key, *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in ("a", "b") for c in (split, "first", "n")])


def first_of_each(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, first_id, n): like ``mark_copies`` by smallest id, as an aggregate that sums before it shuffles, so that a
    key with very many copies is no one task's work."""
    return df.groupBy(key).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))


def copy_report(df: DataFrame, key: str, id_col: str, source: str) -> DataFrame:
    """(kept_source, dropped_source, n): which source's row is kept, and which source's rows it displaces."""
    firsts = df.groupBy(key).agg(F.min_by(source, id_col).alias("kept_source"), F.min(id_col).alias("first_id"))
    joined = df.join(firsts, key).filter(F.col(id_col) != F.col("first_id"))
    return joined.groupBy("kept_source", F.col(source).alias("dropped_source")).agg(F.count("*").alias("n"))


def equal_pairs(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(a, b), a < b: all pairs of rows with equal keys. Pairs grow with the square of a group: for groups of any size use
    ``first_of_each``."""
    often = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    few = df.join(often, key).select(key, id_col)
    left, right = few.withColumnRenamed(id_col, "a"), few.withColumnRenamed(id_col, "b")
    return left.join(right, key).filter("a < b").select("a", "b")


def band_values(h: Column, bits: int, bands: int) -> Column:
    """The ``bands`` stretches of a hash, each with its place."""
    edges = [bits * i // bands for i in range(bands + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftright(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def choose_stretches(n: int, max_distance: int, bits: int) -> int:
    """The number of stretches of a hash for the least work over n rows: few long ones meet few unrelated rows but take more probes."""
    return min(range(1, max_distance + 2), key=lambda m: probe_work(n, max_distance, bits, m))


def probe_work(n: int, max_distance: int, bits: int, stretches: int) -> float:
    """Probes written and pairs met by stretches of evenly spread hashes."""
    wide, near = bits // stretches, max_distance // stretches
    probes = stretches * sum(math.comb(wide, k) for k in range(near + 1))
    return n * probes * (1 + n / 2**wide)


def probed_values(values: DataFrame, max_distance: int, bits: int, m: int) -> DataFrame:
    """(ha, hb, distance), ha < hb, of different hashes (h): of m stretches of the hash one at least differs in ``max_distance`` // m bits at
    most. Each row is entered under its stretches, and probes all values that near to them."""
    each = values.select("h", F.explode(band_values(F.col("h"), bits, m)).alias("k")).select("h", F.col("k.band").alias("band"), F.col("k.value").alias("value"))
    edges = [bits * i // m for i in range(m + 1)]
    wide = {b: edges[b + 1] - edges[b] for b in range(m)}
    masks = [(b, sum(1 << i for i in flips)) for b, w in wide.items() for k in range(max_distance // m + 1) for flips in itertools.combinations(range(w), k)]
    probes = F.broadcast(values.sparkSession.createDataFrame(masks, "band int, mask long"))  # as many rows as a row has probes
    left = each.join(probes, "band").select(F.col("h").alias("ha"), "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    right = each.withColumnRenamed("h", "hb")
    met = left.join(right, ["band", "value"]).filter("ha < hb").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= max_distance)
    return met.select("ha", "hb", "distance").distinct()


#: More hashes than this are cut into cells first, to see whether that is less work.
CELLS_FROM = 5000


def near_hashes(values: DataFrame, max_distance: int, bits: int = 63, stretches: int | None = None) -> DataFrame:
    """(ha, hb, distance), ha < hb: all pairs of different hashes (h) within ``max_distance``, without misses, by the way that is least work: cells of a
    metric partition, whose pairs are counted before they are compared, stretches of the hash, or tiles of all pairs."""
    n = values.count()
    m = stretches or choose_stretches(n, max_distance, bits)
    if stretches:
        return probed_values(values, max_distance, bits, m)
    least = min(probe_work(n, max_distance, bits, m), tile_work(n))
    if n > CELLS_FROM and worth_cutting(values, n, max_distance):
        cells, _ = cells_of(values, max_distance)
        if sum(total_work(cells)) <= least:
            return near_values(cells, max_distance)
    return tiled_values(values, n, max_distance) if tile_work(n) <= least else probed_values(values, max_distance, bits, m)


def hamming_pairs(df: DataFrame, hash_col: str, id_col: str, max_distance: int, bits: int = 63, stretches: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: all pairs of rows within ``max_distance``, without misses. Rows of one hash are compared once, and their pairs written
    out at the end; ``near_hashes`` has the pairs of different hashes alone."""
    kept = materialize(df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("h IS NOT NULL"), "hashes")
    values = materialize(kept.groupBy("h").agg(F.count("*").alias("n")), "values")
    near = near_hashes(values.select("h"), max_distance, bits, stretches)
    left, right = kept.select(F.col("id").alias("x"), F.col("h").alias("ha")), kept.select(F.col("id").alias("y"), F.col("h").alias("hb"))
    apart = near.join(left, "ha").join(right, "hb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").filter("a < b")
    same = equal_pairs(kept.join(values.filter("n > 1").select("h"), "h"), "h", "id").withColumn("distance", F.lit(0))
    return apart.unionByName(same)


def prefix_probe_pairs(df: DataFrame, hash_col: str, id_col: str, max_distance: int, bits: int = 63, prefix_bits: int = 8, prefix_distance: int = 2) -> DataFrame:
    """(a, b, distance), a < b: candidates whose leading bits differ in at most ``prefix_distance`` places. Pairs that differ
    in more of the leading bits are missed; ``hamming_pairs`` misses none."""
    spark = df.sparkSession
    prefix = F.shiftright(F.col("h"), bits - prefix_bits).cast("int")
    kept = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("h IS NOT NULL").withColumn("prefix", prefix)
    codes = spark.range(1 << prefix_bits).select(F.col("id").cast("int").alias("prefix"))
    near = codes.crossJoin(codes.withColumnRenamed("prefix", "other")).filter(hamming(F.col("prefix"), F.col("other")) <= prefix_distance)
    probes = kept.join(F.broadcast(near), "prefix").select(F.col("id").alias("a"), F.col("h").alias("ha"), "other")
    targets = kept.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("prefix").alias("other"))
    met = probes.join(targets, "other").filter("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb")))
    return met.filter(F.col("distance") <= max_distance).select("a", "b", "distance")


def components(pairs: DataFrame) -> DataFrame:
    """(id, group_id) for each row that is in a pair; groups are transitive."""
    return connected_components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


#: Links that one task decides in order; more are decided component by component, and a larger component in steps of so many.
TASK_LINKS = 1_000_000
#: Rounds over all open rows before the rest is decided in order.
OPEN_ROUNDS = 3


def _in_order(batches):
    """For mapInArrow over (part, id, below), parts together: the anchors of each part, of whose rows all smaller open neighbours are in it.
    A row has a line for each of its links, with the neighbour if that is smaller."""
    import pyarrow as pa

    def anchors(links):
        found = set()
        for row in sorted(links):
            if found.isdisjoint(links[row]):
                found.add(row)
        return sorted(found)

    known, links, kind = None, {}, None
    for batch in batches:
        kind = batch.column("id").type
        for part, row, below in arrow.rows(batch, ["part", "id", "below"]):
            if part != known:
                yield pa.RecordBatch.from_arrays([pa.array(anchors(links), kind)], names=["id"])
                known, links = part, {}
            mine = links.setdefault(row, [])
            if below is not None:
                mine.append(below)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(anchors(links), kind)], names=["id"])


def _prefixes(opened: DataFrame) -> DataFrame:
    """(id, part) of open rows: of each component the first rows that have ``TASK_LINKS`` links or so. ``opened`` has (a, b), both ways."""
    parts = connected_components(opened, "a", "b").withColumnsRenamed({"node": "id", "component": "part"})
    placed = numbered(parts, ["id"], "place")
    degree = opened.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    known = materialize(placed.join(degree, "id"), "placed")
    # places at halves, quarters, ... of a component's rows: the largest share whose links fit
    shares = [2.0**-k for k in range(1, 31)]
    sized = known.groupBy("part").agg(F.sum("n").alias("links"), F.percentile_approx("place", shares, 100_000).alias("cuts"), F.max("place").alias("most"), F.min("place").alias("least"))
    k = F.ceil(F.log2(F.col("links") / TASK_LINKS)).cast("int")
    cut = F.when(F.col("links") <= TASK_LINKS, F.col("most")).otherwise(F.greatest("least", F.element_at("cuts", F.least(k, F.lit(30)))))
    return known.join(sized.select("part", cut.alias("cut")), "part").filter("place <= cut").select("id", "part")


def star_clusters(pairs: DataFrame) -> DataFrame:
    """(id, anchor): anchors in order of id take their direct, still free neighbours; no link is followed further.

    A row is an anchor if none of its smaller neighbours is one, otherwise it belongs to the smallest of them: the anchors are the
    first independent set in order of id. A few rounds over all open rows make those anchors whose smaller neighbours are all covered, and cover
    their neighbours; that decides most rows of most graphs, but of a chain in order of its ids two rows a round. So what is then left is decided in order: by
    one task if it has at most ``TASK_LINKS`` links, else by one task a component, and of a component with more links the first rows
    of so many at a time. The number of rounds doesn't grow with the length of a chain."""
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct(), "links")
    kind = dict(both.dtypes)["a"]
    opened, beside, rounds = both, [], 0
    while left := opened.limit(TASK_LINKS + 1).count():
        lines = opened.select(F.col("a").alias("id"), F.when(F.col("b") < F.col("a"), F.col("b")).alias("below"))
        if left <= TASK_LINKS:
            anchors = lines.select(F.lit(0).alias("part"), "id", "below").repartition(1).mapInArrow(_in_order, f"id {kind}")
        elif rounds < OPEN_ROUNDS:
            anchors = opened.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).filter("id < least").select("id")
        else:
            stretch = materialize(_prefixes(opened), "prefixes")
            anchors = lines.join(stretch, "id").select("part", "id", "below").repartition("part").sortWithinPartitions("part").mapInArrow(_in_order, f"id {kind}")
        anchors = materialize(anchors, "anchors")
        covered = materialize(opened.join(anchors.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct(), "covered")
        beside.append(covered)
        decided = materialize(anchors.union(covered), "decided")
        opened = opened.join(decided.withColumnRenamed("id", "a"), "a", "left_anti").join(decided.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        opened = materialize(opened, "open")
        rounds += 1
    if not beside:
        return both.select(F.col("a").alias("id"), F.col("b").alias("anchor"))
    # all rows but the covered ones are anchors, also those whose neighbours were all covered by others
    covered = beside[0]
    for more in beside[1:]:
        covered = covered.union(more)
    mine = both.join(covered.withColumnRenamed("id", "a"), "a").join(covered.withColumnRenamed("id", "b"), "b", "left_anti").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("anchor"))
    mine = materialize(mine, "stars")
    return mine.union(mine.select("anchor", "anchor").distinct())


#: Ids that one task decides in order in each round of ``hash_stars``.
PREFIX = 20_000


def hash_stars(df: DataFrame, hash_col: str, id_col: str, max_distance: int, bits: int = 63) -> DataFrame:
    """(id, anchor): ``star_clusters`` of ``hamming_pairs``, without a list of pairs, which grows with the square of the rows.

    Of rows of one hash, which have the same neighbours, the first stands for all. A task decides the first ``PREFIX`` open ids in order, and the
    others are compared with the anchors among these alone: an anchor of an earlier round is smaller than those of later ones, so it keeps
    what it covers. Another round follows as long as at least half of the others are covered, so rounds are as many as n can be halved; with more open rows,
    which then have few near ones, their pairs are listed."""
    kept = materialize(df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("id IS NOT NULL AND h IS NOT NULL").distinct(), "hashes")
    ids = materialize(kept.groupBy("id").agg(F.min("h").alias("h"), F.count("*").alias("n")), "ids")
    alone = ids.filter("n = 1").select("id", "h")
    firsts = materialize(first_of_each(alone, "h", "id"), "firsts")
    copies = alone.join(firsts.filter("n > 1"), "h").filter("id <> first_id").select("id", "first_id")
    # an id with several hashes stands for none of them
    several = kept.join(ids.filter("n > 1").select("id"), "id").select("id", "h")
    opened = materialize(firsts.select(F.col("first_id").alias("id"), "h").union(several), "open")
    left, beside = opened.count(), []
    while left or not beside:
        anchors = materialize(first_apart(opened, PREFIX, max_distance), "anchors")
        covered = materialize(first_near(opened, left, anchors, max_distance), "covered")
        beside.append(covered)
        decided = anchors.select("id").union(covered.select("id")).distinct()
        opened = materialize(opened.join(decided, "id", "left_anti").select("id", "h"), "open")
        before, left = left, opened.count()
        if left > max(PREFIX, (before - PREFIX) / 2):
            beside.append(star_clusters(hamming_pairs(opened, "h", "id", max_distance, bits)).filter("id <> anchor"))
            break
    covered = beside[0]
    for more in beside[1:]:
        covered = covered.union(more)
    covered = materialize(covered, "covered")
    later = copies.join(covered.withColumnRenamed("id", "first_id"), "first_id", "left").select("id", F.coalesce("anchor", "first_id").alias("anchor"))
    mine = materialize(covered.union(later), "stars")
    return mine.union(mine.select("anchor", "anchor").distinct())


def leaked_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits, n): keys that occur in more than one split."""
    seen = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n"))
    return seen.filter(F.size("splits") > 1)


def leaked_pairs(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, n): keys that two splits share."""
    leaks = leaked_keys(df, key, split)
    a = leaks.select(key, F.explode("splits").alias("split_a"), "splits")
    pairs = a.select("split_a", F.explode("splits").alias("split_b")).filter("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


def group_leaks(df: DataFrame, group: str, split: str, label: str) -> DataFrame:
    """(group, n_splits, n_classes, fails): groups that span splits; only those of a single class fail."""
    spans = df.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.count_distinct(label).alias("n_classes")).filter("n_splits > 1")
    return spans.withColumn("fails", F.col("n_classes") == 1)


def cross_split_pairs(pairs: DataFrame, rows: DataFrame, id_col: str, split: str) -> DataFrame:
    """(a, b, split_a, split_b): pairs whose rows lie in different splits."""
    named = rows.select(F.col(id_col), F.col(split))
    one = pairs.join(named.withColumnsRenamed({id_col: "a", split: "split_a"}), "a")
    return one.join(named.withColumnsRenamed({id_col: "b", split: "split_b"}), "b").filter("split_a <> split_b")


def ordered_digest(df: DataFrame, key: str, value: str, digits: int = 3) -> DataFrame:
    """(digest, n): one digest of all (key, value) rows, independent of their order: rows are hashed, the hashes of each bucket (of equal
    leading ``digits``) are digested in order, then the buckets'. Give more digits for more rows: 16 ** digits buckets share them evenly."""
    line = F.sha2(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).cast("binary"), 256)
    rows = df.select(line.alias("h")).withColumn("bucket", F.substring("h", 1, digits))
    each = rows.groupBy("bucket").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))).cast("binary"), 256).alias("d"), F.count("*").alias("n"))
    top = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]))
    return each.agg(F.sha2(top.cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))
