"""Pairs of hashes within a Hamming distance by a metric partition: cells around pivots, cut again where they are large.

Each row's home is the cell of its nearest pivot. If x and y are within ``r`` and p is the pivot of x, the triangle inequality gives
d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2 r for y's own pivot q. So y also enters, as a guest, every cell
whose pivot is at most 2 r farther from it than its own, and each pair within ``r`` meets in the home of one of them; no pair is missed. Of two rows of
different homes the one whose pivot has the larger number is the guest, so that a pair meets once.

A cell of more than ``LIMIT`` rows is cut by pivots of its own, by the same rule, until it is small or doesn't get less work, as
where its rows are near each other throughout, so that its pairs are what was asked for. Pivots are a few rows of a cell, chosen by a hash, and each round
is one pass that deals rows by cell; the pairs of a large cell are dealt over several tasks. Where a sample shows that distances to pivots
tell little, as at a wide radius, nothing is cut: all pairs are compared in tiles of two blocks, each a bounded task of array operations.
Where only the first near row in an order is asked for, ``first_apart`` and ``first_near`` compare rows with few others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions.scalar import hamming
from curata.session import materialize

#: Rows of a cell that is compared as it is, and pivots of a larger one, about.
LIMIT, PIVOTS = 2000, 128
#: Pairs that one task compares, about.
TASK_PAIRS = 20_000_000
#: A round that leaves more than this share of a cell's pairs isn't worth it: such cells stay as they are.
WORTH = 0.7
ROUNDS = 30
#: Rows on which the first cut is tried.
SAMPLE = 4096
#: Rows of a tile's block, and the work of a pair in a tile, where a row of a join is 1.
BLOCK, TILE_PAIR = 20_000, 0.02
#: Pairs that a tile, and a block beside anchors, hold in memory at once.
CHUNK, NEAR_CHUNK = 1 << 16, 1 << 18


def _work(cells: DataFrame) -> DataFrame:
    """(cell, homes, rows, pairs): the pairs that meet in each cell."""
    sized = cells.groupBy("cell").agg(F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("homes"), F.count("*").alias("rows"))
    return sized.withColumn("pairs", F.col("homes").cast("double") * (F.col("rows") - (F.col("homes") + 1) / 2))


def _cut(cells: DataFrame, large: DataFrame, r: int, seed: int) -> DataFrame:
    """(old, cell, h, guest): the rows of large cells in smaller ones."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), "h"), F.col("homes")) < PIVOTS
    mine = cells.join(large.select("cell", "homes"), "cell")
    # about PIVOTS rows a cell, whatever its size
    pivots = mine.filter(~F.col("guest") & drawn).groupBy("cell").agg(F.array_sort(F.collect_set("h")).alias("pivots"))
    placed = mine.join(pivots, "cell")
    away = F.transform("pivots", lambda p: F.bit_count(p.bitwiseXOR(F.col("h"))))
    placed = placed.withColumn("away", away).withColumn("least", F.array_min("away")).withColumn("home", F.array_position("away", F.col("least")) - 1)
    every = placed.select("cell", "h", "guest", "least", "home", F.posexplode("away").alias("place", "d"))
    enters = (F.col("d") <= F.col("least") + 2 * r) & (F.col("guest") | (F.col("place") <= F.col("home")))
    own = ~F.col("guest") & (F.col("place") == F.col("home"))
    return every.filter(enters).select(F.col("cell").alias("old"), F.xxhash64("cell", "place", F.lit(seed)).alias("cell"), "h", (~own).alias("guest"))


def cells_of(values: DataFrame, r: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(cell, h, guest) of different hashes (h), written, and the rows and pairs after each round."""
    open_ = materialize(values.select(F.lit(0).cast("long").alias("cell"), "h", F.lit(False).alias("guest")), "cells")
    done, steps = [], []
    for seed in range(ROUNDS):
        work = materialize(_work(open_), "cell-work")
        large = work.filter(F.col("rows") > LIMIT)
        done.append(open_.join(large.select("cell"), "cell", "left_anti").select("cell", "h", "guest"))
        if not large.limit(1).count():
            break
        cut = materialize(_cut(open_, large, r, seed), "cells")
        left = _work(cut.select("cell", "guest")).join(cut.select("cell", "old").distinct(), "cell").groupBy("old").agg(F.sum("pairs").alias("left"))
        judged = large.join(left.withColumnRenamed("old", "cell"), "cell", "left")
        # without pivots of its own a cell can't be cut
        worth = materialize(judged.select("cell", (F.col("left") <= WORTH * F.col("pairs")).alias("worth")), "worth")
        done.append(open_.join(worth.filter("NOT coalesce(worth, false)").select("cell"), "cell").select("cell", "h", "guest"))
        open_ = materialize(cut.join(worth.filter("worth").select(F.col("cell").alias("old")), "old").select("cell", "h", "guest"), "cells")
        steps.append(tuple(work.agg(F.sum("rows"), F.sum("pairs")).first()))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out, "cells"), steps


def worth_cutting(values: DataFrame, n: int, r: int) -> bool:
    """Whether a first cut of about ``SAMPLE`` of n different hashes (h) leaves less work. It only chooses the way, not the pairs."""
    drawn = values.filter(F.pmod(F.xxhash64(F.lit(-1), "h"), F.lit(n)) < SAMPLE)
    one = drawn.select(F.lit(0).cast("long").alias("cell"), "h", F.lit(False).alias("guest"))
    return total_work(_cut(one, _work(one), r, 0).select("cell", "guest"))[1] <= WORTH * total_work(one)[1]


def tile_work(n: int) -> float:
    """Rows dealt to tiles and pairs compared there."""
    return n * -(-n // BLOCK) + TILE_PAIR * n * n / 2


def tiled_values(values: DataFrame, n: int, r: int) -> DataFrame:
    """(ha, hb, distance), ha < hb, of n different hashes (h): all pairs are compared, two blocks of rows at a time."""
    blocks = max(1, -(-n // BLOCK))
    mine = values.select("h", F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = mine.select("h", "block", other).select((high * (high + 1) / 2 + low).cast("int").alias("tile"), "block", "h")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        tile = table.column("tile")[0].as_py()
        j = (math.isqrt(8 * tile + 1) - 1) // 2
        i = tile - j * (j + 1) // 2
        block, h = table.column("block").to_numpy(), table.column("h").to_numpy()
        x, y = h[block == i].view(np.uint64), h[block == j].view(np.uint64)
        found: list[list] = [[], [], []]
        step = max(1, CHUNK // max(1, len(y)))
        apart, d, near = (np.empty((step, len(y)), kind) for kind in (np.uint64, np.uint8, bool))  # filled again and again
        for start in range(0, len(x), step):
            k = min(step, len(x) - start)
            np.bitwise_xor(x[start : start + k, None], y[None, :], out=apart[:k])
            np.bitwise_count(apart[:k], out=d[:k])
            np.less_equal(d[:k], r, out=near[:k])
            at, to = np.divmod(np.flatnonzero(near[:k]), max(1, len(y)))
            a, b = x[start + at].view(np.int64), y[to].view(np.int64)
            once = a < b if i == j else np.ones(len(a), bool)
            for column, part in zip(found, (np.minimum(a, b)[once], np.maximum(a, b)[once], d[at, to][once].astype(np.int32)), strict=True):
                column.append(part)
        kinds = {"ha": np.int64, "hb": np.int64, "distance": np.int32}
        return pa.table({name: np.concatenate([np.zeros(0, kind), *c]) for (name, kind), c in zip(kinds.items(), found, strict=True)})

    tiles = blocks * (blocks + 1) // 2
    return dealt.repartitionById(tiles, "tile").groupBy("tile").applyInArrow(compare, "ha long, hb long, distance int")  # a tile a task


def first_apart(rows: DataFrame, ids: int, r: int) -> DataFrame:
    """(id, h) of anchors among the first ``ids`` ids of rows (id, h): in order of id those that are within ``r`` of no anchor before them. One
    task decides them. An id may have several hashes and is near whatever one of them is near."""

    def decide(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        own, h = table.column("id").combine_chunks(), table.column("h").to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)]))
        ends = np.append(starts[1:], len(h))
        place = np.repeat(np.arange(len(starts)), ends - starts)
        taken = np.zeros(len(starts), bool)
        for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
            for one in h[start:end] if not taken[k] else ():
                taken[place[end + np.flatnonzero(np.bitwise_count(one ^ h[end:]) <= r)]] = True
        yield from table.filter(pa.array(~taken[place])).to_batches()

    first = rows.select("id").distinct().orderBy("id").limit(ids)
    return rows.join(first, "id", "left_semi").select("id", "h").repartition(1).sortWithinPartitions("id").mapInArrow(decide, f"id {dict(rows.dtypes)['id']}, h long")


def first_near(rows: DataFrame, n: int, anchors: DataFrame, r: int) -> DataFrame:
    """(id, anchor): the smallest of the anchors (id, h) within ``r`` of each of n rows (id, h), for rows that have one. A block of rows and all
    anchors are a task; a row that has met its anchor is compared no further."""
    blocks = max(1, -(-n // BLOCK))
    mine = rows.select("id", "h", F.lit(False).alias("anchor"), F.pmod(F.xxhash64("h", "id"), F.lit(blocks)).cast("int").alias("block"))
    dealt = mine.union(anchors.select("id", "h", F.lit(True), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    kind = dict(rows.dtypes)["id"]

    def compare(table):
        import numpy as np
        import pyarrow as pa

        other = table.filter(table.column("anchor")).sort_by("id")
        table = table.filter(pa.array(~table.column("anchor").to_numpy()))
        x, y = (t.column("h").to_numpy().view(np.uint64) for t in (table, other))
        first, left, at = np.full(len(x), -1), np.arange(len(x)), 0
        while len(left) and at < len(y):
            to = at + max(1, NEAR_CHUNK // len(left))
            near = np.bitwise_count(y[at:to, None] ^ x) <= r
            met = near.any(axis=0)
            first[left[met]] = at + near[:, met].argmax(axis=0)
            x, left, at = x[~met], left[~met], to
        met = first >= 0
        return pa.table({"id": table.column("id").filter(pa.array(met)), "anchor": other.column("id").take(pa.array(first[met]))})

    found = dealt.repartitionById(blocks, "block").groupBy("block").applyInArrow(compare, f"id {kind}, anchor {kind}")
    return found.filter("id <> anchor").groupBy("id").agg(F.min("anchor").alias("anchor"))


def total_work(cells: DataFrame) -> tuple[int, float]:
    """(rows, pairs) of all cells."""
    return tuple(_work(cells).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first())


def near_values(cells: DataFrame, r: int) -> DataFrame:
    """(ha, hb, distance), ha < hb: the different hashes within ``r``, each pair once."""
    parts = _work(cells).select("cell", F.greatest(F.ceil(F.col("pairs") / TASK_PAIRS), F.lit(1)).cast("int").alias("parts"))
    dealt = cells.join(parts, "cell")
    homes = dealt.filter("NOT guest").select("cell", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"), F.col("h").alias("x"))
    others = dealt.select("cell", F.col("h").alias("y"), "guest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = homes.join(others, ["cell", "part"]).filter((F.col("guest") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    met = met.withColumn("distance", hamming(F.col("x"), F.col("y"))).filter(F.col("distance") <= r)
    return met.select(F.least("x", "y").alias("ha"), F.greatest("x", "y").alias("hb"), "distance")
