"""Classes that share a block (a band of MinHash, a cell of a lattice), dealt over tasks as tiles of pairs.

A block's classes are cut into chunks of bounded size and every pair of chunks is a tile, so no block, however
frequent, is one task's work. A pair belongs to the smallest block that both of its classes are in.

*Cores.* In a block of several chunks the number of pairs would grow with the square of a group of near copies. Where the
distance is a metric, classes within half of the greatest linked distance of one class (the core's centre) are all linked
to each other by the triangle inequality. So each class of such blocks is compared with one centre, the smallest of
its blocks' smallest classes, and pairs within a core are neither dealt nor compared: they are counted by the core's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import by_key
from curata.session import materialize

TILE = ["block", "i", "j"]
TILES = "block long, i int, j int, chunk int, cid long, core long"
#: Centres of at most so many classes and so much weight are broadcast; more are joined by shuffle, with the same result.
BROADCAST_CENTRES, BROADCAST_WEIGHT = 1000, 1_000_000


class Blocks:
    """Tiles of ``classes`` (cid, weight, copies, blocks), written before: blocks are arrays of long numbers."""

    def __init__(self, classes: DataFrame, max_weight: int, max_classes: int):
        self.classes, self.limits = classes, (max_weight, max_classes)
        each = classes.select("cid", "weight", F.explode("blocks").alias("block"))
        shared = each.groupBy("block").agg(F.count("*").alias("n"), F.sum("weight").alias("all"), F.min("cid").alias("centre")).filter("n > 1")
        self.shared = materialize(shared.select("block", "centre", self._chunks("n", "all").alias("chunks")), "shared-blocks")
        self.frequent = bool(self.shared.filter("chunks > 1").limit(1).count())
        self.cores: DataFrame | None = None

    def _chunks(self, n: str, weight: str):
        return F.greatest(F.ceil(F.col(weight) / self.limits[0]), F.ceil(F.col(n) / self.limits[1]), F.lit(1)).cast("int")

    def candidates(self) -> DataFrame:
        """(cid, centre) of the classes in blocks of several chunks, written."""
        each = self.classes.select("cid", F.explode("blocks").alias("block"))
        found = each.join(self.shared.filter("chunks > 1").select("block", "centre"), "block").groupBy("cid").agg(F.min("centre").alias("centre"))
        return materialize(found, "candidates")

    def find_cores(self, candidates: DataFrame, held: DataFrame, near) -> None:
        """``held`` has what is compared, (cid, held), for all candidates; ``near(a, b)`` is true within half of the distance."""
        centres = candidates.select(F.col("centre").alias("cid")).distinct().join(held, "cid").select(F.col("cid").alias("centre"), F.col("held").alias("centre_held"))
        size = self.classes.join(candidates.select(F.col("centre").alias("cid")).distinct(), "cid").agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if size[0] <= BROADCAST_CENTRES and size[1] <= BROADCAST_WEIGHT:
            centres = F.broadcast(centres)
        met = candidates.join(held, "cid").join(centres, "centre").filter(near(F.col("held"), F.col("centre_held")))
        self.cores = materialize(met.select("cid", F.col("centre").alias("core")), "cores")

    def tiles(self) -> DataFrame:
        """The rows of ``TILES``: a class in each tile that has pairs for it. ``core`` is -1 outside of cores."""
        classes = self.classes.select("cid", "weight", "blocks")
        classes = classes.join(self.cores, "cid", "left").withColumn("core", F.coalesce("core", F.lit(-1))) if self.cores is not None else classes.withColumn("core", F.lit(-1).cast("long"))
        dealt = classes.select("cid", "weight", "core", F.explode("blocks").alias("block")).join(self.shared.select("block", "chunks"), "block")
        zero = F.lit(0).cast("int")
        single = dealt.filter("chunks = 1").select("block", zero.alias("i"), zero.alias("j"), zero.alias("chunk"), "cid", "core")
        if not self.frequent:
            return single
        many = materialize(dealt.filter("chunks > 1").select("block", "cid", "core", "weight"), "frequent")
        groups = many.groupBy("block", "core").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).withColumn("own", self._chunks("n", "all"))
        block = Window.partitionBy("block")
        start = F.coalesce(F.sum("own").over(block.orderBy("core").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
        groups = groups.select("block", "core", "own", start.alias("start"), F.sum("own").over(block).cast("int").alias("total"))
        groups = materialize(groups, "block-groups")
        placed = many.join(groups, ["block", "core"]).withColumn("chunk", (F.col("start") + F.pmod(F.xxhash64("cid"), F.col("own"))).cast("int"))
        # chunks of one core never meet
        others = F.expr("""CASE WHEN core = -1 THEN sequence(0, total - 1) ELSE concat(
            CASE WHEN start > 0 THEN sequence(0, start - 1) ELSE array() END, CASE WHEN start + own < total THEN sequence(start + own, total - 1) ELSE array() END) END""")
        met = placed.select("block", "cid", "core", "chunk", F.explode(others).alias("other"))
        return single.unionByName(met.select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "cid", "core"))

    def core_links(self) -> DataFrame | None:
        """(cid, root, n) of the classes in cores: the core's centre, and the rows of the core's other classes."""
        if self.cores is None:
            return None
        sized = self.cores.join(self.classes.select("cid", "copies"), "cid")
        total = materialize(sized.groupBy("core").agg(F.sum("copies").alias("all")), "core-sizes")
        return sized.join(total, "core").select("cid", F.col("core").alias("root"), (F.col("all") - F.col("copies")).alias("n"))


def share_earlier(blocks: list[np.ndarray], block: int) -> np.ndarray:
    """Pairs of rows that are both in a block before ``block``; blocks are sorted."""
    early = [b[: np.searchsorted(b, block)] for b in blocks]
    if len(blocks) == 2:
        both = len(np.intersect1d(early[0], early[1], assume_unique=True)) > 0
        return np.array([[False, both], [both, False]])
    return intersections(early) > 0


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from a matrix of the members that two sets or more hold."""
    if len(sets) == 2:
        size = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, size], [size, 0]])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[col] > 1
    row, col = row[often], (np.cumsum(count > 1) - 1)[col[often]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)))
    width = 4096
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[a:b], col[a:b] - at] = 1
        total += m @ m.T
    return total.astype(np.int64)


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to by a symmetric mask."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class Tile:
    """One tile's rows of an Arrow table of ``TILES`` with ``blocks``."""

    def __init__(self, table):
        self.block, self.i, self.j, self.chunk, self.cid, self.core = (table.column(f.split()[0]).to_numpy() for f in TILES.split(", "))
        lists = table.column("blocks").combine_chunks()
        self.values, self.ends = lists.values.to_numpy(), lists.offsets.to_numpy()

    def pairs(self, a: int, b: int, mask: np.ndarray | None = None) -> np.ndarray:
        """Upper-triangle mask of the pairs among rows a to b that are this tile's to compare, within ``mask``."""
        pairs = np.triu(np.ones((b - a, b - a), dtype=bool) if mask is None else mask, 1)
        if self.i[a] != self.j[a]:
            pairs &= self.chunk[a:b][:, None] != self.chunk[a:b][None, :]
        core = self.core[a:b]
        if (core >= 0).any():
            pairs &= (core[:, None] != core[None, :]) | (core[:, None] < 0)
        if pairs.any():
            pairs &= ~share_earlier([self.values[self.ends[r] : self.ends[r + 1]] for r in range(a, b)], int(self.block[a]))
        return pairs


def dealt(tiles: DataFrame, n: int) -> DataFrame:
    return tiles.repartition(n, *TILE).sortWithinPartitions(*TILE, "cid")


def groups(batches):
    """(table, tile, bounds of groups of two rows or more) from Arrow batches of dealt tiles."""
    for table, starts in by_key(batches, TILE):
        yield table, Tile(table), [(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
