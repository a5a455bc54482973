"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector at random onto ``blocks`` times 8 dimensions and decodes
each 8 to the nearest point of the E8 lattice; the points name a cell. A vector enters its own
cell and the neighbouring ones: in each block the lattice's 240 shortest vectors lead to the
neighbours, and those nearest to the projection are taken. Vectors that share a cell of any
table are compared by cosine in double precision.

Equal vectors are one class. Cells are dealt as tiles of pairs (``blocks.py``), so no
cell is one task's work; a pair belongs to the smallest cell that both vectors enter, so it
is counted once, and tiles return a row for each class and not for each pair. In frequent cells vectors within half of the
greatest linked angle of one centre are a core, whose pairs are all linked by the triangle inequality of angles and aren't compared.

``SETTING`` holds at every size, so that the links found don't depend on the number of rows: recall 0.93 or more at cosine 0.9 and
practically 1 from 0.95 on, whatever the dimension; tests measure it. More blocks of the lattice make smaller cells, in which fewer unrelated
vectors meet, and need more tables for the same recall: who expects tens of millions of vectors may pass one of ``FINER``.

Defined results: vectors that are null, zero, or hold null or non-finite components link
with nothing, and are components of their own; finite components of any size are sound (vectors are scaled by their
largest component first); vectors of different lengths don't link; equal
vectors link; an id that repeats with another vector is a row of its own; a cosine of exactly the bound links, as far as
double precision tells; a component without any id has none. Labels and other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.blocks import Blocks, dealt, groups, roots
from curata.llm.common import partitions
from curata.operators.graph import connected_components
from curata.session import materialize

COSINE = 0.9
#: (tables, blocks, neighbouring cells entered in each block besides the vector's own, scale).
SETTING = (8, 2, 2, 1.8)
FINER = ((32, 3, 1, 1.6), (40, 4, 1, 1.4))
CHUNK_CLASSES = 512
SEED = 8


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: signed pairs of coordinates, and halves with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole vectors with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    whole = np.rint(x)
    off = x - whole
    odd = np.flatnonzero(whole.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return whole


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class LatticeHash:
    def __init__(self, dim: int, tables: int, blocks: int, neighbours: int, scale: float, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        wide = max(dim, 8 * blocks)
        self.tables, self.blocks, self.neighbours = tables, blocks, neighbours
        self.axes = [np.linalg.qr(rng.normal(size=(wide, 8 * blocks)))[0][:dim] * np.sqrt(dim / 8) * scale for _ in range(tables)]
        self.roots = e8_roots()
        self.mix = rng.integers(0, 2**62, (blocks, 8), dtype=np.int64) * 2 + 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cells that each unit vector enters, as numbers whose upper bits are the table."""
        out = []
        with np.errstate(over="ignore"):
            for t, axes in enumerate(self.axes):
                y = unit @ axes
                codes = np.zeros((len(unit), 1), dtype=np.int64)
                for b in range(self.blocks):
                    part = y[:, 8 * b : 8 * b + 8]
                    home = nearest_e8(part)
                    near = np.argsort(-((part - home) @ self.roots.T), axis=1, kind="stable")[:, : self.neighbours]
                    points = np.concatenate([home[:, None], home[:, None] + self.roots[near]], axis=1)
                    code = (np.rint(2 * points).astype(np.int64) * self.mix[b]).sum(axis=2)
                    codes = (codes[:, :, None] * np.int64(0x5851F42D4C957F2D) + code[:, None, :]).reshape(len(unit), -1)
                codes ^= (codes >> 29) & 0x7FFFFFFFF
                codes *= np.int64(0x2545F4914F6CDD1D)
                out.append((codes & ((1 << 56) - 1)) | (t << 56))
        return np.sort(np.concatenate(out, axis=1), axis=1)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component comes to 1 first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _key(vector: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.to_json(vector).cast("binary"), 256)), 1, 16)


def classes_of(vectors: DataFrame) -> DataFrame:
    """(key, vector, first_id, copies) of the sound vectors, equal ones together."""
    sound = F.size("vector") > 0
    sound &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound &= F.exists("vector", lambda x: x != 0)
    kept = vectors.filter(sound).withColumn("key", _key("vector"))
    return kept.groupBy("key").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))


CLASSES = "key binary, first_id long, copies long, unit array<double>, blocks array<long>"


def with_cells(classes: DataFrame, setting: tuple[int, int, int, float]) -> DataFrame:
    """The rows of ``CLASSES``: unit vectors and the cells that they enter, sorted."""

    def run(batches):
        import pyarrow as pa

        hashes: dict[int, LatticeHash] = {}
        for batch in batches:
            lists = batch.column("vector")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sizes = np.diff(bounds)
            units, cells = [None] * len(sizes), [None] * len(sizes)
            for dim in sorted(set(sizes.tolist())):
                these = np.flatnonzero(sizes == dim)
                unit = unit_vectors(values[bounds[these][:, None] + np.arange(dim)])
                hashed = hashes.setdefault(dim, LatticeHash(dim, *setting)).cells(unit) ^ np.int64(dim << 40)
                for i, u, c in zip(these.tolist(), unit, hashed, strict=True):
                    units[i], cells[i] = u, np.unique(c)
            kept = [batch.column(c) for c in ("key", "first_id", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(units, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int64()))], names=["key", "first_id", "copies", "unit", "blocks"])

    return classes.mapInArrow(run, CLASSES)


def _compare(cosine: float):
    def run(batches):
        import pyarrow as pa

        for table, tile, bounds in groups(batches):
            copies = table.column("copies").to_numpy()
            vectors = table.column("unit").combine_chunks()
            numbers, ends = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            cols: list[list] = [[], [], []]
            for a, b in bounds:
                if len(set(np.diff(ends[a : b + 1]).tolist())) > 1:  # cells of different dimensions that share a number
                    x = np.zeros((b - a, int(np.diff(ends[a : b + 1]).max())))
                    sizes = np.diff(ends[a : b + 1])
                    for r in range(b - a):
                        x[r, : sizes[r]] = numbers[ends[a + r] : ends[a + r + 1]]
                    near = (x @ x.T >= cosine) & (sizes[:, None] == sizes[None, :])
                else:
                    x = numbers[ends[a] : ends[b]].reshape(b - a, -1)
                    near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                if not near.any():
                    continue
                linked = tile.pairs(a, b, near)
                if not linked.any():
                    continue
                linked |= linked.T
                has = np.flatnonzero(linked.any(axis=1))
                for col, part in zip(cols, (tile.cid[a:b][has], tile.cid[a:b][roots(linked)[has]], (linked[has] * copies[a:b]).sum(axis=1)), strict=True):
                    col.extend(part.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cid", "root", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, setting: tuple[int, int, int, float] = SETTING) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector."""
    source = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    n = partitions(source.sparkSession)
    found = with_cells(classes_of(source), setting)
    classes = materialize(found.withColumns({"cid": F.monotonically_increasing_id(), "weight": F.lit(1).cast("long")}), "vectors")
    blocks = Blocks(classes, CHUNK_CLASSES, CHUNK_CLASSES)
    if blocks.frequent:
        # within half of the angle, less what rounding may add
        half = math.cos(math.acos(cosine) / 2) + 1e-9
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
        blocks.find_cores(blocks.candidates(), classes.select("cid", F.col("unit").alias("held")), lambda a, b: dot(a, b) >= half)
    tiles = dealt(blocks.tiles().join(classes.select("cid", "blocks", "unit", "copies"), "cid"), n)
    links, core = tiles.mapInArrow(_compare(cosine), "cid long, root long, n long"), blocks.core_links()
    links = materialize(links if core is None else links.unionByName(core), "links")
    near = links.groupBy("cid").agg(F.sum("n").alias("near"))
    parts = connected_components(links.filter("cid <> root"), "cid", "root").withColumnRenamed("node", "cid")
    known = classes.select("cid", "key", "first_id", "copies").join(parts, "cid", "left").join(near, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = materialize(known, "known")
    lowest = materialize(known.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
    named = known.join(lowest, "component").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    named = materialize(named, "named")
    out = source.select("vec_id", _key("vector").alias("key")).join(named, "key", "left")
    own = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(found: DataFrame, truth_links: int) -> float:
    """Links found, as a share of those that brute force finds."""
    got = found.agg(F.sum("n_links")).first()[0] or 0
    return 1.0 if not truth_links else got / truth_links
