"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. *Classes.* Rows with equal texts (128 bits of SHA-256) are one text. Every whole text becomes the set of 64-bit hashes
   of its word n-grams, and of that set only a 128-bit key and its band hashes are kept. Texts with equal sets are
   one class from here on, so copies cost nothing more.
2. *Bands.* ``choose_bands`` takes the band and row counts from the threshold and the target
   recall. Band hashes are exploded, counted, and only bands with two classes or more go on.
3. *Tiles.* Bands are dealt as tiles of pairs (``blocks``). In frequent bands classes whose similarity to one centre is at
   least half-way between the threshold and 1 are a core: the Jaccard distance is a metric, so all of a core
   are linked, without a comparison. Classes without a pair of their own in a tile leave it before any n-grams are moved.
4. *Verification.* N-gram sets are built again for the classes that remain, and each tile
   compares its pairs exactly. A tile returns a row for each class (its links and the smallest
   class that it is connected to there), not a row for each pair; ``similar_pairs`` returns the pairs.
5. *Groups* are the connected components of the tiles' and the cores' star edges.

Different near copies that are far from every centre (a similarity between the threshold and half-way) are still all
compared with each other, as the exact number of links asks for it.

Defined results: texts with fewer words than n have one n-gram, all of their words; null,
empty and blank texts have none: each is a class and group of its own without links. Rows
that repeat a document are copies and all ``kept`` if it is. A group is named by its smallest doc_id; that of rows without
any doc_id is null, but they link like others and one text of them is kept. Very long texts are read whole; their bands
are made of 256 n-grams at a time. Ties don't occur: similarity is compared in whole numbers. Other columns of the input are dropped
(``keep_one`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.blocks import TILES, Blocks, dealt, groups, intersections, roots
from curata.llm.common import partitions, text_key, worker_state
from curata.llm.tokens import text_batches
from curata.operators.graph import connected_components
from curata.session import materialize

N = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
THRESHOLD = (4, 5)
TARGET_RECALL = 0.999
#: N-grams and classes of a chunk, about; a tile holds two chunks.
CHUNK_NGRAMS = 1_000_000
CHUNK_CLASSES = 512
#: Up to so many ids are broadcast (8 bytes each) to pick texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def choose_bands(threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = TARGET_RECALL, max_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for which at most 25 bands reach the recall at the threshold."""
    for rows in range(max_rows, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= 25:
            return bands, rows
    return 25, 1


def ngram_hashes(text: bytes, n: int = N) -> np.ndarray:
    """The sorted set of hashes of the word n-grams of a UTF-8 text."""
    import xxhash

    words = text.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * _MUL
            mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


class MinHash:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 256):  # a matrix that fits a core's cache
                x = grams[None, at : at + 256] * self.mul[:, None]
                x += self.add[:, None]
                x ^= x >> np.uint64(31)
                np.minimum(low, x.min(axis=1), out=low)
            band = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
            for r in range(self.rows):
                band = (band ^ low[r :: self.rows][: self.bands]) * _MUL
                band ^= band >> np.uint64(29)
        return band.view(np.int64)


def signatures(texts: DataFrame, n: int = N, bands: tuple[int, int] | None = None) -> DataFrame:
    """``texts`` (key, text_id, copies, first_id, text) without the text, with set_key, n_grams and the sorted blocks; the
    set_key of a text without words is null."""
    count, rows = bands or choose_bands()
    kept = ["key", "text_id", "copies", "first_id"]

    def run(batches):
        import pyarrow as pa
        import xxhash

        worker_state("grams")
        minhash = MinHash(count, rows)
        for batch, texts in text_batches(batches):
            keys, sizes, found = [], [], []
            for text in texts:
                grams = ngram_hashes(text, n)
                sizes.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                found.append(np.unique(minhash.band_hashes(grams)) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*kept, "set_key", "n_grams", "blocks"])

    return texts.select(*kept, "text").mapInArrow(run, "key binary, text_id long, copies long, first_id long, set_key binary, n_grams long, blocks array<long>")


def ngram_sets(texts: DataFrame, n: int = N) -> DataFrame:
    """(cid, held) of (cid, text): the hashes of the n-grams."""

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([ngram_hashes(t, n).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["cid", "held"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, held array<long>")


def _needed(batches):
    """For mapInArrow over dealt tiles with blocks: the rows that have a pair of their own in their tile."""
    import pyarrow as pa

    for table, tile, bounds in groups(batches):
        keep = np.zeros(table.num_rows, dtype=bool)
        for a, b in bounds:
            pairs = tile.pairs(a, b)
            keep[a:b] = pairs.any(axis=0) | pairs.any(axis=1)
        yield from table.filter(pa.array(keep)).select([f.split()[0] for f in TILES.split(", ")]).combine_chunks().to_batches()


def _verify(threshold: tuple[int, int], want_pairs: bool):
    """For mapInArrow over dealt tiles with blocks, copies and n-grams."""
    over, under = threshold

    def run(batches):
        import pyarrow as pa

        for table, tile, bounds in groups(batches):
            copies = table.column("copies").to_numpy()
            grams = table.column("held").combine_chunks()
            values, ends = grams.values.to_numpy(), grams.offsets.to_numpy()
            cols: list[list] = [[], [], [], []]
            for a, b in bounds:
                both = intersections([values[ends[r] : ends[r + 1]] for r in range(a, b)])
                size = np.diff(ends[a : b + 1])
                linked = tile.pairs(a, b, both * (over + under) >= over * (size[:, None] + size[None, :]))
                if want_pairs:
                    for x, y in zip(*np.nonzero(linked), strict=True):
                        low, high = sorted((int(tile.cid[a + x]), int(tile.cid[a + y])))
                        for col, value in zip(cols, (low, high, both[x, y], size[x] + size[y] - both[x, y]), strict=True):
                            col.append(value)
                elif linked.any():
                    linked |= linked.T
                    has = np.flatnonzero(linked.any(axis=1))
                    found = (tile.cid[a:b][has], tile.cid[a:b][roots(linked)[has]], (linked[has] * copies[a:b]).sum(axis=1))
                    for col, part in zip(cols, found, strict=False):
                        col.extend(part.tolist())
            names = ["cid_a", "cid_b", "n_both", "n_any"] if want_pairs else ["cid", "root", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[: len(names)]], names=names)

    return run


class Join:
    """The classes of a table's documents and what links them."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL):
        self.n, self.threshold = n, threshold
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        keyed = self.docs.filter("text IS NOT NULL").withColumn("key", text_key(F.col("text")))
        texts = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("text").alias("text"))
        self.texts = materialize(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts", compression="zstd")
        signed = materialize(signatures(self.texts, n, choose_bands(threshold[0] / threshold[1], recall)), "signatures")
        classes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(
            F.min("text_id").alias("text_id"), F.sum("copies").alias("copies"), F.first("n_grams").alias("weight"), F.first("blocks").alias("blocks")
        )
        self.classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.members = signed.select("key", "first_id", "set_key").join(self.classes.select("set_key", "cid", "copies"), "set_key").drop("set_key")
        self.blocks = Blocks(self.classes, CHUNK_NGRAMS, CHUNK_CLASSES)
        if self.blocks.frequent:
            candidates = self.blocks.candidates()
            self.blocks.find_cores(candidates, materialize(self._sets(candidates.select("cid")), "candidate-sets"), self._near)

    def _near(self, a: Column, b: Column) -> Column:
        """Whether a similarity is at least half-way between the threshold and 1."""
        over, under = sum(self.threshold), 2 * self.threshold[1]
        return F.size(F.array_intersect(a, b)) * (over + under) >= over * (F.size(a) + F.size(b))

    def _sets(self, cids: DataFrame) -> DataFrame:
        """(cid, held): the n-grams of classes. Ids are broadcast if they are counted to be few; else both sides are shuffled."""
        ids = materialize(self.classes.select("cid", "text_id").join(cids.distinct(), "cid"), "picked")
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return ngram_sets(self.texts.select("text_id", "text").join(F.broadcast(ids) if few else ids, "text_id"), self.n)

    def _compared(self) -> DataFrame:
        n = partitions(self.docs.sparkSession)
        needed = dealt(self.blocks.tiles().join(self.classes.select("cid", "blocks"), "cid"), n).mapInArrow(_needed, TILES)
        needed = materialize(needed, "tiles")
        held = self.classes.select("cid", "blocks", "copies").join(self._sets(needed.select("cid")), "cid")
        return dealt(needed.join(held, "cid"), n)

    def pairs(self) -> DataFrame:
        """(set_a, set_b, n_both, n_any): each linked pair of classes once, but for pairs within a core."""
        found = self._compared().mapInArrow(_verify(self.threshold, True), "cid_a long, cid_b long, n_both long, n_any long")
        for c in ("a", "b"):
            found = found.join(self.classes.select(F.col("cid").alias(f"cid_{c}"), F.col("set_key").alias(f"set_{c}")), f"cid_{c}")
        return found.select(F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"), "n_both", "n_any")

    def cores(self) -> DataFrame:
        """(set_key, core): the classes that are all linked to each other through a core's centre."""
        if self.blocks.cores is None:
            return self.classes.select("set_key", F.col("cid").alias("core")).limit(0)
        return self.blocks.cores.join(self.classes.select("cid", "set_key"), "cid").select("set_key", "core")

    def named(self) -> DataFrame:
        """(key, class_id, kept_key, n_links, copy_class_id, n_copies, kept_copies), a row a text with words, written."""
        links = self._compared().mapInArrow(_verify(self.threshold, False), "cid long, root long, n long")
        core = self.blocks.core_links()
        links = materialize(links if core is None else links.unionByName(core), "links")
        near = links.groupBy("cid").agg(F.sum("n").alias("near"))
        parts = connected_components(links.filter("cid <> root"), "cid", "root").withColumnRenamed("node", "cid")
        # the text that stays: the smallest id, any id before none
        text = F.struct(F.col("first_id").isNull(), "first_id", "key")
        members = materialize(self.members, "members")
        copied = members.groupBy("cid").agg(F.min(text).alias("least"), F.first("copies").alias("copies"))
        known = copied.join(parts, "cid", "left").join(near, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        known = materialize(known, "known")
        lowest = materialize(known.groupBy("component").agg(F.min("least").alias("stays"), F.sum("copies").alias("all")), "lowest")
        info = known.join(lowest, "component").select(
            "cid", F.col("stays.first_id").alias("class_id"), F.col("stays.key").alias("kept_key"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
            F.col("least.first_id").alias("copy_class_id"), F.col("copies").alias("n_copies"), F.col("all").alias("n_class"),
        )
        return materialize(members.select("key", "cid").join(info, "cid").drop("cid"), "named")

    def documents(self) -> DataFrame:
        """(doc_id, class_id, n_links, copy_class_id, n_copies, kept), one row a document.

        ``class_id`` is the smallest doc_id that links lead to, ``n_links`` the number of other documents linked
        directly (copies of the n-gram set among them), ``kept`` is true for one document of each class."""
        out = self.docs.select("doc_id", text_key(F.col("text")).alias("key")).join(self.named(), "key", "left")
        alone = F.col("kept_key").isNull()
        return out.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("copy_class_id")).alias("copy_class_id"),
            F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
            (alone | (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        )


def near_duplicates(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    return Join(docs, n, threshold, recall).documents()


def similar_pairs(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    return Join(docs, n, threshold, recall).pairs()


def keep_one(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: one row of each class stays, and every row without words."""
    named = Join(docs, n, threshold, recall).named().filter("n_class > 1")
    listed = materialize(named.select("key", "kept_key", "class_id", F.lit(True).alias("found")), "near")
    # the columns travel in a struct, where no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("id"), text_key(docs["text"]).alias("key")).join(listed, "key", "left")
    single = rows.filter("found IS NULL")
    stays = rows.filter("key = kept_key AND id <=> class_id").dropDuplicates(["key"])
    return single.select("row.*").unionByName(stays.select("row.*"))
