"""Mixing sources to target weights.

1. *Targets.* Sources in code point order, null last, weigh 1, 2, 3, repeating. They share
   all words by weight; a target stops at ``MAX_REPEATS`` times its source's size and the
   excess is shared again by weight. Only one row a source is involved.
2. *Blocks.* A source's documents are laid end to end in a fixed pseudorandom order (by
   bucket of a hash, then id) and cut into blocks of ``BLOCK_WORDS`` words. Where a document
   starts is a sum over buckets plus a sum within its bucket, so that no source, however
   large, has to pass through one task.
3. *Slots.* Each output shard draws its numbers of blocks by source from a multinomial
   distribution with the target shares. Slots of a source are numbered across shards; what
   a source draws beyond its target is dropped and what it lacks goes into closing shards,
   so each source ends at its target to the word: its last slot may hold part of a block.
4. *Join.* A slot's number modulo the number of blocks goes through the source's own
   pseudorandom permutation (a keyed Feistel network over the index) and gives the block
   that it takes, and slots and documents meet on (source, block).

Slots run through all blocks before any repeats, so a document is used at most
``MAX_REPEATS`` times. All draws are keyed by (seed, shard) or (seed, source).

Sources are rows on the driver, and entries of a draw's probabilities; their number is not limited otherwise.

Defined results: null and empty texts have size 0 and nothing is taken; repeated rows are
documents of their own, and rows that tie in id, size and text can take each other's place; null ids stay null; very
long texts are counted whole and lie in many blocks; other columns of the input are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import prefix_sums, split_words
from curata.session import materialize

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_REPEATS = 3
SEED = 7
#: Rows a bucket of the order holds on average.
BUCKET_ROWS = 2_000


#: Up to so many sources are broadcast to the rows; more are joined by a shuffle. Both give the same rows.
BROADCAST_SOURCES = 100_000


def few(table: DataFrame, sources: int) -> DataFrame:
    """A table of one row a source, to be broadcast if it is small."""
    return F.broadcast(table) if sources <= BROADCAST_SOURCES else table


def targets(sizes: list[int], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Target words by source, for sizes in source order: weights 1, 2, 3, repeating."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    found = [0.0] * len(sizes)
    open_, left = [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                found[i] = share * weights[i]
            break
        for i in full:
            found[i] = float(max_repeats * sizes[i])
            left -= found[i]
        capped = set(full)
        open_ = [i for i in open_ if i not in capped]
    return found


class Permutation:
    """A keyed pseudorandom permutation of range(n): a Feistel network walked until it falls inside."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = list(np.random.default_rng(key).integers(0, 2**63, rounds, dtype=np.uint64))

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, index, back: bool) -> np.ndarray:
        x = np.asarray(index, dtype=np.uint64)
        with np.errstate(over="ignore"):
            x = self._once(x, self.keys, back)
            while (out := x >= self.n).any():
                x[out] = self._once(x[out], self.keys, back)
        return x.astype(np.int64)

    def apply(self, index) -> np.ndarray:
        return self._walk(index, False)

    def invert(self, index) -> np.ndarray:
        return self._walk(index, True)


def slot_quota(size: int, words: int, block: int, where_short: int) -> tuple[int, int]:
    """(whole slots, words of the slot after them) that make ``words`` words, when a round of slots has one
    short block (the last of the source) at place ``where_short``."""
    n_blocks = -(-size // block)
    short = size - (n_blocks - 1) * block
    rounds, rest = divmod(words, size)
    if rest <= where_short * block:
        slots, part = divmod(rest, block)
    elif rest < where_short * block + short:
        slots, part = where_short, rest - where_short * block
    else:
        more, part = divmod(rest - where_short * block - short, block)
        slots = where_short + 1 + more
    return rounds * n_blocks + slots, part


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def plan_sources(sizes: DataFrame, block: int, seed: int, max_repeats: int = MAX_REPEATS) -> list[dict]:
    """One dict a source from (source, size) rows, in code point order with null last."""
    rows = sorted(sizes.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = []
    for i, (row, target) in enumerate(zip(rows, targets([r["size"] for r in rows], max_repeats), strict=True)):
        size, words = row["size"], min(round(target), max_repeats * row["size"])
        n_blocks = -(-size // block)
        slots = part = 0
        if words:
            slots, part = slot_quota(size, words, block, int(Permutation(n_blocks, seed * 1_000_003 + i).invert([n_blocks - 1])[0]))
        plan.append({"source": row["source"], "s": i, "source_size": size, "target": target, "n_blocks": n_blocks, "slots": slots, "part": part})
    return plan


def lay_out(docs: DataFrame, total_rows: int) -> DataFrame:
    """``docs`` (doc_id, s, size, tie and any other columns) with ``at``: the words of its source before it."""
    buckets = max(1, -(-total_rows // BUCKET_ROWS))
    df = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "s", "tie"), F.lit(buckets)))
    order = Window.partitionBy("s", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sums = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "s", "tie"), F.lit(buckets))).groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    sums = prefix_sums(sums, "s", "bucket", "n", "ahead").select("s", "bucket", "ahead")
    return df.join(sums, ["s", "bucket"]).withColumn("at", F.col("ahead") + F.col("within")).drop("bucket", "within", "ahead")


def draw_slots(spark, plan: list[dict], seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, s, t): the slots of all shards; ``t`` numbers those of a source from 0 up to its quota."""
    quota = np.array([p["slots"] + (p["part"] > 0) for p in plan], dtype=np.int64)
    total = int(quota.sum())
    n_shards = -(-total // shard_slots) if total else 0
    share = (quota / total).tolist() if total else []

    def draw(frames):
        import pandas as pd

        for frame in frames:
            for shard in frame["id"]:
                got = np.random.default_rng([seed, int(shard)]).multinomial(shard_slots, share)
                has = np.flatnonzero(got)
                yield pd.DataFrame({"shard": np.int64(shard), "s": has.astype(np.int32), "n": got[has]})

    drawn = spark.range(0, n_shards).mapInPandas(draw, "shard long, s int, n long") if n_shards else spark.createDataFrame([], "shard long, s int, n long")
    limits = few(spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota)], "s int, quota long"), len(quota))
    runs = prefix_sums(drawn, "s", "shard", "n", "t0")
    kept = runs.join(limits, "s").withColumn("n", F.least("n", F.col("quota") - F.col("t0"))).filter("n > 0").select("shard", "s", "t0", "n")
    got = drawn.groupBy("s").agg(F.sum("n").alias("got"))
    lacks = limits.join(got, "s", "left").withColumn("t0", F.least(F.coalesce("got", F.lit(0)), F.col("quota"))).withColumn("lack", F.col("quota") - F.col("t0")).filter("lack > 0")
    # closing shards hold what a source lacks, in runs of at most a shard
    closing = lacks.select("s", "t0", "lack", F.explode(F.sequence(F.lit(0), F.floor((F.col("lack") - 1) / shard_slots))).alias("k")).select(
        (F.lit(n_shards) + F.col("k")).cast("long").alias("shard"), "s", (F.col("t0") + F.col("k") * shard_slots).alias("t0"), F.least(F.lit(shard_slots), F.col("lack") - F.col("k") * shard_slots).cast("long").alias("n")
    )
    return kept.unionByName(closing).select("shard", "s", F.explode(F.sequence(F.col("t0"), F.col("t0") + F.col("n") - 1)).alias("t"))


def take_blocks(slots: DataFrame, plan: list[dict], block: int, seed: int) -> DataFrame:
    """(shard, s, t, epoch, block, part): the block that each slot takes; ``part`` is the words it takes of it, -1 for all."""
    n_blocks = [p["n_blocks"] for p in plan]
    last = {p["s"]: (p["slots"], p["part"]) for p in plan}

    def run(frames):
        perms: dict[int, Permutation] = {}
        for frame in frames:
            out = frame.copy()
            out["epoch"] = 0
            out["block"] = 0
            out["part"] = -1
            for s, rows in frame.groupby("s").groups.items():
                s = int(s)
                perm = perms.setdefault(s, Permutation(n_blocks[s], seed * 1_000_003 + s))
                t = frame.loc[rows, "t"].to_numpy()
                out.loc[rows, "epoch"] = t // n_blocks[s]
                out.loc[rows, "block"] = perm.apply(t % n_blocks[s])
                slots_, part = last[s]
                out.loc[rows, "part"] = np.where(t == slots_, part, -1)
            yield out.astype({"epoch": "int32", "block": "int64", "part": "int64"})

    return slots.mapInPandas(run, "shard long, s int, t long, epoch int, block long, part long")


def mix(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, max_repeats: int = MAX_REPEATS, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes (doc_id, text, source); ``row`` may name a column with a long key of each row. Returns

    * rows (row, doc_id, tie, source, size, source_size, target, s, at), one a document;
    * the slots (shard, s, t, epoch, block, part);
    * taken (s, at, row, epoch, size, first_word, n_words): the words of documents that slots take.
    """
    spark = docs.sparkSession
    key = docs[row].cast("long") if row else F.monotonically_increasing_id()
    sized = docs.select(key.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), F.xxhash64(docs["text"].cast("string")).alias("tie"))
    sized = materialize(sized, "sizes")
    plan = plan_sources(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).select("source", "size"), block, seed, max_repeats)
    info = spark.createDataFrame([(p["source"], p["s"], p["source_size"], p["target"]) for p in plan], "source string, s int, source_size long, target double")
    rows = sized.join(few(info, len(plan)), sized["source"].eqNullSafe(info["source"])).drop(info["source"])
    rows = materialize(lay_out(rows, sized.count()), "layout")
    slots = take_blocks(draw_slots(spark, plan, seed), plan, block, seed)
    has = rows.filter("size > 0")
    parts = has.select("s", "at", "size", "row", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    met = parts.join(slots.select("s", "block", "epoch", "part"), ["s", "block"])
    low = F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block, F.when(F.col("part") >= 0, F.col("block") * block + F.col("part")).otherwise((F.col("block") + 1) * block))
    taken = met.select("s", "at", "size", "row", "epoch", (low - F.col("at")).alias("first_word"), (high - low).alias("n_words")).filter("n_words > 0")
    return rows, slots, taken


def mix_digest(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row a document."""
    rows, _, taken = mix(docs, block, seed)
    used = taken.groupBy("s", "at", "size").agg(F.sum("n_words").alias("taken"))
    joined = rows.join(used, ["s", "at", "size"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
