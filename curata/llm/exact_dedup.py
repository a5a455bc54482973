"""Exact dedup by an index of live digests: cuckoo filters in front of bucketed content.

A text's digest (SHA-256) names its bucket of the index. A bucket holds a cuckoo filter of its live digests
(16-bit fingerprints, four cells a slot, two slots a digest), the stored keys, and the content, the texts
themselves. An arriving text whose fingerprint is absent is new: it enters filter, keys and content and nothing is
compared. A hit is looked up by its key and compared byte by byte with the bucket's content; a false hit
enters as a new text. A filter that overflows is doubled and filled again from the stored keys. Deleting
takes a digest out of all three.

``update`` reads one generation of an index and writes the next, so a lost executor repeats a task and harms
nothing. Copies are put together before they travel: first within each input partition, then, where a partition held several,
by digest and hundred partitions, so that a text that a third of all rows share reaches its bucket
a few times. Only arriving texts are held by a task, at most ``BUCKET_BYTES`` or so of them when an index is
built; stored content streams past them.

Defined results: a null text counts as empty, and equal texts are equal bytes, nothing is normalised. The
largest ``doc_id`` stays, any before none; of rows with that id and that text one stays. A group of rows without ids keeps
one of them and its ``keep_id`` is null. Very long texts are one row each. Other columns of the input
are not read. An empty table gives an empty index and no rows. Unequal texts under one digest stop the job, so that no text can go unseen.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import only
from curata.session import materialize, shared_dir

#: Text that a bucket is planned for when an index is built, as it decides how many buckets there are.
BUCKET_BYTES = 8 << 20
#: Text that a task holds while it puts copies together.
HELD_BYTES = 32 << 20
#: Partitions whose repeated texts are put together by one task.
PARTS_TOGETHER = 100

FILTER, GONE, ARRIVING, CONTENT = range(4)
ARRIVING_SCHEMA = "digest binary, n long, keep_id long, text binary, size long, part int"
INDEX_SCHEMA = "bucket long, kind int, digest binary, n long, keep_id long, text binary, cells binary, keys binary"


class CuckooFilter:
    """Fingerprints of digests. Digests are uniform, so their own bits are the hashes."""

    CELLS, KICKS = 4, 200

    def __init__(self, slots: int = 16, cells: bytes | None = None):
        self.cells = array("H", cells if cells is not None else bytes(2 * self.CELLS * slots))
        self.slots = len(self.cells) // self.CELLS

    def _other(self, slot: int, mark: int) -> int:
        return slot ^ (mark * 0x5BD1E995 >> 3 & self.slots - 1)

    def _home(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        slot = int.from_bytes(digest[:8], "little") & self.slots - 1
        return mark, slot, self._other(slot, mark)

    def _find(self, slot: int, mark: int) -> int:
        for at in range(slot * self.CELLS, (slot + 1) * self.CELLS):
            if self.cells[at] == mark:
                return at
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._home(digest)
        return self._find(one, mark) >= 0 or self._find(two, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if no cell came free; a fingerprint is then without a cell, and the filter has to be filled anew."""
        mark, one, two = self._home(digest)
        for slot in (one, two):
            if (at := self._find(slot, 0)) >= 0:
                self.cells[at] = mark
                return True
        slot = two
        for kick in range(self.KICKS):
            at = slot * self.CELLS + (kick + mark) % self.CELLS
            mark, self.cells[at] = self.cells[at], mark
            slot = self._other(slot, mark)
            if (at := self._find(slot, 0)) >= 0:
                self.cells[at] = mark
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Takes out one fingerprint of a digest that is in the filter."""
        mark, one, two = self._home(digest)
        at = self._find(one, mark)
        self.cells[at if at >= 0 else self._find(two, mark)] = 0

    @classmethod
    def filled(cls, slots: int, keys) -> CuckooFilter:
        """A filter of at least so many slots that holds all keys."""
        while True:
            made = cls(slots)
            if all(map(made.insert, keys)):
                return made
            slots *= 2


class Bucket:
    """One bucket during an update: its filter and stored keys, and the texts that arrive."""

    def __init__(self):
        self.filter, self.keys, self.gone, self.fresh = CuckooFilter(), set(), set(), {}

    def load(self, cells: bytes, keys: bytes) -> None:
        self.filter, self.keys = CuckooFilter(cells=cells), {keys[i : i + 32] for i in range(0, len(keys), 32)}

    def remove(self, digest: bytes) -> None:
        if digest in self.filter and digest in self.keys:
            self.filter.delete(digest)
            self.keys.remove(digest)
            self.gone.add(digest)

    def arrive(self, digest: bytes, text: bytes, n: int, keep_id: int | None) -> None:
        if digest in self.filter and digest in self.keys:
            if digest in self.fresh:
                merge(self.fresh[digest], text, n, keep_id)
            else:
                self.fresh[digest] = [text, n, keep_id]  # until its content comes by
            return
        self.fresh[digest] = [text, n, keep_id]
        self.keys.add(digest)
        if not self.filter.insert(digest):
            self.filter = CuckooFilter.filled(2 * self.filter.slots, self.keys)

    def stored(self, digest: bytes, text: bytes, n: int, keep_id: int | None):
        """The entry of a text that an earlier update stored, or None if it is gone."""
        if digest in self.gone:
            return None
        entry = [text, n, keep_id]
        if digest in self.fresh:
            merge(entry, *self.fresh.pop(digest))
        return entry


def merge(entry: list, text: bytes, n: int, keep_id: int | None) -> None:
    if entry[0] != text:
        raise ValueError("unequal texts under one digest")
    entry[1] += n
    if keep_id is not None and (entry[2] is None or keep_id > entry[2]):
        entry[2] = keep_id


def _batches(rows, schema: list[str], size):
    """Arrow batches of about 4 MB."""
    import pyarrow as pa

    types = {"bucket": pa.int64(), "kind": pa.int32(), "n": pa.int64(), "keep_id": pa.int64(), "size": pa.int64(), "part": pa.int32()}
    held, total = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(column, types.get(name, pa.binary())) for name, column in zip(schema, zip(*held, strict=True), strict=True)], names=schema)

    for row in rows:
        held.append(row)
        total += size(row) + 100
        if total >= 4 << 20:
            yield made()
            held, total = [], 0
    if held:
        yield made()


def _combine(batches):
    """For mapInArrow over (digest, n, keep_id, text): copies within the partition as one row, ``ARRIVING_SCHEMA``."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows():
        held, total = {}, 0
        for batch in batches:
            for digest, n, keep_id, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "keep_id", "text")), strict=True):
                if digest in held:
                    merge(held[digest], text, n, keep_id)
                    continue
                held[digest] = [text, n, keep_id]
                total += len(text) + 200
            if total >= HELD_BYTES:
                yield from ((d, n, k, t, len(t), part) for d, (t, n, k) in held.items())
                held, total = {}, 0
        yield from ((d, n, k, t, len(t), part) for d, (t, n, k) in held.items())

    yield from _batches(rows(), ["digest", "n", "keep_id", "text", "size", "part"], lambda row: row[4])


def _apply(batches):
    """For mapInArrow over rows of ``INDEX_SCHEMA`` in order of bucket and kind: the next generation of the buckets."""
    columns = ["bucket", "kind", "digest", "n", "keep_id", "text", "cells", "keys"]

    def closed(number, bucket):
        for digest, (text, n, keep_id) in bucket.fresh.items():
            yield number, CONTENT, digest, n, keep_id, text, None, None
        yield number, FILTER, None, None, None, None, bucket.filter.cells.tobytes(), b"".join(sorted(bucket.keys))

    def rows():
        number, bucket = None, None
        for batch in batches:
            for at, kind, digest, n, keep_id, text, cells, keys in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if at != number:
                    if bucket:
                        yield from closed(number, bucket)
                    number, bucket = at, Bucket()
                if kind == FILTER:
                    bucket.load(cells, keys)
                elif kind == GONE:
                    bucket.remove(digest)
                elif kind == ARRIVING:
                    bucket.arrive(digest, text, n, keep_id)
                elif entry := bucket.stored(digest, text, n, keep_id):
                    yield number, CONTENT, digest, entry[1], entry[2], entry[0], None, None
        if bucket:
            yield from closed(number, bucket)

    yield from _batches(rows(), columns, lambda row: len(row[5] or b"") + len(row[6] or b"") + len(row[7] or b""))


def digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets).cast("long"))


def _next(spark: SparkSession, index: DataFrame | None, changes: DataFrame, path: str | None) -> str:
    """Applies changes (digest, n, keep_id, text, kind, bucket) and writes the next generation."""
    path = path or shared_dir(spark, "digest-index")
    wanted = [f.name for f in spark.createDataFrame([], INDEX_SCHEMA).schema.fields]
    rows = changes.withColumns({"cells": F.lit(None).cast("binary"), "keys": F.lit(None).cast("binary")}).select(wanted)
    if index is not None:
        rows = index.select(wanted).unionByName(rows)
    rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_apply, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def insert(docs: DataFrame, index: str | None = None, buckets: int | None = None, path: str | None = None) -> str:
    """Puts the texts of (doc_id, text) into an index, or into a new one, and returns the folder of its next generation.

    The number of buckets is that of the index; for a new one it follows from the bytes of text, or is given, for
    an index that is to grow."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").select(digest(F.col("text")).alias("digest"), F.lit(1).cast("long").alias("n"), F.col("doc_id").cast("long").alias("keep_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    combined = materialize(rows.mapInArrow(_combine, ARRIVING_SCHEMA), "combined", compression="zstd")
    together = combined.filter("n > 1").repartition("digest", F.floor(F.col("part") / PARTS_TOGETHER)).mapInArrow(_combine, ARRIVING_SCHEMA)
    arriving = combined.filter("n = 1").unionByName(together)
    old = buckets_of(spark, index) if index else None
    if old is None and buckets is None:
        buckets = -(-(combined.agg(F.sum("size")).first()[0] or 1) // BUCKET_BYTES)
    buckets = old or buckets
    made = _next(spark, load(spark, index) if index else None, arriving.withColumns({"kind": F.lit(ARRIVING), "bucket": _bucket(buckets)}), path)
    _note(spark, made, buckets)
    return made


def delete(docs: DataFrame, index: str, path: str | None = None) -> str:
    """Takes the texts of ``docs``, with all their copies, out of an index; texts that it doesn't hold are passed over."""
    spark = docs.sparkSession
    buckets = buckets_of(spark, index)
    gone = only(docs, "text").select(digest(F.col("text")).alias("digest")).distinct()
    empty = {c: F.lit(None).cast(t) for c, t in (("n", "long"), ("keep_id", "long"), ("text", "binary"))}
    made = _next(spark, load(spark, index), gone.withColumns(empty | {"kind": F.lit(GONE), "bucket": _bucket(buckets)}), path)
    _note(spark, made, buckets)
    return made


def _note(spark: SparkSession, path: str, buckets: int) -> None:
    spark.range(1).select(F.lit(buckets).cast("long").alias("buckets")).coalesce(1).write.parquet(f"{path}-buckets")


def buckets_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}-buckets").first()[0]


def live(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, keep_id, text) of the live texts of an index; name columns to read those alone."""
    return load(spark, path).filter(F.col("kind") == CONTENT).select("digest", "n", "keep_id", "text")


def decisions(docs: DataFrame, index: str) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of each row of ``docs``, whose texts are in the index."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    # rows of one id and one text are counted, so that one of them stays
    rows = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("same"))
    known = live(docs.sparkSession, index).select("digest", F.col("n").alias("group_size"), "keep_id")
    met = rows.join(known.hint("merge"), "digest").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "same")).alias("place"))
    return met.select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"))


ORACLE_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
SELECT doc_id, keep_id, group_size,
  doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY rows.t, doc_id) = 1 AS kept,
  sha256(rows.t) AS text_sha256
FROM rows JOIN groups ON rows.t = groups.t
"""
