"""Line dedup with content-defined chunks of lines.

A rolling hash runs over the hashes of a document's lines: it holds the last ``window`` lines, a
line that comes in is added and the one that leaves is taken off. Boundaries of chunks depend on
that hash alone, so they are found again where a passage is shifted within another document.

``deduplicate_runs``, which the query and the pipeline use, opens a chunk at every line with text:
a chunk is that line, the next line with text and the blank lines between them, and its hash is the
rolling hash of these two. Chunks are then as short and dense as they can be. A run of two text lines or more is made of
such pairs, so a line is in a run with an earlier occurrence just if one of its pairs has one:
no boundary can miss it, and pairs that follow each other give the maximal run.
Runs begin and end at lines with text; blank lines around them stay. Where a run overlaps its own
earlier occurrence, as in a line repeated many times, the first line stays.

``deduplicate`` cuts sparser chunks, which lose most short passages: a chunk ends where the rolling hash of ``WINDOW``
lines is divisible by ``DIVISOR``. Chunks have at least ``MIN_LINES`` lines; a shorter rest joins the chunk before it.

Either way rows with equal texts (128 bits of SHA-256) are one text, which counts once, at its first row, that with the smallest id: the other
rows repeat all of its chunks. Chunks of the texts are counted by hash with map-side sums. For those that occur twice
the first occurrence, by doc_id and place, is looked up, the bytes of the others are compared with its bytes, and the
others are removed. A chunk of very many occurrences is compared in shares of about ``SHARE_ROWS``, each of which gets
the first's bytes.

Defined results: null and empty texts have no chunks and stay as they are; chunks of which
fewer than ``MIN_TEXT_LINES`` lines hold a word (a pair holds two) are never removed; of rows that share
an id and text one keeps what is first in it, the others repeat it, also where they have no id; null ids come first; texts that share an id are in order of their SHA-256;
very long texts are one row and are read whole; other columns pass through, whatever their names, but for
``n_lines``, ``n_removed_lines`` and ``n_removed_chunks``, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.common import by_key, partitions, text_key, worker_state
from curata.llm.tokens import text_batches
from curata.session import materialize, release

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
MIN_TEXT_LINES = 2
#: Occurrences of a chunk that are compared in one task, about.
SHARE_ROWS = 2000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


class Rolling:
    """The hash of the last ``window`` line hashes."""

    def __init__(self, window: int):
        self.window, self.out = window, pow(_BASE, window, 1 << 64)
        self.lines: list[int] = []
        self.value = 0

    def push(self, line: int) -> int:
        self.value = (self.value * _BASE + line) & _MASK
        self.lines.append(line)
        if len(self.lines) > self.window:
            self.value = (self.value - self.lines[-1 - self.window] * self.out) & _MASK
        return self.value


def mixed(value: int) -> int:
    """A hash whose low bits depend on all bits of ``value``."""
    value = ((value ^ (value >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return value ^ (value >> 32)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chunk_bounds(hashes: list[int], window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk, from the hashes of a document's lines."""
    bounds, start, n, rolling = [], 0, len(hashes), Rolling(window)
    for i, h in enumerate(hashes):
        value = rolling.push(h)
        if i + 1 - start >= min_lines and mixed(value) % divisor == 0:
            bounds.append((start, i + 1))
            start = i + 1
    if start < n:
        if bounds and n - start < min_lines:
            bounds[-1] = (bounds[-1][0], n)
        else:
            bounds.append((start, n))
    return [b for b in bounds if b[1] - b[0] >= min_lines]


def text_chunks(text: bytes, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> list[tuple[int, int, int]]:
    """(hash, first line, line after the last) of each chunk with text."""
    import xxhash

    hash64, lines = xxhash.xxh3_64_intdigest, text.split(b"\n")
    bounds = chunk_bounds(list(map(hash64, lines)), window, divisor, min_lines) if len(lines) >= min_lines else []
    return [(signed(hash64(b"\n".join(lines[a:b]))), a, b) for a, b in bounds if sum(bool(_WORD.search(x)) for x in lines[a:b]) >= MIN_TEXT_LINES]


def text_pairs(text: bytes) -> list[tuple[int, int, int]]:
    """(hash, first line, line after the last) of each line with text and the next one with text."""
    import xxhash

    hash64, found, before, blank = xxhash.xxh3_64_intdigest, [], None, []
    for i, line in enumerate(text.split(b"\n")):
        if not _WORD.search(line):
            blank.append(line)
            continue
        h = hash64(line)
        if before is not None:
            # the blank lines belong to the line after them; the rolling hash of a window of two
            last = hash64(b"\n".join([*blank, line])) if blank else h
            found.append((signed(mixed((before[1] * _BASE + last) & _MASK)), before[0], i + 1))
        before, blank = (i, h), []
    return found


CHUNKS = "hash long, key binary, first_id long, first int, last int"
PIECES = "hash long, share int, is_first boolean, key binary, first int, last int, bytes binary"


def _chunk_rows(find):
    """For mapInArrow over (key, first_id, text): the rows of ``CHUNKS``."""

    def run(batches):
        import pyarrow as pa

        worker_state("lines")
        for batch, texts in text_batches(batches):
            found = [find(t) for t in texts]
            counts = [len(f) for f in found]
            of = pa.array(np.repeat(np.arange(len(texts)), counts))
            hashes, first, last = zip(*(c for f in found for c in f), strict=True) if sum(counts) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), batch.column("key").take(of), batch.column("first_id").take(of), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["hash", "key", "first_id", "first", "last"]
            )

    return run


def _chunk_bytes(batches):
    """For mapInArrow over (key, text, parts): the rows of ``PIECES``; a first occurrence goes to each share."""
    import pyarrow as pa

    types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    for batch, texts in text_batches(batches):
        cols: list[list] = [[] for _ in types]
        for key, text, parts in zip(batch.column("key").to_pylist(), texts, batch.column("parts").to_pylist(), strict=True):
            lines = text.split(b"\n")
            for p in parts:
                data = b"\n".join(lines[p["first"] : p["last"]])
                for share in range(p["shares"]) if p["is_first"] else (p["share"],):
                    for col, value in zip(cols, (p["hash"], share, p["is_first"], key, p["first"], p["last"], data), strict=True):
                        col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


def _compare(batches):
    """For mapInArrow over ``PIECES`` by (hash, share), the first occurrence in front: chunks whose bytes equal the first's."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for table, starts in by_key(batches, ["hash", "share"]):
        data = table.column("bytes").combine_chunks()
        same = pc.equal(data, data.take(pa.array(np.repeat(starts[:-1], np.diff(starts)))))
        found = table.select(["key", "first", "last"]).filter(pc.and_(same, pc.invert(table.column("is_first"))))
        yield from found.combine_chunks().to_batches()


def different_texts(docs: DataFrame) -> DataFrame:
    """(key, first_id, first_row, text) of (doc_id, row, text), written: different texts of two lines or more with their first row, that with the
    smallest id, null first."""
    several = docs.filter(F.instr("text", "\n") > 0).select("doc_id", "row", "text", text_key(F.col("text")).alias("key"))
    texts = several.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("text").alias("text"))
    return materialize(texts.select("key", F.col("least.doc_id").alias("first_id"), F.col("least.row").alias("first_row"), "text"), "texts", compression="zstd")


def repeated_chunks(texts: DataFrame, find) -> DataFrame:
    """(key, first, last): chunks of ``different_texts`` whose bytes have an earlier occurrence."""
    n = partitions(texts.sparkSession)
    chunks = materialize(texts.mapInArrow(_chunk_rows(find), CHUNKS), "chunks", compression="zstd")
    place = F.struct("first_id", "key", "first")
    # written, so that the join has a plain exchange on both sides and AQE can split a hash of very many rows
    often = materialize(chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("one")).filter("n > 1"), "often")
    shares = F.ceil(F.col("n") / SHARE_ROWS).cast("int")
    part = F.struct("hash", "first", "last", (place == F.col("one")).alias("is_first"), shares.alias("shares"), F.pmod(F.xxhash64("key", "first"), shares).cast("int").alias("share"))
    parts = chunks.join(often, "hash").select("key", part.alias("part")).groupBy("key").agg(F.collect_list("part").alias("parts"))
    pieces = texts.select("key", "text").join(parts, "key").mapInArrow(_chunk_bytes, PIECES)
    dealt = pieces.repartition(n, "hash", "share").sortWithinPartitions("hash", "share", ~F.col("is_first"))
    found = materialize(dealt.mapInArrow(_compare, "key binary, first int, last int"), "repeated")
    release(chunks)
    return found


def _merged(cut) -> list[tuple[int, int]]:
    """The listed chunks, those that overlap put together."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(set(cut)):
        if runs and a < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _keep_lines(find, names: list[str], text_col: str):
    """For mapInArrow over (rest, text, found, is_first, cut): the columns ``names`` with the lines that are left, and what was removed."""

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            left: list = []
            counts: list[list] = [[], [], []]
            for text, found, is_first, cut in zip(texts, *(batch.column(c).to_pylist() for c in ("found", "is_first", "cut")), strict=True):
                n = 0 if text is None else text.count(b"\n") + 1
                removed, runs = 0, []
                if found:
                    runs = _merged([(c["first"], c["last"]) for c in cut or ()] if is_first else [(a, b) for _, a, b in find(text)])
                if runs:
                    lines = text.split(b"\n")
                    for a, b in reversed(runs):
                        del lines[a:b]
                        removed += b - a
                    text = b"\n".join(lines)
                left.append(text)
                for col, value in zip(counts, (n, removed, len(runs)), strict=True):
                    col.append(value)
            rest = batch.column("rest")
            columns = [pa.array(left, pa.binary()).cast(pa.string()) if c == text_col else rest.field(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=[*names, *MADE])

    return run


MADE = ["n_lines", "n_removed_lines", "n_removed_chunks"]


def _without(docs: DataFrame, text: str, find) -> DataFrame:
    base = docs.drop(*MADE)
    # the other columns travel in a struct, where no name can clash; the number of a row is made once, as it is written
    rest = F.struct(*[base[c] for c in base.columns if c != text])
    own = base.select(rest.alias("rest"), base[text].cast("string").alias("text"), base["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    own = materialize(own, "rows", compression="zstd")
    texts = different_texts(own)
    cut = repeated_chunks(texts, find).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("cut"))
    listed = materialize(texts.select("key", "first_row", F.lit(True).alias("found")).join(cut, "key", "left"), "listed")
    rows = own.withColumn("key", text_key(F.col("text"))).join(listed, "key", "left")
    marked = rows.select("rest", "text", F.col("first_row").eqNullSafe(F.col("row")).alias("is_first"), "found", "cut")
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in base.schema] + [T.StructField(c, T.LongType()) for c in MADE]
    return marked.mapInArrow(_keep_lines(find, base.columns, text), T.StructType(fields))


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with repeated chunks cut from its texts, and ``n_lines``, ``n_removed_lines``, ``n_removed_chunks``."""
    return _without(docs, text, lambda t: text_chunks(t, window, divisor, min_lines))


def deduplicate_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all repeated runs of two lines with text or more cut from its texts, and ``n_lines``, ``n_removed_lines``,
    ``n_removed_chunks`` (runs)."""
    return _without(docs, text, text_pairs)
