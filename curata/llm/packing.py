"""Packing: shortest-pack-first over the length histogram.

``cut_pieces`` encodes whole texts and cuts each document's ids into pieces of at most
``max_len``; a piece notes its rank among pieces of its length within the task that cut it.
``pack`` then needs the histogram of lengths (at most ``max_len`` rows,
which is all that reaches the driver), the packing patterns made from it, which are broadcast, and for each
(task, length) the pieces of that length in earlier tasks, which are joined by sorting. A piece's global rank within its
length selects its pattern, its copy of the pattern and its place in the sequence.

Patterns: lengths are placed longest first, always into the packs with the most room, and
a pattern's count is split when fewer pieces than packs are left. Each length adds at most
two patterns, and a pattern holds at most sqrt(2 * max_len) different lengths, so the table
that is broadcast has a bound that doesn't depend on the data.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are
packed each by itself; null ids stay null; a very long text becomes many pieces; pieces of one length tie, and take places in
the order of the tasks that cut them; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import only, prefix_sums
from curata.llm.token_output import list_column
from curata.llm.tokens import END_ID, encoder, text_batches
from curata.session import materialize

MAX_LEN = 2048
PIECES = "block int, local_rank long, doc_id long, start long, length long, doc_tokens long, ids array<int>"
INTERVALS = "length long, from_rank long, to_rank long, per_pack long, offset0 long, sequence0 long"


def pack_histogram(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (number of packs, {length: pieces a pack}), lengths in the order in which they were placed."""
    free: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []  # a heap of the free spaces that occur, largest first

    def put(room: int, packs: int, pattern: dict[int, int]) -> None:
        if not free.get(room):
            heapq.heappush(rooms, -room)
        free.setdefault(room, []).append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while rooms and not free.get(-rooms[0]):
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                put(max_len - length, left, {length: 1})
                break
            room = -rooms[0]
            packs, pattern = free[room].pop()
            if (used := min(packs, left)) < packs:
                free[room].append((packs - used, pattern))
            put(room - length, used, pattern | {length: pattern.get(length, 0) + 1})
            left -= used
    return [p for room in sorted(free) for p in free[room]]


def intervals(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, ...]]:
    """Rows of ``INTERVALS``: which ranks of a length a pattern takes, and where it puts them."""
    rows, taken, sequence = [], Counter(), 0
    for packs, pattern in patterns:
        offset = 0
        for length, each in pattern.items():
            rows.append((length, taken[length], taken[length] + packs * each, each, offset, sequence))
            taken[length] += packs * each
            offset += length * each
        sequence += packs
    return rows


def cut(vocabulary: str, max_len: int = MAX_LEN, end_id: int = END_ID):
    """For mapInArrow over (doc_id, text): the rows of ``PIECES``."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        block, seen = TaskContext.get().partitionId(), Counter()
        end, width = end_id.to_bytes(4, "little"), 4 * max_len
        for batch, texts in text_batches(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    n = len(piece) // 4
                    for col, value in zip(cols, (seen[n], doc_id, at // 4, n, len(ids) // 4, piece), strict=True):
                        col.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(cols[0]), pa.int32()), *(pa.array(c, pa.int64()) for c in cols[:5]), list_column(cols[5])],
                names=["block", "local_rank", "doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """The pieces of (doc_id, text), written once to the shared folder."""
    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialize(source.mapInArrow(cut(vocabulary, max_len, end_id), PIECES), "pieces", compression="zstd")


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``pieces`` (with block, local_rank and length, and any other columns) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if histogram and max(histogram) > max_len:
        raise ValueError(f"a piece is longer than {max_len}")
    # a row for each task and length, which grows with the data: joined by sorting, never broadcast
    before = prefix_sums(counts, "length", "block", "n", "before").select("block", "length", "before").hint("merge")
    places = spark.createDataFrame(intervals(pack_histogram(histogram, max_len)), INTERVALS)
    ranked = pieces.join(before, ["block", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).drop(places["length"])
    at = F.col("rank") - F.col("from_rank")
    return placed.withColumns(
        {"sequence_id": F.col("sequence0") + F.floor(at / F.col("per_pack")).cast("long"), "offset": F.col("offset0") + at % F.col("per_pack") * F.col("length")}
    ).drop("before", "rank", *[c.split()[0] for c in INTERVALS.split(", ")][1:], "block", "local_rank")


def checksum(batches):
    """For mapInArrow over ``PIECES``: crc32 of the ids instead of them."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        view = memoryview(ids.values.to_numpy(zero_copy_only=True)).cast("B")
        ends = ids.offsets.to_pylist()
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = [batch.column(i) for i in range(6)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], names=[*batch.schema.names[:6], "ids_crc32"])


def pack_digest(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN) -> DataFrame:
    """Packs whole documents; a row for each piece, with the checksum of its ids. Pieces are cut and summed in one pass: their
    ids aren't written, as no one reads them (``cut_pieces`` writes them)."""
    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    cut_ids = cut(vocabulary, max_len)
    pieces = source.mapInArrow(lambda batches: checksum(cut_ids(batches)), PIECES.replace("ids array<int>", "ids_crc32 long"))
    return pack(materialize(pieces, "pieces", compression="zstd"), max_len).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
