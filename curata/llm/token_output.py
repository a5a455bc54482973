"""Token-id output: Parquet list columns, ordered by document, readable column by column.

``write_tokens`` deals documents by ranges of ``doc_id`` before encoding (texts are smaller
than their ids), encodes each range in order and writes Spark's own Parquet files. Ids are
a list column with dictionary encoding, the integer metadata beside it is delta encoded
(format v2), and row groups, pages and page indexes are set by options. Each range notes
where its documents start within it (``block``, ``local_start``), so a global start needs
only the sum of each range: one row a range.

``read_tokens`` reads any columns: metadata alone never touches the ids.

Defined results: a null or empty text has the end id alone; repeated rows are encoded
each; ties of ``doc_id`` lie next to each other, in the order of their rows, over as many ranges as they need; a null ``doc_id``
comes first; a very long text is one list; other columns of the input are not written; an empty table gives empty files.
"""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import only, partitions
from curata.llm.tokens import END_ID, encoder, text_batches

TOKEN_SCHEMA = "block int, doc_id long, local_start long, n_tokens long, ids array<int>"

#: Parquet options of the token files.
FILE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#block": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}


def list_column(parts: list[bytes]):
    """Little-endian 32-bit ids, one bytes object a row, as an Arrow list column."""
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode_ranges(vocabulary: str, end_id: int = END_ID):
    """For mapInArrow over (doc_id, text) in order: the rows of ``TOKEN_SCHEMA``."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        block, at = TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch, texts in text_batches(batches):
            ids = [b + end for b in encode(texts)]
            counts = [len(b) // 4 for b in ids]
            starts = []
            for n in counts:
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(ids), pa.int32()), batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), list_column(ids)],
                names=["block", "doc_id", "local_start", "n_tokens", "ids"],
            )

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, ranges: int | None = None, options: dict[str, str] | None = None) -> None:
    """Encodes whole texts of (doc_id, text) and writes the ids under ``path`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # the number of the row parts the rows of a repeated or null id over ranges
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(ranges or partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    ordered.mapInArrow(encode_ranges(vocabulary, end_id), TOKEN_SCHEMA).write.options(**(FILE_OPTIONS | (options or {}))).parquet(path)


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The token files; name columns to read those alone."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def block_starts(tokens: DataFrame) -> DataFrame:
    """(block, block_start): the ids before each range; one row a range, read from the metadata columns."""
    totals = tokens.groupBy("block").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))


def with_starts(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``start``: the ids of all documents before each one. The broadcast side has one row a range."""
    starts = block_starts(tokens.select("block", "local_start", "n_tokens"))
    return tokens.join(F.broadcast(starts), "block").withColumn("start", F.col("block_start") + F.col("local_start")).drop("block_start")


def checksum(batches):
    """For mapInArrow over (doc_id, start, n_tokens, ids): crc32 of the ids instead of them."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
        offsets = ids.offsets.to_numpy()
        view = memoryview(np.ascontiguousarray(values)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ids read from token files."""
    return with_starts(tokens).select("doc_id", "start", "n_tokens", "ids").mapInArrow(checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")
