"""WARC archives with a two-level capture index.

Writing: each task writes its records, a gzip member each, to an archive file of its own in
the shared folder, behind a warcinfo record, and returns where each record lies. Of records with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the smallest page id is a response, the others
are revisit records without the payload that refer to it. Which they are comes from a grouping of digests,
so payloads meet only on their own page id.

Index: capture lines are sorted by reversed-host key (a range partitioning, then a sort in
each range) and compressed in blocks of ``BLOCK_LINES`` lines. Beside its blocks each range writes a sparse directory: the
first and last key of each block and where it lies, sorted, with the entries' offsets at the end of the file. The index
itself is a table of one row a range (its first and last key and its files).

``lookup`` takes a table of keys. A task bisects the index's rows, binary-searches the directory of a range by reading single
entries at their offsets, and so finds the blocks of a key; those byte ranges are read, each once, and the lines of wanted
keys are returned. ``read_records`` reads the records' ranges, ``resolve`` gives revisits the payload they refer to.
Blocks are dealt over tasks by place, so a key of very many captures is no one task's work.

Files are named by task attempt, and only files named in a committed table are ever read, so
a task that is run again leaves at most an orphan.

Defined results: null html is an empty payload; a null url has an empty key and no target
URI; a null page id is kept as null and never refers or is referred to; rows that repeat a
page id and payload are all of the same type; keys that tie are in order of page id and place; a very long page is one
record; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import datetime
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import only, partitions
from curata.session import filesystem, materialize, qualified, shared_dir

REVISIT_BYTES = 100
BLOCK_LINES = 2000
#: Archive files end after this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
COMPRESSION = 4

CAPTURES = "key string, page_id long, record_type string, archive string, at long, length long"
INDEX = "first_key string, last_key string, file string, directory string, directory_bytes long, n_blocks int, n_lines long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def surt(url: Column) -> Column:
    """The reversed-host key of a URL: lower-case host parts in reverse, then path and query; no scheme, user, port of
    the scheme, leading www or fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    authority = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^[^@]*@", "")), r"^www\d*\.|:(80|443)$", "")
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", F.lit("/")).otherwise(tail)))


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def _join(head: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", *head, f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def warcinfo(name: str, date: str) -> bytes:
    fields = b"software: curata\r\nformat: WARC File Format 1.1\r\n"
    return _join(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], fields)


def record(page_id, url, kind: str, refers_to: tuple | None, digest: str, payload: bytes, date: str, info: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone, whose Content-Length is that of the full payload;
    ``refers_to`` is the page id and URL of its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if info:
        head.append(f"WARC-Warcinfo-ID: {info}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(*refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {refers_to[0]}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_to[1])}")
    return _join(head, http if kind == "revisit" else http + payload)


def parse(data: bytes) -> dict:
    """The fields of ``RECORDS`` from one uncompressed record."""
    end = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    body = block.index(b"\r\n\r\n") + 4
    full = int(re.search(rb"Content-Length: (\d+)", block[:body])[1])
    number = lambda name: int(fields[name]) if name in fields else None
    kind = fields["WARC-Type"]
    payload = None if kind == "revisit" else block[body:]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    damaged = hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:")
    if damaged or payload is not None and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {number('WARC-Page-ID')}")
    return {"page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload_digest": digest, "payload_bytes": full, "payload": payload}


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the pages that are revisits, one row for each pair."""
    sized = pages.filter((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    pairs = sized.select("page_id", "digest").distinct()
    # written, so that AQE can split a payload of very many pages
    first = sized.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).filter("first.page_id < last")
    first = materialize(first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "repeated")
    return pairs.join(first, "digest").filter(F.col("page_id") != F.col("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: datetime.datetime | None = None) -> DataFrame:
    """Writes (page_id, url, html) as archives under ``folder``, dated now or as given; returns the rows of ``CAPTURES``."""
    stamp = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "key": surt(F.col("url"))})
    marked = rows.join(record_types(rows), ["page_id", "digest"], "left")

    def write(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        out, name, at, info = None, "", 0, ""
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    head = gzip.compress(warcinfo(name, stamp), COMPRESSION, mtime=0)
                    out.write(head)
                    at, info = len(head), record_id(name)
                kind = "response" if row["refers_to"] is None else "revisit"
                of = None if row["refers_to"] is None else (row["refers_to"], row["refers_url"])
                data = gzip.compress(record(row["page_id"], row["url"], kind, of, row["digest"], row["payload"], stamp, info), COMPRESSION, mtime=0)
                out.write(data)
                for col, value in zip(cols, (row["key"], row["page_id"], kind, name, at, len(data)), strict=True):
                    col.append(value)
                at += len(data)
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "page_id", "record_type", "archive", "at", "length"])
        if out:
            out.close()

    return materialize(marked.mapInArrow(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted capture lines as compressed blocks, and a sparse directory for each range of keys, under ``folder``;
    returns the rows of ``INDEX``."""
    spark = captures.sparkSession
    ordered = captures.repartitionByRange(partitions(spark), "key", "page_id", "archive", "at").sortWithinPartitions("key", "page_id", "archive", "at")

    def write(batches):
        import numpy as np
        import pyarrow as pa

        fs, base = filesystem(folder)
        name, at, out = f"part-{uuid.uuid4().hex}", 0, None
        lines: list[str] = []
        keys: list[str] = []
        entries: list[bytes] = []
        span: list = [None, None, 0]

        def close_block():
            nonlocal at
            data = gzip.compress("\n".join(lines).encode(), mtime=0)
            out.write(data)
            entries.append(json.dumps([keys[0], keys[-1], at, len(data)]).encode())
            at += len(data)
            span[:] = [keys[0] if span[0] is None else span[0], keys[-1], span[2] + len(lines)]
            lines.clear()
            keys.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                keys.append(row["key"])
                lines.append(json.dumps([row["key"], row["page_id"], row["record_type"], row["archive"], row["at"], row["length"]]))
                if len(lines) == block_lines:
                    close_block()
        if lines:
            close_block()
        if not out:
            return
        out.close()
        data = b"".join(entries)
        offsets = np.cumsum([0, *map(len, entries)]).astype("<u8").tobytes()
        with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as directory:
            directory.write(data + offsets)
        values = (span[0], span[1], f"{name}.cdx.gz", f"{name}.dir", len(data), len(entries), span[2])
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    return materialize(ordered.mapInArrow(write, INDEX), "index")


class Directory:
    """The sparse directory of one range, read an entry at a time. ``read(at, length)`` reads bytes of its file."""

    def __init__(self, read: Callable[[int, int], bytes], n_bytes: int, n_blocks: int):
        self.read, self.n_bytes, self.n_blocks = read, n_bytes, n_blocks
        self.known: dict[int, tuple] = {}

    def entry(self, i: int) -> tuple[str, str, int, int]:
        """(first key, last key, place, length) of block i."""
        if i not in self.known:
            where = self.read(self.n_bytes + 8 * i, 16)
            a, b = int.from_bytes(where[:8], "little"), int.from_bytes(where[8:], "little")
            self.known[i] = tuple(json.loads(self.read(a, b - a)))
        return self.known[i]

    def blocks(self, key: str):
        """(place, length) of the blocks that span the key: a binary search for the first, then those after it."""
        i = bisect.bisect_left(range(self.n_blocks), key, key=lambda i: self.entry(i)[1])
        while i < self.n_blocks and self.entry(i)[0] <= key:
            yield self.entry(i)[2:]
            i += 1


def find_blocks(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(file, at, length, key): the blocks that may hold captures of the keys, a table of ``key``."""
    ranges = sorted(tuple(r) for r in index.select("first_key", "last_key", "file", "directory", "directory_bytes", "n_blocks").collect())  # a row a range: at most the number of partitions

    def find(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        held: list = [None, None, None]
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for key in batch.column("key").to_pylist():
                at = bisect.bisect_left(ranges, key, key=lambda r: r[1])
                while at < len(ranges) and ranges[at][0] <= key:
                    _, _, file, directory, n_bytes, n_blocks = ranges[at]
                    if held[0] != directory:
                        if held[1]:
                            held[1].close()
                        source = fs.open_input_file(f"{base}/{directory}")
                        held = [directory, source, Directory(lambda a, n, source=source: source.read_at(n, a), n_bytes, n_blocks)]
                    for place, length in held[2].blocks(key):
                        for col, value in zip(cols, (file, place, length, key), strict=True):
                            col.append(value)
                    at += 1
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "at", "length", "key"])
        if held[1]:
            held[1].close()

    # sorted keys stay in one directory for long
    wanted = keys.filter("key IS NOT NULL").select("key").distinct()
    return wanted.repartitionByRange(partitions(keys.sparkSession), "key").sortWithinPartitions("key").mapInArrow(find, "file string, at long, length long, key string")


def block_lines(fs, base: str, file: str, at: int, length: int) -> list[list]:
    with fs.open_input_file(f"{base}/{file}") as f:
        return [json.loads(line) for line in gzip.decompress(f.read_at(length, at)).decode().split("\n")]


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The capture lines of a table of reversed-host keys (``key``): blocks are found in the directories, and read once each."""

    def read(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            for row in batch.to_pylist():
                lines, found = block_lines(fs, base, row["file"], row["at"], row["length"]), []
                in_order = [line[0] for line in lines]
                for key in row["keys"]:
                    found += lines[bisect.bisect_left(in_order, key) : bisect.bisect_right(in_order, key)]
                cols = list(zip(*found, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in CAPTURES.split(", ")])

    blocks = find_blocks(keys, index, folder).groupBy("file", "at", "length").agg(F.collect_set("key").alias("keys"))
    return blocks.mapInArrow(read, CAPTURES)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of capture lines, read by byte range, in order of their place in an archive."""

    def read(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        name, source = None, None
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            found, size = [], 0
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if source:
                        source.close()
                    name = row["archive"]
                    source = fs.open_input_file(f"{base}/{name}")
                found.append(tuple(parse(zlib.decompress(source.read_at(row["length"], row["at"]), wbits=31)).values()))
                size += len(found[-1][-1] or b"")
                if size > 8 << 20:
                    yield _records(found, types)
                    found, size = [], 0
            if found:
                yield _records(found, types)
        if source:
            source.close()

    spark = captures.sparkSession
    # a stretch of an archive is a task's work, so that a large archive is read by many
    dealt = captures.repartition(partitions(spark), "archive", F.floor(F.col("at") / (8 << 20))).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(read, RECORDS)


def _records(found: list[tuple], types):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])


def resolve(records: DataFrame) -> DataFrame:
    """``RECORDS`` with the payload of each revisit taken from the response it refers to."""
    responses = records.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("payload").alias("full")).dropDuplicates(["of", "of_digest"])
    met = records.join(responses, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return met.withColumn("payload", F.coalesce("payload", "full")).select(records.columns)


def archive(pages: DataFrame, folder: str | None = None, date: datetime.datetime | None = None) -> tuple[DataFrame, str]:
    """Writes archives and index for (page_id, url, html); returns the index and the folder."""
    folder = qualified(pages.sparkSession, folder) if folder else shared_dir(pages.sparkSession, "warc")
    return write_index(write_archives(pages, folder, date), folder), folder


def read_archive(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The records of a table of reversed-host keys (``key``), by way of the index."""
    return read_records(lookup(keys, index, folder), folder)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> f THEN f END AS refers_to
FROM f"""

