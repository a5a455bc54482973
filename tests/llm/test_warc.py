"""WARC archives and their two-level index."""

import datetime
import gzip
import hashlib
import json
import math

import pytest

from curata.llm import warc

DATE = "2026-01-02T03:04:05Z"


def test_record_round_trip():
    data = warc.record(7, "http://a/b", "response", None, hashlib.sha256(b"x\r\n\r\ny").hexdigest(), b"x\r\n\r\ny", DATE)
    r = warc.parse(data)
    assert r["payload"] == b"x\r\n\r\ny" and r["page_id"] == 7 and r["payload_bytes"] == 6
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"\r\n\r\ny", b"\r\n\r\nz"))


def test_directory_is_searched_by_single_reads():
    entries = [(f"k{2 * i:05d}", f"k{2 * i + 1:05d}", 100 * i, 100) for i in range(1000)]
    lines = [json.dumps(e).encode() for e in entries]
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line))
    data = b"".join(lines) + b"".join(o.to_bytes(8, "little") for o in offsets)
    reads = []
    read = lambda at, n: reads.append(n) or data[at : at + n]
    for key, want in (("k01000", [(50_000, 100)]), ("k01001", [(50_000, 100)]), ("k00000", [(0, 100)]), ("k01999", [(99_900, 100)]), ("a", []), ("z", []), ("k00000x", [(0, 100)])):
        reads.clear()
        assert list(warc.Directory(read, offsets[-1], len(entries)).blocks(key)) == want
        # two reads an entry: about log2(1000) entries, and the one after the last that fits
        assert len(reads) <= 2 * (math.ceil(math.log2(len(entries))) + 2)


ROWS = [
    (3, "https://www.B.example.org:443/p?q=1#f", "<p>" + "x" * 200),
    (1, "http://a.example.org/", "<p>" + "x" * 200),
    (2, None, None),
    (4, "http://a.example.org/", "tiny"),
    (5, "http://c.d/é", "tiny"),
    (6, "http://a.example.org/", "ü" * 80),
    (7, "x", "<p>" + "x" * 200),
    (7, "x", "<p>" + "x" * 200),
    (1, "http://second.example.org/", "<p>" + "x" * 200),
    (None, "y", "<p>" + "x" * 200),
    (9, "http://long/", "z" * 3_000_000),
    *((100 + i, "http://hot.example.org/", f"page {i}") for i in range(40)),
]


@pytest.fixture(scope="module")
def archived(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, digest string, key string")
    captures = warc.write_archives(df, folder := warc.shared_dir(spark, "warc"), datetime.datetime(2026, 1, 2, 3, 4, 5))
    # blocks of three lines: a frequent key spans several blocks, and ranges
    return warc.write_index(captures, folder, 3), folder, df.select(warc.surt(df["url"]).alias("key"))


def test_archive(archived):
    index, folder, keys = archived
    records = warc.read_archive(keys, index, folder).cache()
    got = records.collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in got) == sorted((i or 0, len((h or "").encode())) for i, _, h in ROWS)
    refers = {r.page_id: r.refers_to for r in got}
    assert [refers[i] for i in (1, 2, 3, 4, 5, 6, 7, None)] == [None, None, 1, None, None, None, 1, None]
    full = {(r.page_id, bytes(r.payload).decode()) for r in warc.resolve(records).collect()}
    assert full == {(i, h or "") for i, _, h in ROWS}


def test_lookup(spark, archived):
    index, folder, _ = archived
    find = lambda *keys: sorted(r.page_id for r in warc.lookup(spark.createDataFrame([(k,) for k in keys], "key string"), index, folder).collect())
    assert find("org,example,a)/") == [1, 4, 6] and find("org,example,b)/p?q=1") == [3] and find("zz", "0", "org,example") == []
    assert find("org,example,hot)/") == list(range(100, 140)) and find("org,example,hot)/", "", "long)/") == [2, 9, *range(100, 140)]
    places = warc.find_blocks(spark.createDataFrame([("org,example,a)/",)], "key string"), index, folder).count()
    assert places <= 2 and index.agg({"n_blocks": "sum"}).first()[0] > 15


def test_archives_begin_with_warcinfo(archived):
    index, folder, _ = archived
    import glob

    files = glob.glob(f"{folder.removeprefix('file:')}/*.warc.gz")
    texts = [gzip.open(f).read() for f in files]
    assert texts and all(t.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for t in texts)
    whole = b"".join(texts)
    assert whole.count(b"WARC-Refers-To: <urn") == 3 and b"WARC-Date: 2026-01-02T03:04:05Z" in whole
    response = warc.record_id(1, "http://a.example.org/", hashlib.sha256(ROWS[0][2].encode()).hexdigest()).encode()
    assert whole.count(b"WARC-Refers-To: " + response) == 3 and whole.count(b"WARC-Record-ID: " + response) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    index, folder = warc.archive(empty)
    assert warc.read_archive(empty.select(warc.surt(empty["url"]).alias("key")), index, folder).count() == 0
