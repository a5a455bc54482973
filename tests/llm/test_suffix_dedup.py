"""Suffix-array dedup against brute force over all windows of all texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from curata.llm import suffix_dedup


def brute(rows, length):
    seen = Counter(x[i : i + length] for _, x in rows for i in range(len(x) - length + 1))
    want = []
    for d, x in rows:
        hit = np.zeros(len(x) + 1, dtype=bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                hit[i : i + length] = True
        want.append((d, len(x), int(hit.sum()), int((hit[1:] > hit[:-1]).sum() + hit[0]), bytes(c for c, h in zip(x, hit, strict=False) if not h)))
    return Counter(want)


def same_crc(first: bytes, second: bytes) -> tuple[bytes, bytes]:
    """Both with an ending each that gives them one crc32."""
    rng = random.Random(5)
    tail = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)).encode()
    ends = {zlib.crc32(t, zlib.crc32(second)): t for t in (tail() for _ in range(1 << 17))}
    for _ in range(1 << 20):
        whole = first + tail()
        if zlib.crc32(whole) in ends:
            return whole, second + ends[zlib.crc32(whole)]
    raise AssertionError("no clash")


def rows_of_texts():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    passages = [text(260), text(205), text(700), text(199)]
    rows = [(None if i % 7 == 0 else i, text(rng.randint(0, 500)) + rng.choice(passages) + text(rng.randint(0, 300))) for i in range(250)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (8, None), (8, ""), (-(2**63), passages[0]), (None, "a" * 900), (5, "é" * 300 + passages[1]), (10, passages[2] * 3), (11, text(199))]
    # two texts of equal crc32 share a passage with a third, under one id and under null ids
    one, two = same_crc((text(30) + passages[0]).encode(), (text(40) + passages[0]).encode())
    return rows + [(900, one.decode()), (900, two.decode()), (None, one.decode()[1:]), (None, two.decode()[1:])]


@pytest.mark.parametrize(("group_kinds", "share_rows", "held"), [(2000, 2000, 50_000), (5, 3, 2)])
def test_production_lengths(spark, monkeypatch, group_kinds, share_rows, held):
    monkeypatch.setattr(suffix_dedup, "GROUP_KINDS", group_kinds)
    monkeypatch.setattr(suffix_dedup, "SHARE_ROWS", share_rows)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "HELD_TEXT", 16 << 20 if held > 2 else 2000)
    rows = rows_of_texts()
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "doc_id long, text string, key string, text_id string, copies int").repartition(5)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate(df).collect())
    assert got == brute([(d, (t or "").encode()) for d, t in rows], 200)


def test_texts_longer_than_a_slice(spark):
    """Repeats on both sides of the boundary between slices, and across it."""
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, suffix_dedup.SLICE + 5000).astype(np.uint8).tobytes()
    edge = suffix_dedup.SLICE
    rows = [(1, body), (2, body[edge - 300 : edge + 300]), (3, b"x" + body[-250:]), (4, body[edge - 100 : edge + 99])]
    out = {r.doc_id: r for r in suffix_dedup.deduplicate(spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string")).collect()}
    assert (out[1].n_removed, out[1].n_spans) == (850, 2) and bytes(out[1].kept) == body[: edge - 300] + body[edge + 300 : -250]
    assert bytes(out[2].kept) == b"" and bytes(out[3].kept) == b"x" and out[4].n_removed == 0


def test_empty_and_short(spark):
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = suffix_dedup.deduplicate(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [(r.n_bytes, r.n_removed, bytes(r.kept)) for r in out] == [(0, 0, b"")] * 2


def test_copies_are_compared():
    """Copies come together within a partition and over partitions; two texts under one key stop the job."""
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "copies", "text"])
    rows = [(b"k", 1, b"text"), (b"l", 1, b"other"), (b"k", 1, b"text")]
    for find, want in ((suffix_dedup._partition_texts, {b"k": 2, b"l": 1}), (suffix_dedup._equal_texts, {b"k": 2, b"l": 1})):
        given = sorted(rows) if find is suffix_dedup._equal_texts else rows
        assert {r["key"]: r["copies"] for b in find([batch(*given[:1]), batch(*given[1:])]) for r in b.to_pylist()} == want
        with pytest.raises(ValueError, match="unequal texts"):
            list(find([batch((b"k", 1, b"text"), (b"k", 1, b"TEXT"))]))
