"""Exact dedup: the filter, the index through insertions and deletions, and decisions against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from curata.llm import exact_dedup
from curata.llm.exact_dedup import Bucket, CuckooFilter

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256((text or "").encode()).digest()


def awkward(n=400, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "a", "b " * 3, "ß́ é", "x" * 300_000, *[f"text {i}" for i in range(150)]]
    rows = [(rng.choice([None, rng.randrange(300), 2**60 + rng.randrange(3)]), rng.choice(texts)) for _ in range(n)]
    return rows + [(5, "tie")] * 3 + [(None, "no id")] * 4 + [(i, "hot") for i in range(n // 2)]


def decided(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, kept = max(known) if known else None, False
        for i in ids:
            out.append((i, sha(text).hex(), keep, len(ids), i == keep and not kept))
            kept |= i == keep
    return Counter(out)


def found(df):
    return Counter((r.doc_id, bytes(r.digest).hex(), r.keep_id, r.group_size, r.kept) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_decisions_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 1000)
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS).repartition(parts).selectExpr("*", "1 AS digest", "'x' AS bucket", "2 AS n", "3 AS keep_id", "4 AS kept")
    assert found(exact_dedup.decisions(docs, exact_dedup.insert(docs, buckets=5))) == decided(rows)
    assert found(exact_dedup.decisions(docs, exact_dedup.insert(docs))) == decided(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.decisions(docs, exact_dedup.insert(docs)).count() == 0


def test_insertions_and_deletions(spark):
    """After any order of updates the index holds what a dictionary holds, and its filters find each live digest."""
    rng = random.Random(2)
    live, index = {}, None
    for round_ in range(5):
        rows = [(rng.randrange(10_000), f"text {rng.randrange(300)}") for _ in range(150)]
        index = exact_dedup.insert(spark.createDataFrame(rows, DOCS).repartition(3), index, buckets=3)
        for doc_id, text in rows:
            n, keep = live.get(text, (0, -1))
            live[text] = (n + 1, max(keep, doc_id))
        gone = [(None, f"text {rng.randrange(400)}") for _ in range(60)] + [(1, None)]
        index = exact_dedup.delete(spark.createDataFrame(gone, DOCS), index)
        for _, text in gone:
            live.pop(text, None)
        got = {bytes(r.text).decode(): (r.n, r.keep_id, bytes(r.digest)) for r in exact_dedup.live(spark, index).collect()}
        assert got == {t: (*v, sha(t)) for t, v in live.items()}
    filters = exact_dedup.load(spark, index).filter("kind = 0").collect()
    held = [d for r in filters for d in (bytes(r["keys"])[i : i + 32] for i in range(0, len(r["keys"]), 32))]
    assert sorted(held) == sorted(map(sha, live))
    assert all(any(sha(t) in CuckooFilter(cells=bytes(r.cells)) for r in filters) for t in live)
    assert exact_dedup.buckets_of(spark, index) == 3


def test_filter_grows_and_forgets():
    digests = [sha(f"{i}") for i in range(5000)]
    bucket = Bucket()
    for i, d in enumerate(digests):
        bucket.arrive(d, b"%d" % i, 1, i)
    assert bucket.filter.slots >= 5000 / 4 and all(d in bucket.filter for d in digests)
    for d in digests[:4000]:
        bucket.remove(d)
    assert all(d in bucket.filter for d in digests[4000:])
    assert sum(d in bucket.filter for d in digests[:4000]) < 40  # false hits only
    assert sum(1 for x in bucket.filter.cells if x) == 1000


def test_hits_are_verified():
    """Digests of one fingerprint and slot stay apart; unequal texts under one digest stop the job."""
    one, two = bytes(32), bytes(10) + b"\1" * 22
    filt = CuckooFilter()
    assert filt.insert(one) and two in filt
    bucket = Bucket()
    bucket.arrive(one, b"a", 1, 1)
    bucket.arrive(two, b"b", 1, 2)
    bucket.arrive(one, b"a", 2, None)
    assert {d: tuple(e) for d, e in bucket.fresh.items()} == {one: (b"a", 3, 1), two: (b"b", 1, 2)}
    with pytest.raises(ValueError, match="unequal texts"):
        bucket.arrive(one, b"c", 1, 3)
    # more digests of one slot than its cells hold grow the filter until their own bits part them
    many = [i.to_bytes(8, "little") + b"\7\0" + bytes(22) for i in range(0, 64 * 1024, 1024)]
    grown = CuckooFilter.filled(16, many)
    assert all(d in grown for d in many) and grown.slots > 1024
