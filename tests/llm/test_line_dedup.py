"""Line dedup against brute force over all runs of lines."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from curata.llm import line_dedup

SCHEMA = "doc_id long, text string, key string, _cut string, found int, rest string"


def in_order(rows):
    """(id, text) pairs in the operator's order."""
    return sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1]).digest()[:16]))


def runs_brute(rows):
    """(id, text, what is left) of each row, from all runs of two text lines or more that begin and end with one."""
    seen, want = set(), []
    for d, x in in_order(rows):
        lines = x.split(b"\n")
        full = [i for i, line in enumerate(lines) if line.split()]
        gone = set()
        for k, a in enumerate(full):
            for b in full[k + 1 :]:
                run = b"\n".join(lines[a : b + 1])
                if run in seen:
                    gone.update(range(a, b + 1))
                seen.add(run)
        want.append((d, x, b"\n".join(line for i, line in enumerate(lines) if i not in gone)))
    return want


def chunks_brute(rows, window, divisor, min_lines):
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    seen, want = set(), []
    for d, x in in_order(rows):
        lines = x.split(b"\n")
        hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
        ends, start = [], 0
        for i in range(len(lines)):
            value = sum(h * pow(base, k, 1 << 64) for k, h in enumerate(reversed(hashes[max(0, i + 1 - window) : i + 1]))) & mask
            value = ((value ^ (value >> 32)) * 0xD6E8FEB86659FD93) & mask
            if i + 1 - start >= min_lines and (value ^ (value >> 32)) % divisor == 0:
                ends.append(i + 1)
                start = i + 1
        if start < len(lines):
            ends[len(ends) - 1 if ends and len(lines) - start < min_lines else len(ends) :] = [len(lines)]
        gone, start = set(), 0
        for end in ends:
            chunk = lines[start:end]
            if len(chunk) >= min_lines and sum(bool(line.split()) for line in chunk) > 1:
                if b"\n".join(chunk) in seen:
                    gone.update(range(start, end))
                seen.add(b"\n".join(chunk))
            start = end
        want.append((d, x, b"\n".join(line for i, line in enumerate(lines) if i not in gone)))
    return want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passages = [[f"passage {n} line {i} {rng.random()}" for i in range(n)] for n in (2, 2, 2, 3, 3, 4, 5, 8)]
    passages.append(["over", "", "a blank", " ", "", "line"])
    fresh = lambda: [f"own {rng.random()}" for _ in range(rng.randint(0, 5))]
    out = [(100 + i, "\n".join(fresh() + rng.choice(passages) + fresh() + rng.choice(passages) + fresh())) for i in range(60)]
    copied = "\n".join(fresh() + passages[0] + ["tail"])
    out += [(7, copied), (3, copied), (3, copied), (None, copied), (None, "\n".join(passages[3])), (-(2**63), "\n".join(["x", *passages[3]])), (3, "\n".join(passages[4])), (3, "\n".join([*passages[4], "more"]))]
    out += [(1, None), (2, ""), (4, "\n\n \n"), (5, "one line"), (6, "same\n" * 6), (8, "over\n\na blank\n"), (9, "long line " * 50_000 + "\nnext"), (10, "long line " * 50_000 + "\nnext")]
    return out


@pytest.mark.parametrize("share", [2000, 3])
def test_all_runs(spark, monkeypatch, rows, share):
    monkeypatch.setattr(line_dedup, "SHARE_ROWS", share)
    df = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA).repartition(3)
    out = line_dedup.deduplicate_runs(df)
    got = out.collect()
    want = runs_brute(rows)
    assert Counter((r.doc_id, (r.text or "").encode()) for r in got) == Counter((d, left) for d, _, left in want)
    assert {(r.key, r._cut, r.found, r.rest) for r in got} == {("a", "b", 1, "c")} and out.columns[: len(df.columns)] == df.columns
    assert sum(r.n_removed_lines for r in got) == sum(x.count(b"\n") - left.count(b"\n") + (left == b"" and bool(x)) for _, x, left in want)


def test_copies_without_an_id(spark):
    """Three copies without ids keep the text once; a fourth under an id comes after them."""
    rows = [(None, "a\nb\nc")] * 3 + [(5, "a\nb\nc")] + [(6, "x\ny")] * 2
    for find in (line_dedup.deduplicate_runs, lambda d: line_dedup.deduplicate(d, divisor=1)):
        got = Counter((r.doc_id, r.text) for r in find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
        assert got[None, "a\nb\nc"] == 1 and got[6, "x\ny"] == 1 and got[5, "a\nb\nc"] == 0 and sum(got.values()) == 6


def test_sparse_chunks(spark, rows):
    want = chunks_brute(rows, line_dedup.WINDOW, line_dedup.DIVISOR, line_dedup.MIN_LINES)
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text or "").encode()) for r in got) == Counter((d, left) for d, _, left in want) and any(x != left for _, x, left in want)


def test_repeated_hashes_with_other_bytes_stay(spark, monkeypatch, rows):
    """With a hash that always collides, only chunks equal to the hash's first go."""
    find = lambda t: [(1, a, b) for _, a, b in line_dedup.text_pairs(t)]
    df = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "x\na\nb"), (4, "y\nc\nd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup._without(df, "text", find).collect()} == {1: "a\nb", 2: "c\nd", 3: "x", 4: "y\nc\nd"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicate_runs(empty).count() == line_dedup.deduplicate(empty).count() == 0
