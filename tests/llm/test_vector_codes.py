"""Vector codes against a plain form that compares all entries in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from curata.llm import vector_codes
from curata.llm.queries import op12_vector_codes

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))  # noqa: E731, B905
    nearest = lambda book, x: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(book, cut(v, p))[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(book)]  # noqa: B905
    out = []
    for i, v, lab in kept:
        best = [nearest(books[p], cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), lab))
    totals = {}
    for _, _, error, lab in out:
        totals[lab] = totals.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, c, e, totals[lab]) for i, c, e, lab in out], digest


def vectors(n, dims, seed=0, wide=1.0):
    rng = random.Random(seed)
    near = [[rng.uniform(-wide, wide) for _ in range(dims)] for _ in range(9)]
    return [(i if i % 11 else None if i % 2 else 7, [round(x + rng.choice([0, 0, 0.01, -0.02]) * wide, 2) for x in rng.choice(near)], rng.choice([None, 1, 2])) for i in range(n)]


def check(spark, tmp_path, rows, schema=ROWS, table="in"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    df.selectExpr("*", "1 AS id", "'x' AS v", "2 AS code", "3 AS error", "4 AS label_error").write.parquet(str(tmp_path / table / "embeddings.parquet"))
    got = op12_vector_codes(spark, str(tmp_path / table)).collect()
    want, digest = plain(rows)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} <= {digest}


@pytest.mark.parametrize(("n", "dims"), [(150, 32), (40, 16), (90, 0)])
def test_codes_equal_plain_form(spark, tmp_path, n, dims):
    bad = [(900, None, 1), (901, [None] * dims if dims else None, 1), (902, [math.inf] * dims if dims else None, 2), (903, [math.nan] * dims if dims else None, 2)]
    check(spark, tmp_path, vectors(n, dims) + bad)


def test_large_components_and_empty_table(spark, tmp_path):
    check(spark, tmp_path, vectors(70, 16, wide=3e6), table="large")
    check(spark, tmp_path, [], table="empty")
    check(spark, tmp_path, [(1, None, 1)], table="null")


def test_unequal_lengths_are_told(spark, tmp_path):
    for rows, said in (([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], "components"), ([(1, [1.0] * 10, 1)], "divide")):
        df = spark.createDataFrame(rows, ROWS)
        with pytest.raises(Exception, match=said):
            vector_codes.compress(df)[0].collect()


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        book = rng.integers(-300, 300, (64, 4)) * rng.integers(0, 2)
        parts = np.concatenate([rng.integers(-300, 300, (50, 4)), book[:5], -book[:5]])
        index, squared, widths = vector_codes.AnnularSearch(book).nearest(parts)
        all_squared = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == all_squared.argmin(axis=1)).all() and (squared == all_squared.min(axis=1)).all()
    book = rng.integers(-3000, 3000, (64, 1))
    assert vector_codes.AnnularSearch(book).nearest(rng.integers(-3000, 3000, (500, 1)))[2].mean() < 16


def test_decode_is_within_the_error(spark):
    rows = [(i, v, lab) for i, (_, v, lab) in enumerate(vectors(100, 16))]
    df = spark.createDataFrame(rows, ROWS)
    coded, books = vector_codes.compress(df)
    given = {i: np.floor(np.float32(v).astype(float) * 256) for i, v, _ in rows}
    for r in vector_codes.decode(coded, books).collect():
        assert round(((np.array(r.v) * 256 - given[r.id]) ** 2).sum()) == r.error and len(r.code) == 16
