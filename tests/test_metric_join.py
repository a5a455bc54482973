"""Hamming pairs by a metric partition: exact, and of bounded work a row on hashes in clusters."""

import random

import pytest

from curata.operators import dedup, metric_join


def clustered(n, seed=1, size=20, spread=4, bits=63):
    """Clusters of about ``size`` hashes that differ from their centre in up to ``spread`` bits."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        centre = rng.getrandbits(bits)
        for _ in range(rng.randint(1, 2 * size)):
            h = centre
            for _ in range(rng.randint(0, spread)):
                h ^= 1 << rng.randrange(bits)
            out.append(h)
    return out[:n]


def brute(rows, r):
    return sorted((min(a, b), max(a, b), (x ^ y).bit_count()) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if a != b and (x ^ y).bit_count() <= r)


@pytest.mark.parametrize(("data", "r"), [("clusters", 6), ("one", 10), ("uniform", 8)])
def test_pairs_are_exact(spark, monkeypatch, data, r):
    """Small limits force several rounds; a dense cluster can't be cut, evenly spread hashes go by stretches or cells."""
    monkeypatch.setattr(metric_join, "LIMIT", 40)
    monkeypatch.setattr(metric_join, "TASK_PAIRS", 500)
    monkeypatch.setattr(dedup, "CELLS_FROM", 10)
    hashes = {"clusters": clustered(500), "one": clustered(260, size=10**6), "uniform": [random.Random(i).getrandbits(20) << 40 for i in range(300)]}[data]
    rows = [(i, h) for i, h in enumerate(hashes)] + [(1000 + i, h) for i, h in enumerate(hashes[:30])] + [(1000, hashes[5])]
    df = spark.createDataFrame([*rows, (7, None)], "id long, h long")
    got = dedup.hamming_pairs(df, "h", "id", r)
    assert sorted(set(tuple(x) for x in got.collect())) == sorted(set(brute(rows, r))) and got.columns == ["a", "b", "distance"]
    values = df.filter("h IS NOT NULL").select("h").distinct()
    cells, _ = metric_join.cells_of(values, r)
    near = metric_join.near_values(cells, r).collect()
    want = {(min(x, y), max(x, y)) for i, x in enumerate(set(hashes)) for y in list(set(hashes))[:i] if (x ^ y).bit_count() <= r}
    assert {(x.ha, x.hb) for x in near} == want and len(near) == len(want)
    assert metric_join.near_values(metric_join.cells_of(values.filter("false"), r)[0], r).count() == 0


def test_work_a_row_is_bounded(spark, monkeypatch):
    """Three sizes: rows of cells and pairs met grow about as the hashes in clusters do, not as their square. Where distances say
    nothing, as between evenly spread hashes, cells don't get less work, and stretches are taken."""
    monkeypatch.setattr(metric_join, "LIMIT", 300)
    rows, pairs, chosen = [], [], []
    for n in (1500, 3000, 6000):
        values = spark.createDataFrame([(h,) for h in set(clustered(n, size=150))], "h long")
        cells, _ = metric_join.cells_of(values, 4)
        found = metric_join.total_work(cells)
        rows.append(found[0] / n)
        pairs.append(found[1] / n)
        chosen.append(min(sum(found), dedup.probe_work(n, 4, 63, dedup.choose_stretches(n, 4, 63))) / n)
    assert max(pairs) < 3.2 * pairs[0] and max(rows) < 3.5 and max(chosen) < 2 * chosen[0]
    spread = spark.createDataFrame([(random.Random(i).getrandbits(63),) for i in range(3000)], "h long")
    cells, _ = metric_join.cells_of(spread, 4)
    assert sum(metric_join.total_work(cells)) > dedup.probe_work(3000, 4, 63, dedup.choose_stretches(3000, 4, 63))


@pytest.mark.parametrize("block", [70, 10**6])
def test_wide_radius_goes_by_tiles(spark, monkeypatch, block):
    """Evenly spread hashes at a wide radius are not cut into cells, whose pairs one task would compare: tiles hold two blocks each."""
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "SAMPLE", 300)
    monkeypatch.setattr(dedup, "CELLS_FROM", 10)
    monkeypatch.setattr(dedup, "cells_of", lambda *_: pytest.fail("cut into cells"))
    hashes = sorted({random.Random(i).getrandbits(63) - (i % 2 << 63) for i in range(400)})
    values = spark.createDataFrame([(h,) for h in hashes], "h long")
    near = dedup.near_hashes(values, 21)
    want = sorted((x, y, ((x ^ y) & (1 << 64) - 1).bit_count()) for i, x in enumerate(hashes) for y in hashes[i + 1 :])
    assert sorted(map(tuple, near.collect())) == [w for w in want if w[2] <= 21]
