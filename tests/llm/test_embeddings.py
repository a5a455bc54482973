"""Lattice hashing: recall against brute force at the bound itself, and the defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import blocks, embed_lattice


def planted(dim, n, low, high, seed=0):
    """Pairs whose cosines are spread evenly from low to high, and unrelated to all others."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w = rng.normal(size=(n, dim))
    w -= (w * a).sum(axis=1, keepdims=True) * a
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = np.linspace(low, high, n)[:, None]
    return a, c * a + np.sqrt(1 - c * c) * w


@pytest.mark.parametrize("setting", [embed_lattice.SETTING, *embed_lattice.FINER])
@pytest.mark.parametrize("dim", [16, 64, 384])
def test_recall_of_each_setting(setting, dim):
    a, b = planted(dim, 400, 0.9, 0.92)
    h = embed_lattice.LatticeHash(dim, *setting)
    met = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(h.cells(a), h.cells(b), strict=True)])
    assert met >= 0.9


def test_links_at_the_bound(spark):
    """Only pairs of cosine 0.9 to 0.92 link here, so nothing else can hide one that is missed."""
    a, b = planted(64, 300, 0.9 + 1e-9, 0.92)
    rows = [(i, x.tolist()) for i, x in enumerate(a)] + [(1000 + i, x.tolist()) for i, x in enumerate(b)]
    got = {r.vec_id: r for r in embed_lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.concatenate([a, b])
    truth = int((np.triu(x @ x.T, 1) >= 0.9).sum())
    assert truth >= 300 and sum(r.n_links for r in got.values()) >= 0.9 * 2 * truth
    for i in range(300):
        assert got[1000 + i].component_id in (i, 1000 + i) and got[1000 + i].kept == (got[1000 + i].n_links == 0)


@pytest.mark.parametrize("chunk", [512, 7])
def test_frequent_cells(spark, monkeypatch, chunk):
    """A tight cluster, a loose one across its cells, a repeated vector and single ones: links equal brute force but for recall."""
    monkeypatch.setattr(embed_lattice, "CHUNK_CLASSES", chunk)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=64)
    hot /= np.linalg.norm(hot)
    tight = hot + 0.02 * rng.normal(size=(120, 64))
    loose = hot + 0.045 * rng.normal(size=(60, 64))
    single = rng.normal(size=(100, 64))
    x = np.concatenate([tight, loose, single, tight[:3], tight[:1]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("cells", "key", "blocks", "core")})
    got = {r.vec_id: r for r in embed_lattice.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum() and (found[:120] >= 0.97 * links[:120]).all()
    assert all(got[i].component_id == 0 for i in range(180)) and got[283].component_id == 0


def test_defined_results(spark):
    big = [1e200] * 63
    rows = [(1, None), (2, [0.0] * 64), (3, [float("nan")] * 64), (4, [None] * 64), (5, []), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [*big, 1e200]), (9, [*big, 2e200]), (10, [*[1e-200] * 63, 1e-200]),
            (11, [float("inf")] * 64), (6, [5.0, -1.0]), (None, [1.0, 2.1]), (20, [1.0, 0.0, 0.0]), (21, [0.9, 0.19**0.5, 0.0]), (None, [0.0, 0.0, 7.0]), (None, [0.0, 0.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed_lattice.near_duplicates(df).collect()
    by = {r.vec_id: r for r in got if r.vec_id not in (6, None)}
    assert len(got) == len(rows)
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3, 4, 5, 11))
    assert by[9].component_id == 8 and by[10].component_id == 8 and by[8].n_links == 2
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id == 6) == [(0, 6), (2, 6)] and by[7].component_id == 6
    assert sorted(((r.n_links, r.component_id) for r in got if r.vec_id is None), key=str) == [(1, None), (1, None), (2, 6)]
    assert embed_lattice.near_duplicates(df.limit(0)).count() == 0


def test_finer_settings_have_smaller_cells():
    meets = []
    for setting in (embed_lattice.SETTING, *embed_lattice.FINER):
        h = embed_lattice.LatticeHash(64, *setting)
        x = np.random.default_rng(3).normal(size=(1500, 64))
        cells = h.cells(x / np.linalg.norm(x, axis=1, keepdims=True)).ravel()
        count = np.unique(cells, return_counts=True)[1]
        meets.append((count * (count - 1)).sum() / (1500 * 1499))
    assert meets == sorted(meets, reverse=True) and meets[0] < 1e-3


def test_tile_pairs_of_cores_are_left_out():
    import pyarrow as pa

    table = pa.table({"block": [5, 5, 5, 5], "i": [0, 0, 0, 0], "j": [0, 0, 0, 0], "chunk": [0, 0, 0, 0], "cid": [1, 2, 3, 4], "core": [9, 9, -1, -1], "blocks": [[3, 5], [5], [3, 5], [5]]})
    table = table.set_column(6, "blocks", pa.array(table.column("blocks").to_pylist(), pa.list_(pa.int64())))
    got = blocks.Tile(table).pairs(0, 4)
    # 1-2 are of one core, 1-3 share block 3 as well
    assert [tuple(p) for p in np.argwhere(got)] == [(0, 3), (1, 2), (1, 3), (2, 3)]
