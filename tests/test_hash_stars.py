"""Star clusters of hashes without a list of their pairs, and one tile a task where pairs are listed."""

import random

import pytest
from pyspark.sql import functions as F

from curata.operators import dedup, metric_join
from curata.plans import curation


def plain(rows, r):
    """Ids in order: a free one is an anchor and takes its free neighbours."""
    own, taken = {}, {}
    for i, h in set(rows):
        if i is not None and h is not None:
            own.setdefault(i, []).append(h)
    for x in sorted(own):
        if x not in taken:
            taken.update({y: x for y in own if y not in taken and (y == x or any(((a ^ b) & (1 << 64) - 1).bit_count() <= r for a in own[x] for b in own[y]))})
    return sorted((i, a) for i, a in taken.items() if list(taken.values()).count(a) > 1)


def made(kind):
    """Near hashes of both signs, copies, an id with several hashes, a row twice, nulls."""
    rng = random.Random(3)
    hashes = []
    while len(hashes) < 240:
        centre = rng.getrandbits(63)
        for _ in range({"dense": 40, "sparse": 2}[kind]):
            h = centre
            for _ in range(4):
                h ^= 1 << rng.randrange(63)
            hashes.append(h)
    hashes = [h if i % 3 else ~h for i, h in enumerate(hashes)]
    ids = rng.sample(range(10_000), len(hashes) + 60)
    rows = list(zip(ids, [*hashes, *hashes[5:35], *[hashes[7]] * 30], strict=True))
    return [*rows, (ids[0], hashes[50]), (ids[9], hashes[7]), (ids[9], hashes[100]), rows[3], (10_001, None), (None, hashes[3])]


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_stars_equal_the_plain_form(spark, monkeypatch, kind, text):
    """Small limits force several rounds; in sparse rows the rest goes by its pairs."""
    monkeypatch.setattr(dedup, "PREFIX", 20)
    monkeypatch.setattr(metric_join, "BLOCK", 70)
    monkeypatch.setattr(metric_join, "NEAR_CHUNK", 300)
    listed, real = [], dedup.hamming_pairs
    monkeypatch.setattr(dedup, "hamming_pairs", lambda *a, **k: (listed.append(1), real(*a, **k))[1])
    rows = [(None if i is None else f"{i:05d}" if text else i, h) for i, h in made(kind)]
    got = dedup.hash_stars(spark.createDataFrame(rows, f"id {'string' if text else 'long'}, h long"), "h", "id", 9)
    assert sorted(map(tuple, got.collect())) == plain(rows, 9) and got.columns == ["id", "anchor"]
    assert bool(listed) == (kind == "sparse")


def test_no_rows(spark):
    assert dedup.hash_stars(spark.createDataFrame([(1, None)], "id long, h long"), "h", "id", 9).count() == 0


def test_query_lists_no_pairs_of_copies(spark, monkeypatch, tmp_path):
    """3000 copies of a vector are 4.5 million pairs, but 3000 rows."""
    monkeypatch.setattr(dedup, "hamming_pairs", lambda *_, **__: pytest.fail("pairs are listed"))
    vector = [float(i * 37 % 64) for i in range(64)]
    spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, vector)).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = curation.star_clusters(spark, str(tmp_path))
    assert got.filter("anchor = 0").count() == got.count() == 3000


def test_a_task_has_one_tile(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 50)
    values = spark.createDataFrame([(random.Random(i).getrandbits(63),) for i in range(400)], "h long")
    near = metric_join.tiled_values(values, 400, 63)
    each = near.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(each) == 36 and sum(r["count"] for r in each) == 400 * 399 // 2
