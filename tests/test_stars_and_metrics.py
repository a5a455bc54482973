"""Star clusters in few rounds, and metrics whose groups may be null or of any size, against plain forms."""

import random

import pytest

from curata.operators import boxes, dedup, metrics, splits


def plain_stars(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    taken, out = {}, {}
    for x in sorted(near):
        if x in taken:
            continue
        mine = [y for y in near[x] if y > x and y not in taken]
        taken[x] = x
        for y in mine:
            taken[y] = x
    for x, anchor in taken.items():
        if list(taken.values()).count(anchor) > 1:
            out[x] = anchor
    return out


def rounds_of(monkeypatch):
    """Counts the rounds: each materialises its anchors once."""
    seen, real = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name, **o: (seen.append(name), real(df, name, **o))[1])
    return lambda: seen.count("anchors")


@pytest.mark.parametrize("links", [1_000_000, 900])
def test_long_chain_in_few_rounds(spark, monkeypatch, links):
    """A chain in order of its ids, by one task or in steps of 900 links."""
    monkeypatch.setattr(dedup, "TASK_LINKS", links)
    count = rounds_of(monkeypatch)
    pairs = [(i, i + 1) for i in range(2000)]
    got = {r.id: r.anchor for r in dedup.star_clusters(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i - i % 2 for i in range(2000)} and count() <= 20
    assert got == plain_stars(pairs)


@pytest.mark.parametrize("links", [1_000_000, 60])
def test_stars_equal_the_sequential_form(spark, monkeypatch, links):
    monkeypatch.setattr(dedup, "TASK_LINKS", links)
    rng = random.Random(links)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(160)] + [(i, i + 1) for i in range(200, 260)] + [(300, x) for x in range(301, 340)] + [(2**60, 2**60 + 1), (5, 5), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.anchor for r in dedup.star_clusters(df).collect()}
    assert got == plain_stars([p for p in pairs if None not in p])
    assert dedup.star_clusters(df.filter("false")).count() == 0


def test_latency_keeps_null_groups(spark):
    rows = [("a", float(i)) for i in range(1, 2001)] + [(None, 5.0), (None, 7.0), ("empty", None)]
    got = {r.k: tuple(r)[1:] for r in metrics.latency(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    assert got == {"a": (1000.0, 1900.0, 1000.5, 2000.0), None: (5.0, 5.0, 6.0, 7.0), "empty": (None, None, None, None)}


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_percentile_floor_is_exact(spark, n):
    rng = random.Random(n)
    values = sorted(rng.choice([0.5, rng.random()]) for _ in range(n))
    for p in (0.0, 0.05, 0.5, 1.0):
        at = (n - 1) * p
        low, high = values[int(at)], values[min(int(at) + 1, n - 1)]
        (row,) = metrics.percentile_floor(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", p, 0.0).collect()
        assert row.threshold == pytest.approx(low + (at - int(at)) * (high - low)) and row.n == n
    (none,) = metrics.percentile_floor(spark.createDataFrame([(None,)], "v double"), "v").collect()
    assert none.n == 0


def test_areas_of_continuous_scores(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() if g != "ties" else rng.randrange(3) / 2, rng.random() < 0.3) for g in ("x", "ties", None) for _ in range(300)] + [("no", 0.5, False)]
    df = spark.createDataFrame(rows, "g string, s double, p boolean")
    roc = {r.g: r.auc for r in metrics.roc_auc(df, "s", "p", "g").collect()}
    pr = {r.g: r.auc for r in metrics.pr_auc(df, "s", "p", "g").collect()}
    for g in ("x", "ties", None):
        pos, neg = [[s for k, s, p in rows if k == g and p is v] for v in (True, False)]
        assert roc[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        area, before, tp, fp = 0.0, 1.0, 0, 0
        for s in sorted({s for k, s, _ in rows if k == g}, reverse=True):
            new = pos.count(s)
            tp, fp = tp + new, fp + neg.count(s)
            area += new / len(pos) * (tp / (tp + fp) + before) / 2
            before = tp / (tp + fp)
        assert pr[g] == pytest.approx(area)
    assert roc["no"] == 0.0 and pr["no"] == 0.0


def test_average_precision_of_continuous_scores(spark):
    rng = random.Random(2)
    rows = [("c", rng.random(), rng.random() < 0.5) for _ in range(400)]
    (got,) = metrics.average_precision(spark.createDataFrame(rows, "class_name string, confidence double, is_tp boolean"), spark.createDataFrame([("c", 300)], "class_name string, n long")).collect()
    ranked, tp, points = sorted(rows, key=lambda r: -r[1]), 0, []
    for k, r in enumerate(ranked, 1):
        tp += r[2]
        points.append((r[2], tp / k))
    best, ap = 0.0, 0.0
    for hit, p in reversed(points):
        best = max(best, p)
        ap += best * hit / 300
    assert got.ap == pytest.approx(ap) and got.recall == pytest.approx(tp / 300) and got.precision == pytest.approx(tp / 400)


def test_box_statistics_median(spark):
    rows = [("a", i / 3000, 1.0) for i in range(1, 2502)] + [(None, 0.1, 0.5), (None, 0.3, 0.5)]
    got = {r.class_name: r for r in boxes.box_statistics(spark.createDataFrame(rows, "class_name string, w double, h double")).collect()}
    assert got["a"].median_area == pytest.approx(1251 / 3000) and got[None].median_area == pytest.approx(0.1) and got[None].n == 2


@pytest.mark.parametrize(("counts", "stratified"), [({"a": 50, "b": 30, None: 7}, True), ({"a": 50, "b": 1}, False), ({c: 2 for c in "abcdefgh"}, False)])
def test_held_back(spark, counts, stratified):
    rows = [(f"{c}{i}", c) for c, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, c string")
    got = splits.held_back(df, "c", "id", 0.15, 0.2).collect()
    n = len(rows)
    held = -(-n * 15 // 80)
    assert len(got) == n and sum(r.split == "valid" for r in got) == held and {r.id for r in got} == {r[0] for r in rows}
    if stratified:
        for c, k in counts.items():
            mine = sum(r.split == "valid" for r in got if r.c == c)
            assert abs(mine - k * held / n) < 1
    assert splits.held_back(df.filter("false"), "c", "id", 0.15).count() == 0


def test_group_split_deals_each_group_once(spark):
    rows = [(f"g{i % 40}", "x" if i % 40 < 25 else "y") for i in range(400)]
    got = splits.group_split(spark.createDataFrame(rows, "g string, c string"), "g", "c").collect()
    assert len(got) == 40 and {r.split for r in got if r.modal == "y"} == {"train", "valid", "test"}
    assert sum(r.split == "train" for r in got if r.modal == "x") == 17 or sum(r.split == "train" for r in got if r.modal == "x") == 18


def test_report_is_one_file(spark, tmp_path):
    """Counts and nested lists come back as they were, an existing report is not overwritten."""
    from curata.sources import sinks

    df = spark.createDataFrame([("a", 2, ["x"]), ("b", None, [])], "name string, n int, refs array<string>").repartition(4)
    path = str(tmp_path / "report")
    sinks.write_report_json(df, path)
    assert len(list((tmp_path / "report").glob("part-*"))) == 1
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(path).collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_report_json(df, path)
