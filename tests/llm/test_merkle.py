"""The Merkle manifest against a plain recursive form."""

import hashlib
import random
import zlib

import pytest

from curata.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """The root, and of each leaf the runs above it: (place in the run, the run)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    ways = []
    for at in range(len(digests)):
        way = []
        for level in levels[:-1]:
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            way.append((at % 3, run))
            at //= 3
        ways.append(way)
    return levels[-1][0], ways


def plain(rows):
    if not rows:
        return []
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in ordered}
    root, above = tree([grown[s][0] for s in ordered])
    out = []
    for s, top in zip(ordered, above, strict=True):
        subroot, ways = grown[s]
        for (_, _, leaf, row), way in zip(sorted(sources[s], key=lambda x: x[:3]), ways, strict=True):
            doc_id, text = row[0], row[1]
            cut = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
            folded = leaf_of(doc_id, cut, *row[2:])
            for place, run in way + top:
                folded = h(*run[:place], folded, *run[place + 1 :])
            proof = h(*(d for place, run in way + top for i, d in enumerate(run) if i != place))
            out.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "one line", "two\nlines\n", "é\n" * 3, f"text {i}\nmore"])
        out.append((rng.choice([i, i, i, None, 2**60 + i % 2]), text, rng.choice([None, "de", ""]), rng.choice(sources), rng.choice([None, i])))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 28, 82, 400])
def test_manifest_equals_plain_form(spark, n):
    rows = rows_of(n, [None, "", "b", "a", "hot", "hot", "hot", "\U0001f600", "￮"]) + rows_of(n, ["hot"])[: n // 2]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS tree", "2 AS at", "3 AS leaf", "4 AS path", "5 AS place")
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr) == plain(rows)


def test_many_small_steps(spark, monkeypatch):
    """Several rounds of the frontier and of the proofs, sources joined by a shuffle, a very long text."""
    monkeypatch.setattr(merkle, "STEP", 1)
    monkeypatch.setattr(merkle, "ROUND", 1)
    monkeypatch.setattr(merkle, "BROADCAST_SOURCES", 0)
    rows = rows_of(150, ["a", "b"]) + [(9, "long\n" * 100_000, "de", "long", 1)]
    assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(6)).collect()), key=repr) == plain(rows)


def test_many_sources(spark):
    rows = [(i, f"t\n{i}", None, f"s{i % 60}", i) for i in range(130)]
    assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()), key=repr) == plain(rows)


def test_events_in_any_order():
    """Nodes of a tree reach the task in any order, in any share: what isn't resolved comes out as it went in."""
    import pyarrow as pa

    digests = [hashlib.sha256(b"%d" % i).digest() for i in range(47)]
    rng = random.Random(3)
    nodes = [(0, 47, 0, i, d) for i, d in enumerate(digests)]
    links = {}
    while True:
        rng.shuffle(nodes)
        left = []
        for part in (nodes[: len(nodes) // 2], nodes[len(nodes) // 2 :]) if len(nodes) > 6 else (nodes,):
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["tree", "size", "level", "at", "digest"])
            for made in merkle._grow([batch]):
                for r in made.to_pylist():
                    if r["kind"] == merkle.LINKS:
                        assert (r["level"], r["at"]) not in links
                        links[r["level"], r["at"]] = r["children"]
                    else:
                        left.append((r["tree"], r["size"], r["level"], r["at"], r["digest"]))
        if len(left) == 1:
            break
        nodes = left
    assert left[0][4].hex() == tree([d.hex() for d in digests])[0] and len(links) == 16 + 6 + 2 + 1
