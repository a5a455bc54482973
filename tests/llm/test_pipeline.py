"""Every stage of the pipeline against a plain version, its input being what the stage before it wrote."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_line_dedup import runs_brute

import corpus_pipeline as p
from curata.llm import language_id as li
from curata.llm.tokens import vocabulary
from curata.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of_documents():
    rng = random.Random(7)
    tongues = {"aa": ["wo", "ra", "the", "ski", "lum"], "bb": ["zzu", "qi", "vox", "jep", "kwa"]}
    word = lambda x: "".join(rng.choice(tongues[x]) for _ in range(rng.randint(1, 4)))
    line = lambda x: " ".join(word(x) for _ in range(rng.randint(4, 14)))
    text = lambda x: "\n".join(line(x) for _ in range(rng.randint(1, 8)))
    rows = [(i, text("aa" if i % 3 else "bb"), ("aa" if i % 3 else "bb") if i % 5 else None, f"s{i % 4}" if i % 7 else None) for i in range(60)]
    passage = "\n".join(line("aa") for _ in range(3))
    rows += [(100 + i, text("aa") + "\n" + passage + "\n" + text("aa"), "aa", "s1") for i in range(6)]
    # near copies of one text, single words of which differ, and copies under null and repeated ids
    body = [word("aa") for _ in range(120)]
    for i in range(8):
        words = list(body)
        words[10 * i] = f"changed{i}"
        rows.append((200 + i if i < 5 else None, " ".join(words), "aa", "s2"))
    rows += [(3, " ".join(body), "aa", "s0"), (200, text("bb"), "bb", "s3"), (None, text("bb"), None, "s3"), (None, text("bb"), None, "s3"), rows[5], (5, rows[5][1], "aa", "other")]
    rows += [(300, None, "aa", "s1"), (301, "", "aa", "s1"), (302, " \n ", "aa", "s1"), (303, "123 456 !", "aa", "s1"), (304, passage, "aa", "s1"), (305, " ".join(word("bb") for _ in range(5000)), "bb", "s3")]
    return [(d, t, x, s, len(t) if t is not None else None) for d, t, x, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and of each stage."""
    docs = spark.createDataFrame(rows_of_documents(), SCHEMA).repartition(3)
    out = [docs.collect()]
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, ""), name.replace(" ", "-"))
        out.append(docs.collect())
        assert name == p.STAGES[-1][0] or docs.columns == p.COLUMNS
    return out


def test_language_stage(stages):
    rows = stages[0]
    sums = defaultdict(lambda: np.zeros(li.BUCKETS))
    for r in rows:
        if r.lang is not None and r.text is not None and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2):
            sums[r.lang] += li.trigram_counts(r.text)
    names = sorted(sums)
    table = np.array([sums[x] for x in names]) + li.SMOOTHING
    model = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    want = []
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            shares = li.mixture(li.trigram_counts(r.text), model)
            if shares.max() >= p.LEAST_SHARE:
                want.append((r.doc_id, r.text, r.lang or names[int(shares.argmax())], r.source, r.n_chars))
    assert Counter(map(tuple, stages[1])) == Counter(want) and len(want) == len(rows) - 4


def test_line_stage(stages):
    # which of the rows of one id and text is the first is open, so those count by what is left of them
    want = []
    for doc_id, x, left in runs_brute([(r.doc_id, r.text) for r in stages[1]]):
        text = left.decode()
        if WORD.search(text):
            want.append((doc_id, text, len(text) if left != x else None))
    known = {(r.doc_id, r.text): r.n_chars for r in stages[1]}
    got = [(r.doc_id, r.text, None if (r.doc_id, r.text) in known and r.n_chars == known[r.doc_id, r.text] else r.n_chars) for r in stages[2]]
    same = [(d, t, None if (d, t) in known and n in (None, known[d, t]) else n) for d, t, n in want]
    assert Counter(got) == Counter(same) and len(want) < len(stages[1])
    assert {(r.doc_id, r.lang, r.source) for r in stages[2]} <= {(r.doc_id, r.lang, r.source) for r in stages[1]}


def grams(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicate_stage(stages):
    rows = stages[2]
    sets = [grams(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        members[g].append(r)
    got = Counter(map(tuple, stages[3]))
    assert sum(got.values()) == len(members) < len(rows)
    for rows_ in members.values():
        stay = [r for r in rows_ if got[tuple(r)]]
        ids = [r.doc_id for r in rows_ if r.doc_id is not None]
        assert len({(r.doc_id, r.text) for r in stay}) == 1 and stay[0].doc_id == (min(ids) if ids else None)


def plain_targets(sizes):
    """Weights 1, 2, 3, repeating; whatever exceeds 3 times a source's size is shared again, a little at a time."""
    weight = [1 + i % 3 for i in range(len(sizes))]
    low, high = 0.0, float(3 * sum(sizes) + 1)
    for _ in range(200):  # the level at which the capped shares add up to everything
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * n, level * w) for n, w in zip(sizes, weight, strict=True)) < sum(sizes) else (low, level)
    return [min(3 * n, high * w) for n, w in zip(sizes, weight, strict=True)]


def test_mixing_stage(stages):
    words = lambda t: WORD.findall(t or "")
    sizes = Counter()
    for r in stages[3]:
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = dict(zip(names, plain_targets([sizes[s] for s in names]), strict=True))
    taken, used = Counter(), defaultdict(list)
    for r in stages[4]:
        taken[r.source] += len(words(r.text))
        used[r.doc_id, r.source].append(words(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in names) and sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=len(names))
    whole = defaultdict(list)
    for r in stages[3]:
        whole[r.doc_id, r.source].append(words(r.text))
    for key, parts in used.items():
        budget = Counter()
        for w in whole[key]:
            budget += Counter({x: 3 * n for x, n in Counter(w).items()})
        assert not sum(map(Counter, parts), Counter()) - budget
        # a round's words keep the order of the document
        for part in parts:
            assert any(_in_order(part, w) for w in whole[key])


def _in_order(part, words):
    at = iter(words)
    return all(any(x == y for y in at) for x in part)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in stages[4]:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((r.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in stages[5]) == want
    places = defaultdict(list)
    for r in stages[5]:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(found))])
        assert [o for o, _ in sorted(found)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert sorted(places) == list(range(len(places)))


def test_unique_texts_survive_repeated_ids(spark):
    """Near copies that share ids with other texts, or have none, take nothing with them."""
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a, None, None, 1), (7, near, None, None, 2), (7, other, None, None, 3), (None, a, None, None, 4), (None, other + " y z", None, None, 5), (None, None, None, None, 6)], SCHEMA)
    got = {(r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {(3, a), (7, other), (None, None)}
    alone = spark.createDataFrame([(None, a, None, None, 1), (None, near, None, None, 2), (None, near, None, None, 2)], SCHEMA)
    assert p.drop_near_duplicates(spark, alone, "").count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, ""), name.replace(" ", "-"))
    assert docs.count() == 0
