"""Training-data operators against brute force, on fixtures with nulls, ties, copies and empty tables."""

import glob
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curata.llm import language_id, mixing, ngram_join, packing, quality_rules, token_output
from curata.llm.tokens import vocabulary
from curata.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, block string"
WORDS = [a + b for a in ("wo", "ra", "the", "ski", "lum") for b in ("n", "ta", "rik", "so", "pe", "zu", "mo")]


def rows_of_documents():
    rng = random.Random(0)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    text = lambda: "\n".join(sentence(rng.randint(3, 25)) for _ in range(rng.randint(1, 9)))
    passage = "\n".join(sentence(20) for _ in range(4))
    texts = [text() for _ in range(30)]
    texts += texts[:5] + [max(texts, key=len) + " end", "first " + max(texts, key=len)] + [t + "\n" + passage + "\n" + text() for t in (text(), text(), text())] + [passage] * 4
    texts += [None, "", " \n\t", "12 34", "x " * 3000, "a b", "a b", "ab" * 400, "\n".join(["same line here"] * 6)]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[3], (None, texts[2], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return Counter((r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for r in docs.select("doc_id", "text").collect())


def test_packing(docs, empty):
    want = encoded(docs)
    rows = packing.pack_digest(docs, vocabulary(), 64).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert pieces == sum((Counter({(d, a // 4, len(x[a : a + 256]) // 4, zlib.crc32(x[a : a + 256]), len(x) // 4): n for a in range(0, len(x), 256)}) for (d, x), n in want.items()), Counter())
    assert packing.pack_digest(empty, vocabulary()).count() == 0


def test_token_output(spark, docs, empty):
    path = shared_dir(spark, "t")
    token_output.write_tokens(docs, path, vocabulary())
    assert token_output.read_tokens(spark, path, "doc_id", "n_tokens").columns == ["doc_id", "n_tokens"]
    got = token_output.digest(token_output.read_tokens(spark, path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter({(d, len(x) // 4, zlib.crc32(x)): n for (d, x), n in encoded(docs).items()})
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    # ids in dictionary encoding, the numbers beside them delta encoded, pages indexed, row groups of the wanted size
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in column.encodings
                else:
                    assert "DELTA_BINARY_PACKED" in column.encodings and not column.has_dictionary_page
                assert column.has_offset_index and column.has_column_index and column.total_compressed_size <= 32 << 20
    path = shared_dir(spark, "t")
    token_output.write_tokens(empty, path, vocabulary())
    assert token_output.digest(token_output.read_tokens(spark, path)).count() == 0


def near_brute(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = lambda i, j: sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))
    near = [{j for j in range(len(rows)) if j != i and linked(i, j)} for i in range(len(rows))]
    group = {}
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j].doc_id for j in seen if rows[j].doc_id is not None]
        group[i] = min(ids) if ids else None
    return Counter((r.doc_id, group[i], len(near[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("chunk", [512, 2])
def test_ngram_join(docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", chunk)
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == near_brute(docs.select("doc_id", "text").collect())
    if chunk == 512:
        assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.similar_pairs(docs).count() > 0


def test_keep_one_keeps_columns(docs):
    """Columns named like the operator's own pass through, and one row of each group stays."""
    clash = docs.withColumns({c: F.lit("clash") for c in ("row", "key", "found", "id", "kept_key", "class_id")})
    got = ngram_join.keep_one(clash)
    assert got.columns == clash.columns and {tuple(r[c] for c in ("row", "key", "found", "id", "kept_key", "class_id")) for r in got.collect()} == {("clash",) * 6}
    found = ngram_join.near_duplicates(docs).filter("kept").collect()
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in found) - Counter({3: 1})  # one of two equal rows


def test_mixing_many_sources(spark):
    """More sources than rows of any other, each with its target, and documents that share ids."""
    rows = [(i % 50, " ".join(["w"] * (i % 7)), f"s{i:04d}" if i else None) for i in range(1500)]
    got = mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == pytest.approx(sum(i % 7 for i in range(1500)), abs=1500 * 0.5)
    assert all(0 <= r.taken <= 3 * r["size"] and abs(r.taken - r.target) <= 0.5 for r in got)


def test_mixing(docs, empty):
    got = mixing.mix_digest(docs, 16).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, count(r.text)) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    names = sorted((s for s in sizes if s), key=str) + [None]
    want = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        of = source[r.doc_id]
        assert r.source_size == sizes[of] and r.target == pytest.approx(want[of]) and 0 <= r.taken <= 3 * r["size"]
        taken[of] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_digest(docs, 16).collect()))
    assert mixing.mix_digest(empty).count() == 0


def test_language_id(spark, docs, empty):
    rng = random.Random(4)
    tongues = {"aa": "kalomire", "bb": "schtzung"}
    rows = [(i, " ".join("".join(rng.choice(tongues[x]) for _ in range(5)) for _ in range(30)), x, None, 0, "", "") for i in range(200) for x in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", None, 0, "", ""), (901, "123 !", "bb", None, 0, "", ""), (902, "", None, None, 0, "", "")]
    out = language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert {r.lang_pred for r in out if r.doc_id >= 900} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert language_id.identify(empty).count() == 0 and language_id.identify(docs).count() == docs.count()


def test_quality_rules(spark, docs, empty):
    more = ["- a\n* b\n\t• c\nd - e", "one...\ntwo… \nthree... x\n…\r", "the end. " * 40, "a b c a b c", "x " * 2000 + "y " * 2000, "word " * 300_000]
    extra = spark.createDataFrame([(500 + i, t, None, None, None, "clash", "clash") for i, t in enumerate(more)], SCHEMA)
    both = docs.union(extra).withColumns({c: F.lit("clash") for c in ("w", "l", "_w", "_l", "s", "z", "i", "g", "row", "whole")}).withColumns({"n_words": F.lit("x"), "kept": F.lit("y")})
    got = quality_rules.apply_rules(both).collect()
    assert {tuple(r[c] for c in ("w", "l", "_w", "_l", "s", "z", "i", "g", "row", "whole")) for r in got} == {("clash",) * 10}
    assert len(got) == both.count() and quality_rules.apply_rules(empty).count() == 0
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.n_bullet_lines == sum(bool(re.match("[ \\t]*[-*•‣▪◦–]", x)) for x in lines) and r.n_ellipsis_lines == sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in lines)
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
