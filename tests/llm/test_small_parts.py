"""Parts of the training-data operators that need no Spark."""

import numpy as np
import pytest

from curata.llm import embed_lattice, language_id, line_dedup, mixing, ngram_join, packing, suffix_dedup
from curata.llm.tokens import WordEncoder, vocabulary


def test_word_encoder_equals_the_library():
    e = WordEncoder(vocabulary())
    assert e.by_word and e.plain
    texts = [
        "It's 'tis don't", "a<|endoftext|>b <|startoftext|>", "x²y ½ café́ ﬁ ŉ İstanbul ΣΑΣ Ǆ", "a\x1cb\x85c d e", "你好 мир 123 4a5 !!! a_b", "Ünïcödé ÀÉ×÷ ß ſ K Å", "tab\tnl\nvt\x0bff\x0ccr\r",
        "é ́x à.", "<|ENDOFTEXT|> A<|EndOfText|>b", "A\u030A I\u0307 E\u0301S \u212A\u212B", "Y\u030A W\u030A T\u0308 H\u0331", "IT'S WE'LL I'M ÀB'S", "ΑΣ ΑΣ. σς ẞ Ǆ Dž", "가 ᄀ ᅡ", "#$%^&*() [x]{y}~`", "", " \n ", "Word, word. WORD!! word",
    ]
    for t in texts:
        assert np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() == e.encode([t.encode()])[0]
    assert e.encode([None]) == [b""]


def test_shortest_pack_first():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 5000).tolist() + [2048] * 50 + [1] * 300
    histogram = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.pack_histogram(histogram)
    assert len(patterns) <= 2 * 2048
    used = {}
    for packs, pattern in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            used[n] = used.get(n, 0) + packs * k
    assert used == histogram
    assert 1 - sum(lengths) / (2048 * sum(p for p, _ in patterns)) < 0.01
    assert packing.pack_histogram({}) == [] and packing.intervals([]) == []


def test_targets():
    assert mixing.targets([10, 10, 10]) == pytest.approx([5, 10, 15])
    got = mixing.targets([1000, 1, 1])
    assert got[1] == 3 and got[2] == 3 and sum(got) == pytest.approx(1002)
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0.0, 5.0]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation(n):
    p = mixing.Permutation(n, 3)
    out = p.apply(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and (p.invert(out) == np.arange(n)).all()


@pytest.mark.parametrize("words", [0, 1, 63, 64, 65, 700, 999, 1000, 1001, 2500, 3000])
def test_slot_quota(words):
    size, block = 1000, 64
    n = -(-size // block)
    p = mixing.Permutation(n, 9)
    slots, part = mixing.slot_quota(size, words, block, int(p.invert([n - 1])[0]))
    lengths = [min(block, size - b * block) for b in p.apply(np.arange(n))]
    assert sum(lengths[t % n] for t in range(slots)) + part == words and (part == 0 or part < lengths[slots % n])


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= 25


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(7)]
    got = ngram_join.intersections(sets)
    for i in range(7):
        for j in range(i):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_nearest_lattice_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    p = embed_lattice.nearest_e8(x)
    roots = embed_lattice.e8_roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    assert np.allclose(p.sum(axis=1) % 2, 0)
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= ((x[:, None] - p[:, None] - roots) ** 2).sum(axis=2).min(axis=1) + 1e-9).all() and (d <= 1 + 1e-9).all()


def test_suffix_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    depth = 12
    s = suffix_dedup.Suffixes(data, depth)
    pos = np.arange(500)
    group = np.sort(rng.integers(0, 9, 500))
    first = np.searchsorted(group, group)
    last = np.searchsorted(group, group, side="right")
    got = s.sort(pos, first, last)
    for g in range(9):
        rows = got[group == g]
        want = sorted(pos[group == g].tolist(), key=lambda p: bytes(data[p : p + depth]))
        assert [bytes(data[p : p + depth]) for p in rows] == [bytes(data[p : p + depth]) for p in want]


def test_segments_cover_all_starts_once():
    text = bytes(np.random.default_rng(5).integers(97, 101, 5000).astype(np.uint8))
    first, n, distance, anchor = suffix_dedup.segments(text)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(text) - 199
    assert len(suffix_dedup.segments(b"x" * 199)[0]) == 0 and len(suffix_dedup.segments(b"")[0]) == 0


def test_chunk_bounds_resist_shifts():
    rng = np.random.default_rng(6)
    lines = rng.integers(0, 2**63, 200).tolist()
    plain = {tuple(lines[a:b]) for a, b in line_dedup.chunk_bounds(lines)}
    moved = [1, 2, 3, *lines]
    assert len(plain & {tuple(moved[a:b]) for a, b in line_dedup.chunk_bounds(moved)}) > 0.8 * len(plain)
    assert line_dedup.chunk_bounds([]) == [] and line_dedup.chunk_bounds([1]) == []


def test_mixture_finds_two_languages():
    rng = np.random.default_rng(8)
    p = rng.dirichlet(np.full(language_id.BUCKETS, 0.05), 3)
    log_p = np.log(p + 1e-9).astype(np.float32)
    one = np.bincount(rng.choice(language_id.BUCKETS, 2000, p=p[0]), minlength=language_id.BUCKETS)
    two = one + np.bincount(rng.choice(language_id.BUCKETS, 1000, p=p[2]), minlength=language_id.BUCKETS)
    assert language_id.mixture(one, log_p).round(2).tolist() == [1, 0, 0]
    got = language_id.mixture(two, log_p)
    assert got[1] == 0 and got[0] == pytest.approx(2 / 3, abs=0.05)
