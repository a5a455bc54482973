"""Language identification: estimation against its plain form, and the defined results."""

import random
import zlib

import numpy as np
import pytest

from curata.llm import language_id as li


def plain_shares(counts, log_p, chosen, steps=20_000):
    """Expectation-maximisation one occurrence class at a time, for a fixed set of languages and a fixed number of steps."""
    cells = [c for c in range(len(counts)) if counts[c]]
    p = {(l, c): float(np.exp(np.float64(log_p[l, c]))) for l in chosen for c in cells}
    total = sum(int(counts[c]) for c in cells)
    w = {l: 1 / len(chosen) for l in chosen}
    for _ in range(steps):
        new = dict.fromkeys(chosen, 0.0)
        for c in cells:
            whole = sum(w[l] * p[l, c] for l in chosen)
            for l in chosen:
                new[l] += int(counts[c]) * w[l] * p[l, c] / whole
        new = {l: x / total for l, x in new.items()}
        if max(abs(new[l] - w[l]) for l in chosen) < 1e-9:
            break
        w = new
    return w


def likelihood(counts, log_p, w):
    cells = np.flatnonzero(counts)
    return float(counts[cells] @ np.log(sum(x * np.exp(log_p[l, cells].astype(np.float64)) for l, x in w.items())))


@pytest.mark.parametrize("mix", [(1.0, 0, 0, 0), (0.7, 0.3, 0, 0), (0.4, 0.35, 0.25, 0), (0.9, 0.1, 0, 0)])
def test_mixture_equals_plain_estimation(monkeypatch, mix):
    rng = np.random.default_rng(int(100 * mix[0]))
    log_p = np.log(rng.dirichlet(np.full(300, 0.1), 4) + 1e-9).astype(np.float32)
    p = np.exp(log_p.astype(np.float64))
    p /= p.sum(axis=1, keepdims=True)
    counts = np.bincount(rng.choice(300, 400, p=np.array(mix) @ p), minlength=300)
    got = li.mixture(counts, log_p)
    chosen = np.flatnonzero(got).tolist()
    want = plain_shares(counts, log_p, chosen)
    assert all(got[l] == pytest.approx(want[l], abs=0.01) for l in chosen)
    # no set of one language more gains as much as the penalty, and dropping one loses more than it
    cost = li.PENALTY * 0.5 * np.log(counts.sum())
    best = likelihood(counts, log_p, want)
    for other in set(range(4)) - set(chosen):
        assert likelihood(counts, log_p, plain_shares(counts, log_p, [*chosen, other])) - best <= cost + 0.5
    if len(chosen) > 1:
        for gone in chosen:
            assert best - likelihood(counts, log_p, plain_shares(counts, log_p, [l for l in chosen if l != gone])) > cost - 0.5
    assert set(chosen) == {l for l, x in enumerate(mix) if x}


def test_counts_over_slices(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ünß\n") for _ in range(5000))
    whole = li.trigram_counts(text)
    monkeypatch.setattr(li, "SLICE", 17)
    assert (li.trigram_counts(text) == whole).all() and whole.sum() == len(text)


def test_ties_and_unknown(spark):
    """Two languages learned from one text tie: the first in code point order is named."""
    rows = [(1, "abc abd", "zz"), (4, "abc abd", "aa"), (3, "abc", None), (6, "qqq www", None), (7, "", None), (8, None, "aa"), (9, "12 ...", None)]
    rows = [(i, t, x) for i, t, x in rows]
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 4))
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in li.identify(df).collect()}
    assert [got[i].lang_pred for i in (1, 3, 4, 7, 8, 9)] == ["aa", "aa", "aa", "und", "und", "und"] and got[6].lang_pred in ("aa", "zz")
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)


def test_many_languages(spark):
    """More labels than any list of languages has."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(700)]
    df = spark.createDataFrame([(i, f"{w} {w} {w}", f"l{i:04d}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in li.identify(df).collect()}
    learned = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(got[i].lang_pred == f"l{i:04d}" for i in learned) > 0.95 * len(learned)
