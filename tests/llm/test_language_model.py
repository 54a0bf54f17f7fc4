"""Scores against plain counts, and the trie's codes against arrays."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsift.llm import language_model as lm

HELD = lambda i: F.crc32(i.cast("string").cast("binary")) % 7 == 2


def plain(rows, mu=(200.0, 50.0)):
    docs = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, (t or "").encode().lower().split() + [None]) for i, t in rows]
    grams = [Counter(tuple(w[k:k + n]) for _, h, w in docs if not h for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, types = sum(grams[0].values()), len(grams[0])
    out = []
    for i, h, w in docs:
        base = score = 0.0
        for k in range(len(w)):
            p = (grams[0][(w[k],)] + 1) / (total + types + 1)
            base += math.log10(p)
            if k > 0:
                p = (grams[1][tuple(w[k - 1:k + 1])] + mu[0] * p) / (grams[0][(w[k - 1],)] + mu[0])
            if k > 1:
                p = (grams[2][tuple(w[k - 2:k + 1])] + mu[1] * p) / (grams[1][tuple(w[k - 2:k])] + mu[1])
            score += math.log10(p)
        out.append(((i, h, len(w), sum(grams[0][(x,)] > 0 for x in w), total), base, score))
    return out


@pytest.mark.parametrize("which", ["small", "odd"])
def test_scores(which, small_docs, odd_docs):
    docs = small_docs if which == "small" else odd_docs
    expected = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    for size in (8 << 20, 30_000):
        got = sorted((((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score)
                      for r in lm.score_texts(docs, HELD, part_bytes=size).collect()), key=str)
        assert [g[0] for g in sorted(got, key=lambda g: str(g[0]))] == [e[0] for e in sorted(expected, key=lambda e: str(e[0]))]
        for g, e in zip(sorted(got, key=lambda g: (str(g[0]), g[1])), sorted(expected, key=lambda e: (str(e[0]), e[1]))):
            assert g[1] == pytest.approx(e[1], rel=1e-9)
            assert g[2] == pytest.approx(e[2], rel=0.02, abs=0.05)      # quantised


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 6), (300, 300), (1000, 10**9), (4000, 2**50), (700, 701)):
        values = np.sort(rng.choice(universe, n, replace=False)) if universe < 10**6 else np.unique(rng.integers(0, universe, n))
        code = lm.EliasFano(values, universe)
        asked = np.unique(np.r_[values, rng.integers(0, universe, 500), 0, universe - 1])
        at, found = code.successor(asked)
        assert (found == np.isin(asked, values)).all()
        assert (at[found] == np.searchsorted(values, asked[found])).all()


def test_quantise():
    x = np.random.default_rng(0).normal(size=1000)
    codes, book = lm.quantise(x)
    assert np.abs(book[codes] - x).max() <= (x.max() - x.min()) / 256
    assert lm.quantise(np.full(3, 2.0))[1][0] == 2.0


def test_counts_beyond_four_bytes():
    """Three parts with almost 2^31 of one word each: the answer is their sum, not a limit."""
    pack, most = lm._packer(), 2**31 - 1
    keys = [np.array([5, 9], np.uint64), np.array([9], np.uint64), np.array([9, 2**63], np.uint64)]
    counts = [np.array([1, most], np.int32), np.array([most], np.int32), np.array([most, 4], np.int32)]
    rows = [{"dest": 0, "part": i, "level": 1, "keys": pack(lm._gaps(k)), "n": pack(c)}
            for i, (k, c) in enumerate(zip(keys, counts))]
    answer = {r["part"]: r for r in lm._add_up(pa.Table.from_pylist(rows)).to_pylist()}
    got = [lm._unpack_counts(answer[i]["c"]).tolist() for i in range(3)]
    assert got == [[1, 3 * most], [3 * most], [3 * most, 4]]
    assert (answer[-1]["total"], answer[-1]["types"]) == (3 * most + 5, 3)


def test_nothing(no_docs):
    assert lm.score_texts(no_docs, HELD).count() == 0
