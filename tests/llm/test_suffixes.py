"""Repeated passages against brute force."""

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from twinsift.llm import suffixes


def plain(rows, depth=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - depth + 1) if i is not None else ():
            w = b[k:k + depth]
            first[w] = min(i, first.get(w, i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - depth + 1) if i is not None else ():
            if first[b[k:k + depth]] < i:
                gone[k:k + depth] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def run(docs, **more):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in suffixes.remove_repeats(docs, **more).collect())


@pytest.mark.parametrize("which", ["small", "odd"])
def test_tables(which, small_docs, odd_docs):
    docs = small_docs if which == "small" else odd_docs
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (8 << 20, 40_000):
        assert run(docs, part_bytes=size) == plain(rows)


def test_made(spark):
    rng = random.Random(4)
    passages = ["".join(rng.choice("abcd é\n") for _ in range(rng.choice([49, 50, 51, 75, 200]))) for _ in range(25)]
    rows = []
    for i in range(150):
        t = "".join(rng.choice(passages)[rng.choice([0, 0, 3]):] if rng.random() < .6 else "".join(
            rng.choice("abcdefgh ") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(8)))
        rows.append((rng.randrange(120), t))
    rows += [(200, "ab" * 300), (201, "ab" * 40), (202, "x" * 500), (203, "x" * 49), (204, "y" * 50), (205, "y" * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(rows)
    assert sum(x[2] > 0 for x in expected) > 50
    assert run(docs, part_bytes=3_000) == expected
    kept = {(r.doc_id, hashlib.sha256(r.kept.encode()).hexdigest()) for r in
            suffixes.remove_repeats(docs.where("doc_id >= 200"), with_text=True).collect()}
    assert len(kept) == 6


def test_anchors_cover_all_windows():
    rng = np.random.default_rng(2)
    for top in (3, 1 << 40):
        h = rng.integers(0, top, 500, np.uint64)
        at, first, last = suffixes.anchors(h, 27)
        assert first[0] == 0 and last[-1] == len(h) - 27 and (first[1:] == last[:-1] + 1).all()
        for a, f, e in zip(at, first, last):
            for w in (f, e):
                run_ = h[w:w + 27]
                assert a == w + np.flatnonzero(run_ == run_.min())[-1]


def test_nothing(no_docs):
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_equal_phrases_in_different_surroundings(spark):
    """Two texts around one phrase whose contexts agree in 32 bits of a hash, and many more such texts."""
    pair = [(1, "tlbjfcxp  jvcxtfcxmiwpwba zwfdahftepdltcciowuqkhwwvfqvbzshftlsuswaonbdatazgcjmhyenigurochssiynnjbmakxgrc"),
            (2, "liylgboihfjfelbmdsosoajrvudvbc uohzjmycsciowuqkhwwvfqvbzshftlsusourgcgpxhqa ufamnzooswenlnnxtevmjflifauv")]
    rng = np.random.default_rng(11)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    noise = letters[rng.integers(0, len(letters), (20_000, 80))]
    rows = pair + [(10 + i, noise[i, :40].tobytes().decode() + "ciowuqkhwwvfqvbzshftlsus" + noise[i, 40:].tobytes().decode())
                   for i in range(len(noise))]
    for given in (pair, rows):
        out = suffixes.remove_repeats(spark.createDataFrame(given, "doc_id long, text string"))
        assert out.where("n_removed > 0 OR n_spans > 0 OR n_bytes <> 104").count() == 0


@pytest.mark.parametrize("part_bytes", [1_500, 1 << 20])
def test_hot_digits(spark, part_bytes):
    rng = random.Random(part_bytes)
    phrase = "the license of this text is"
    ends = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(30)]
    rows = [(rng.randrange(90), rng.choice(ends) + phrase + rng.choice(ends) + rng.choice(["", phrase])) for _ in range(110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1, 4, 10_000):
        assert run(docs, part_bytes=part_bytes, hot_digit=hot) == plain(rows)


def test_first_exchange_is_let_go(spark):
    """What the first pass exchanged is off the disk before the second one begins."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    rows = [(i, letters[rng.integers(0, len(letters), 2_000)].tobytes().decode()) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def exchanged():
        return {f for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    before = exchanged()
    out = suffixes.remove_repeats(docs, part_bytes=1 << 20)
    until = time.time() + 20            # files are deleted in the background
    while (left := sum(f.stat().st_size for f in exchanged() - before if f.exists())) > 1 << 20 and time.time() < until:
        time.sleep(0.2)
    assert left < 1 << 20
    assert out.where("n_removed = 0 AND n_bytes = 2000").count() == 1_500
