"""Greedy string tiling against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.llm import tiling


def plain_tiles(a, b, least):
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = 0
        found = []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k:
                    found.append((i, j))
        if best < least:
            return tiles
        for i, j in found:
            if not any(ma[i:i + best]) and not any(mb[j:j + best]):
                ma[i:i + best] = mb[j:j + best] = [True] * best
                tiles.append((i, j, best))


@pytest.mark.parametrize("seed", range(12))
def test_tiles(seed):
    rng = random.Random(seed)
    a = [rng.randrange(1, 3 + seed) for _ in range(rng.randrange(1, 60))]
    cut = len(a) // 2
    b = a[cut:] + [0, 0] + a[:cut] + [rng.randrange(1, 3 + seed) for _ in range(30)]
    least = 2 + seed % 4
    assert sorted(tiling.greedy_tiles(np.array(a), np.array(b), least)) == sorted(plain_tiles(a, b, least))


def test_running_hashes():
    rng = np.random.default_rng(1)
    long, short = rng.integers(0, 4, 400), None
    short = long[137:190]
    for size in (3, 8, 9, 30, 53):
        h = tiling.running_hashes(long, size)
        assert h[137] == tiling.running_hashes(short, size)[0]
        windows = {tuple(long[i:i + size]) for i in range(len(long) - size + 1)}
        assert len(set(h.tolist())) == len(windows)


def test_contaminated(spark, odd_docs):
    words = [f"q{i}" for i in range(40)]
    filler = " ".join(f"f{i}" for i in range(200))
    item, other = " ".join(words), " ".join(f"z{i}" for i in range(20))
    texts = {
        1: f"{filler} {item.upper()} {filler}", 2: " ".join(words[20:] + ["x"] + words[:20]), 3: " ".join(words[:20]) + filler,
        4: " ".join(w if i % 4 else "gap" for i, w in enumerate(words)), 5: filler, 6: f"{other} {item}", 7: "tiny one", 8: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("item_id", F.lit(5))
    tests = spark.createDataFrame([(10, item), (11, other), (12, "tiny one"), (13, None), (14, ""), (None, other)], "item_id long, text string")
    for block in (1_000_000, 10):
        out = tiling.contaminated(docs, tests, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in out} == {(1, 10), (2, 10), (6, 10), (6, 11), (6, None), (7, 12)}
        two = next(r for r in out if r.doc_id == 2)
        assert (two.coverage, two.n_tiles, two.longest_tile, two.first_word, two.end_word) == (1.0, 2, 20, 0, 41)


def test_repeated_items_are_dealt(spark):
    """Copies of one item fall in several blocks, and each of them is reported once."""
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item), (2, "nothing of it here at all")], "doc_id long, text string")
    tests = spark.createDataFrame([(5, item)] * 12 + [(None, item)] * 3, "item_id long, text string")
    out = tiling.contaminated(docs, tests, block_words=60).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in out) == [(1, 0)] * 3 + [(1, 5)] * 12


def test_odd_rows(spark, odd_docs, no_docs, folder):
    tests = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert tiling.contaminated(odd_docs, tests).count() == 0
    assert tiling.contaminated(no_docs, tests).count() == 0
    assert tiling.contaminated(odd_docs, tests.limit(0)).count() == 0
    own = odd_docs.where("length(text) > 5").selectExpr("doc_id item_id", "text")
    found = tiling.contaminated(odd_docs, own)
    assert {r.doc_id for r in found.where("doc_id = item_id").collect()} == {r.item_id for r in own.where(r"item_id is not null and text rlike '\\S'").collect()}
