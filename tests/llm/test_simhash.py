"""Fingerprints and links against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinsift.llm import simhash
from twinsift.operators.components import connected_components


def plain(text, k=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, limit):
    """Breadth-first components over distinct values."""
    nodes, out = sorted(nodes), {}
    values = np.array(nodes, np.uint64)
    for n in nodes:
        if n in out:
            continue
        out[n], queue = n, [n]
        while queue:
            near = values[np.bitwise_count(values ^ np.uint64(queue.pop())) <= limit]
            for m in map(int, near):
                if m not in out:
                    out[m] = n
                    queue.append(m)
    return out


def check(rows, docs):
    fps = [(r.doc_id, plain(r.text)) for r in docs]
    groups = reachable({f for _, f in fps}, 2)
    lowest = {}
    for d, f in fps:
        if d is not None:
            lowest[groups[f]] = min(d, lowest.get(groups[f], d))
    assert Counter((d, f"{f:016x}", lowest.get(groups[f])) for d, f in fps) == Counter(rows)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_near_duplicates(which, small_docs, odd_docs):
    docs = small_docs if which == "small" else odd_docs
    out = simhash.near_duplicates(docs).collect()
    check([(r.doc_id, f"{r.code[0] % 2**64:016x}", r.component_id) for r in out], docs.collect())


def _codes(n, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, clusters, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 2), np.uint64)
    near = centres[rng.integers(0, clusters, n)] ^ flips[:, 0] ^ np.where(rng.random(n) < 0.6, flips[:, 1], np.uint64(0))
    return np.unique(np.r_[near, rng.integers(0, 2**64, n // 4, np.uint64)])


@pytest.mark.parametrize("hot", [16_384, 40, 4])
def test_exact_tops_meet_every_link(spark, hot):
    codes = _codes(1200, 6, 5)
    nodes = spark.createDataFrame([(int(c.view(np.int64)), [int(c.view(np.int64))]) for c in codes], "node long, code array<long>")
    tops = simhash.exact_tops(nodes, 2, hot)
    links = tops.repartition(3, "top").sortWithinPartitions("top").mapInArrow(simhash._search(2, 1), "src long, dst long").collect()
    expected = reachable({int(c) for c in codes}, 2)
    joined = {int(c): int(c) for c in codes}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x
    for r in links:
        a, b = find(r.src % 2**64), find(r.dst % 2**64)
        joined[max(a, b)] = min(a, b)
    assert {c: find(c) for c in joined} == expected


@pytest.mark.parametrize("words, limit", [(1, 2), (1, 9), (4, 30)])
def test_gray_index(words, limit):
    rng = np.random.default_rng(words + limit)
    base = rng.integers(0, 2**64, (12, words), np.uint64)
    codes = base[rng.integers(0, 12, 900)].copy()
    for _ in range(limit // 2):
        at, bit = rng.integers(0, words, 900), np.uint64(1) << rng.integers(0, 64, 900, np.uint64)
        codes[np.arange(900), at] ^= np.where(rng.random(900) < 0.7, bit, np.uint64(0))
    codes = np.unique(np.r_[codes, rng.integers(0, 2**64, (300, words), np.uint64)], axis=0)
    codes = codes[simhash.gray_order(codes)]
    labels = simhash.GrayIndex(codes).components(limit)
    seen = np.full(len(codes), -1)
    for i in range(len(codes)):
        if seen[i] < 0:
            queue, seen[i] = [i], i
            while queue:
                near = np.flatnonzero((simhash._differing(codes, codes[queue.pop()]) <= limit) & (seen < 0))
                seen[near] = i
                queue += near.tolist()
    assert (seen == labels).all()


def test_gray_order():
    codes = np.array([[i ^ (i >> 1)] for i in np.random.default_rng(1).permutation(500)], np.uint64)
    ordered = codes[simhash.gray_order(codes)][:, 0]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_long_codes_find_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(120)]
    copies = [t.replace(t.split()[100], "changed") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, limit=36, words64=4, bands=32).collect()}
    assert sum(out[i + 120] == i for i in range(120)) >= 118 and all(out[i] == i for i in range(120))


@pytest.mark.parametrize("width", [12, 18, 24])
def test_recall_does_not_fall_with_the_width(spark, width):
    rng = np.random.default_rng(width)
    codes = rng.integers(0, 2**64, (300, 4), np.uint64)
    moved = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    for row in moved:
        row[rng.choice(256, 44, replace=False)] ^= 1
    both = np.r_[codes, np.packbits(moved, axis=1, bitorder="little").view(np.uint64)].view(np.int64)
    nodes = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(both)], "node long, code array<long>")
    links = simhash.near_links(nodes, 44, 4, 16_384, 44, 0.02, width=width).distinct().collect()
    assert sum({r.src, r.dst} == {i, i + 300} for r in links for i in [min(r.src, r.dst)]) >= 288


@pytest.mark.parametrize("hot", [60, 8])
def test_hot_top_nodes_are_divided(spark, hot):
    rng = np.random.default_rng(hot)
    codes = rng.integers(0, 2**64, (40, 1), np.uint64).repeat(10, axis=0)
    codes ^= np.uint64(1) << rng.integers(0, 64, (400, 1), np.uint64)
    codes = np.unique(codes, axis=0)
    rows = [(k % 2, int(c), [int(c)]) for k in (0, 1) for c in codes[:, 0].view(np.int64)]
    tops = spark.createDataFrame(rows, "top long, node long, code array<long>")
    links = simhash.banded_links(tops, len(rows), 2, 1, hot)
    seen = dict(connected_components(links).collect())
    values = codes[:, 0].tolist()
    expected = reachable(set(values), 2)
    groups = lambda of: {frozenset(v for v in values if of(v) == g) for g in map(of, values)}
    assert groups(expected.get) == groups(lambda v: seen.get(int(np.uint64(v).view(np.int64)), v))
    dealt = simhash.in_cells(tops.where("top = 0").withColumnRenamed("top", "_top").withColumn("left", F.lit(True)), "_top", hot)
    assert dealt.groupBy("top").count().agg(F.max("count")).first()[0] < 6 * hot < len(codes) * 2


def test_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_spark_hash_is_the_same(spark):
    text = "ähnlich so here"
    row = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()
    assert row.h % 2**64 == plain(text)
