"""Operators against brute force, with hot keys made small enough to occur."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinsift import operators as op
from twinsift.operators import containers, hamming, skew


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def distance(a, b):
    return bin((a ^ b) & (2 ** 64 - 1)).count("1")


def near_copies(seed, groups, extra_in_one_bucket):
    rnd = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = rnd.getrandbits(64)
        out.add(base)
        for _ in range(3):
            x = base
            for bit in rnd.sample(range(64), rnd.choice([1, 2, 3, 5, 8, 10, 11, 13])):
                x ^= 1 << bit
            out.add(x)
    shared = rnd.getrandbits(16)
    out |= {rnd.getrandbits(48) << 16 | shared for _ in range(extra_in_one_bucket)}
    return sorted(signed(x) for x in out)


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 5, 8, 10, 11, 13])
@pytest.mark.parametrize("hot_bucket", [50_000, 30])
def test_near_pairs_equal_brute_force(spark, threshold, hot_bucket):
    values = near_copies(threshold, 40, 60)
    items = spark.createDataFrame(list(enumerate(values)), "id bigint, h bigint")
    got = [(r.h_a, r.h_b, r.dist) for r in op.hamming_join(items, threshold, hot_bucket=hot_bucket).collect()]
    want = {(a, b, distance(a, b)) for a, b in combinations(values, 2) if distance(a, b) <= threshold}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("threshold", [20, 28, 35])
def test_near_pairs_at_high_limits(spark, threshold):
    values = near_copies(threshold, 15, 20)
    items = spark.createDataFrame(list(enumerate(values)), "id bigint, h bigint")
    for hot_bucket in (50_000, 40):
        got = [(r.h_a, r.h_b, r.dist) for r in op.hamming_join(items, threshold, hot_bucket=hot_bucket).collect()]
        want = {(a, b, distance(a, b)) for a, b in combinations(values, 2) if distance(a, b) <= threshold}
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("threshold", [1, 4, 10])
def test_near_pairs_of_few_different_bits(spark, threshold):
    """Constant bits, the highest one among them, and bits that rarely differ."""
    rnd = random.Random(threshold)
    base = 1 << 63 | 0xFF00FF00
    values = {base | rnd.getrandbits(12) << 40 for _ in range(150)} | {base ^ 1 << 63, base, 0, (1 << 64) - 1, 1 << 63}
    values = sorted(signed(x) for x in values)
    items = spark.createDataFrame(list(enumerate(values)), "id bigint, h bigint")
    got = [(r.h_a, r.h_b, r.dist) for r in op.hamming_join(items, threshold, hot_bucket=40).collect()]
    want = {(a, b, distance(a, b)) for a, b in combinations(values, 2) if distance(a, b) <= threshold}
    assert len(got) == len(want) and set(got) == want


def test_bands_follow_the_table():
    even = [0.5] * 64
    for threshold in (3, 10):
        plans = [hamming._plan(range(64), even, threshold, n) for n in (10**4, 10**6, 10**8)]
        assert [len(p) for p in plans] == sorted((len(p) for p in plans), reverse=True)
        assert len(plans[0]) > len(plans[2])
        for bands in plans:
            assert sum(b.radius + 1 for b in bands) == threshold + 1
            assert sorted(b for band in bands for b in band.bits) == list(range(64))
    # Sixteen bits that tell nothing leave no band without others.
    dull = [1.0 if b < 16 else 0.5 for b in range(64)]
    bands = hamming._plan(range(64), dull, 10, 10**6)
    telling = [sum(b >= 16 for b in band.bits) for band in bands]
    assert max(telling) - min(telling) <= 1


def closure(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 10])
def test_components(spark, hot_rows):
    rnd = random.Random(7)
    chain = [(i, i + 1) for i in range(100)]
    star = [(500, 600 + i) for i in range(80)]
    loose = [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    edges = chain + star + loose + [(5, 5)]
    rnd.shuffle(edges)
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r.node: r.component for r in op.connected_components(frame, hot_rows=hot_rows).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == closure({n for e in real for n in e}, real)


@pytest.mark.parametrize("hot_bucket, hot_rows", [(50_000, skew.HOT_ROWS), (30, 5)])
def test_similar_groups(spark, hot_bucket, hot_rows):
    values = near_copies(3, 40, 40)
    rnd = random.Random(1)
    items = [(i, rnd.choice(values) if i % 3 else values[0]) for i in range(300)]
    frame = spark.createDataFrame(items, "id bigint, h bigint")
    got = {(r.id, r.root, r.members, r.category) for r in op.similar_groups(
        frame, 2, 10, hot_bucket=hot_bucket, hot_rows=hot_rows).collect()}
    edges = [(a, b) for (a, x), (b, y) in combinations(items, 2) if distance(x, y) <= 10]
    root = closure({i for i, _ in items}, edges)
    far = defaultdict(int)
    value = dict(items)
    for a, b in edges:
        far[root[a]] = max(far[root[a]], distance(value[a], value[b]))
    size = Counter(root.values())
    want = {(i, root[i], size[root[i]], "exact" if far[root[i]] <= 2 else "similar") for i, _ in items if size[root[i]] > 1}
    assert got == want


def entry_rows(seed):
    """Containers with a common entry, several frequent ones and identical copies."""
    rnd = random.Random(seed)
    rows = []
    for c in range(60):
        kinds = {"everywhere"} | {f"often{rnd.randrange(4)}" for _ in range(2)} | {f"rare{rnd.randrange(80)}" for _ in range(3)}
        rows += [(f"c{c:02d}", k) for k in kinds for _ in range(rnd.choice([1, 1, 2]))]
    for c in range(15):
        rows += [(f"copy{c:02d}", k) for k in ("everywhere", "same1", "same2")]
    return rows


@pytest.mark.parametrize("heavy_entry", [1000, 5])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_container_overlap(spark, monkeypatch, heavy_entry, least):
    monkeypatch.setattr(containers, "PAIR_COST", -1)        # else too few rows for pairs of entries
    rows = entry_rows(least)
    frame = spark.createDataFrame(rows, "container string, hash string")
    contents = defaultdict(Counter)
    for c, h in rows:
        contents[c][h] += 1
    kinds, weighted = set(), set()
    for a, b in combinations(sorted(contents), 2):
        shared = contents[a].keys() & contents[b].keys()
        totals = (sum(contents[a].values()), sum(contents[b].values()))
        if len(shared) >= least:
            kinds.add((a, b, len(shared), *totals))
        if sum(contents[a][h] for h in shared) >= least:
            weighted.add((a, b, sum(contents[a][h] for h in shared), *totals))
    columns = ["container_a", "container_b", "common", "total_a", "total_b"]
    got = [tuple(r) for r in op.container_overlap(frame, least, heavy_entry).select(*columns).collect()]
    assert len(got) == len(kinds) and set(got) == kinds
    for few in (0, 3, 1000):        # by entries alone, both ways, by pairs of entries alone
        got = [tuple(r) for r in op.container_overlap(frame, least, heavy_entry, few).select(*columns).collect()]
        assert len(got) == len(kinds) and set(got) == kinds, few
    got = [tuple(r) for r in op.container_overlap_entries(frame, least, heavy_entry).select(*columns).collect()]
    assert len(got) == len(weighted) and set(got) == weighted


def test_baskets_meet_at_pairs_of_entries(spark, monkeypatch):
    """Where entries are in thirty containers each, pairs of entries are fewer than meetings."""
    rnd = random.Random(3)
    rows = [(f"c{i:03d}", f"p{k}") for i in range(300) for k in rnd.sample(range(30), 1 + i % 4)]
    contents = defaultdict(set)
    for c, h in rows:
        contents[c].add(h)
    want = {(a, b, n) for a, b in combinations(sorted(contents), 2) if (n := len(contents[a] & contents[b])) >= 3}
    found, at_pairs = [], containers._met_at_pairs
    monkeypatch.setattr(containers, "_met_at_pairs", lambda *a: found.append(at_pairs(*a)) or found[-1])
    frame = spark.createDataFrame(rows, "container string, hash string")
    got = {tuple(r) for r in op.container_overlap(frame, 3).select("container_a", "container_b", "common").collect()}
    assert got == want and found[0] is not None


@pytest.mark.parametrize("weighted", [False, True])
def test_overlap_at_frequent_entries_meets_by_pattern(spark, monkeypatch, weighted):
    met, meetings = [], containers._heavy_meetings

    def counted(wanted, heavy, *more):
        met.append(heavy.select("id").distinct().count())
        return meetings(wanted, heavy, *more)

    monkeypatch.setattr(containers, "_heavy_meetings", counted)
    monkeypatch.setattr(containers, "CELL_ROWS", 7, raising=False)     # several lots of one pattern
    # Forty contents of one pattern, some copied, some that also share a rare entry.
    rows = [(f"c{i:02d}", h) for i in range(40) for h in ("often1", "often2", f"own{i}", f"rare{i // 2 % 9}")]
    rows += [(f"d{i}", h) for i in range(3) for h in ("often1", "often2", "own0", "rare0")]
    rows += [(f"e{i}", h) for i in range(9) for h in ("often2", "often2", f"of{i}")]
    contents = defaultdict(Counter)
    for c, h in rows:
        contents[c][h] += 1
    want = {(a, b, n) for a, b in combinations(sorted(contents), 2)
            if (n := sum(contents[a][h] if weighted else 1 for h in contents[a].keys() & contents[b].keys())) >= 2}
    frame = spark.createDataFrame(rows, "container string, hash string")
    listed = (op.container_overlap_entries if weighted else op.container_overlap)(frame, 2, 12)
    got = [tuple(r) for r in listed.select("container_a", "container_b", "common").collect()]
    assert len(got) == len(want) and set(got) == want
    assert met and max(met) <= 4


def test_compact_overlap_says_the_same(spark):
    frame = spark.createDataFrame(entry_rows(9), "container string, hash string")
    classes = defaultdict(list)
    for r in op.container_classes(frame).collect():
        classes[r.rep].append(r.container)
    listed = set()
    for r in op.overlap_classes(frame, 2, 5).collect():
        assert (r.copies_a, r.copies_b) == (len(classes[r.rep_a]), len(classes[r.rep_b]))
        for a in classes[r.rep_a]:
            for b in classes[r.rep_b]:
                if a != b:
                    listed.add((min(a, b), max(a, b), r.common))
    want = {(r.container_a, r.container_b, r.common) for r in op.container_overlap(frame, 2).collect()}
    assert listed == want


def test_container_groups(spark):
    frame = spark.createDataFrame(entry_rows(4) + [("z1", "solo1"), ("z1", "solo2"), ("z2", "solo1"), ("z2", "solo2")],
                                  "container string, hash string")
    pairs = op.container_overlap(frame, 3).collect()
    nodes = {c for r in pairs for c in (r.container_a, r.container_b)}
    root = closure(nodes, [(r.container_a, r.container_b) for r in pairs])
    shared = defaultdict(int)
    for r in pairs:
        shared[root[r.container_a]] = max(shared[root[r.container_a]], r.common)
    got = {(r.container, r.root, r.shared) for r in op.container_groups(frame, 3, 5).collect()}
    assert got == {(c, root[c], shared[root[c]]) for c in nodes}


def pairs_listed(monkeypatch):
    """Every join that writes out container or content pairs fails from here on."""
    def refused(*_args, **_more):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(containers, "_overlapping", refused)
    monkeypatch.setattr(containers, "_listed", refused)


@pytest.mark.parametrize("heavy_entry", [1000, 5, 1])
def test_groups_and_strongest_overlaps_without_pairs(spark, monkeypatch, heavy_entry):
    rows = entry_rows(7) + [(f"z{i}", f"solo{k}") for i in range(3) for k in range(9)]
    frame = spark.createDataFrame(rows, "container string, hash string").cache()
    contents = defaultdict(set)
    for c, h in rows:
        contents[c].add(h)
    shared = {(a, b): len(contents[a] & contents[b]) for a, b in combinations(sorted(contents), 2)}
    pairs_listed(monkeypatch)
    least = 2
    pairs = {p: n for p, n in shared.items() if n >= least}
    root = closure({c for p in pairs for c in p}, list(pairs))
    best = defaultdict(int)
    for (a, _), n in pairs.items():
        best[root[a]] = max(best[root[a]], n)
    got = {(r.container, r.root, r.shared) for r in op.container_groups(frame, least, heavy_entry).collect()}
    assert got == {(c, root[c], best[root[c]]) for c in root}
    want = sorted((-n, *p) for p, n in pairs.items())
    for n in (2, 40, 400):
        got = [(-r.common, r.container_a, r.container_b) for r in op.strongest_overlaps(frame, least, n, heavy_entry).collect()]
        assert got == want[:n]


@pytest.mark.parametrize("measure", ["mean_min", "aligned"])
@pytest.mark.parametrize("hot_rows, hot_frame", [(skew.HOT_ROWS, 1000), (64, 12)])
def test_sequences(spark, measure, hot_rows, hot_frame):
    rnd = random.Random(11)
    base = [[rnd.getrandbits(64) for _ in range(4)] for _ in range(12)]
    rows, n = [], 0
    for frames in base:
        for flips in (0, 0, 1, 4, 12):
            noisy = [f ^ sum(1 << b for b in rnd.sample(range(64), flips)) for f in frames]
            noisy = noisy[: rnd.choice([3, 4])] + [0, 1, 3][: rnd.choice([0, 0, 1, 1, 3])]
            rows.append((n, [signed(f) for f in noisy]))
            n += 1
    rows.append((n, []))
    frame = spark.createDataFrame(rows, "id bigint, frames array<bigint>")

    def one_way(a, b):
        return sum(min(distance(x, y) for y in b) for x in a) / len(a)

    def dist(a, b):
        if measure == "mean_min":
            return min(one_way(a, b), one_way(b, a))
        k = min(len(a), len(b))
        return sum(distance(a[i * len(a) // k], b[i * len(b) // k]) for i in range(k)) / k

    shown = [(i, f) for i, f in rows if f]
    edges = {(a, b): dist(x, y) for (a, x), (b, y) in combinations(shown, 2) if dist(x, y) <= 10}
    root = closure({i for i, _ in shown}, edges)
    size = Counter(root.values())
    far = defaultdict(float)
    for (a, _), d in edges.items():
        far[root[a]] = max(far[root[a]], d)
    want = {(i, root[i], "exact" if far[root[i]] <= 3 else "similar") for i, _ in shown if size[root[i]] > 1}
    got = {(r.id, r.root, r.category) for r in op.similar_sequences(
        frame, measure=measure, hot_rows=hot_rows, hot_frame=hot_frame).collect()}
    assert got == want


def test_hot_key_join_is_the_plain_join(spark):
    rows = spark.range(2000).select(F.col("id").alias("path"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 50).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    for settle in (True, False):
        got = skew.join_to_groups(rows, groups, "k", "n", "path", hot_rows=100, settle=settle)
        assert got.count() == 2000
        assert got.where("k = 0").agg(F.min("n"), F.max("n")).first()[:] == got.where("k = 0").select("n", "n").first()[:]


def test_global_position(spark):
    rnd = random.Random(5)
    values = [(i, rnd.randrange(10)) for i in range(500)]
    frame = spark.createDataFrame(values, "id int, v int").repartition(7)
    placed = op.global_position(frame, [F.col("v").desc(), F.col("id").asc()])
    got = [r.id for r in placed.orderBy("position").collect()]
    assert got == [i for i, v in sorted(values, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.position for r in placed.collect()) == list(range(1, 501))


def test_plan_twice_changes_nothing(spark):
    members = spark.createDataFrame(
        [("regular", "g1", p, k) for p, k in (("a", True), ("b", False), ("c", True))]
        + [("image", "g2", "b", True), ("image", "g2", "d", True)],
        "tab string, group_id string, path string, keep boolean",
    ).withColumn("size", F.lit(1))
    plan = op.deletion_plan(members.where("tab = 'regular'"))
    once = op.apply_deletions(members, plan)
    twice = op.apply_deletions(once, plan)
    assert sorted(r.path for r in once.collect()) == sorted(r.path for r in twice.collect()) == ["a", "c"]
