"""Contraction before the exchange, and components against a plain union-find."""

import random

import numpy as np
import pyarrow as pa
import pytest

from twinsift import operators as op
from twinsift.operators import components


def brute(pairs):
    name = {}
    for a, b in pairs:
        x, y = name.setdefault(a, a), name.setdefault(b, b)
        low = min(x, y)
        name = {k: low if v in (x, y) else v for k, v in name.items()}
    return name


@pytest.mark.parametrize("kind,portion", [("long", 7), ("string", 7), ("long", 1_000_000), ("string", 50), ("double", 1_000_000)])
def test_against_brute_force(spark, monkeypatch, kind, portion):
    monkeypatch.setattr(components, "FOREST_EDGES", portion)
    rng = random.Random(portion)
    names = {"long": lambda i: i * 7 - 300, "string": lambda i: f"{'äz'[i % 2]}{i}", "double": lambda i: i / 3}[kind]
    pairs = [(names(rng.randrange(200)), names(rng.randrange(200))) for _ in range(130)]
    pairs += [(names(300 + i), names(301 + i)) for i in range(40)] + pairs[:20]
    # Columns are named as the operator names its own, with one more beside them.
    rows = [(*p, "x") for p in pairs] + [(None, names(1), "x"), (names(2), None, "x"), (names(3), names(3), "x")]
    frame = spark.createDataFrame(rows, f"v {kind}, u {kind}, node string").repartition(5)
    got = {r.node: r.component for r in op.connected_components(frame, "v", "u").collect()}
    want = {k: v for k, v in brute([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want


def test_links_do_not_follow_the_bands(spark):
    """Each node of a dense group is named by 40 bands; it leaves with about one link."""
    rng = np.random.default_rng(3)
    n, rows = 4000, []
    for _ in range(40):
        group = rng.integers(0, 12, n)
        low = np.full(12, n)
        np.minimum.at(low, group, np.arange(n))
        rows += [(int(i), int(low[g])) for i, g in enumerate(group) if low[g] != i]
    frame = spark.createDataFrame(rows, "u long, v long").repartition(16)
    links = components.contracted(frame)
    assert links.count() < 1.1 * n
    assert links.select("v").distinct().count() < 20


def test_nothing(spark):
    assert op.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_smallest_reachable():
    a, b = np.array([5, 3, 9, 1, 7]), np.array([3, 8, 1, 0, 9])
    assert components.smallest_reachable(10, a, b).tolist() == [0, 0, 2, 3, 4, 3, 6, 0, 3, 0]


def test_portions_of_never_null_columns(monkeypatch):
    """Batches as Spark hands them over for columns without nulls, more than one portion of them."""
    monkeypatch.setattr(components, "FOREST_EDGES", 6)
    never = pa.schema([pa.field("u", pa.int64(), nullable=False), pa.field("v", pa.int64(), nullable=False)])
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 1]), pa.array([2, 3, 1, 2])], schema=never) for _ in range(5)]
    links = [(u, v) for found in components._forest(batches) for u, v in zip(*(c.to_pylist() for c in found.columns))]
    assert sorted(links) == [(2, 1), (3, 1)]
