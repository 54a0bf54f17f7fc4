"""Near copies by the exact Jaccard similarity of shingle sets.

Fingerprints of the sets and the index of ``simhash`` propose groups with a
wide limit. Within a group each set is compared with that of the group's
smallest node; those it does not settle meet all others of the group, in
cells. Only pairs that are similar enough are linked.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import skew
from ..operators.components import connected_components
from .common import durable, text_of
from .simhash import _CHUNK, HOT_ROWS, _lowest_ids, _raw_texts, in_cells, majority, near_links

_SEED = 42
_CELL = 256     # rows of a block of a group


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words; one of a shorter text, none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size, found = max(1, len(words) - shingle + 1), []
    digest = partial(xxhash.xxh64_intdigest, seed=_SEED)
    for at in range(0, size, _CHUNK):
        part = words[at:at + _CHUNK + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        found.append(np.unique(np.fromiter(map(digest, joined), np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _facts(text: Column, shingle: int, n: int) -> Column:
    """Node (hash of the set) and fingerprint of the set of a text."""

    @F.arrow_udf("struct<node: bigint, code: array<bigint>>")
    def facts(batch: pa.Array) -> pa.Array:
        sets = [shingle_set(t, shingle) for t in _raw_texts(batch)]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=_SEED) for s in sets], np.uint64).view(np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *(majority(s, n) for s in sets)]).view(np.int64)
        codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(nodes), codes], ["node", "code"])

    return facts(text)


def _sets(text: Column, shingle: int) -> Column:
    @F.arrow_udf("binary")
    def sets(batch: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, shingle).tobytes() for t in _raw_texts(batch)], pa.binary())

    return sets(text)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets, 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def _alike(a: Column, b: Column, similarity: float) -> Column:
    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([
            jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity
            for x, y in zip(left, right)], pa.bool_())

    return alike(a, b)


def linked(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, near: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions of similar pairs, such that with the ``near`` ones joined all similar pairs of ``left`` rows are."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    labels = np.arange(len(nodes))
    labels[near] = labels[near].min(initial=len(nodes))
    out, present = [], np.zeros(len(ids), bool)
    for i in np.flatnonzero(left):
        other = labels != labels[i]
        if not other.any():
            break
        mine = ids[starts[i]:starts[i] + sizes[i]]
        present[mine] = True
        shared = np.add.reduceat(present[ids], starts, dtype=np.int64)
        present[mine] = False
        found = np.flatnonzero(other & (shared / (sizes[i] + sizes - shared) >= similarity))
        out += [(int(i), int(j)) for j in found]
        labels[np.isin(labels, labels[found])] = labels[i]
    return out


def _cell(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        left = np.isin(nodes, table.column("node").to_numpy()[table.column("left").to_numpy()])
        near = table.column("near").to_numpy()[first]
        column = table.column("set")
        sets = [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in first]
        pairs = np.array(linked(nodes, sets, left, near, similarity), np.int64).reshape(-1, 2)
        return pa.table({"src": nodes[pairs[:, 0]], "dst": nodes[pairs[:, 1]]})

    return run


def near_copies(
    docs: DataFrame, key: str, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 5, similarity: float = 0.8, limit: int = 60, aim: int = 48, miss: float = 0.02,
    words64: int = 4, hot_nodes: int = 4_096,
) -> DataFrame:
    """The ``keep`` columns of every row, ``node`` (hash of its shingle set) and ``component_id``.

    Rows link if their sets have a Jaccard similarity of ``similarity`` or
    more; ``component_id`` is the smallest id reachable, null if there is none.
    Pairs are proposed within ``limit`` bits, by bands that miss a pair ``aim``
    bits apart with probability ``miss`` at most. ``key`` tells rows apart:
    rows with equal keys have equal texts.

    Null and empty texts have one empty set. Null ids are never the smallest.
    Equal sets are one node, however many rows have them.
    """
    marked = durable(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("_id"), F.col(key).alias("_key"),
        _facts(text_of(text_col), shingle, words64).alias("_f"),
    ).select("_row", "_id", "_key", "_f.*"))
    nodes = durable(marked.groupBy("node").agg(
        F.first("code").alias("code"), F.min("_id").alias("_first"), F.min("_key").alias("_key")))
    proposed = durable(connected_components(near_links(
        nodes.select("node", "code"), limit, words64, hot_nodes, aim, miss)).join(nodes.select("node", "_key"), "node"))
    texts = docs.select(F.col(key).alias("_key"), text_of(text_col).alias("_text")).join(proposed, "_key")
    sets = durable(texts.groupBy("component", "node").agg(F.first("_text").alias("_text")).select(
        "component", "node", _sets(F.col("_text"), shingle).alias("set")).where(F.length("set") > 0))
    others = sets.where("node <> component")
    # A group's rows are divided by their number wherever they meet the group's facts.
    counts = sets.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    pivots = sets.where("node = component").select("component", F.col("set").alias("_low")).join(counts, "component")
    compared = durable(skew.join_to_groups(others, pivots, "component", "_n", "node", HOT_ROWS, settle=True).select(
        "component", "node", _alike(F.col("set"), F.col("_low"), similarity).alias("near")))
    found = compared.where("near").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    open_ = compared.groupBy("component").agg(F.count("*").alias("_n"), F.count_if(~F.col("near")).alias("_far")).where(
        "_n > 1 AND _far > 0").select("component", "_n")
    doubtful = skew.join_to_groups(compared, open_, "component", "_n", "node", HOT_ROWS, settle=True).drop("_n")
    rest = others.join(doubtful, ["component", "node"]).withColumn("left", ~F.col("near"))
    cells = in_cells(rest, "component", _CELL).select("top", "node", "set", "near", "left")
    found = found.unionByName(cells.groupBy("top").applyInArrow(_cell(similarity), "src long, dst long"))
    return marked.join(_lowest_ids(nodes, found), "node").select("_row.*", "node", "component_id")
