"""Connected components of an edge table.

Before anything is exchanged, every task replaces its edges by a spanning
forest of stars: each node it has met points to the smallest node reachable in
the task. However many edges a node has, it leaves with one link. Dealt by
node, the links of all tasks are contracted once more the same way.

What is left goes through alternating star contraction (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014): every round links each
node's neighbours to the smallest of them. The number of rounds grows with the
logarithm of the longest path, not with the path itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import skew
from .durable import durable


FOREST_EDGES = 2_000_000    # edges a task contracts at once


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges a-b: the smallest node of each one's component."""
    names = np.arange(n)
    while True:
        x, y = names[a], names[b]
        apart = x != y
        if not apart.any():
            return names
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(names, x, low)
        np.minimum.at(names, y, low)
        while True:
            further = names[names]
            if np.array_equal(further, names):
                break
            names = further


def _stars(u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
    """Links (node, smallest node reachable) of all nodes but the smallest ones."""
    nodes = pc.unique(pa.chunked_array([*u.chunks, *v.chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    code = lambda x: pc.index_in(x, value_set=nodes).to_numpy().astype(np.int64)
    names = smallest_reachable(len(nodes), code(u), code(v))
    moved = np.flatnonzero(names != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(names[moved]))], names=["u", "v"])


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract a task's edges, ``FOREST_EDGES`` of them at a time.

    The links of one portion go into the next as long as they are few beside
    it, so a node met all over the task still leaves once.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return _stars(table.column(0), table.column(1))

    for batch in batches:
        if batch.num_rows:
            # Spark marks columns that are never null; the links of a portion are not marked.
            held.append(pa.RecordBatch.from_arrays(batch.columns, names=["u", "v"]))
            size += batch.num_rows
        if size >= FOREST_EDGES:
            done = stars()
            if done.num_rows > FOREST_EDGES // 2:
                yield done
                held, size = [], 0
            else:
                held, size = [done], done.num_rows
    if held:
        yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, with the components of the edges (u, v), few per node.

    A node has a link per task it was met in at most; the tasks that the links
    are dealt to by node join these names, so that the nodes of a dense group
    end with the same, smallest one.
    """
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    return edges.mapInArrow(_forest, schema).repartition("u").mapInArrow(_forest, schema).distinct()


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the smallest neighbour and the number of neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))


def _linked_to_minimum(edges: DataFrame, lows: DataFrame, hot_rows: int, hot: bool) -> DataFrame:
    if not hot:
        return edges.join(lows, "u")
    return skew.join_to_groups(edges, lows, "u", "n", "v", hot_rows, settle=True)


def _large_star(edges: DataFrame, hot_rows: int, hot: bool) -> DataFrame:
    """Link every larger neighbour of u to the smallest node around u."""
    both = edges.select(F.explode(F.array(
        F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    )).alias("e")).select("e.*")
    lows = _neighbour_minimum(both).withColumn("low", F.least("u", "low"))
    linked = _linked_to_minimum(both, lows, hot_rows, hot)
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int, hot: bool) -> DataFrame:
    """``edges`` point from u to a smaller v: link u and its v to the smallest."""
    lows = _neighbour_minimum(edges)
    linked = _linked_to_minimum(edges, lows, hot_rows, hot)
    moved = linked.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether the links are stars already, and the largest number of links of a node.

    Stars: no node has two outgoing links, and no centre is linked further.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("out")),
    )).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("links"))
    row = nodes.agg(
        F.max((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("links") > 1))).alias("unsettled"),
        F.max("links").alias("links"),
    ).first()
    return not row.unsettled, row.links or 0


def connected_components(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Nodes without an edge to another node do not appear. The driver only
    steers the rounds: it asks whether the links have become stars, which every
    round brings closer, so it goes on until they are.
    """
    a, b = F.col(src), F.col(dst)
    links = durable(contracted(edges.where(a != b).select(a.alias("u"), b.alias("v"))))
    while True:
        settled, links_of_one = _shape(links)
        if settled:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        hot = links_of_one > hot_rows
        links = durable(_small_star(_large_star(links, hot_rows, hot), hot_rows, hot))
