"""A Merkle manifest of a dataset, with proofs by pointer jumping.

The rows of a source are the leaves of its tree, ordered by id; the sources'
roots are the leaves of the tree above. Every node holds a pointer to an
ancestor and the siblings met on the way there, as one segment per level.
Joining the table of pointers with itself doubles the distance and puts the
segments together, until every node points to the root.

The sixteen leaves of a run have the same way up, so pointers are kept for the
nodes above the leaves alone; the leaves take the last jump, by which each
adds the other leaves of its run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import global_position
from .common import durable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1                   # number of the tree over the sources
_SEGMENTS = "array<struct<left:binary,right:binary>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the fields, each as its length in bytes, a colon and its value, or a dash for null."""
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[one(c) for c in fields]).cast("binary"), 256)


def _hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(_hex(s["left"]), h, _hex(s["right"])).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of all siblings of a proof as hex text, level by level, left to right."""
    flat = F.array_join(F.transform(proof, lambda s: _hex(F.concat(s["left"], s["right"]))), "")
    return F.sha2(flat.cast("binary"), 256)


def _beside(digests: Column, at: Column) -> Column:
    """The segment of the member at position ``at`` (from 0): what stands left and right of it."""
    joined = lambda part: F.unhex(F.array_join(part, ""))
    return F.struct(joined(F.slice(digests, F.lit(1), at)).alias("left"),
                    joined(F.slice(digests, at + 2, F.size(digests))).alias("right"))


def _node(tree: Column, level: int, i: Column) -> Column:
    return F.concat_ws(":", tree, F.lit(level), i)


def _up(c: str, arity: int) -> Column:
    return F.ceil(F.col(c) / arity)


def _climb(nodes: DataFrame, arity: int, final: Column) -> tuple[list[DataFrame], DataFrame]:
    """Pointers (node, anc, seg) of all nodes below the tops of their trees, and the tops (tree, digest).

    ``nodes`` have tree, i, n (nodes of the tree at this level), digest.
    ``final`` is what the top of a tree is called.
    """
    pointers, tops, level = [], None, 0
    while True:
        alone = nodes.where("n = 1").select("tree", "digest")
        tops = alone if tops is None else tops.unionByName(alone)
        runs = durable(nodes.where("n > 1").groupBy("tree", F.floor(F.col("i") / arity).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("run"), F.first("n").alias("n")))
        if runs.isEmpty():
            return pointers, tops
        runs = runs.withColumn("n", _up("n", arity))
        above = F.when(F.col("n") == 1, final).otherwise(_node(F.col("tree"), level + 1, F.col("up")))
        members = runs.select("tree", above.alias("anc"), F.col("run.digest").alias("digests"), F.posexplode("run").alias("at", "one"))
        pointers.append(members.select(
            _node(F.col("tree"), level, F.col("one.i")).alias("node"), "anc",
            F.array(_beside(F.col("digests"), F.col("at"))).alias("seg")))
        nodes = runs.select("tree", F.col("up").alias("i"), "n", F.sha2(F.array_join("run.digest", "").cast("binary"), 256).alias("digest"))
        level += 1


def _jump(pointers: DataFrame) -> DataFrame:
    """Double the distance of the pointers until all reach the root."""
    pointers = durable(pointers)
    while True:
        open_ = pointers.where(F.col("anc").isNotNull())
        if open_.isEmpty():
            return pointers
        next_ = pointers.select(F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("seg").alias("_seg"), F.col("subroot").alias("_sub"))
        pointers = durable(open_.join(next_, "anc").select(
            "node", F.col("_anc").alias("anc"), F.concat("seg", "_seg").alias("seg"),
            F.coalesce("subroot", "_sub").alias("subroot"),
        ).unionByName(pointers.where(F.col("anc").isNull())))


def manifest(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", source_col: str = "source",
    fields: Sequence[str] = FIELDS, carry: Mapping[str, Column] | None = None, arity: int = 16,
) -> DataFrame:
    """The ``keep`` columns of every row, ``carry``'s, leaf, subroot, root and proof.

    Leaves are digests of ``fields``. Those of a source ascend by id; every
    ``arity`` consecutive nodes, fewer at the end, are one node above. Roots
    of sources, in the order of their names, have the same kind of tree.
    ``proof`` is an array of (left, right): digests, 32 bytes each, that stand
    left and right of the way to the root, from the leaf up; ``fold`` follows
    it. ``carry`` names further columns computed from a row in the same pass.

    Missing ids and a missing source come first; null fields have a digest
    of their own. Rows of equal ids follow their leaves, equal rows are leaves
    each. Only ``fields`` are read, long texts once. An empty table gives no
    rows. Columns not in ``keep`` are left out.
    """
    carry = dict(carry or {})
    leaf = leaf_digest([F.col(c) for c in fields])
    rows = durable(docs.select(
        F.struct(F.struct(*[F.col(c) for c in keep]).alias("keep"), F.struct(F.lit(0).alias("_"), *[
            c.alias(name) for name, c in carry.items()]).alias("carry")).alias("row"),
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), leaf.alias("leaf"),
        F.monotonically_increasing_id().alias("at")))
    asc = lambda *names: [F.col(c).asc_nulls_first() for c in names]
    placed = global_position(rows, asc("source", "id", "leaf", "at"))
    # One row per source; leaves of a source are a range of positions.
    sources = global_position(
        placed.groupBy("source").agg(F.min("position").alias("first"), F.count("*").alias("n")), asc("source"), "tree")
    sources = durable(sources)
    count = sources.count()
    numbered = placed.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    i = F.col("position") - F.col("first")
    runs = durable(numbered.groupBy((F.col("tree") - 1).alias("tree"), F.floor(i / arity).alias("i")).agg(
        F.sort_array(F.collect_list(F.struct(i.alias("i"), "leaf", "row"))).alias("run"), F.first("n").alias("n")))
    joined = F.sha2(F.array_join("run.leaf", "").cast("binary"), 256)
    below = runs.select("tree", "i", _up("n", arity).alias("n"), F.when(
        F.col("n") == 1, F.get("run.leaf", F.lit(0))).otherwise(joined).alias("digest"))
    subroot_name = lambda tree: _node(F.lit(_TOP), 0, tree)
    # The root of a single source is the root of all, which no pointer leaves.
    lower, tops = _climb(below, arity, subroot_name(F.col("tree")) if count > 1 else F.lit(None).cast("string"))
    subroots = durable(tops.select(
        F.lit(_TOP).alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), "digest"))
    upper, root = _climb(subroots, arity, F.lit(None).cast("string"))
    root = root.first()
    root = F.lit(root.digest if root else None).cast("string")
    pointers = docs.sparkSession.createDataFrame([], f"node string, anc string, seg {_SEGMENTS}")
    for found in [*lower, *upper]:
        pointers = pointers.unionByName(found)
    names = subroots.select(subroot_name(F.col("i")).alias("node"), F.col("digest").alias("subroot"))
    ways = _jump(pointers.join(names, "node", "left"))
    mine = F.when(F.col("n") <= arity, subroot_name(F.col("tree"))).otherwise(_node(F.col("tree"), 0, F.col("i")))
    leaves = runs.withColumn("node", mine).join(ways.drop("anc"), "node", "left").select(
        "n", "seg", "subroot", F.col("run.leaf").alias("digests"), F.posexplode("run").alias("at", "one"))
    none = F.array().cast(_SEGMENTS)
    own = F.when(F.col("n") > 1, F.array(_beside(F.col("digests"), F.col("at")))).otherwise(none)
    return leaves.select(
        "one.row.keep.*", *[F.col(f"one.row.carry.{c}").alias(c) for c in carry], F.col("one.leaf").alias("leaf"),
        F.coalesce("subroot", root).alias("subroot"), root.alias("root"),
        F.concat(own, F.coalesce("seg", none)).alias("proof"))
