"""Groups of items with similar fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import skew
from .components import connected_components
from .durable import durable
from .hamming import HOT_BUCKET, collapse, near_pairs


def _linked(fingerprints: DataFrame, threshold: int, hot_bucket: int, hot_rows: int) -> DataFrame:
    """(rep, root, far): component of every fingerprint that has a neighbour.

    ``far`` is the largest distance from it to one of its neighbours.

    Two passes over the near pairs, neither of which stores them. The first
    keeps per fingerprint only the smallest neighbour and the largest distance
    (a map-side aggregate). Joining everyone to its smallest neighbour already
    merges dense clusters, so the second pass has to report only which of
    these labels touch each other.
    """
    pairs = near_pairs(fingerprints, threshold, ["rep"], hot_bucket, both_ways=True)
    around = durable(
        pairs.groupBy(F.col("rep_a").alias("rep"), F.col("h_a").alias("h")).agg(
            F.min("rep_b").alias("_low"), F.max("dist").alias("far")
        ).select("rep", "h", "far", F.least("rep", "_low").alias("label"))
    )
    touching = near_pairs(
        around, threshold, ["label"], hot_bucket,
        condition=F.col("l.label") != F.col("r.label"),
    ).select(
        F.greatest("label_a", "label_b").alias("src"), F.least("label_a", "label_b").alias("dst")
    )
    links = around.select(F.col("rep").alias("src"), F.col("label").alias("dst")).unionByName(touching)
    roots = connected_components(links, hot_rows=hot_rows).withColumnsRenamed(
        {"node": "rep", "component": "root"}
    )
    return around.select("rep", "far").join(roots, "rep")


def _components(fingerprints: DataFrame, threshold: int, hot_bucket: int, hot_rows: int) -> DataFrame:
    """(h, rep, n, root, far) for all fingerprints, alone ones included."""
    if threshold <= 0:
        return fingerprints.select("h", "rep", "n", F.col("rep").alias("root"), F.lit(0).cast("bigint").alias("far"))
    linked = _linked(fingerprints, threshold, hot_bucket, hot_rows)
    return fingerprints.join(linked, "rep", "left").select(
        "h", "rep", "n",
        F.coalesce("root", "rep").alias("root"),
        F.coalesce("far", F.lit(0)).cast("bigint").alias("far"),
    )


def _to_items(items: DataFrame, grouped: DataFrame, fingerprint: str, hot_rows: int) -> DataFrame:
    """Give each item the group of its fingerprint."""
    return skew.join_to_groups(
        items.where(F.col(fingerprint).isNotNull()).withColumn("h", F.col(fingerprint)),
        grouped, "h", "n", "id", hot_rows, settle=True,
    ).drop(*(["n"] + (["h"] if fingerprint != "h" else [])))


def similar_groups(
    items: DataFrame,
    exact: int = 0,
    similar: int = 10,
    fingerprint: str = "h",
    hot_bucket: int = HOT_BUCKET,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Items (``id`` and a fingerprint) with ``root`` and ``category``.

    Groups are the components at the ``similar`` threshold. A group is
    ``exact`` when no two neighbours in it differ by more than ``exact`` bits.
    """
    parts = durable(_components(durable(collapse(items, fingerprint)), similar, hot_bucket, hot_rows))
    groups = (
        parts.groupBy("root").agg(F.sum("n").alias("members"), F.max("far").alias("_far"))
        .where("members > 1")
        .select("root", "members", F.when(F.col("_far") <= exact, "exact").otherwise("similar").alias("category"))
    )
    grouped = skew.join_to_groups(parts.select("h", "n", "root"), groups, "root", "members", "h", hot_rows, settle=True)
    return _to_items(items, grouped, fingerprint, hot_rows)


def similar_groups_two_level(
    items: DataFrame,
    exact: int = 0,
    similar: int = 10,
    fingerprint: str = "h",
    hot_bucket: int = HOT_BUCKET,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Two independent groupings.

    Components at ``exact`` are the exact groups. Components at ``similar``
    count only when none of their members is in an exact group.
    """
    fingerprints = durable(collapse(items, fingerprint))
    near = durable(_components(fingerprints, exact, hot_bucket, hot_rows))
    exact_groups = near.groupBy("root").agg(F.sum("n").alias("members")).where("members > 1")
    exact_parts = skew.join_to_groups(near.select("h", "n", "root"), exact_groups, "root", "members", "h", hot_rows, settle=True)
    taken = exact_parts.select("h", F.lit(True).alias("_taken"))
    wide = durable(_components(fingerprints, similar, hot_bucket, hot_rows).join(taken, "h", "left"))
    similar_only = (
        wide.groupBy("root")
        .agg(F.sum("n").alias("members"), F.max(F.coalesce("_taken", F.lit(False))).alias("_mixed"))
        .where("members > 1 AND NOT _mixed").drop("_mixed")
    )
    similar_parts = skew.join_to_groups(
        wide.select("h", "n", "root"), similar_only, "root", "members", "h", hot_rows, settle=True
    )
    grouped = exact_parts.withColumn("category", F.lit("exact")).unionByName(
        similar_parts.withColumn("category", F.lit("similar"))
    )
    return _to_items(items, grouped, fingerprint, hot_rows)
