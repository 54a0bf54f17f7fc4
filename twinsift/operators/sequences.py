"""Similarity of fingerprint sequences (one fingerprint per sampled frame).

``sequences`` tables have ``id`` and ``frames``, an array of fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import aligned_distance, mean_min_distance
from . import skew
from .components import connected_components
from .durable import durable
from .hamming import HOT_BUCKET, MAX_THRESHOLD, near_pairs

PER_TASK = 64           # a part of a frame has this fraction of what a hot key has
HOT_FRAME = 1_000       # frames shown more often are not used to find candidates
HOT_SLACK = 1.5         # up to a third of a sequence may be hot

_DISTANCES = {"mean_min": mean_min_distance, "aligned": aligned_distance}


def sequence_classes(sequences: DataFrame) -> DataFrame:
    """(frames, rep, n): equal sequences once, with their smallest id. Empty ones are left out."""
    return (
        sequences.where(F.size("frames") > 0)
        .groupBy("frames").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    )


def _meet(left: DataFrame, touching: DataFrame, right: DataFrame, kinds: DataFrame, hot_rows: int) -> DataFrame:
    """(a, b) for every frame of ``left`` that touches a frame of ``right``.

    A frame many sequences show is divided over tasks.
    """
    parts = F.ceil(F.col("in_") / F.lit(max(hot_rows // PER_TASK, 1)))
    weights = kinds.select(F.col("h").alias("h_a"), F.greatest(parts, F.lit(1)).cast("int").alias("_parts"))
    one = left.select(F.col("rep").alias("a"), F.col("h").alias("h_a")).join(weights, "h_a").withColumn(
        "_part", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int")
    ).drop("_parts")
    every = touching.select("h_a", "h_b").join(weights, "h_a").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    ).drop("_parts")
    other = right.select(F.col("rep").alias("b"), F.col("h").alias("h_b"))
    return other.join(every, "h_b").join(one, ["h_a", "_part"]).select("a", "b")


def _touching(kinds: DataFrame, threshold: float, hot_bucket: int, of: str | None = None) -> DataFrame:
    """(h_a, h_b, dist): frames within the threshold, equal ones included.

    ``of`` names a flag: only frames that have it are looked at from.
    """
    columns = ["h"] if of is None else ["h", of]
    near = near_pairs(
        kinds, math.floor(threshold), columns, hot_bucket, both_ways=True,
        condition=None if of is None else F.col(f"l.{of}"),
    ).select("h_a", "h_b", "dist")
    same = kinds if of is None else kinds.where(of)
    return near.unionByName(same.select(
        F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(0).cast("bigint").alias("dist")
    ))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(classes: DataFrame, threshold: float, hot_bucket: int, hot_rows: int, hot_frame: int) -> DataFrame:
    """(a, b): all pairs that can be within the threshold, and not many more.

    Both distances are means over the frames of one sequence (for the aligned
    one, the shorter), so a pair within the threshold has a pair of frames
    within it. Equal frames are compared once, however many sequences show
    them.
    """
    shown = durable(classes.select("rep", F.explode(F.array_distinct("frames")).alias("h")))
    kinds = durable(shown.groupBy("h").agg(F.count("*").alias("in_")))
    if kinds.where(F.col("in_") > hot_frame).isEmpty():
        return _unordered(_meet(shown, _touching(kinds, threshold, hot_bucket), shown, kinds, hot_rows))
    return _candidates_beside_hot(classes, shown, kinds, threshold, hot_bucket, hot_rows, hot_frame)


def _candidates_beside_hot(classes: DataFrame, shown: DataFrame, kinds: DataFrame, threshold: float,
                           hot_bucket: int, hot_rows: int, hot_frame: int) -> DataFrame:
    """Candidates when some frames (black, title cards) are shown by very many sequences.

    A frame is hot when it and the frames around it are shown more than
    ``hot_frame`` times. A sequence with n frames, r of them not hot, that is
    within the threshold t of another has one of these r within t * n / r of a
    frame of the other: the r distances sum to t * n at most. So sequences that
    are at least two thirds not hot are looked up by those frames alone, with
    their own limit. The others are looked up by all their frames.
    """
    slack = min(HOT_SLACK, MAX_THRESHOLD / max(threshold, 1.0))
    widest = threshold * slack + 1e-9
    around = near_pairs(kinds, math.floor(widest), ["in_"], hot_bucket, both_ways=True).groupBy(
        F.col("h_a").alias("h")
    ).agg(F.sum("in__b").alias("_near"))
    cold = durable(kinds.join(around, "h", "left").select(
        "h", "in_", (F.col("in_") + F.coalesce("_near", F.lit(0)) <= hot_frame).alias("cold")
    ))
    positions = classes.select("rep", F.explode("frames").alias("h")).join(cold.select("h", "cold"), "h")
    limits = durable(positions.groupBy("rep").agg(
        F.count("*").alias("n"), F.count_if("cold").alias("r")
    ).select("rep", F.when(
        # The small addition guards whole limits against a quotient just below.
        F.col("n") <= F.col("r") * F.lit(slack), F.floor(F.col("n") * F.lit(threshold) / F.col("r") + 1e-9)
    ).alias("limit")))
    flagged = shown.join(limits, "rep").join(cold.select("h", "cold"), "h")
    strong = flagged.where("limit IS NOT NULL AND cold")
    weak = durable(flagged.where("limit IS NULL").select("rep", "h"))
    by_cold = (
        strong.select(F.col("rep").alias("a"), F.col("h").alias("h_a"), "limit")
        .join(_touching(cold, widest, hot_bucket, of="cold"), "h_a").where(F.col("dist") <= F.col("limit"))
        .join(shown.select(F.col("rep").alias("b"), F.col("h").alias("h_b")), "h_b")
        .select("a", "b")
    )
    if weak.isEmpty():
        return _unordered(by_cold)
    in_weak = weak.select("h").distinct().withColumn("weak", F.lit(True))
    marked = durable(kinds.join(in_weak, "h", "left").select("h", "in_", F.coalesce("weak", F.lit(False)).alias("weak")))
    by_all = _meet(weak, _touching(marked, threshold, hot_bucket, of="weak"), shown, kinds, hot_rows)
    return _unordered(by_cold.unionByName(by_all))


def _class_pairs(classes: DataFrame, threshold: float, measure: str, hot_bucket: int, hot_rows: int,
                 hot_frame: int) -> DataFrame:
    """(a, b, dist) over class representatives, a < b, dist <= threshold."""
    distance = _DISTANCES[measure]
    arrays_a = classes.select(F.col("rep").alias("a"), F.col("frames").alias("_fa"))
    arrays_b = classes.select(F.col("rep").alias("b"), F.col("frames").alias("_fb"))
    return (
        _candidates(classes, threshold, hot_bucket, hot_rows, hot_frame)
        .join(arrays_a, "a").join(arrays_b, "b")
        .select("a", "b", distance(F.col("_fa"), F.col("_fb")).alias("dist"))
        .where(F.col("dist") <= threshold)
    )


def sequence_similarity_join(
    sequences: DataFrame,
    threshold: float = 10.0,
    measure: str = "mean_min",
    hot_bucket: int = HOT_BUCKET,
    hot_rows: int = skew.HOT_ROWS,
    hot_frame: int = HOT_FRAME,
) -> DataFrame:
    """Pairs of different sequences within the threshold.

    (id_a, id_b, dist, n_a, n_b): ``id_a`` stands for the ``n_a`` items that
    have its exact frames; see ``sequence_classes`` for who they are.
    """
    classes = durable(sequence_classes(sequences))
    pairs = _class_pairs(classes, threshold, measure, hot_bucket, hot_rows, hot_frame)
    a = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"))
    b = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(a, "a").join(b, "b").select(
        F.col("a").alias("id_a"), F.col("b").alias("id_b"), "dist", "n_a", "n_b"
    )


def _grouped(classes: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """(rep, root, far) of every class at the given limit."""
    near = pairs.where(F.col("dist") <= limit)
    roots = connected_components(near, "a", "b").withColumnsRenamed({"node": "rep", "component": "root"})
    far = near.select(F.col("a").alias("rep"), "dist").unionByName(
        near.select(F.col("b").alias("rep"), "dist")
    ).groupBy("rep").agg(F.max("dist").alias("far"))
    return classes.select("rep", "n").join(roots, "rep", "left").join(far, "rep", "left").select(
        "rep", "n", F.coalesce("root", "rep").alias("root"), F.coalesce("far", F.lit(0.0)).alias("far")
    )


def _to_items(sequences: DataFrame, classes: DataFrame, grouped: DataFrame, hot_rows: int) -> DataFrame:
    labelled = classes.select("frames", "rep", "n").join(grouped.drop("n"), "rep")
    kept = sequences.where(F.size("frames") > 0)
    return skew.join_to_groups(kept, labelled.drop("rep"), "frames", "n", "id", hot_rows, settle=True).select(
        *[c for c in sequences.columns if c != "frames"],
        F.size("frames").cast("bigint").alias("frame_count"), "root", "members", "category",
    )


def similar_sequences(
    sequences: DataFrame,
    exact: float = 3.0,
    similar: float = 10.0,
    measure: str = "mean_min",
    hot_bucket: int = HOT_BUCKET,
    hot_rows: int = skew.HOT_ROWS,
    hot_frame: int = HOT_FRAME,
) -> DataFrame:
    """Items with ``root``, ``category`` and ``frame_count``; one grouping.

    A group is ``exact`` when no two neighbours in it are further apart than
    ``exact``.
    """
    classes = durable(sequence_classes(sequences))
    pairs = durable(_class_pairs(classes, similar, measure, hot_bucket, hot_rows, hot_frame))
    parts = durable(_grouped(classes, pairs, similar))
    groups = (
        parts.groupBy("root").agg(F.sum("n").alias("members"), F.max("far").alias("_far"))
        .where("members > 1")
        .select("root", "members", F.when(F.col("_far") <= exact, "exact").otherwise("similar").alias("category"))
    )
    grouped = skew.join_to_groups(parts.drop("far"), groups, "root", "members", "rep", hot_rows, settle=True)
    return _to_items(sequences, classes, grouped, hot_rows)


def similar_sequences_two_level(
    sequences: DataFrame,
    exact: float = 3.0,
    similar: float = 10.0,
    measure: str = "mean_min",
    hot_bucket: int = HOT_BUCKET,
    hot_rows: int = skew.HOT_ROWS,
    hot_frame: int = HOT_FRAME,
) -> DataFrame:
    """Exact groups, and similar groups that have no member in an exact one."""
    classes = durable(sequence_classes(sequences))
    pairs = durable(_class_pairs(classes, max(exact, similar), measure, hot_bucket, hot_rows, hot_frame))
    near = durable(_grouped(classes, pairs, exact))
    exact_groups = near.groupBy("root").agg(F.sum("n").alias("members")).where("members > 1")
    exact_parts = skew.join_to_groups(near.drop("far"), exact_groups, "root", "members", "rep", hot_rows, settle=True)
    taken = exact_parts.select("rep", F.lit(True).alias("_taken"))
    wide = durable(_grouped(classes, pairs, similar).drop("far").join(taken, "rep", "left"))
    similar_only = (
        wide.groupBy("root")
        .agg(F.sum("n").alias("members"), F.max(F.coalesce("_taken", F.lit(False))).alias("_mixed"))
        .where("members > 1 AND NOT _mixed").drop("_mixed")
    )
    similar_parts = skew.join_to_groups(wide.drop("_taken"), similar_only, "root", "members", "rep", hot_rows, settle=True)
    grouped = exact_parts.withColumn("category", F.lit("exact")).unionByName(
        similar_parts.withColumn("category", F.lit("similar"))
    )
    return _to_items(sequences, classes, grouped, hot_rows)


def sample_frames(frames: DataFrame, positions: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """Pick the rows of an ordered table at the wanted positions.

    ``positions`` has ``key`` and ``positions`` (array of frame indexes).
    """
    wanted = positions.select(key, F.posexplode("positions").alias("sample", frame))
    return frames.join(wanted, [key, frame])
