"""Deciding what to keep: marks, rules, plans, and applying them.

Result members are one row per (``tab``, ``group_id``, ``path``) with ``size``
and ``keep``; group facts are aggregates over them. All per-group choices are
plain aggregates joined back, so no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import container_of, is_entry, origin_score, rule_score
from . import skew
from .ranking import global_position


def _with_group(members: DataFrame, groups: DataFrame, key: str, hot_rows: int) -> DataFrame:
    return skew.join_to_groups(members, groups, key, "_n", "path", hot_rows).drop("_n")


def keep_first(members: DataFrame, key: str = "group_id", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Keep the member with the smallest path of each group."""
    groups = members.groupBy(key).agg(F.count("*").alias("_n"), F.min("path").alias("_first"))
    return _with_group(members, groups, key, hot_rows).withColumn(
        "keep", F.col("path") == F.col("_first")
    ).drop("_first")


def keep_original(members: DataFrame, key: str = "group_id", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Keep the member most likely to be the original; the first path on ties."""
    scored = members.withColumn("score", origin_score(F.col("path")))
    groups = scored.groupBy(key).agg(
        F.count("*").alias("_n"), F.min(F.struct("score", "path")).alias("_best")
    )
    return _with_group(scored, groups, key, hot_rows).withColumn(
        "keep", F.col("path") == F.col("_best.path")
    ).drop("_best")


def resolve_keepers(
    members: DataFrame,
    prefer: Sequence[str] = (),
    reject: Sequence[str] = (),
    key: str = "group_id",
    mark: str = "mark",
    hot_rows: int = skew.HOT_ROWS,
    files_only: bool = True,
) -> DataFrame:
    """Add ``status`` and ``remove``.

    ``marked``      every member carries YES or NO: those marks count
    ``ruled``       one member alone has the highest rule score: it stays
    ``unresolved``  neither: nothing is removed

    Container entries have no say and are not removed, unless ``files_only``
    is switched off.
    """
    counts = ~is_entry(F.col("path")) if files_only else F.lit(True)
    said = F.upper(F.trim(F.coalesce(F.col(mark), F.lit(""))))
    scored = members.withColumn("_said", said).withColumn("_counts", counts).withColumn(
        "score", rule_score(F.col("path"), prefer, reject)
    )
    # Scores are few per group (one per rule combination), so this first
    # aggregate already reduces a large group to a handful of rows.
    by_score = scored.groupBy(key, "score").agg(
        F.count_if("_counts").alias("_rows"),
        F.min(F.when(F.col("_counts"), F.col("path"))).alias("_path"),
        F.bool_and(~F.col("_counts") | F.col("_said").isin("YES", "NO")).alias("_marked"),
    )
    groups = by_score.groupBy(key).agg(
        F.sum("_rows").alias("_n"),
        (F.bool_and("_marked") & (F.sum("_rows") > 0)).alias("_marked"),
        F.max(F.when(F.col("_rows") > 0, F.struct("score", "_rows", "_path"))).alias("_top"),
    )
    has_rules = F.lit(bool(prefer or reject))
    status = (
        F.when(F.col("_marked"), "marked")
        .when(has_rules & (F.col("_top._rows") == 1), "ruled")
        .otherwise("unresolved")
    )
    remove = (
        F.when(F.col("status") == "marked", F.col("_said") == "NO")
        .when(F.col("status") == "ruled", F.col("path") != F.col("_top._path"))
        .otherwise(F.lit(False))
    )
    return (
        _with_group(scored, groups, key, hot_rows)
        .withColumn("status", status).withColumn("remove", F.col("_counts") & remove)
        .drop("_said", "_counts", "_marked", "_top")
    )


def unresolved_sample(resolved: DataFrame, n: int = 10, key: str = "group_id") -> DataFrame:
    """The first ``n`` unresolved groups and how many more there are."""
    open_groups = resolved.where(F.col("status") == "unresolved").groupBy(key).agg(
        F.count("*").alias("members")
    )
    rest = open_groups.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))
    return open_groups.orderBy(key).limit(n).withColumn("remaining", rest.scalar())


def group_facts(members: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Per group: members, sizes and the three savable measures.

    ``savable``          all but the first member
    ``savable_by_mark``  members not kept
    ``wasted``           size of the first member, times all others
    """
    first = F.min(F.struct("path", "size"))
    return (
        members.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.sum("size").alias("bytes"),
            F.max("size").alias("largest"),
            first.alias("_first"),
            F.sum(F.when(F.col("keep"), 0).otherwise(F.col("size"))).alias("savable_by_mark"),
            F.max(is_entry(F.col("path")).cast("int")).cast("bigint").alias("has_entry"),
        )
        .withColumn("savable", F.col("bytes") - F.col("_first.size"))
        .withColumn("wasted", F.col("_first.size") * (F.col("n") - 1))
        .drop("_first")
    )


def group_ids(groups: DataFrame, prefix: str = "r", root: str = "root") -> DataFrame:
    """Sequential ids by descending savable bytes, e.g. ``r1``, ``r2``."""
    ranked = global_position(groups, [F.col("savable").desc(), F.col(root).asc()])
    return ranked.withColumn("group_id", F.concat(F.lit(prefix), F.col("position"))).drop("position")


_ORDERS = {
    "savable": "savable", "total": "largest", "count": "n",
    "archive_first": "has_entry", "shared": "shared",
}


def sort_groups(groups: DataFrame, order: str = "savable", key: str = "group_id") -> DataFrame:
    """Add ``position`` in the chosen order; ``none`` keeps the order of the ids."""
    if order == "none":
        return global_position(groups, [F.col(key).asc()])
    return global_position(groups, [F.coalesce(F.col(_ORDERS[order]), F.lit(0)).desc(), F.col(key).asc()])


def mark_groups(
    members: DataFrame,
    keep: bool,
    text: str | None = None,
    group_ids: Sequence[str] | None = None,
    key: str = "group_id",
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Set ``keep`` for all members of the groups chosen by id or by filter text.

    Without either, all groups are marked.
    """
    if group_ids is not None:
        chosen = F.col(key).isin(list(group_ids))
        return members.withColumn("keep", F.when(chosen, F.lit(keep)).otherwise(F.col("keep")))
    if not text:
        return members.withColumn("keep", F.lit(keep))
    hit = F.contains(F.lower(F.col("path")), F.lit(text.lower()))
    groups = members.groupBy(key).agg(F.count("*").alias("_n"), F.bool_or(hit).alias("_hit"))
    return _with_group(members, groups, key, hot_rows).withColumn(
        "keep", F.when(F.col("_hit"), F.lit(keep)).otherwise(F.col("keep"))
    ).drop("_hit")


def toggle_members(members: DataFrame, toggles: DataFrame, keys: Sequence[str] = ("group_id", "path")) -> DataFrame:
    """Flip ``keep`` of the listed members; an even number of flips changes nothing."""
    flips = toggles.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("_flip"))
    flipped = F.coalesce("_flip", F.lit(False))
    return members.join(flips, list(keys), "left").withColumn(
        "keep", F.when(flipped, ~F.col("keep")).otherwise(F.col("keep"))
    ).drop("_flip")


def deletion_plan(members: DataFrame) -> DataFrame:
    """Paths to remove. Container entries cannot be removed on their own.

    A path that any group keeps stays, so plans over several tabs do not undo
    each other; of a group that keeps nothing, the first path stays.
    """
    group = [c for c in ("tab", "group_id") if c in members.columns]
    stays = members.where("keep").select("path")
    if group:
        nothing = members.groupBy(*group).agg(
            F.bool_or("keep").alias("_any"), F.min("path").alias("path")).where("NOT _any")
        stays = stays.unionByName(nothing.select("path"))
    return (
        members.where(~F.col("keep") & ~is_entry(F.col("path")))
        .groupBy("path").agg(F.max("size").alias("size"))
        .join(stays, "path", "left_anti")
    )


def deletion_total(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def apply_deletions(members: DataFrame, deleted: DataFrame, keys: Sequence[str] = ("tab", "group_id"),
                    hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Remove deleted paths from all result tables; keep groups with two or more left."""
    left = members.join(deleted.select("path"), "path", "left_anti")
    group = F.concat_ws("\u0001", *keys)
    counted = left.withColumn("_group", group)
    groups = counted.groupBy("_group").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return _with_group(counted, groups, "_group", hot_rows).drop("_group")


def _on_disk(path: Column) -> Column:
    return F.when(is_entry(path), container_of(path)).otherwise(path)


def drop_missing(members: DataFrame, inventory: DataFrame) -> DataFrame:
    """Members whose file (or container) is still in the inventory."""
    present = inventory.select(F.col("path").alias("_disk"))
    return members.withColumn("_disk", _on_disk(F.col("path"))).join(
        present, "_disk", "left_semi"
    ).drop("_disk")


def missing_paths(members: DataFrame, inventory: DataFrame) -> DataFrame:
    """Distinct member paths whose file (or container) is gone."""
    present = inventory.select(F.col("path").alias("_disk"))
    return members.select("path").distinct().withColumn("_disk", _on_disk(F.col("path"))).join(
        present, "_disk", "left_anti"
    ).drop("_disk")
