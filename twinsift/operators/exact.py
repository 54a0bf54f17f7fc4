"""Exact duplicates: items with equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import content_hash, head_hash, is_entry, container_of, tail_hash
from . import skew
from .durable import reused


def fingerprint_items(items: DataFrame, content: str = "content") -> DataFrame:
    """Replace the content by its hash (and its size where that is missing)."""
    out = items.withColumn("hash", content_hash(F.col(content)))
    if "size" not in items.columns:
        out = out.withColumn("size", F.octet_length(content).cast("bigint"))
    return out.drop(content)


def min_size_filter(items: DataFrame, min_kib: int = 0) -> DataFrame:
    if min_kib <= 0:
        return items
    return items.where(F.col("size") >= min_kib * 1024)


def repeated(items: DataFrame, keys: list[str], hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Items whose key values occur more than once.

    The count is a hash aggregate with map-side partials over the key columns
    only; a frequent key is divided when it is joined back.
    """
    key = F.struct(*keys)
    counts = items.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return skew.join_to_groups(
        items.withColumn("_key", key), counts, "_key", "_n", "path", hot_rows
    ).drop("_key", "_n")


def size_candidates(items: DataFrame) -> DataFrame:
    """Items sharing their size with another one; nothing else can be equal."""
    return repeated(items, ["size"])


def head_tail_candidates(items: DataFrame, content: str = "content", kib: int = 64) -> DataFrame:
    """Items whose size, head and then tail occur again. ``kib = 0`` skips this.

    Worth its extra shuffles where reading a whole item is expensive (files).
    For table rows the content is already in memory: hash it directly.
    """
    if kib <= 0:
        return items
    narrow = items.withColumn("head", head_hash(F.col(content), kib))
    narrow = repeated(narrow, ["size", "head"])
    narrow = narrow.withColumn("tail", tail_hash(F.col(content), kib))
    return repeated(narrow, ["size", "head", "tail"]).drop("head", "tail")


def duplicate_members(items: DataFrame, key: str = "hash", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Items whose key occurs more than once, with ``n``, ``savable`` and ``keep``.

    The first aggregate runs over all items and moves only keys and two
    numbers. Paths, needed to pick the first member, are compared among the
    duplicates alone. ``items`` is read twice: pass something cheap to read.
    """
    keyed = items.where(F.col(key).isNotNull())
    counts = keyed.groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("_total")).where("n > 1")
    members = reused(skew.join_to_groups(keyed, counts, key, "n", "path", hot_rows))
    firsts = members.groupBy(key).agg(
        F.min(F.struct("path", "size")).alias("_first"), F.count("*").alias("_n")
    )
    return (
        skew.join_to_groups(members, firsts, key, "_n", "path", hot_rows)
        .withColumn("savable", F.col("_total") - F.col("_first.size"))
        .withColumn("keep", F.col("path") == F.col("_first.path"))
        .drop("_total", "_first", "_n")
    )


def exact_duplicates(
    items: DataFrame,
    content: str | None = "content",
    min_kib: int = 0,
    staged: bool = False,
    head_kib: int = 64,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Members of all groups of equal content.

    ``items`` needs ``path`` and either a content column or (``content=None``)
    a ready ``hash`` and ``size``. Content is read and hashed once; only the
    narrow rows are kept for the group aggregate and the join back to members.
    ``staged`` first drops items by size, head and tail.
    """
    if content is not None:
        if "size" not in items.columns:
            items = items.withColumn("size", F.octet_length(content).cast("bigint"))
        items = min_size_filter(items, min_kib)
        if staged:
            items = head_tail_candidates(size_candidates(items), content, head_kib)
        items = reused(fingerprint_items(items, content))
    else:
        items = min_size_filter(items, min_kib)
    return duplicate_members(items, hot_rows=hot_rows)


def drop_single_container_groups(members: DataFrame, key: str = "hash",
                                 hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Drop groups that consist only of entries of one and the same container."""
    container = F.when(is_entry(F.col("path")), container_of(F.col("path")))
    kept = (
        members.groupBy(key)
        .agg(
            F.count("*").alias("_n"),
            F.bool_and(is_entry(F.col("path"))).alias("_inside"),
            F.min(container).alias("_lo"),
            F.max(container).alias("_hi"),
        )
        .where(~(F.col("_inside") & (F.col("_lo") == F.col("_hi"))))
        .select(key, "_n")
    )
    return skew.join_to_groups(members, kept, key, "_n", "path", hot_rows).drop("_n")


def _link(items: DataFrame) -> list[str]:
    return [c for c in ("device", "inode", "size") if c in items.columns]


def hardlink_groups(items: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Items that are the same (device, inode, size): one is kept, none is read.

    Without a ``device`` column all items are taken to be on one device.
    """
    keyed = items.where(F.col("inode").isNotNull()).withColumn("link", F.concat_ws(":", *_link(items)))
    return duplicate_members(keyed, "link", hot_rows)


def hardlink_representatives(items: DataFrame) -> DataFrame:
    """One item per (device, inode, size) for hashing; items without inode all stay."""
    columns = items.columns
    linked = items.where(F.col("inode").isNotNull())
    one = linked.groupBy(*_link(items)).agg(
        F.min_by(F.struct(*columns), F.col("path")).alias("_item")
    ).select("_item.*")
    return items.where(F.col("inode").isNull()).unionByName(one)


def skip_known_duplicates(items: DataFrame, members: DataFrame) -> DataFrame:
    """Items that are not a second or later member of an exact group."""
    known = members.where(~F.col("keep")).select("path")
    return items.join(known, "path", "left_anti")
