"""Summaries over result members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import format_size, short_hash, tab_type
from .review import group_facts


def scan_summary(members: DataFrame, key: str = "group_id") -> DataFrame:
    """Number of groups and members, and bytes that copies occupy."""
    return group_facts(members, [key]).agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("members"),
        F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"),
    )


def type_stats(members: DataFrame) -> DataFrame:
    """Members, bytes and whole percent per type, and a ``total`` row."""
    typed = members.select(tab_type(F.col("path"), F.col("tab")).alias("type"), "size")
    table = typed.rollup("type").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.grouping("type").alias("_all")
    )
    # The table has one row per type: the window sees seven rows at most.
    return table.withColumn("_total", F.max("n").over(Window.partitionBy())).select(
        F.when(F.col("_all") == 1, "total").otherwise(F.col("type")).alias("type"),
        "n",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.floor(F.col("n") * 100 / F.col("_total") + 0.5).cast("bigint").alias("percent"),
    )


def tab_badges(members: DataFrame) -> DataFrame:
    """Groups and bytes per result table."""
    return (
        members.groupBy("tab", "group_id").agg(F.sum("size").alias("_bytes"))
        .groupBy("tab").agg(F.count("*").alias("groups"), F.sum("_bytes").alias("bytes"))
    )


def removal_stats(members: DataFrame) -> DataFrame:
    """Per table: groups, members marked for removal, and their bytes."""
    gone = ~F.col("keep")
    return (
        members.groupBy("tab", "group_id").agg(
            F.count_if(gone).alias("_n"), F.sum(F.when(gone, F.col("size")).otherwise(0)).alias("_bytes")
        )
        .groupBy("tab").agg(
            F.count("*").alias("groups"), F.sum("_n").alias("remove"), F.sum("_bytes").alias("remove_bytes")
        )
    )


def overlap_header(members: DataFrame) -> DataFrame:
    """One line per group: its size and what its members have in common."""
    facts = members.groupBy("tab", "group_id").agg(
        F.count("*").alias("n"),
        F.max("shared").alias("shared"),
        F.max("category").alias("category"),
        F.min(F.struct("path", "hash")).alias("_first"),
    )
    hash_ = F.coalesce("_first.hash", F.lit(""))
    label = (
        F.when(F.col("tab") == "archive", F.concat_ws(" ", F.lit("shared"), F.col("shared")))
        .when(F.col("tab").isin("image", "video"), F.when(F.col("category") == "exact", "exact").otherwise("similar"))
        .otherwise(hash_)
    )
    return facts.select("tab", "group_id", "n", label.alias("label"))


def member_lines(members: DataFrame, style: str = "report") -> DataFrame:
    """Members with display columns: short hash and readable size."""
    return members.withColumn("short", short_hash(F.col("hash"))).withColumn(
        "size_text", format_size(F.col("size"), style)
    )
