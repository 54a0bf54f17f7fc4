"""Reusing fingerprints of items that have not changed.

A cache row is (path, size, mtime) with any of ``hash``, ``phash`` and
``frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["path", "size", "mtime"]
VALUES = ["hash", "phash", "frames"]


def cache_lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Attach stored fingerprints to unchanged items; others get nulls."""
    known = [c for c in VALUES if c in cache.columns]
    return items.drop(*known).join(cache.select(*KEY, *known), KEY, "left")


def cache_misses(items: DataFrame, cache: DataFrame, column: str = "hash") -> DataFrame:
    """Items whose fingerprint still has to be computed."""
    return items.join(cache.where(F.col(column).isNotNull()).select(*KEY), KEY, "left_anti")


def merge_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key; per column the new value where there is one, else the old."""
    both = old.withColumn("_age", F.lit(0)).unionByName(
        new.withColumn("_age", F.lit(1)), allowMissingColumns=True
    )
    values = [c for c in VALUES if c in both.columns]
    return both.groupBy(*KEY).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in values
    ])
