"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .durable import durable

HOT_ROWS = 1_000_000    # keys with more rows are spread over several tasks
SHARE = 10_000          # a key of under a 10,000th of the rows is no burden for one task


def join_to_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    count: str,
    spread_by: str,
    hot_rows: int = HOT_ROWS,
    settle: bool = False,
) -> DataFrame:
    """Attach one row per key (``groups``) to many rows per key.

    By default this is the plain join, lazy and visible to the optimizer as a
    whole: the adaptive skew join divides a large key's rows over tasks and
    repeats its one group row, without any list of such keys.

    ``settle`` writes the groups out first, for plans that read them several
    times, and then divides keys itself, by ``groups[count]``: one above the
    limit gets ``count / limit`` parts, all of them, however many keys that
    are. The limit is ``hot_rows`` or a ``SHARE``-th of all rows, so the list
    of such keys that is broadcast has ``SHARE`` rows at most.
    """
    if not settle:
        return rows.join(groups, key)
    groups = durable(groups)
    seen = groups.agg(F.sum(count).alias("rows"), F.max(count).alias("most")).first()
    limit = max(hot_rows, (seen.rows or 0) // SHARE)
    if (seen.most or 0) <= limit:
        return rows.join(groups, key)
    parts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = groups.where(F.col(count) > limit).select(key, parts.alias("_parts"))
    part = F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    right = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "_part"]).drop("_part")


def spread_self_join(left: DataFrame, right: DataFrame, key: str, spread_by: str,
                     parts: Column, condition: Column) -> DataFrame:
    """Equi-join of two aliased sides whose hot keys are divided into parts.

    ``parts`` is the number of parts of the row's key and must be the same
    expression value on both sides. The left row goes to one part, the right
    row to all of them, so every combination meets exactly once. The repeated
    side is never broadcast, as its size is not what estimates say.
    """
    one = left.withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    every = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    same = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._part") == F.col("r._part"))
    return one.alias("l").join(every.alias("r").hint("merge"), same & condition, "inner")
