"""Saving a whole result and taking it up again later."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

def save_session(members: DataFrame, folder: str, session_id: str | None = None) -> None:
    """Write the members by tab into a folder of this session, then the manifest.

    A reader that finds the manifest knows that everything it names is there:
    an older session's members stay until the new manifest has replaced the old.
    """
    spark = members.sparkSession
    session_id = session_id or uuid.uuid4().hex
    place = f"members-{session_id}-{uuid.uuid4().hex[:8]}"
    members.write.partitionBy("tab").parquet(f"{folder}/{place}")
    saved = spark.read.schema(members.schema).parquet(f"{folder}/{place}")
    counts = saved.groupBy("tab").agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("members"))
    # One row per tab that has members; a session without any has a row without a tab.
    rows = [(r.tab, r.groups, r.members) for r in counts.collect()] or [(None, 0, 0)]
    manifest = spark.createDataFrame(rows, "tab string, groups long, members long").select(
        F.lit(session_id).alias("session_id"), F.current_timestamp().alias("saved_at"), "tab",
        F.lit(place).alias("folder"), "groups", "members", F.lit(members.schema.json()).alias("columns"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def load_session(spark: SparkSession, folder: str) -> DataFrame:
    """Members of all saved tabs; an empty result has its columns all the same."""
    saved = spark.read.schema("folder string, columns string").json(f"{folder}/manifest").first()
    return spark.read.schema(T.StructType.fromJson(json.loads(saved.columns))).parquet(f"{folder}/{saved.folder}")


def load_session_csv(spark: SparkSession, folder: str, tab: str = "regular") -> DataFrame:
    """Members from an exported CSV, whichever tab's columns it has.

    Separator rows are skipped; sizes are read from ``size`` or ``size_bytes``
    and are 0 when unreadable; anything but NO counts as keep. ``ordinal``
    (file, row) follows the order of the files' names and rows.
    """
    raw = (
        spark.read.option("header", "true").option("quote", '"').option("escape", '"')
        .option("multiLine", "true").csv(folder)
    )

    def text(name: str):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    size = F.coalesce(text("size"), text("size_bytes")).try_cast("bigint")
    # Files are read in any order, each of them whole and in its own order.
    rows = raw.withColumn("ordinal", F.struct(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))
    return rows.where(F.coalesce(text("group_id"), F.lit("")) != "").select(
        F.lit(tab).alias("tab"),
        F.trim(text("group_id")).alias("group_id"),
        F.coalesce(text("path"), F.lit("")).alias("path"),
        F.coalesce(size, F.lit(0)).alias("size"),
        F.coalesce(text("type"), F.lit("file")).alias("type"),
        text("hash").alias("hash"),
        text("phash").alias("phash"),
        text("category").alias("category"),
        text("frame_count").try_cast("int").alias("frame_count"),
        text("shared_files").try_cast("int").alias("shared"),
        text("created").alias("created"),
        (F.upper(F.coalesce(text("keep"), F.lit(""))) != "NO").alias("keep"),
        "ordinal",
    )


def session_groups(members: DataFrame) -> DataFrame:
    """Group facts of loaded members; the first in file order is not savable."""
    return members.groupBy("tab", "group_id").agg(
        F.count("*").alias("n"),
        (F.sum("size") - F.min_by("size", "ordinal")).alias("savable"),
        F.max("category").alias("category"),
    )
