"""Intermediate results that outlive the executors which computed them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_reused: list[DataFrame] = []
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder every node can read and write, as the cluster names it.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and continue from there.

    What was exchanged for them is deleted once they are written. Otherwise
    Spark keeps it until the driver's JVM happens to collect the plan, which
    may be after the disk is full.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_LET_GO)
    spark.conf.set(_LET_GO, "true")
    try:
        once = df.select("*")       # a plan has the setting of the moment it is made
    finally:
        spark.conf.set(_LET_GO, before)
    return once.checkpoint(eager=True)


def reused(df: DataFrame) -> DataFrame:
    """Keep rows that a plan reads several times.

    Lost blocks are computed again from the lineage, so this is only a saving,
    not something results depend on. ``release()`` drops all of them.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _reused.append(kept)
    return kept


def release() -> None:
    while _reused:
        _reused.pop().unpersist()
