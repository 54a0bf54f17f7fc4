"""File trees as tables."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import file_name
from ..operators import skew
from ..operators.durable import durable, reused
from ..operators.exact import (
    duplicate_members, hardlink_representatives, min_size_filter, repeated, size_candidates,
)
from ..operators.filters import JUNK_NAMES, ExcludeRules, is_junk

_LISTING = "path string, is_dir boolean, size bigint, device bigint, inode bigint, mtime double, created double"
_COLUMNS = ["path", "is_dir", "size", "device", "inode", "mtime", "created"]
_ROWS_PER_FRAME = 10_000
_CHUNK = 1 << 20


def _list_directories(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """List each directory one level deep, not following symbolic links."""
    rows: list[tuple] = []
    for frame in frames:
        for directory in frame["path"]:
            try:
                entries = os.scandir(directory)
            except OSError:
                continue
            with entries:
                for entry in entries:
                    try:
                        info = entry.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    is_dir = stat.S_ISDIR(info.st_mode)
                    if is_dir or stat.S_ISREG(info.st_mode):
                        rows.append((entry.path, is_dir, info.st_size, info.st_dev, info.st_ino, info.st_mtime, info.st_ctime))
                    if len(rows) >= _ROWS_PER_FRAME:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def file_inventory(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Regular files below the roots: path, size, device, inode, mtime, created.

    Level by level: all directories of a level are spread over the tasks, so a
    deep or lopsided tree does not end up in one of them. Hidden files count;
    symbolic links and unreadable places are passed over. Every node must see
    the roots under the same path; for object stores use ``object_inventory``.
    """
    rules = ExcludeRules(exclude)
    path = F.col("path")
    open_dir = ~rules.skips_directory(path) & ~file_name(path).isin(JUNK_NAMES)
    level = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string")
    level = level.distinct().where(~rules.skips_directory(path))
    levels = []
    while waiting := level.count():
        # Little work per row but a lot of waiting: more tasks than bytes suggest.
        tasks = min(waiting, spark.sparkContext.defaultParallelism * 2)
        listing = durable(level.repartition(tasks, "path").mapInPandas(_list_directories, _LISTING))
        levels.append(listing.where(~F.col("is_dir")))
        level = listing.where(F.col("is_dir") & open_dir).select("path").distinct()
    if not levels:
        levels = [spark.createDataFrame([], _LISTING)]
    files = reduce(DataFrame.unionByName, levels)
    return multi_root_union(
        files.where(~is_junk(path) & ~rules.skips_file(path)).select(
            "path", "size", "device", "inode",
            F.timestamp_seconds(F.floor("mtime")).alias("mtime"),
            F.timestamp_seconds(F.floor("created")).alias("created"),
        )
    )


def object_inventory(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """As ``file_inventory`` through Spark's own listing, metadata only.

    For storage without mount points. Spark passes over names that start with
    a dot or an underscore, and such files have no inode.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    kept = files.where(~is_junk(F.col("path")) & ~ExcludeRules(exclude).skips(F.col("path")))
    return multi_root_union(kept)


def multi_root_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Inventories of several roots as one; overlapping roots list a file once."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)
    return whole.dropDuplicates(["path"])


def _digest(path: str, start: int, length: int | None) -> str | None:
    """SHA-256 of a byte range, read in chunks; None when unreadable."""
    try:
        with open(path, "rb") as file:
            if start < 0:
                file.seek(max(os.fstat(file.fileno()).st_size + start, 0))
            digest = hashlib.sha256()
            left = length
            while left is None or left > 0:
                chunk = file.read(_CHUNK if left is None else min(_CHUNK, left))
                if not chunk:
                    break
                digest.update(chunk)
                left = None if left is None else left - len(chunk)
            return digest.hexdigest()
    except OSError:
        return None


def hash_files(files: DataFrame, column: str = "hash", part: str = "full", kib: int = 64) -> DataFrame:
    """Add the SHA-256 of each file's head, tail or whole content.

    Only the bytes in question are read, in chunks. Unreadable files are
    dropped. Files are spread by path first: after a step that joined on
    size, files of one size would otherwise sit in one task.
    """
    start, length = {"full": (0, None), "head": (0, kib * 1024), "tail": (-kib * 1024, None)}[part]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{column: [_digest(p, start, length) for p in frame["path"]]})

    schema = files.drop(column).withColumn(column, F.lit("").cast("string")).schema
    hashed = files.drop(column).repartition("path").mapInPandas(run, schema)
    return hashed.where(F.col(column).isNotNull())


def exact_duplicate_files(
    inventory: DataFrame,
    min_kib: int = 0,
    head_kib: int = 64,
    check_inode: bool = False,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Members of groups of files with equal content.

    Sizes come from the listing. Of files with a repeated size the head is
    read, of those still alike the tail, and only the rest in full.
    ``check_inode`` reads hard-linked files once.
    """
    files = min_size_filter(inventory, min_kib)
    if check_inode:
        files = hardlink_representatives(files)
    files = size_candidates(files)
    if head_kib > 0:
        files = repeated(reused(hash_files(files, "_head", "head", head_kib)), ["size", "_head"])
        files = repeated(reused(hash_files(files, "_tail", "tail", head_kib)), ["size", "_head", "_tail"])
        files = files.drop("_head", "_tail")
    hashed = reused(hash_files(files))
    return duplicate_members(hashed, hot_rows=hot_rows)
