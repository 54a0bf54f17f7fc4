"""Where fingerprints are kept between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.fingerprint_cache import KEY, VALUES, merge_fingerprints

_ENTRY = "MAP<STRING, STRUCT<hash: STRING, phash: STRING, vhash_frames: ARRAY<DECIMAL(20,0)>>>"
_SCHEMA = "path string, size bigint, mtime bigint, hash string, phash string, frames array<bigint>"
_UNSIGNED = 1 << 64
_SIGN = 1 << 63


def _as_bits(value: Column) -> Column:
    """The BIGINT with the same 64 bits as an unsigned number."""
    def number(n: int) -> Column:
        return F.lit(str(n)).cast("decimal(20,0)")

    wrapped = F.when(value >= number(_SIGN), value - number(_UNSIGNED))
    return wrapped.otherwise(value).cast("bigint")


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def load_fingerprint_cache(spark: SparkSession, path: str) -> DataFrame:
    """Import a JSON cache file: ``{"meta", "entries"}`` or the bare entry map.

    A missing or unreadable file gives an empty table. One JSON document is
    one row to Spark, so import it once and keep it with ``save_cache``.
    """
    try:
        text = spark.read.option("wholetext", "true").text(path)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], _SCHEMA)
        raise
    inner = F.get_json_object("value", "$.entries")
    entries = F.from_json(F.coalesce(inner, F.col("value")), _ENTRY)
    pattern = r"(?s)^(.*)\|(\d+)\|(\d+)$"
    return text.select(F.explode(entries).alias("key", "entry")).where(F.col("key").rlike(pattern)).select(
        F.regexp_extract("key", pattern, 1).alias("path"),
        F.regexp_extract("key", pattern, 2).cast("bigint").alias("size"),
        F.regexp_extract("key", pattern, 3).cast("bigint").alias("mtime"),
        F.col("entry.hash").alias("hash"),
        F.col("entry.phash").alias("phash"),
        F.transform("entry.vhash_frames", _as_bits).alias("frames"),
    )


def _latest(spark: SparkSession, folder: str) -> tuple[int, int, list[str]]:
    """Current version, the whole version it builds on, and the scanned paths."""
    try:
        versions = spark.read.option("mergeSchema", "true").parquet(f"{folder}/versions")
    except AnalysisException as error:
        if _missing(error):
            return 0, 0, []
        raise
    row = versions.orderBy(F.col("version").desc()).first()
    if row is None:
        return 0, 0, []
    base = row.asDict().get("base")     # earlier stores have whole versions only
    return row.version, row.version if base is None else base, list(row.scan_paths)


def _stored(spark: SparkSession, folder: str, version: int, base: int) -> DataFrame:
    whole = spark.read.parquet(f"{folder}/data/version={base}")
    if version == base:
        return whole
    # The changes are few beside the whole, which is not shuffled for them.
    parts = [spark.read.parquet(f"{folder}/data/version={v}").withColumn("_v", F.lit(v)) for v in range(base + 1, version + 1)]
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    newest = changes.groupBy(*KEY).agg(F.max_by(F.struct(*VALUES), "_v").alias("_x")).select(*KEY, "_x.*")
    return whole.join(changes.select(*KEY), KEY, "left_anti").unionByName(newest)


def load_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a stored cache; empty when there is none."""
    version, base, _ = _latest(spark, folder)
    if version == 0:
        return spark.createDataFrame([], _SCHEMA)
    return _stored(spark, folder, version, base)


def scan_paths(spark: SparkSession, folder: str) -> list[str]:
    return _latest(spark, folder)[2]


def save_cache(fingerprints: DataFrame, folder: str, paths: Sequence[str] = (), compact_share: float = 0.25) -> DataFrame:
    """Merge fingerprints into the stored cache and return the new version.

    Only rows that are new or change go into the new version; a key found in
    several versions has its newest row. Once the changes since the last whole
    version exceed ``compact_share`` of its rows, a whole version is written.
    A version goes to a folder of its own and becomes current with one
    appended row, so an interrupted run leaves the previous version in place.
    """
    spark = fingerprints.sparkSession
    version, base, old_paths = _latest(spark, folder)
    new = f"{folder}/data/version={version + 1}"
    if version == 0:
        merge_fingerprints(load_cache(spark, folder), fingerprints).write.mode("overwrite").parquet(new)
        base = 1
    else:
        known = _stored(spark, folder, version, base)
        incoming = fingerprints.select(*KEY).distinct()
        touched = known.join(incoming, KEY, "left_semi")
        before = touched.select(*KEY, F.struct(*VALUES).alias("_before"))
        merge_fingerprints(touched, fingerprints).join(before, KEY, "left").where(
            F.col("_before").isNull() | ~F.struct(*VALUES).eqNullSafe(F.col("_before"))
        ).drop("_before").write.mode("overwrite").parquet(new)
        rows = lambda v: spark.read.parquet(f"{folder}/data/version={v}").count()
        changed = sum(rows(v) for v in range(base + 1, version + 2))
        if changed > compact_share * rows(base):
            _stored(spark, folder, version + 1, base).write.mode("overwrite").parquet(f"{folder}/data/version={version + 2}")
            version, base = version + 1, version + 2
    known_paths = list(dict.fromkeys([*old_paths, *paths]))
    spark.createDataFrame(
        [(version + 1, base, known_paths)], "version int, base int, scan_paths array<string>"
    ).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return load_cache(spark, folder)
