"""The whole pipeline: four result tables from items, entries and fingerprints."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import to_hex16
from ..operators import (
    container_groups, drop_single_container_groups, exact_duplicates, exclude_rules, ignore_builtin,
    keep_first, similar_groups, similar_sequences, skip_known_duplicates,
)
from ..operators.durable import reused
from ..sources.archives import in_containers, union_items


@dataclass(frozen=True)
class ScanOptions:
    """Thresholds and switches of a scan."""

    phash_exact: int = 0
    phash_similar: int = 10
    vhash_exact: float = 3.0
    vhash_similar: float = 10.0
    vhash_measure: str = "mean_min"
    min_overlap: int = 2
    min_size_kib: int = 0
    exclude: list[str] = field(default_factory=list)
    skip_duplicates: bool = True
    drop_single_container: bool = True


MEMBER_COLUMNS = [
    ("tab", "string"), ("group_id", "string"), ("path", "string"), ("size", "bigint"), ("type", "string"),
    ("hash", "string"), ("phash", "string"), ("category", "string"), ("frame_count", "bigint"),
    ("shared", "bigint"), ("total_files", "bigint"), ("keep", "boolean"),
]


def members_of(rows: DataFrame, tab: str, root: Column) -> DataFrame:
    """Bring result rows into the common member schema.

    Group ids are built from the group's own key, which stays the same from
    run to run and needs no numbering; ``group_ids`` numbers them on demand.
    """
    named = rows.withColumn("tab", F.lit(tab)).withColumn(
        "group_id", F.concat(F.lit(tab[0] + ":"), root.cast("string"))
    )
    return named.select(*[
        (F.col(name) if name in named.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in MEMBER_COLUMNS
    ])


def scan(
    items: DataFrame,
    entries: DataFrame | None = None,
    fingerprints: DataFrame | None = None,
    sequences: DataFrame | None = None,
    container_sizes: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
) -> DataFrame:
    """Members of all groups found, one table with a ``tab`` column.

    ``items``           path, size, hash (and type)
    ``entries``         container, path, size, hash of container entries
    ``fingerprints``    id, path, size, h
    ``sequences``       id, path, size, frames
    ``container_sizes`` container, size
    """
    def allowed(rows: DataFrame, path: str = "path") -> DataFrame:
        """Rows whose file is neither junk nor excluded; of entries, the container counts."""
        named = rows.withColumns({"_path": F.col("path"), "path": F.col(path)})
        return exclude_rules(ignore_builtin(named), options.exclude).withColumn("path", F.col("_path")).drop("_path")

    items = allowed(items)
    entries = None if entries is None else allowed(entries, "container")
    fingerprints = None if fingerprints is None else allowed(fingerprints)
    sequences = None if sequences is None else allowed(sequences)
    if "type" not in items.columns:
        items = items.withColumn("type", F.lit("file"))
    columns = ["path", "size", "hash", "type"]
    everything = items.select(*columns)
    if entries is not None:
        everything = union_items(everything, entries.select(*columns))
    exact = exact_duplicates(reused(everything), content=None, min_kib=options.min_size_kib)
    regular = drop_single_container_groups(exact) if options.drop_single_container else exact
    tabs = [members_of(regular, "regular", F.col("hash"))]
    if fingerprints is not None:
        left = skip_known_duplicates(fingerprints, exact) if options.skip_duplicates else fingerprints
        found = similar_groups(left, options.phash_exact, options.phash_similar)
        named = found.withColumn("phash", to_hex16(F.col("h"))).withColumn("type", F.lit("file"))
        tabs.append(members_of(keep_first(named, "root"), "image", F.col("root")))
    if sequences is not None:
        left = skip_known_duplicates(sequences, exact) if options.skip_duplicates else sequences
        found = similar_sequences(left, options.vhash_exact, options.vhash_similar, options.vhash_measure)
        tabs.append(members_of(keep_first(found.withColumn("type", F.lit("file")), "root"), "video", F.col("root")))
    if entries is not None and options.min_overlap > 0:
        found = container_groups(in_containers(entries), options.min_overlap, sizes=container_sizes)
        named = found.withColumnsRenamed({"container": "path", "total": "total_files"}).withColumn(
            "type", F.lit("archive")
        )
        tabs.append(members_of(named, "archive", F.col("root")))
    return reduce(DataFrame.unionByName, tabs)
