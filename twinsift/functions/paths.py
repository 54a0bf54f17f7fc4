"""Path arithmetic: names, extensions, container paths, scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

CONTAINER_SEP = "::"

# The extension lists decide which items are compared as what.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "heic", "heif"]
VIDEO_EXTENSIONS = [
    "mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "mpg", "mpeg", "ts", "mts", "m2ts",
]
ARCHIVE_EXTENSIONS = ["zip", "7z", "rar"]

# The shorter lists behind the per-type statistics.
STATS_IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "heic"]
STATS_VIDEO_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v"]
STATS_ARCHIVE_EXTENSIONS = ["zip", "7z", "rar", "tar", "gz", "bz2", "xz"]

# Fixed value: names that look like a copy.
COPY_PATTERN = r"(?i)copy|복사|\(\d+\)|_\d{8}|[ _-]copy\d*"
COPY_PENALTY = 10


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def has_extension(path: Column) -> Column:
    return file_name(path).rlike(r"(?s)^.+\.[^.]*$")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def is_entry(path: Column) -> Column:
    return F.instr(path, CONTAINER_SEP) > 0


def container_of(path: Column) -> Column:
    return F.split_part(path, F.lit(CONTAINER_SEP), F.lit(1))


def entry_of(path: Column) -> Column:
    """Inner path of ``container::inner``; null for a plain path."""
    start = F.instr(path, CONTAINER_SEP) + F.lit(len(CONTAINER_SEP))
    return F.when(is_entry(path), F.substr(path, start))


def media_type(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(IMAGE_EXTENSIONS), "image")
        .when(ext.isin(VIDEO_EXTENSIONS), "video")
        .when(ext.isin(ARCHIVE_EXTENSIONS), "archive")
        .otherwise("other")
    )


def tab_type(path: Column, tab: Column) -> Column:
    """Type shown in the statistics: the tab decides, else the extension."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return (
        F.when(tab.isin("image", "video", "archive"), tab)
        .when(ext.isin(STATS_IMAGE_EXTENSIONS), "image")
        .when(ext.isin(STATS_VIDEO_EXTENSIONS), "video")
        .when(ext.isin(STATS_ARCHIVE_EXTENSIONS), "archive")
        .when(tab == "regular", "regular")
        .otherwise("other")
    )


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def origin_score(path: Column) -> Column:
    """Lower is more likely the original: shallow paths, no copy marker."""
    return (depth(path) + F.when(path.rlike(COPY_PATTERN), COPY_PENALTY).otherwise(0)).cast("bigint")


def rule_score(path: Column, prefer: Iterable[str] = (), reject: Iterable[str] = ()) -> Column:
    """+1 for every preferred text in the path, -1 for every rejected one."""
    score = F.lit(0).cast("bigint")
    for text in prefer:
        score = score + F.contains(path, F.lit(text)).cast("bigint")
    for text in reject:
        score = score - F.contains(path, F.lit(text)).cast("bigint")
    return score


def cache_key(path: Column, size: Column, mtime: Column) -> Column:
    return F.concat_ws("|", path, size.cast("string"), F.unix_timestamp(mtime).cast("string"))
