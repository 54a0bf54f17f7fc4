"""Content hashes used for exact matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KIB = 1024
SMALL_ENTRY_BYTES = 1024 * KIB


def content_hash(content: Column) -> Column:
    """SHA-256 of the whole content, lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def head_hash(content: Column, kib: int = 64) -> Column:
    """SHA-256 of the first ``kib`` KiB (all of it when shorter)."""
    return F.sha2(F.substring(content.cast("binary"), 1, kib * KIB), 256)


def tail_hash(content: Column, kib: int = 64) -> Column:
    """SHA-256 of the last ``kib`` KiB (all of it when shorter)."""
    n = kib * KIB
    return F.sha2(F.substring(content.cast("binary"), -n, n), 256)


def short_hash(hash_col: Column, length: int = 8) -> Column:
    return F.left(hash_col, F.lit(length))


def entry_fingerprint(size: Column, name: Column, content: Column) -> Column:
    """64-bit fingerprint of a container entry as 16 hex digits.

    Entries up to 1 MiB are identified by content. Larger ones by their size
    mixed with the byte length of their name, which needs no decompression
    but can match unrelated entries; prefer ``content_hash`` for exact work.
    """
    by_content = F.left(content_hash(content), F.lit(16))
    by_shape = size.cast("bigint").bitwiseXOR(F.octet_length(name).cast("bigint"))
    return F.when(size <= SMALL_ENTRY_BYTES, by_content).otherwise(
        F.lpad(F.lower(F.hex(by_shape)), 16, "0")
    )
