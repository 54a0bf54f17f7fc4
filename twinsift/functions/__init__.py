"""Column-level building blocks. Everything here is a JVM-side expression."""

from .fingerprints import (
    bit_text,
    from_hex16,
    hamming,
    hamming_hex,
    luma,
    pixel_hash,
    sign_hash,
    to_hex16,
)
from .hashing import content_hash, entry_fingerprint, head_hash, short_hash, tail_hash
from .paths import (
    cache_key,
    container_of,
    depth,
    entry_of,
    extension,
    file_name,
    is_entry,
    media_type,
    origin_score,
    rule_score,
    tab_type,
)
from .sequences import (
    aligned_distance,
    mean_min_distance,
    sample_positions,
    sample_seconds,
    sample_seconds_inclusive,
)
from .sizes import format_size

__all__ = [
    "aligned_distance", "bit_text", "cache_key", "container_of", "content_hash",
    "depth", "entry_fingerprint", "entry_of", "extension", "file_name",
    "format_size", "from_hex16", "hamming", "hamming_hex", "head_hash",
    "is_entry", "luma", "mean_min_distance", "media_type", "origin_score",
    "pixel_hash", "rule_score", "sample_positions", "sample_seconds",
    "sample_seconds_inclusive", "short_hash", "sign_hash", "tab_type",
    "tail_hash", "to_hex16",
]
