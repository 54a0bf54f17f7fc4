"""Reading file trees and containers; saving and loading results."""

from .archives import tar_entries, union_items, zip_entries
from .cache_store import load_cache, load_fingerprint_cache, save_cache
from . import exports
from .exports import (
    append_deletion_log,
    export_duplicates_report,
    export_overlap_csv,
    export_regular_csv,
    export_sequence_csv,
    export_similar_csv,
)
from .files import exact_duplicate_files, file_inventory, hash_files, multi_root_union, object_inventory
from .sessions import load_session, load_session_csv, save_session
