"""DataFrame -> DataFrame operators."""

from .components import connected_components
from .containers import (
    container_classes,
    container_collapse,
    container_entry_total,
    container_groups,
    container_overlap,
    container_overlap_entries,
    container_pair_groups,
    container_pair_rollup,
    min_container_entries,
    overlap_classes,
    overlap_hashes,
    overlap_ratios,
    shared_hashes,
    strongest_overlaps, top_overlaps,
)
from .durable import durable, new_folder, release, reused, shared_folder
from .exact import (
    drop_single_container_groups,
    duplicate_members,
    exact_duplicates,
    fingerprint_items,
    hardlink_groups,
    hardlink_representatives,
    head_tail_candidates,
    min_size_filter,
    size_candidates,
    skip_known_duplicates,
)
from .filters import (
    ExcludeRules,
    exclude_fnmatch,
    exclude_rules,
    glob_regex,
    group_text_filter,
    group_type_filter,
    ignore_builtin,
)
from .fingerprint_cache import cache_lookup, cache_misses, merge_fingerprints
from .hamming import hamming_join, near_pairs
from .ranking import global_position
from .report import (
    member_lines,
    overlap_header,
    removal_stats,
    scan_summary,
    tab_badges,
    type_stats,
)
from .review import (
    apply_deletions,
    deletion_plan,
    deletion_total,
    drop_missing,
    group_facts,
    group_ids,
    keep_first,
    keep_original,
    mark_groups,
    missing_paths,
    resolve_keepers,
    sort_groups,
    toggle_members,
    unresolved_sample,
)
from .sequences import (
    sample_frames,
    sequence_classes,
    sequence_similarity_join,
    similar_sequences,
    similar_sequences_two_level,
)
from .similar import similar_groups, similar_groups_two_level
