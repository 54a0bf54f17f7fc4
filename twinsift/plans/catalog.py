"""One named query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import functions as fn, operators as op, sources as src
from ..sources.archives import in_containers
from ..sources.cache_store import load_cache
from ..sources.sessions import session_groups
from . import fixture_files
from .scan import members_of, scan
from .tables import Tables, frame_index

EXCLUDES = ["file:*.webp", "dir:node_modules", "!no-ext", "*.tmp"]
SHELL_EXCLUDES = ["*.webp", "*copy*", "/data/src1?/*"]
PREFER = ["src1", "/en/"]
REJECT = ["copy", "src2"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(spark, folder))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def long(column: Column) -> Column:
    return column.cast("bigint")


# -- shared inputs -----------------------------------------------------------


def _exact(t: Tables) -> DataFrame:
    return op.exact_duplicates(t.items.select("doc_id", "path", "size", "content"))


def _everything(t: Tables) -> DataFrame:
    files = t.hashed.select("path", "size", "hash", F.lit("file").alias("type"))
    return src.union_items(files, t.entries.select("path", "size", "hash", "type"))


def _exact_all(t: Tables) -> DataFrame:
    return op.exact_duplicates(op.reused(_everything(t)), content=None)


def _regular(t: Tables) -> DataFrame:
    """Exact groups over files and entries in the member schema."""
    return members_of(op.drop_single_container_groups(_exact_all(t)), "regular", F.col("hash"))


def _images(t: Tables) -> DataFrame:
    return t.fingerprints.select(
        "id", "h", F.concat(F.lit("/img/"), F.col("id").cast("string"), F.lit(".png")).alias("path"),
        (F.col("vec_id") * 10 + F.col("k") + 100).cast("bigint").alias("size"),
    )


def _clips(t: Tables) -> DataFrame:
    return t.sequences.select(
        "id", "frames", F.concat(F.lit("/clip/"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"),
        (F.col("id") * 7 + 1000).cast("bigint").alias("size"),
    )


def _container_sizes(t: Tables) -> DataFrame:
    return t.entries.groupBy("container").agg(F.sum("size").alias("size"))


def _scan(t: Tables) -> DataFrame:
    return scan(t.hashed.select("path", "size", "hash"), t.entries, _images(t), _clips(t), _container_sizes(t))


def _all_tabs(t: Tables) -> DataFrame:
    """The stored result of a full scan, which the review works on."""
    return op.durable(_scan(t))


def _marked(t: Tables) -> DataFrame:
    """Exact groups of files with YES/NO marks as read from a reviewed report.

    Marks come from the labels: a labelled member is judged, others are not.
    """
    marks = t.table("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("mark")
    )
    return _exact(t).withColumn("group_id", F.col("hash")).join(marks, "doc_id", "left")


# -- scans and sources -------------------------------------------------------


@query
def file_inventory(t: Tables) -> DataFrame:
    """Documents written out as files, then listed; bytes per directory."""
    root = fixture_files.write_texts(t)
    files = src.file_inventory(t.spark, [root]).where(fn.file_name(F.col("path")).startswith("part-"))
    parts = F.split("path", "/")
    return files.groupBy(
        F.split_part(F.element_at(parts, -3), F.lit("="), F.lit(2)).alias("source"),
        F.split_part(F.element_at(parts, -2), F.lit("="), F.lit(2)).alias("lang"),
    ).agg(F.sum("size").alias("bytes"))


@query
def exact_duplicate_files(t: Tables) -> DataFrame:
    """Each document as a file of its own; duplicates found by staged reading."""
    root = fixture_files.write_one_file_each(t)
    found = src.exact_duplicate_files(src.file_inventory(t.spark, [root]), head_kib=1)
    return found.groupBy("hash").agg(
        F.count("*").alias("n"), F.max("size").alias("size"), F.max("savable").alias("savable")
    )


@query
def multi_root_union(t: Tables) -> DataFrame:
    """Inventories of overlapping roots, one per language and one of all."""
    whole = t.hashed.select("path", "size")
    by_lang = [whole.where(F.contains("path", F.lit(f"/{lang}/"))) for lang in ("en", "fr", "de", "es")]
    return src.multi_root_union(whole, *by_lang)


@query
def zip_entries(t: Tables) -> DataFrame:
    return src.zip_entries(fixture_files.zipped(t)).select("path", "size", "hash", "type")


@query
def tar_entries(t: Tables) -> DataFrame:
    return src.tar_entries(fixture_files.tarred(t)).select("path", "size", "hash", "type")


@query
def container_entry_total(t: Tables) -> DataFrame:
    return op.container_entry_total(t.entries).select("path", "total")


@query
def load_session_csv(t: Tables) -> DataFrame:
    """Exported and read back."""
    folder = op.new_folder(t.spark, "regular-csv")
    src.export_regular_csv(_regular_with_created(t), folder)
    return src.load_session_csv(t.spark, folder).select("group_id", "path", "size", "type", "hash", "keep")


@query
def load_fingerprint_cache(t: Tables) -> DataFrame:
    """The JSON form of the cache, written and imported."""
    path = fixture_files.write_json_cache(t)
    return src.load_fingerprint_cache(t.spark, path).select("path", "size", "mtime", "hash", "phash")


# -- scalar projections ------------------------------------------------------


@query
def content_hash(t: Tables) -> DataFrame:
    return t.items.select("path", fn.content_hash(F.col("content")).alias("hash"))


@query
def head_hash(t: Tables) -> DataFrame:
    return t.items.select("path", fn.head_hash(F.col("content"), 1).alias("hash"))


@query
def tail_hash(t: Tables) -> DataFrame:
    return t.items.select("path", fn.tail_hash(F.col("content"), 1).alias("hash"))


@query
def entry_fingerprint(t: Tables) -> DataFrame:
    """Sizes scaled by 64, so that both ways of identifying an entry occur."""
    return t.items.select(
        "path", fn.entry_fingerprint(F.col("size") * 64, F.col("path"), F.col("content")).alias("fingerprint")
    )


@query
def split_container_path(t: Tables) -> DataFrame:
    paths = t.entries.select("path").unionByName(t.hashed.select("path"))
    return paths.select(
        "path", fn.container_of(F.col("path")).alias("container"), fn.entry_of(F.col("path")).alias("entry"),
        fn.is_entry(F.col("path")).alias("is_entry"),
    )


@query
def classify_media(t: Tables) -> DataFrame:
    return t.hashed.select("path", fn.media_type(F.col("path")).alias("media"))


@query
def format_size(t: Tables) -> DataFrame:
    """Sizes moved through all magnitudes, in the four styles."""
    power = (F.col("doc_id") % 36).cast("int")
    sized = t.hashed.select("doc_id", F.call_function("shiftleft", F.col("size"), power).alias("n"))
    return sized.select("doc_id", "n", *[
        fn.format_size(F.col("n"), style).alias(style) for style in ("scanner", "report", "web", "stats")
    ])


@query
def origin_score(t: Tables) -> DataFrame:
    return t.hashed.select("path", fn.origin_score(F.col("path")).alias("score"))


@query
def rule_score(t: Tables) -> DataFrame:
    return t.hashed.select("path", fn.rule_score(F.col("path"), PREFER, REJECT).alias("score"))


@query
def pixel_hash(t: Tables) -> DataFrame:
    """Vectors as 8 x 8 gray images."""
    grid = F.transform("v", lambda x: F.floor((x + 1) * 127))
    return t.vectors.select("id", fn.bit_text(fn.pixel_hash(grid, 8)).alias("bits"))


@query
def vector_sign_hash(t: Tables) -> DataFrame:
    return t.fingerprints.select("id", fn.bit_text(F.col("h")).alias("bits"))


@query
def luma_rgb(t: Tables) -> DataFrame:
    rgb = F.transform("v", lambda x: F.floor((x + 1) * 127).cast("int"))
    return t.vectors.select("id", F.array_join(fn.luma(rgb).cast("array<string>"), ",").alias("gray"))


@query
def hamming_distance(t: Tables) -> DataFrame:
    """Each vector and its disturbed copies against each other."""
    fp = t.fingerprints
    a = fp.select("vec_id", F.col("k").alias("kind_a"), F.col("h").alias("h_a"))
    b = fp.select("vec_id", F.col("k").alias("kind_b"), F.col("h").alias("h_b"))
    return a.join(b, "vec_id").where("kind_a < kind_b").select(
        "vec_id", long(F.col("kind_a")).alias("kind_a"), long(F.col("kind_b")).alias("kind_b"),
        long(fn.hamming(F.col("h_a"), F.col("h_b"))).alias("dist"),
        long(fn.hamming_hex(fn.to_hex16(F.col("h_a")), fn.to_hex16(F.col("h_b")))).alias("dist_hex"),
    )


def _sequence_pairs(t: Tables) -> DataFrame:
    """Sequences of kind 0 next to those of kind 1 and 2 of the same block."""
    s = t.sequences.withColumn("block", F.floor(F.col("id") / 4)).withColumn("kind", F.col("id") % 4)
    first = s.where("kind = 0").select("block", F.col("id").alias("id_a"), F.col("frames").alias("a"))
    other = s.where("kind > 0").select("block", F.col("id").alias("id_b"), F.col("frames").alias("b"))
    return first.join(other, "block")


@query
def sequence_distance_mean_min(t: Tables) -> DataFrame:
    return _sequence_pairs(t).select(
        "id_a", "id_b", F.round(fn.mean_min_distance(F.col("a"), F.col("b")), 6).alias("dist")
    )


@query
def sequence_distance_aligned(t: Tables) -> DataFrame:
    return _sequence_pairs(t).select(
        "id_a", "id_b", F.round(fn.aligned_distance(F.col("a"), F.col("b")), 6).alias("dist")
    )


@query
def sequence_sample(t: Tables) -> DataFrame:
    """Ten evenly spaced events per user."""
    events = frame_index(t.table("events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])
    # One row per user carries the wanted positions to the event rows.
    wanted = events.where("frame = 0").select(
        "user_id", fn.sample_positions(F.col("frames"), 10).alias("positions")
    )
    return op.sample_frames(events.select("user_id", "frame", "event_id"), wanted, "user_id").select(
        "user_id", long(F.col("sample")).alias("sample"), "frame", "event_id"
    )


@query
def sequence_sample_seconds(t: Tables) -> DataFrame:
    """All sample times of media as long as each user's time span, in both forms."""
    span = t.table("events").groupBy("user_id").agg(
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("whole")
    ).select("user_id", (F.col("whole") % 4000).cast("double").alias("seconds"))
    inner = span.select("user_id", F.lit("exclusive").alias("form"), F.posexplode(
        F.transform(fn.sample_seconds(F.col("seconds"), 10), lambda x: x / F.lit(1000000.0))).alias("sample", "at"))
    whole = span.select("user_id", F.lit("inclusive").alias("form"), F.posexplode(
        fn.sample_seconds_inclusive(F.col("seconds"), 10)).alias("sample", "at"))
    return inner.unionByName(whole).select("user_id", "form", long(F.col("sample")).alias("sample"), F.round("at", 5).alias("at"))


@query
def cache_key(t: Tables) -> DataFrame:
    return t.hashed.select(fn.cache_key(F.col("path"), F.col("size"), F.col("mtime")).alias("cache_key"))


@query
def short_hash(t: Tables) -> DataFrame:
    return t.hashed.select("path", fn.short_hash(F.col("hash")).alias("short"))


# -- filters -----------------------------------------------------------------


@query
def ignore_builtin(t: Tables) -> DataFrame:
    return op.ignore_builtin(t.hashed).select("path")


@query
def exclude_rules(t: Tables) -> DataFrame:
    return op.exclude_rules(t.hashed, EXCLUDES).select("path")


@query
def exclude_fnmatch(t: Tables) -> DataFrame:
    return op.exclude_fnmatch(t.hashed, SHELL_EXCLUDES).select("path")


@query
def min_size_filter(t: Tables) -> DataFrame:
    return op.min_size_filter(t.hashed, 1).select("path", "size")


@query
def size_candidates(t: Tables) -> DataFrame:
    return op.size_candidates(t.items.select("path", "size"))


@query
def head_tail_candidates(t: Tables) -> DataFrame:
    return op.head_tail_candidates(op.size_candidates(t.items.select("path", "size", "content")), kib=1).select(
        "path", "size"
    )


@query
def drop_single_container_groups(t: Tables) -> DataFrame:
    return op.drop_single_container_groups(_exact_all(t)).select("hash", "path")


@query
def group_text_filter(t: Tables) -> DataFrame:
    return op.group_text_filter(_regular(t), "SRC1/EN").select("group_id", "path")


@query
def group_type_filter(t: Tables) -> DataFrame:
    members = op.reused(_regular(t))
    return op.group_type_filter(members, "archive").select("group_id", "path", F.lit("archive").alias("kind")).unionByName(
        op.group_type_filter(members, "normal").select("group_id", "path", F.lit("normal").alias("kind"))
    )


@query
def min_container_entries(t: Tables) -> DataFrame:
    return op.min_container_entries(t.entries, 10).select("path")


@query
def skip_known_duplicates(t: Tables) -> DataFrame:
    return op.skip_known_duplicates(t.hashed, _exact(t)).select("path")


# -- joins -------------------------------------------------------------------


@query
def hamming_join(t: Tables) -> DataFrame:
    pairs = op.hamming_join(t.fingerprints, 10)
    a, b = fn.bit_text(F.col("h_a")), fn.bit_text(F.col("h_b"))
    swap = a > b
    return pairs.select(
        F.least(a, b).alias("bits_a"), F.greatest(a, b).alias("bits_b"), "dist",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )


@query
def container_overlap(t: Tables) -> DataFrame:
    return op.container_overlap(t.baskets, 2)


@query
def container_overlap_documents(t: Tables) -> DataFrame:
    """Documents sharing two or more lines."""
    return op.container_overlap(in_containers(t.entries), 2)


@query
def container_overlap_entries(t: Tables) -> DataFrame:
    return op.container_overlap_entries(in_containers(t.entries), 2).select("container_a", "container_b", "common")


@query
def overlap_classes(t: Tables) -> DataFrame:
    return op.overlap_classes(in_containers(t.entries), 2)


@query
def container_classes(t: Tables) -> DataFrame:
    return op.container_classes(in_containers(t.entries)).select("container", "rep", "kinds", "total", "copies")


@query
def overlap_ratios(t: Tables) -> DataFrame:
    return op.overlap_ratios(op.container_overlap(in_containers(t.entries), 2)).select(
        "container_a", "container_b", "ratio_a", "ratio_b"
    )


def _pair_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select("id_a", "id_b", F.round("dist", 6).alias("dist"), "n_a", "n_b")


@query
def sequence_similarity_join(t: Tables) -> DataFrame:
    return _pair_ids(op.sequence_similarity_join(t.sequences, 10.0))


@query
def sequence_similarity_join_aligned(t: Tables) -> DataFrame:
    return _pair_ids(op.sequence_similarity_join(t.sequences, 10.0, "aligned"))


@query
def cache_lookup(t: Tables) -> DataFrame:
    return op.cache_lookup(t.hashed.select("path", "size", "mtime"), t.cache).select("path", "hash", "phash")


@query
def cache_misses(t: Tables) -> DataFrame:
    return op.cache_misses(t.hashed.select("path", "size", "mtime"), t.cache).select("path")


@query
def drop_missing(t: Tables) -> DataFrame:
    return op.drop_missing(_exact(t), t.inventory_now).select("hash", "path")


@query
def apply_deletions(t: Tables) -> DataFrame:
    """What is left of all four tables after some of the removable files went."""
    members = _all_tabs(t)
    plan = op.deletion_plan(members).where(F.length("path") % 3 == 0)
    return op.apply_deletions(members, plan).select("tab", "group_id", "path")


# -- aggregation and graphs --------------------------------------------------


@query
def exact_duplicates(t: Tables) -> DataFrame:
    return _exact(t).select("hash", "path", "size", "n", "savable", "keep")


@query
def exact_duplicates_staged(t: Tables) -> DataFrame:
    found = op.exact_duplicates(t.items.select("path", "size", "content"), staged=True, head_kib=1, min_kib=1)
    return found.select("hash", "path", "size", "n", "savable", "keep")


@query
def exact_duplicates_with_entries(t: Tables) -> DataFrame:
    return _exact_all(t).select("hash", "path", "size", "n", "savable", "keep")


@query
def hardlink_groups(t: Tables) -> DataFrame:
    return op.hardlink_groups(t.linked).select("inode", "size", "path", "n", "keep")


@query
def hardlink_representatives(t: Tables) -> DataFrame:
    """Exact groups when every inode is read once."""
    reps = op.reused(op.hardlink_representatives(t.linked))
    return op.exact_duplicates(reps, content=None).select("hash", "path", "n", "keep")


@query
def connected_components(t: Tables) -> DataFrame:
    """Orders linked by two or more shared parts: long chains."""
    pairs = op.container_overlap(t.baskets, 2)
    return op.connected_components(pairs, "container_a", "container_b")


@query
def similar_groups(t: Tables) -> DataFrame:
    return op.similar_groups(t.fingerprints.select("id", "h")).select("id", "root", "members", "category")


@query
def similar_groups_two_level(t: Tables) -> DataFrame:
    return op.similar_groups_two_level(t.fingerprints.select("id", "h")).select("id", "root", "members", "category")


@query
def similar_sequences(t: Tables) -> DataFrame:
    return op.similar_sequences(t.sequences).select("id", "root", "members", "category", "frame_count")


@query
def similar_sequences_two_level(t: Tables) -> DataFrame:
    return op.similar_sequences_two_level(t.sequences, measure="aligned").select(
        "id", "root", "members", "category", "frame_count"
    )


@query
def container_groups(t: Tables) -> DataFrame:
    return op.container_groups(t.baskets, 2, sizes=t.basket_sizes)


@query
def container_pair_groups(t: Tables) -> DataFrame:
    return op.container_pair_groups(op.container_overlap(t.baskets, 2), t.basket_sizes).select(
        "container_a", "container_b", "common", "size_a", "size_b", "savable"
    )


@query
def container_collapse(t: Tables) -> DataFrame:
    return op.container_collapse(_members_with_totals(t))


def _members_with_totals(t: Tables) -> DataFrame:
    totals = op.container_entry_total(t.entries).select("path", "size", "hash", "type", "total")
    files = t.hashed.select("path", "size", "hash", F.lit("file").alias("type"))
    return op.exact_duplicates(op.reused(src.union_items(files, totals)), content=None)


@query
def container_pair_rollup(t: Tables) -> DataFrame:
    return op.container_pair_rollup(_exact_all(t))


@query
def group_savable(t: Tables) -> DataFrame:
    return op.group_facts(_regular(t)).select("group_id", "n", "bytes", "savable")


@query
def savable_by_mark(t: Tables) -> DataFrame:
    return op.group_facts(op.keep_original(_regular(t))).select("group_id", "savable_by_mark")


@query
def scan_summary(t: Tables) -> DataFrame:
    return op.scan_summary(_exact(t), "hash")


@query
def type_stats(t: Tables) -> DataFrame:
    return op.type_stats(_all_tabs(t))


@query
def tab_badges(t: Tables) -> DataFrame:
    return op.tab_badges(_all_tabs(t))


@query
def removal_stats(t: Tables) -> DataFrame:
    return op.removal_stats(_all_tabs(t))


@query
def overlap_header(t: Tables) -> DataFrame:
    return op.overlap_header(_all_tabs(t))


@query
def full_scan(t: Tables) -> DataFrame:
    """All four result tables."""
    return _scan(t).select("tab", "group_id", "path", "size", "category", "frame_count", "shared", "keep")


# -- ranking -----------------------------------------------------------------


@query
def keep_first(t: Tables) -> DataFrame:
    return op.keep_first(_exact(t), "hash").select("hash", "path", "keep")


@query
def keep_original(t: Tables) -> DataFrame:
    return op.keep_original(_exact(t), "hash").select("hash", "path", "score", "keep")


@query
def resolve_keepers(t: Tables) -> DataFrame:
    return op.resolve_keepers(_marked(t), PREFER, REJECT).select("group_id", "path", "score", "status", "remove")


@query
def group_ids(t: Tables) -> DataFrame:
    facts = op.group_facts(_regular(t)).withColumnRenamed("group_id", "root")
    return op.group_ids(facts).select("group_id", "root", "savable")


@query
def sort_groups(t: Tables) -> DataFrame:
    """Positions of the groups in every order offered."""
    members = _all_tabs(t)
    shared = members.groupBy("group_id").agg(F.max("shared").alias("shared"))
    facts = op.reused(op.group_facts(members).join(shared, "group_id"))
    orders = ["savable", "total", "count", "archive_first", "shared", "none"]
    out = facts.select("group_id")
    for order in orders:
        placed = op.sort_groups(facts, order).select("group_id", F.col("position").alias(f"by_{order}"))
        out = out.join(placed, "group_id")
    return out


@query
def top_overlaps(t: Tables) -> DataFrame:
    return op.strongest_overlaps(in_containers(t.entries), 2, 5).select(
        "container_a", "container_b", "common"
    )


@query
def unresolved_sample(t: Tables) -> DataFrame:
    return op.unresolved_sample(op.resolve_keepers(_marked(t), PREFER, REJECT), 10).select(
        "group_id", "members", "remaining"
    )


# -- set operations ----------------------------------------------------------


@query
def union_items(t: Tables) -> DataFrame:
    return _everything(t).select("path", "size", "hash", "type")


@query
def shared_hashes(t: Tables) -> DataFrame:
    return op.overlap_hashes(in_containers(t.entries).select("container", "hash"), 2)


@query
def missing_paths(t: Tables) -> DataFrame:
    return op.missing_paths(_exact(t), t.inventory_now)


# -- marking, planning, sinks ------------------------------------------------


@query
def mark_groups(t: Tables) -> DataFrame:
    """Groups with a text match kept whole, then one member per group flipped."""
    members = op.mark_groups(op.reused(_regular(t)), True, text="src1/en")
    flips = members.groupBy("group_id").agg(F.max("path").alias("path"))
    return op.toggle_members(members, flips).select("group_id", "path", "keep")


@query
def deletion_plan(t: Tables) -> DataFrame:
    return op.deletion_plan(op.keep_original(_regular(t)))


@query
def deletion_log(t: Tables) -> DataFrame:
    """A plan appended twice on one day, as by a repeated run, and once on the next."""
    folder = op.new_folder(t.spark, "deletion-log")
    plan = op.reused(op.deletion_plan(_regular(t)))
    day = F.lit("2024-01-02 03:04:05").cast("timestamp")
    for moment in (day, day, F.lit("2024-01-03 00:00:00").cast("timestamp")):
        src.exports.append_deletion_log(plan, folder, moment)
    log = t.spark.read.parquet(folder)
    return log.select(F.date_format("log_date", "yyyy-MM-dd").alias("log_day"), "path", "method", "size")


def _regular_with_created(t: Tables) -> DataFrame:
    return _regular(t).withColumn("created", F.lit("2024-01-01 00:00:00"))


def _text_back(t: Tables, folder: str) -> DataFrame:
    return t.spark.read.option("header", "true").option("quote", '"').option("escape", '"').option(
        "multiLine", "true"
    ).csv(folder)


@query
def export_regular_csv(t: Tables) -> DataFrame:
    folder = op.new_folder(t.spark, "regular-csv")
    src.export_regular_csv(_regular_with_created(t), folder)
    return _text_back(t, folder).select("group_id", "path", "size", "type", "hash", "created", "keep")


@query
def export_duplicates_report(t: Tables) -> DataFrame:
    """Both sections of the report in one table; the pairs are written compressed."""
    folder = op.new_folder(t.spark, "report")
    src.export_duplicates_report(_members_with_totals(t), folder, "gzip")
    groups = _text_back(t, f"{folder}/groups").select(
        F.lit("groups").alias("section"), "group_id", F.col("hash").alias("a"), F.col("path").alias("b"), "size", "type",
        F.col("matched_inside").alias("count"),
    )
    pairs = _text_back(t, f"{folder}/pairs").select(
        F.lit("pairs").alias("section"), F.lit("").alias("group_id"), F.col("archive_a").alias("a"), F.col("archive_b").alias("b"),
        F.lit("").alias("size"), F.lit("archive").alias("type"), F.col("shared_files").alias("count"),
    )
    return groups.unionByName(pairs).fillna("", ["size", "count"])


@query
def export_similar_csv(t: Tables) -> DataFrame:
    folder = op.new_folder(t.spark, "similar-csv")
    found = op.keep_first(op.similar_groups(_images(t)), "root")
    src.export_similar_csv(
        members_of(
            found.withColumn("phash", fn.to_hex16(F.col("h"))).withColumn("type", F.lit("file")), "image", F.col("root")
        ), folder,
    )
    return _text_back(t, folder).select(
        "category", "group_id", "path", "size_bytes", "type", fn.bit_text(fn.from_hex16(F.col("phash"))).alias("bits"),
        "keep",
    )


@query
def export_sequence_csv(t: Tables) -> DataFrame:
    folder = op.new_folder(t.spark, "sequence-csv")
    found = op.keep_first(op.similar_sequences(_clips(t)), "root").withColumn("type", F.lit("file"))
    src.export_sequence_csv(members_of(found, "video", F.col("root")), folder)
    return _text_back(t, folder).select("category", "group_id", "path", "size_bytes", "frame_count", "keep")


@query
def export_overlap_csv(t: Tables) -> DataFrame:
    folder = op.new_folder(t.spark, "overlap-csv")
    src.export_overlap_csv(op.container_overlap(in_containers(t.entries), 2), folder, "gzip")
    return _text_back(t, folder).select(
        "archive_a", "archive_b", "common_files", "a_total", "b_total", "overlap_ratio_a", "overlap_ratio_b"
    )


@query
def save_session(t: Tables) -> DataFrame:
    """All tabs saved, loaded and summed up per group."""
    folder = op.new_folder(t.spark, "session")
    src.save_session(_all_tabs(t), folder)
    loaded = src.load_session(t.spark, folder)
    return session_groups(loaded.withColumn("ordinal", F.col("path"))).select("tab", "group_id", "n", "savable", "category")


@query
def update_fingerprint_cache(t: Tables) -> DataFrame:
    """The earlier cache, then a second run's hashes merged into it."""
    folder = op.new_folder(t.spark, "cache")
    seconds = F.unix_timestamp("mtime").alias("mtime")
    src.save_cache(t.cache.select("path", "size", seconds, "hash", "phash"), folder, ["/data/a"])
    src.save_cache(t.hashed.select("path", "size", seconds, "hash"), folder, ["/data/b"])
    return load_cache(t.spark, folder).select("path", "size", "mtime", "hash", "phash")
