"""Small fixed cases: hashing, distances, rules, types, cache."""

import json

import pytest
from pyspark.sql import functions as F

from twinsift import functions as fn, operators as op, sources as src


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_equal_bytes_hash_equal(spark):
    a, b, c = column(spark, [(b"hello",), (b"hello",), (b"world",)], "content binary", fn.content_hash(F.col("content")))
    assert a == b != c


def test_three_files_make_one_group(spark):
    items = spark.createDataFrame(
        [("a.txt", b"same content"), ("b.txt", b"same content"), ("c.txt", b"different")], "path string, content binary"
    )
    rows = op.exact_duplicates(items).orderBy("path").collect()
    assert [(r.path, r.keep, r.n, r.savable) for r in rows] == [("a.txt", True, 2, 12), ("b.txt", False, 2, 12)]


def test_staged_equals_direct(spark):
    rows = [(f"p{i}", bytes([i % 7]) * (2000 + i % 3)) for i in range(60)]
    items = spark.createDataFrame(rows, "path string, content binary")
    direct = {(r.hash, r.path) for r in op.exact_duplicates(items).collect()}
    staged = {(r.hash, r.path) for r in op.exact_duplicates(items, staged=True, head_kib=1).collect()}
    assert direct == staged and direct


@pytest.mark.parametrize("a, b, dist", [(0b1010, 0b1010, 0), (0b1010, 0b0101, 4), (0, -1, 64)])
def test_hamming(spark, a, b, dist):
    assert column(spark, [(a, b)], "a bigint, b bigint", fn.hamming(F.col("a"), F.col("b"))) == [dist]


def test_unreadable_hex_is_far(spark):
    rows = [("00000000000000ff", "0000000000000000"), ("zz", "00"), ("ffffffffffffffff", "0")]
    assert column(spark, rows, "a string, b string", fn.hamming_hex(F.col("a"), F.col("b"))) == [8, 64, 64]


def test_neighbours_of_zero(spark):
    items = spark.createDataFrame([(0, 0), (1, 1), (2, 255)], "id int, h bigint")
    near = {(r.rep_a, r.rep_b) for r in op.hamming_join(items, 2).collect()}
    assert near == {(0, 1)}


def test_sequence_distances(spark):
    rows = [([0, 1, 2], [0, 1, 2]), ([0], [-1]), ([0, 0, 15], [0]), ([], [1])]
    schema = "a array<bigint>, b array<bigint>"
    assert column(spark, rows, schema, fn.mean_min_distance(F.col("a"), F.col("b"))) == [0.0, 64.0, 0.0, float("inf")]
    assert column(spark, rows, schema, fn.aligned_distance(F.col("a"), F.col("b"))) == [0.0, 64.0, 0.0, 64.0]


@pytest.mark.parametrize("rule, path, file_gone, directory_gone", [
    ("file:foo.txt", "/some/dir/foo.txt", True, False),
    ("file:foo.txt", "/some/dir/bar.txt", False, False),
    ("dir:node_modules", "/project/node_modules", False, True),
    ("dir:node_modules", "/project/src", False, False),
    ("!no-ext", "/some/Makefile", True, False),
    ("!no-ext", "/some/file.txt", False, False),
    ("!no-ext", "/some/.profile", True, False),
    ("*.tmp", "/some/file.tmp", True, True),
    ("*.tmp", "/some/file.txt", False, False),
    ("*.{jpg,png}", "/a/b.png", True, True),
    ("/data/[!a]*", "/data/b/c", True, True),
    ("/data/[!a]*", "/data/a/c", False, False),
])
def test_exclude_rules(spark, rule, path, file_gone, directory_gone):
    rules = op.ExcludeRules([rule])
    frame = spark.createDataFrame([(path,)], "path string")
    row = frame.select(rules.skips_file(F.col("path")).alias("f"), rules.skips_directory(F.col("path")).alias("d")).first()
    assert (row.f, row.d) == (file_gone, directory_gone)


def test_directory_rule_takes_the_subtree(spark):
    items = spark.createDataFrame([("/project/node_modules/index.js",), ("/project/src/a.js",)], "path string")
    assert [r.path for r in op.exclude_rules(items, ["dir:node_modules"]).collect()] == ["/project/src/a.js"]


def test_media_types(spark):
    rows = [("photo.jpg",), ("photo.JPEG",), ("video.mp4",), ("a.ZIP",), ("note",), (".jpg",)]
    assert column(spark, rows, "path string", fn.media_type(F.col("path"))) == [
        "image", "image", "video", "archive", "other", "other"
    ]


def test_sizes_round_to_even_on_ties(spark):
    rows = [(0,), (1023,), (1280,), (1024 * 1024 - 1,), (3 * 1024 ** 5,)]
    assert column(spark, rows, "n bigint", fn.format_size(F.col("n"))) == [
        "0 B", "1023 B", "1.2 KB", "1024.0 KB", "3072.0 TB"
    ]
    assert column(spark, [(1536,), (2048,), (1342177280,)], "n bigint", fn.format_size(F.col("n"), "stats")) == [
        "2 KB", "2 KB", "1.3 GB"
    ]


def test_cache_key(spark):
    frame = spark.createDataFrame([("/a|b.txt", 5, 1700000000)], "path string, size bigint, t bigint")
    key = frame.select(fn.cache_key(F.col("path"), F.col("size"), F.timestamp_seconds("t"))).first()[0]
    assert key.rsplit("|", 2) == ["/a|b.txt", "5", "1700000000"]


def test_cache_json_forms(spark, tmp_path):
    entry = {"hash": "abc", "vhash_frames": [1, 2 ** 64 - 1]}
    wrapped, legacy, corrupt = tmp_path / "w.json", tmp_path / "l.json", tmp_path / "c.json"
    wrapped.write_text(json.dumps({"meta": {"scan_paths": ["/x"]}, "entries": {"/f|5|9": entry}}))
    legacy.write_text(json.dumps({"/f|5|9": entry}))
    corrupt.write_text("{not json")
    for path in (wrapped, legacy):
        (row,) = src.load_fingerprint_cache(spark, str(path)).collect()
        assert (row.path, row.size, row.mtime, row.hash, row.phash, row.frames) == ("/f", 5, 9, "abc", None, [1, -1])
    assert src.load_fingerprint_cache(spark, str(corrupt)).isEmpty()
    assert src.load_fingerprint_cache(spark, str(tmp_path / "none.json")).isEmpty()


def test_cache_store_merges_per_column(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert src.load_cache(spark, folder).isEmpty()
    first = spark.createDataFrame([("/f", 5, 9, "h", None)], "path string, size bigint, mtime bigint, hash string, phash string")
    second = spark.createDataFrame([("/f", 5, 9, "p"), ("/g", 1, 1, "q")], "path string, size bigint, mtime bigint, phash string")
    src.save_cache(first, folder, ["/x"])
    merged = src.save_cache(second, folder, ["/y"])
    assert {(r.path, r.hash, r.phash) for r in merged.collect()} == {("/f", "h", "p"), ("/g", None, "q")}
    assert src.cache_store.scan_paths(spark, folder) == ["/x", "/y"]
