"""What is written piece by piece: cache versions, the deletion log, the report."""

import csv
from pathlib import Path

from pyspark.sql import functions as F

from twinsift import sources as src
from twinsift.operators.containers import container_pair_rollup
from twinsift.sources import cache_store

CACHE = "path string, size long, mtime long, hash string, phash string, frames array<bigint>"


def bytes_below(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def content(frame):
    return sorted(map(repr, frame.select("path", "size", "mtime", "hash", "phash", "frames").collect()))


def test_cache_writes_what_changed(spark, tmp_path):
    folder = str(tmp_path / "cache")
    n = 20_000
    rows = spark.range(n).select(
        F.concat(F.lit("/data/"), "id").alias("path"), (F.col("id") * 7).alias("size"), F.col("id").alias("mtime"),
        F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(None).cast("string").alias("phash"),
        F.array(F.xxhash64("id")).alias("frames"))
    src.save_cache(rows, folder, ["/data"])
    whole = bytes_below(f"{folder}/data/version=1")
    # One percent: some new, some with another hash, some as they were, some with one more column.
    more = rows.where("mtime < 100")
    update = more.withColumn("phash", F.when(F.col("mtime") < 30, "abc")).withColumn(
        "hash", F.when(F.col("mtime") < 60, F.col("hash"))).withColumn("frames", F.lit(None).cast("array<bigint>")).unionByName(
        rows.where("mtime < 100").withColumn("path", F.concat("path", F.lit(".new"))))
    after = src.save_cache(update, folder, ["/more"])
    assert bytes_below(f"{folder}/data/version=2") < 0.05 * whole
    changes = spark.read.parquet(f"{folder}/data/version=2")
    assert changes.count() == 130, "thirty with a new column and a hundred new ones"
    assert after.count() == n + 100 and cache_store.scan_paths(spark, folder) == ["/data", "/more"]
    assert after.where("phash = 'abc'").where("hash IS NULL OR frames IS NULL").isEmpty()
    assert content(after) == content(cache_store.merge_fingerprints(rows, update))


def test_cache_versions_add_up(spark, tmp_path):
    folder = str(tmp_path / "cache")
    given = [[("a", 1, 1, "x", None, None), ("b", 1, 1, None, "p", [1])], [("a", 1, 1, "y", None, None)],
             [("a", 1, 1, None, "q", None), ("c", 2, 2, "z", None, [3, 4])], [], [("a", 1, 2, "other", None, None)], [("b", 1, 1, "w", None, None)]]
    want = spark.createDataFrame([], CACHE)
    for share in (100.0, 0.0):
        for rows in given:
            part = spark.createDataFrame(rows, CACHE)
            want = spark.createDataFrame(cache_store.merge_fingerprints(want, part).collect(), CACHE)
            # A run that was stopped has left files behind, but no row in the list of versions.
            spark.createDataFrame([("junk", 0, 0, "j", None, None)], CACHE).write.mode("overwrite").parquet(
                f"{folder}/data/version={cache_store._latest(spark, folder)[0] + 1}")
            assert content(src.save_cache(part, folder, compact_share=share)) == content(want)
    version, base, _ = cache_store._latest(spark, folder)
    assert version > base > 1, "the last rows were known already, so nothing had to be compacted"


def test_deletion_log_is_idempotent(spark, tmp_path):
    folder = str(tmp_path / "log")
    plan = spark.createDataFrame([("/a", 3), ("/b", None), (None, 5)], "path string, size long")
    other = spark.createDataFrame([("/a", 3)], "path string, size long")
    day = F.lit("2024-05-06 07:08:09").cast("timestamp")
    first = src.append_deletion_log(plan, folder, day)
    assert src.append_deletion_log(plan.repartition(3), folder, day) == first
    assert src.append_deletion_log(other, folder, day) != first
    src.append_deletion_log(plan.limit(0), folder, day)
    log = spark.read.parquet(folder)
    assert log.count() == 4 and {str(r.log_date) for r in log.collect()} == {"2024-05-06"}
    src.append_deletion_log(plan, folder)
    assert spark.read.parquet(folder).select("log_date").distinct().count() == 2


def test_report_tells_groups_apart(spark, tmp_path):
    rows = [(f"0123abcd{c}" + "0" * 55, p, 10, None, d) for c, d in (("1", "2024-01-01"), ("2", "2024-02-02")) for p in (f"/{c}x", f"/{c}y")]
    rows += [("0123abcd1" + "0" * 55, "/z.zip::in", 10, 4, "2020-01-01")]
    members = spark.createDataFrame(rows, "hash string, path string, size long, total long, created string")
    src.export_duplicates_report(members, str(tmp_path))
    back = spark.read.option("header", "true").csv(f"{tmp_path}/groups")
    assert {(r.group_id, r.hash, r.path, r.created) for r in back.collect()} == {
        (h, "0123abcd", p.split("::")[0], None if "::" in p else d) for h, p, _, _, d in rows}


def test_report_sorts_pairs_by_position(spark, tmp_path):
    """Positions of containers are in the order of their names, and so are the written pairs."""
    has = {f"/d{'ab'[i % 2]}/doc{i * 37 % 101}.zip": {f"h{k}" for k in range(12) if (i + k) % 5 < 2} for i in range(40)}
    rows = [(h, f"{c}::e{h}", 10, len(hs)) for c, hs in has.items() for h in hs]
    members = spark.createDataFrame(rows, "hash string, path string, size long, total long").repartition(3)
    expected = {(a, b): len(has[a] & has[b]) for a in has for b in has if a < b and has[a] & has[b]}
    pairs = container_pair_rollup(members, heavy_entry=3, placed=True).collect()
    at = {name: i + 1 for i, name in enumerate(sorted(has))}
    assert {(r.container_a.name, r.container_b.name): r.shared for r in pairs} == expected and len(pairs) == len(expected)
    assert all(at[c.name] == c.position for r in pairs for c in (r.container_a, r.container_b))
    src.export_duplicates_report(members, str(tmp_path))
    files = sorted((tmp_path / "pairs").glob("*.csv"))
    back = [tuple(line) for f in files for line in list(csv.reader(f.open()))[1:]]
    assert back == [(a, b, str(n)) for (a, b), n in sorted(expected.items())]
