"""Answers that went wrong once: excludes, sessions, links, plans, limits."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinsift import operators as op
from twinsift.operators import containers, skew
from twinsift.plans.scan import ScanOptions, scan
from twinsift.sources import exports, sessions


def test_excludes_hold_for_every_tab(spark):
    items = spark.createDataFrame([("/a/x.txt", 5, "h1"), ("/b/x.txt", 5, "h1")], "path string, size long, hash string")
    prints = spark.createDataFrame([(1, "/a/1.png", 5, 7), (2, "/a/2.png", 5, 7), (3, "/a/3.jpg", 5, 7), (4, "/a/4.jpg", 5, 7)],
                                   "id long, path string, size long, h long")
    clips = spark.createDataFrame([(1, "/a/1.mp4", 5, [1, 2]), (2, "/a/Thumbs.db", 5, [1, 2]), (3, "/a/3.mp4", 5, [1, 2])],
                                  "id long, path string, size long, frames array<long>")
    entries = spark.createDataFrame([(c, f"{c}::{e}", 5, e) for c in ("/a/1.png", "/a/2.zip", "/a/3.zip") for e in ("e1", "e2", "e3")],
                                    "container string, path string, size long, hash string").withColumn("type", F.lit("zip_entry"))
    found = scan(items, entries, prints, clips, options=ScanOptions(exclude=["*.png"])).select("tab", "path").collect()
    assert {r.path for r in found if r.tab == "image"} == {"/a/3.jpg", "/a/4.jpg"}
    assert {r.path for r in found if r.tab == "video"} == {"/a/1.mp4", "/a/3.mp4"}
    assert {r.path for r in found if r.tab == "archive"} == {"/a/2.zip", "/a/3.zip"}


def test_plan_over_tabs_keeps_a_copy(spark):
    members = spark.createDataFrame(
        [("regular", "g", "A", True), ("regular", "g", "B", False), ("image", "i", "A", False), ("image", "i", "B", True),
         ("video", "v", "C", False), ("video", "v", "D", False)],
        "tab string, group_id string, path string, keep boolean").withColumn("size", F.lit(1))
    assert {r.path for r in op.deletion_plan(members).collect()} == {"D"}


def test_entries_do_not_decide(spark):
    members = spark.createDataFrame(
        [("g", "a.zip::keep/x", None), ("g", "/p/x", None), ("g", "/q/x", None), ("h", "a.zip::x", None), ("h", "b.zip::x", None),
         ("m", "a.zip::y", None), ("m", "/p/y", "no"), ("m", "/q/y", "yes")], "group_id string, path string, mark string")
    out = {r.path: (r.status, r.remove) for r in op.resolve_keepers(members, ["keep", "/q/"]).where("group_id = 'g'").collect()}
    assert out == {"a.zip::keep/x": ("ruled", False), "/p/x": ("ruled", True), "/q/x": ("ruled", False)}
    rest = {r.path: (r.status, r.remove) for r in op.resolve_keepers(members, ["keep"]).where("group_id <> 'g'").collect()}
    assert rest["a.zip::x"] == rest["b.zip::x"] == ("unresolved", False)
    assert rest["a.zip::y"] == ("marked", False) and rest["/p/y"] == ("marked", True)


def test_links_need_the_device(spark):
    files = spark.createDataFrame([("/m1/a", 5, 1, 9), ("/m1/b", 5, 1, 9), ("/m2/a", 5, 2, 9)], "path string, size long, device long, inode long")
    assert {r.path for r in op.hardlink_groups(files).collect()} == {"/m1/a", "/m1/b"}
    assert {r.path for r in op.hardlink_representatives(files).collect()} == {"/m1/a", "/m2/a"}


def test_sessions_may_be_empty_or_replaced(spark, tmp_path):
    members = spark.createDataFrame([("regular", "g", "a", 1), ("image", "h", "b", 2)], "tab string, group_id string, path string, size long")
    sessions.save_session(members, f"{tmp_path}/s", "one")
    assert sessions.load_session(spark, f"{tmp_path}/s").count() == 2
    sessions.save_session(members.limit(0), f"{tmp_path}/s", "two")
    empty = sessions.load_session(spark, f"{tmp_path}/s")
    assert empty.count() == 0 and set(empty.columns) == set(members.columns)


def test_csv_order_over_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    head = "group_id,path,size,type,hash,created,keep\n"
    (tmp_path / "csv/part-00000.csv").write_text(head + "g,/a,7,file,h,,YES\n")
    (tmp_path / "csv/part-00001.csv").write_text(head + "".join(f"g,/b{i},100,file,h,,NO\n" for i in range(500)))
    loaded = sessions.load_session_csv(spark, f"{tmp_path}/csv")
    assert sessions.session_groups(loaded).first().savable == 50_000
    assert [r.path for r in loaded.orderBy("ordinal").collect()] == ["/a", *[f"/b{i}" for i in range(500)]]


@pytest.mark.parametrize("threshold", [36, 50, 64])
def test_any_limit(spark, threshold, monkeypatch):
    from twinsift.operators import hamming
    monkeypatch.setattr(hamming, "WIDE_ROWS", 20)
    rng = random.Random(threshold)
    values = sorted({rng.getrandbits(64) - 2**63 for _ in range(70)})
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(values)], "id long, h long")
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) % 2**64).bit_count() <= threshold}
    got = [(r.h_a, r.h_b) for r in op.hamming_join(frame, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_all_hot_keys_are_divided(spark):
    rows = spark.range(60_000).select(F.col("id").alias("path"), (F.col("id") % 1_500).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.join_to_groups(rows, groups, "k", "n", "path", hot_rows=10, settle=True)
    assert joined.count() == 60_000 and joined.where("n <> 40").isEmpty()


@pytest.mark.parametrize("heavy_entry", [1000, 5, 1])
@pytest.mark.parametrize("copies", [0, 12])
def test_hashes_of_all_overlaps(spark, monkeypatch, heavy_entry, copies):
    """What all pairs share, with lists and lots of a few rows."""
    for name, rows in (("CELL_ROWS", 3), ("LIST_ROWS", 2), ("PART_ROWS", 4)):
        monkeypatch.setattr(containers, name, rows)
    rng = random.Random(heavy_entry)
    has = {f"c{i:03}": {f"h{int(rng.paretovariate(.5)) % 60}" for _ in range(rng.randrange(9))} for i in range(60)}
    has |= {f"b{i:03}": {f"h{k}" for k in range(7)} for i in range(copies)}
    rows = [(c, h) for c, hs in has.items() for h in hs for _ in range(rng.choice([1, 1, 2]))] + [("c001", None)]
    frame = spark.createDataFrame(rows, "container string, hash string")
    expected = sorted((a, b, h) for a in has for b in has if a < b and len(has[a] & has[b]) >= 2 for h in has[a] & has[b])
    assert sorted(map(tuple, op.overlap_hashes(frame, 2, heavy_entry).collect())) == expected and len(expected) > 100


def test_hashes_of_overlaps_do_not_exchange_pairs(spark):
    """400 containers with 12 frequent entries: 957,600 rows, none of which is exchanged."""
    rows = [(f"c{i}", f"{k:064}" if k < 12 else f"{i}-{k}") for i in range(400) for k in range(13)]
    frame = spark.createDataFrame(rows, "container string, hash string")
    found = op.overlap_hashes(frame, 2, 100)

    def exchanged():
        return {f: f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data") if f.exists()}

    before = exchanged()
    assert found.count() == 400 * 399 // 2 * 12
    assert sum(n for f, n in exchanged().items() if f not in before) < 1 << 20


@pytest.mark.parametrize("heavy_entry", [1000, 5, 1])
def test_lots_of_copies_are_all_named(spark, monkeypatch, heavy_entry):
    """Contents with up to 40 copies, whose names come in lots of one or two."""
    for name, rows in (("CELL_ROWS", 3), ("LIST_ROWS", 2), ("PART_ROWS", 4), ("LOT_BITS", 1)):
        monkeypatch.setattr(containers, name, rows)
    rng = random.Random(heavy_entry)
    has = {}
    for i, copies in enumerate([1] * 20 + [2, 2, 3, 5, 9, 40]):
        content = Counter(f"h{int(rng.paretovariate(.5)) % 20}" for _ in range(rng.randrange(2, 9)))
        has |= {f"c{i:02}-{k:02}": content for k in range(copies)}
    rows = [(c, h) for c, hs in has.items() for h, n in hs.items() for _ in range(n)]
    frame = spark.createDataFrame(rows, "container string, hash string")
    pairs = [(a, b) for a in has for b in has if a < b]
    shared = {(a, b): set(has[a]) & set(has[b]) for a, b in pairs}
    totals = {c: sum(hs.values()) for c, hs in has.items()}
    want = sorted((a, b, len(s), totals[a], totals[b]) for (a, b), s in shared.items() if len(s) >= 2)
    assert sorted(map(tuple, op.container_overlap(frame, 2, heavy_entry).collect())) == want and len(want) > 300
    counted = ((a, b, sum(has[a][h] for h in s), totals[a], totals[b]) for (a, b), s in shared.items())
    assert sorted(map(tuple, op.container_overlap_entries(frame, 2, heavy_entry).collect())) == sorted(x for x in counted if x[2] >= 2)
    hashes = sorted((a, b, h) for (a, b), s in shared.items() if len(s) >= 2 for h in s)
    assert sorted(map(tuple, op.overlap_hashes(frame, 2, heavy_entry).collect())) == hashes


def exchanged_rows(plan):
    """Rows that the exchanges of a plan that has run wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(exchanged_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_pairs_of_copies_are_not_exchanged(spark):
    """30 contents with 100 copies each share an entry: 4,350,000 pairs, of which the 435 of contents are exchanged."""
    rows = [(f"/data/{c}.zip::{e}", e) for c in range(3000) for e in ("shared", f"own{c % 30}")]
    members = spark.createDataFrame(rows, "path string, hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = op.container_pair_rollup(members).agg(
            F.count("*").alias("n"), F.sum("shared").alias("shared"), F.max("container_a"), F.max("container_b"))
        facts = found.collect()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    twins = 30 * 100 * 99 // 2
    assert (facts.n, facts.shared) == (3000 * 2999 // 2, 3000 * 2999 // 2 + twins)
    assert exchanged_rows(found._jdf.queryExecution().executedPlan()) < 20_000


@pytest.mark.parametrize("options", [{}, {"few_entries": 0}])
def test_groups_do_not_write_what_meets_at_one_entry(spark, options):
    """900 containers share an entry and two by two another one: 404,550 meetings, 450 pairs."""
    rows = [(f"c{i:03}", h) for i in range(900) for h in ("everywhere", f"own{i}", f"two{i // 2}")]
    frame = spark.createDataFrame(rows, "container string, hash string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.rglob("part-*"))
    groups = op.container_groups(frame, 2, **options).collect()
    assert sorted((r.container, r.root, r.n, r.shared) for r in groups) == [
        (f"c{i:03}", f"c{i // 2 * 2:03}", 2, 2) for i in range(900)]
    assert sum(f.stat().st_size for f in set(folder.rglob("part-*")) - before) < 500_000


@pytest.mark.parametrize("heavy_entry, few_entries", [(1000, 4), (12, 8), (10, 4)])
def test_groups_by_pairs_of_entries(spark, heavy_entry, few_entries):
    """Small and larger baskets: the same groups as from all pairs, whichever way they meet."""
    rng = random.Random(heavy_entry * 10 + few_entries)
    has = {f"o{i:03}": {f"p{rng.choice([rng.randrange(5), *[rng.randrange(5, 250)] * 3])}" for _ in range(rng.choice([1, 2, 3, 3, 4, 7, 12]))}
           for i in range(150)}
    frame = spark.createDataFrame([(c, h) for c, hs in has.items() for h in hs], "container string, hash string")
    shared = {(a, b): len(has[a] & has[b]) for a in has for b in has if a < b and len(has[a] & has[b]) >= 2}
    root = {c: c for pair in shared for c in pair}
    for _ in root:
        for a, b in shared:
            root[a] = root[b] = min(root[a], root[b])
    best = {r: max(n for (a, _), n in shared.items() if root[a] == r) for r in set(root.values())}
    got = {(r.container, r.root, r.shared) for r in op.container_groups(frame, 2, heavy_entry, few_entries=few_entries).collect()}
    assert got == {(c, r, best[r]) for c, r in root.items()} and len(best) > 1


def test_pair_reports_may_be_compressed(spark, tmp_path):
    members = spark.createDataFrame(
        [(f"/d/a{c:03}.zip::{e}", 5, e, 2) for c in range(60) for e in ("x", "y")], "path string, size long, hash string, total long")
    exports.export_duplicates_report(members, f"{tmp_path}/plain")
    exports.export_duplicates_report(members, f"{tmp_path}/packed", "gzip")
    plain, packed = (sorted(map(tuple, spark.read.option("header", "true").csv(f"{tmp_path}/{x}/pairs").collect())) for x in ("plain", "packed"))
    assert plain == packed and len(plain) == 60 * 59 // 2
    size = {x: sum(f.stat().st_size for f in (tmp_path / x / "pairs").glob(f"part-*{end}")) for x, end in (("plain", ".csv"), ("packed", ".csv.gz"))}
    assert 0 < size["packed"] < size["plain"] / 4
    pairs = spark.createDataFrame([("a", "b", 2, 3, 4)], "container_a string, container_b string, common long, total_a long, total_b long")
    exports.export_overlap_csv(pairs, f"{tmp_path}/overlap", "gzip")
    assert [tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/overlap").collect()] == [
        ("a", "b", "2", "3", "4", "66.7", "50.0")] and list((tmp_path / "overlap").glob("*.csv.gz"))
