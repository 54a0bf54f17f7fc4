"""File trees, containers on disk, saved sessions."""

import gzip
import io
import os
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsift import operators as op, sources as src
from twinsift.plans import fixture_files
from twinsift.sources import archives


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, data in {
        "a.txt": b"same" * 1000, "sub/b.txt": b"same" * 1000, "sub/deep/c.txt": b"same" * 999 + b"sama",
        ".hidden": b"h", "_under.txt": b"h", "Thumbs.db": b"x", "empty": b"", "x.tmp": b"t",
        "node_modules/index.js": b"j",
    }.items():
        (root / name).write_bytes(data)
    os.symlink(root / "a.txt", root / "link.txt")
    os.link(root / "a.txt", root / "hard.txt")
    with zipfile.ZipFile(root / "one.zip", "w") as z:
        z.writestr("in/p", b"first")
        z.writestr("in/q", b"second")
        z.writestr("dir/", b"")
    with tarfile.open(root / "two.tar.gz", "w:gz") as t:
        for name in ("p", "q"):
            path = tmp_path / name
            path.write_bytes({"p": b"first", "q": b"second"}[name])
            t.add(path, name)
    (root / "broken.zip").write_bytes((root / "one.zip").read_bytes()[:40])
    return root


def names(frame, root):
    return sorted(os.path.relpath(r.path, root) for r in frame.select("path").collect())


def test_inventory(spark, tree):
    found = src.file_inventory(spark, [str(tree), str(tree / "sub")], ["dir:node_modules"])
    assert names(found, tree) == sorted([
        "a.txt", "hard.txt", "sub/b.txt", "sub/deep/c.txt", ".hidden", "_under.txt", "empty",
        "one.zip", "two.tar.gz", "broken.zip",
    ])
    sizes = {os.path.basename(r.path): (r.size, r.inode) for r in found.collect()}
    assert sizes["empty"][0] == 0 and sizes["a.txt"] == sizes["hard.txt"]


def test_spark_listing_reads_no_content(spark, tree):
    found = src.object_inventory(spark, [str(tree)])
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert found.count() > 5


@pytest.mark.parametrize("check_inode, members", [(False, 3), (True, 2)])
def test_duplicate_files(spark, tree, check_inode, members):
    inventory = op.durable(src.file_inventory(spark, [str(tree)]).where(F.col("path").endswith(".txt")))
    found = src.exact_duplicate_files(inventory, head_kib=1, check_inode=check_inode)
    assert found.where("size = 4000").count() == members
    links = op.hardlink_groups(inventory)
    assert names(links, tree) == ["a.txt", "hard.txt"]


def test_entries_of_containers(spark, tree):
    inventory = src.file_inventory(spark, [str(tree)])
    zips = src.zip_entries(inventory.where(F.col("path").endswith(".zip")))
    tars = src.tar_entries(inventory.where(F.col("path").endswith(".gz")))
    entries = src.union_items(zips, tars)
    assert sorted((r.entry, r.type, r.size) for r in entries.collect()) == [
        ("in/p", "zip_entry", 5), ("in/q", "zip_entry", 6), ("p", "tar_entry", 5), ("q", "tar_entry", 6)
    ]
    (pair,) = op.container_overlap(entries, 2).collect()
    assert pair.common == 2 and pair.container_a.endswith("one.zip") and pair.container_b.endswith("two.tar.gz")


def test_large_container_is_divided(spark, tmp_path, monkeypatch):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(2500):
            z.writestr(f"e{i}", str(i))
    found = src.zip_entries(spark.createDataFrame([(str(path),)], "path string"))
    assert found.select("entry").distinct().count() == found.count() == 2500


def members(spark):
    return spark.createDataFrame(
        [
            ("regular", "r:1", 'a, "b".txt', 10, "file", "ff", None, None, None, "2024-01-01 00:00:00", True),
            ("regular", "r:1", "c.txt", 10, "file", "ff", None, None, None, "2024-01-01 00:00:00", False),
            ("image", "i:1", "한.png", 7, "file", None, "00ff", "similar", None, None, True),
            ("image", "i:1", "x.png", 5, "file", None, "00fe", "similar", None, None, False),
        ],
        "tab string, group_id string, path string, size bigint, type string, hash string, phash string, "
        "category string, shared int, created string, keep boolean",
    )


def test_csv_round_trip(spark, tmp_path):
    folder = str(tmp_path / "csv")
    regular = members(spark).where("tab = 'regular'")
    src.export_regular_csv(regular, folder)
    back = src.load_session_csv(spark, folder)
    columns = ["group_id", "path", "size", "type", "hash", "keep"]
    assert sorted(back.select(*columns).collect()) == sorted(regular.select(*columns).collect())


def test_foreign_csv(spark, tmp_path):
    file = tmp_path / "found.csv"
    file.write_text("group_id,path,size_bytes,keep\n1,/b,7,YES\n1,/a,9,no\n,,,\n2,/c,oops,\n")
    rows = src.load_session_csv(spark, str(file), "image").orderBy("path").collect()
    assert [(r.group_id, r.path, r.size, r.keep, r.type) for r in rows] == [
        ("1", "/a", 9, False, "file"), ("1", "/b", 7, True, "file"), ("2", "/c", 0, True, "file")
    ]
    from twinsift.sources.sessions import session_groups
    groups = {r.group_id: r.savable for r in session_groups(src.load_session_csv(spark, str(file))).collect()}
    assert groups == {"1": 9, "2": 0}


def test_session_round_trip(spark, tmp_path):
    folder = str(tmp_path / "session")
    src.save_session(members(spark), folder, "s1")
    back = src.load_session(spark, folder)
    columns = ["tab", "group_id", "path", "size", "phash", "category", "keep"]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, members(spark).select(*columns).collect()))
    manifest = {r.tab: r.groups for r in spark.read.json(f"{folder}/manifest").collect()}
    assert manifest == {"regular": 1, "image": 1}


def test_containers_are_handed_on_by_their_bytes(monkeypatch):
    """One large batch of texts goes in; no batch of containers is much above the limit."""
    monkeypatch.setattr(fixture_files, "PACK_BYTES", 5_000)
    texts = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(200)], "text": [f"a{i}\n\nb{i}" for i in range(200)]})
    out = list(fixture_files._packed(archives.one_by_one([texts]), fixture_files._write_zip))
    assert len(out) > 5 and max(b.nbytes for b in out) < 7_000
    rows = list(archives._zip_rows(out))
    assert [(r[0], r[1]) for r in rows] == [(f"p{i}", f"part{k}") for i in range(200) for k in (1, 3)]


def test_tar_is_compressed_at_once(monkeypatch):
    """One call for the whole container, whatever the number of its entries; it reads back whole."""
    calls = []
    write = gzip.GzipFile.write
    monkeypatch.setattr(gzip.GzipFile, "write", lambda self, data: (calls.append(1), write(self, data))[1])
    buffer = io.BytesIO()
    fixture_files._write_tar(buffer, [(f"part{i}", b"x" * i) for i in range(1, 40)])
    assert len(calls) == 1
    batch = pa.RecordBatch.from_pydict({"path": ["p"], "content": [buffer.getvalue()]})
    assert [(r[1], r[4]) for r in archives._tar_rows([batch])] == [(f"part{i}", i) for i in range(1, 40)]
