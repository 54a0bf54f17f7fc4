"""Merkle manifests and exact duplicates against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinsift.llm import digest_runs, merkle, queries
from twinsift.llm.common import lower_az

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, arity):
    """Root, and per leaf the runs of siblings on the way up as (left, right) texts."""
    ways, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, at in enumerate(place):
            run = digests[at - at % arity:at - at % arity + arity]
            ways[k].append(("".join(run[:at % arity]), "".join(run[at % arity + 1:])))
        digests = [sha("".join(digests[i:i + arity])) for i in range(0, len(digests), arity)]
        place = [at // arity for at in place]
    return (digests[0] if digests else None), ways


def manifest(rows, arity):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]], arity)
    root, tops = tree([trees[s][0] for s in names], arity)
    out = []
    for s, top in zip(names, tops):
        for r, way in zip(by_source[s], trees[s][1]):
            way = way + top
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf((*r[:4], r[4].translate(UPPER) if r[4] is not None else None))
            for left, right in way:
                h = sha(left + h + right)
            out.append((str(r[0]), leaf(r), trees[s][0], root, sha("".join(a + b for a, b in way)), h, h == root))
    return sorted(out)


def of(spark, rows, arity):
    docs = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, row string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = merkle.leaf_digest([F.col(c) if c != "text" else lower_az(F.col(c)) for c in merkle.FIELDS])
    found = merkle.manifest(docs.repartition(3), carry={"claimed": F.when(tampered, changed)}, arity=arity)
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p, r.f, r.f == r.root) for r in found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), folded.alias("f")).collect())


@pytest.mark.parametrize("arity,count,sources", [(2, 37, 7), (3, 82, 1), (16, 300, 20), (16, 1, 1), (2, 5, 5), (4, 17, 3)])
def test_manifest(spark, arity, count, sources):
    rows = [(i * 3 - 7, [None, "", "\U0001f600", "￿"][i % sources] if i % sources < 4 else f"s{i % sources}",
             None if i % 4 == 0 else "en", None if i % 3 else i, None if i % 11 == 0 else f"Text Ä {i}" if i % 2 else "") for i in range(count)]
    assert of(spark, rows, arity) == manifest(rows, arity)


def test_manifest_ties(spark):
    rows = [(None, "a", "en", 1, "X")] * 40 + [(5, "a", "en", 1, "X")] * 9 + [(5, "a", "en", 1, "Y"), (5, "b", None, None, None)]
    assert of(spark, rows, 4) == manifest(rows, 4)


def test_manifest_nothing(no_docs, odd_docs):
    assert merkle.manifest(no_docs).count() == 0
    got = merkle.manifest(odd_docs, keep=("doc_id", "kept", "host"))
    assert got.count() == odd_docs.count() and got.columns[:3] == ["doc_id", "kept", "host"]


def test_pointers_double(spark):
    """A long way up takes rounds in the logarithm of its length."""
    rows = [(i, "a", None, None, str(i)) for i in range(600)]
    assert of(spark, rows, 2) == manifest(rows, 2)


# -- exact duplicates --------------------------------------------------------


def groups(rows, pick):
    found = defaultdict(list)
    for i, t in rows:
        found[(t or "").translate(UPPER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(UPPER)
        ids = [x for x in found[norm] if x is not None]
        out.append((str(i), str(pick(ids) if ids else None), len(found[norm]), sha(norm)))
    return sorted(out)


@pytest.mark.parametrize("largest,fan,parts", [(True, 2, 11), (False, 3, 7), (True, 16, 40), (False, 16, 1)])
def test_exact(spark, largest, fan, parts):
    texts = [None, "", "Same", "same", "SAME", "ÄB", "äb", "äB", " same", "x" * 50_000, "X" * 50_000]
    rows = [(i if i % 9 else None, texts[i % len(texts)] if i % 2 else f"own {i}") for i in range(400)]
    rows += [(1000 + i, "hot text") for i in range(300)] + [(1000, "hot text")] * 3 + [(None, "nobody")] * 4
    docs = spark.createDataFrame([(*r, "r", "d") for r in rows], "doc_id long, text string, run string, digest string")
    got = digest_runs.exact_duplicates(docs.repartition(parts), largest=largest, fan=fan).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == groups(rows, max if largest else min)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_nothing(no_docs, odd_docs):
    assert digest_runs.exact_duplicates(no_docs).count() == 0
    got = digest_runs.exact_duplicates(odd_docs, keep=("doc_id", "kept", "host"), id_col="doc_id").count()
    assert got == odd_docs.count()


def test_exact_stays_in_the_engine(odd_docs):
    plan = digest_runs.exact_duplicates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_queries_registered():
    assert {"op11_merkle_manifest", "op12_exact_dedup", "op13_token_alignment"} <= set(queries.QUERIES)
