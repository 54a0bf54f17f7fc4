"""Near copies against brute force."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from twinsift.llm import near_copies


def changed(text, n, mark):
    """``n`` words changed, far from each other: five shingles each."""
    words = text.split()
    for k in range(n):
        words[20 + 30 * k] = f"{mark}{k}"
    return " ".join(words)


def test_the_stage_confirms_the_similarity(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(40)]
    assert near_copies.jaccard(*(near_copies.shingle_set(t.encode(), 5) for t in (texts[0], changed(texts[0], 6, "x")))) > 0.8
    assert near_copies.jaccard(*(near_copies.shingle_set(t.encode(), 5) for t in (texts[0], changed(texts[0], 7, "x")))) < 0.8
    rows = [(100 * k + i, t if k == 0 else changed(t, 5 + k, "x" * k)) for k in (0, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], pipeline.COLUMNS)
    stay = {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}
    assert stay >= {i + k for i in range(40) for k in (0, 200)}, "below 0.8 and removed"
    assert sum(100 + i in stay for i in range(40)) <= 1, "above 0.8 and left"


@pytest.mark.parametrize("cell", [256, 6])
def test_groups_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "_CELL", cell)
    rng = np.random.default_rng(cell)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(2)]
    texts = [changed(base[i % 2], int(rng.integers(1, 8)), f"v{i % 9}x") for i in range(80)] + ["", "one", None]
    sets = [near_copies.shingle_set((t or "").encode(), 5) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_copies.jaccard(sets[i], sets[j]) >= 0.8 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, "doc_id", limit=110).collect()}
    assert [out[i] for i in range(len(texts))] == group and len(set(group)) > 3
