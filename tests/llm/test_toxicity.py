"""Held-out accuracy, and rows that have nothing to learn from."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from twinsift.llm import toxicity

TRAIN = lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 0


def made(spark, n=700):
    rng = random.Random(8)
    common = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(common) if rng.random() < .7 else f"rare{rng.getrandbits(30)}" for _ in range(rng.randrange(20, 400))]
        for _ in range(rng.randrange(1, 4)) if toxic else ():
            words[rng.randrange(len(words))] = rng.choice(["Vile", "awful", f"vermin{rng.getrandbits(30)}"])
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    out = toxicity.toxicity(docs, labels, TRAIN).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 700 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in out)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.93 * len(held), (right, len(held))
    # Labels of held-out rows and the other columns have no influence.
    flipped = labels.withColumn("toxic", F.when(TRAIN(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = toxicity.toxicity(docs.withColumn("score", F.lit("clash")).repartition(3), flipped, TRAIN).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in out}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd_docs, labels, TRAIN).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(no_docs, labels, TRAIN).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert {r.score for r in toxicity.toxicity(odd_docs, some, TRAIN).collect()} == {1.0 if some.where("toxic = 1").count() else 0.0}


def plain_models(texts, least, discount):
    """Interpolated Kneser-Ney of two classes over shared continuation counts, from its definition."""
    counts = {1: Counter(), 0: Counter()}
    for toxic, text in texts:
        words = text.lower().split()
        counts[toxic].update(zip(["", *words], words))
    both = counts[0] + counts[1]
    total, before = Counter(), defaultdict(set)
    for (v, w), n in both.items():
        total[w] += n
        before[w].add(v)
    spread = {w: min(len(before[w]), least) for w in total}
    all_spread = sum(spread.values())

    def unigrams(toxic):
        seen = defaultdict(set)
        for v, w in counts[toxic]:
            seen[w].add(v)
        spreads = Counter({w: len(contexts) for w, contexts in seen.items()})
        mass = spreads.total()

        def p(n, s):
            shared = (s + 1) / (all_spread + len(total) + 1)
            return (max(n - discount, 0) + discount * len(spreads) * shared) / mass
        return spreads, p

    (seen_t, pt), (seen_o, po) = unigrams(1), unigrams(0)
    known = {w: (pt(seen_t[w], spread[w]), po(seen_o[w], spread[w])) for w, n in total.items() if n >= least}

    def bigram(toxic, v, w, lower):
        here = {x: n for (u, x), n in counts[toxic].items() if u == v}
        n = sum(here.values())
        return max(here.get(w, 0) - discount, 0) / n + discount * len(here) / n * lower if n else lower

    pairs = {(v, w): math.log(bigram(1, v, w, known[w][0]) / bigram(0, v, w, known[w][1]))
             for (v, w), n in both.items() if v and n >= least}
    pieces = {}
    for begin in {w[:k] for w in total for k in toxicity.PIECES if len(w) > k}:
        under = [w for w in total if len(w) > len(begin) and w.startswith(begin)]
        if sum(total[w] for w in under) >= least:
            s = min(sum(spread[w] for w in under), least)
            pieces[begin] = math.log(pt(sum(seen_t[w] for w in under), s) / po(sum(seen_o[w] for w in under), s))
    return {w: math.log(a / b) for w, (a, b) in known.items()}, pairs, pieces


def test_models_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for i in range(120):
        words = [rng.choice(["Alpha", "beta", "gamma", "delta", "epsilon"]) if rng.random() < .5 else f"combine{rng.randrange(40)}"
                 for _ in range(rng.randrange(0, 60))]
        texts.append((i % 2, " ".join(words + (["vile", "vermin"] if i % 2 else []))))
    frame = spark.createDataFrame([(t, x) for t, x in texts], "toxic int, _text string")
    words, pairs, pieces = toxicity.class_models(frame, 8, 0.75)
    want = plain_models(texts, 8, 0.75)
    got = ({r.w: r.r for r in words}, {(r.v, r.w): r.r for r in pairs}, {r.w: r.r for r in pieces})
    for a, b in zip(got, want):
        assert b and a == pytest.approx(b, rel=1e-9)
    # What a text's features are: its mean ratio, then the best window of each length.
    text = "Alpha beta combine7 combine99 vermin unknown vile " * 6
    r, last = [], None
    for w in text.lower().split():
        begun = next((want[2][w[:k]] for k in reversed(toxicity.PIECES) if len(w) > k and w[:k] in want[2]), 0.0)
        r.append(want[1].get((last, w), want[0].get(w, begun)))
        last = w
    means = [sum(r) / len(r), *(max(sum(r[i:i + n]) for i in range(len(r) - min(n, len(r)) + 1)) / n for n in toxicity.WINDOWS)]
    assert toxicity._reader(words, pairs, pieces)(text.encode()) == pytest.approx(means)
