"""Toxicity by class-conditional Kneser-Ney models.

One bigram model of toxic and one of ordinary texts, interpolated Kneser-Ney,
both backing off to the same shared continuation counts. Those stand for what
is too rare to be told by class, so a frequent expression brings no more to
them than a rare one may have. A word that is rare in both classes together is
told by its longest beginning that is not; if there is none, it takes the
shared counts alone and speaks for neither. A text is scored by the difference of its length-normalised
log-likelihoods, over the text and over its most suspicious window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, lower_az, text_of, word_list

WINDOWS = (1, 4, 32)
#: Lengths of the word beginnings, in characters.
PIECES = (5, 6, 7, 8)


def _pairs(rows: DataFrame) -> DataFrame:
    """(toxic, v, w): each word, ASCII-lower-cased, and the one before, "" for the first."""
    words = rows.select("toxic", word_list(lower_az(F.col("_text"))).alias("_words"))
    return words.select("toxic", F.inline(F.transform("_words", lambda w, i: F.struct(
        F.coalesce(F.get("_words", i - 1), F.lit("")).alias("v"), w.alias("w")))))


def class_models(rows: DataFrame, least: int, discount: float) -> tuple[list, list, list]:
    """Log-likelihood ratios (word, ratio), (word before, word, ratio) and (beginning, ratio).

    ``rows`` has ``_text`` and ``toxic``. Counted are expressions seen at least
    ``least`` times in both classes together, all of them. A class without texts leaves nothing to compare.
    """
    seen = _pairs(rows).groupBy("v", "w").agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("o"))
    bigrams = durable(seen)
    words = durable(bigrams.groupBy("w").agg(
        F.sum(F.col("t") + F.col("o")).alias("n"), F.count(F.when(F.col("t") > 0, 1)).alias("t"),
        F.count(F.when(F.col("o") > 0, 1)).alias("o"), F.least(F.count("*"), F.lit(least)).alias("s")))
    total = words.agg(*[F.sum(c).alias(c) for c in "tos"], F.count("*").alias("types"),
                      F.count(F.when(F.col("t") > 0, 1)).alias("t_types"), F.count(F.when(F.col("o") > 0, 1)).alias("o_types")).first()
    if not total.t or not total.o:
        return [], [], []
    shared = (F.col("s") + 1) / (total.s + total.types + 1)

    def unigram(c: str) -> Column:
        mass, types = total[c], total[f"{c}_types"]
        return (F.greatest(F.col(c) - discount, F.lit(0.0)) + discount * types * shared) / mass

    begun = words.select(F.explode(F.filter(
        F.array(*[F.when(F.length("w") > n, F.substr("w", F.lit(1), F.lit(n))) for n in PIECES]),
        lambda x: x.isNotNull())).alias("w"), "n", "s", "t", "o")
    pieces = begun.groupBy("w").agg(F.sum("n").alias("n"), F.least(F.sum("s"), F.lit(least)).alias("s"), *[
        F.sum(c).alias(c) for c in "to"]).where(F.col("n") >= least)

    known = words.where(F.col("n") >= least).select("w", unigram("t").alias("pt"), unigram("o").alias("po"))
    known = durable(known)
    contexts = bigrams.groupBy("v").agg(*[F.sum(c).alias(f"n{c}") for c in "to"], *[
        F.count(F.when(F.col(c) > 0, 1)).alias(f"k{c}") for c in "to"])
    common = bigrams.where((F.col("t") + F.col("o") >= least) & (F.col("v") != ""))

    def bigram(c: str) -> Column:
        n = F.col(f"n{c}")
        back = F.when(n > 0, discount * F.col(f"k{c}") / n).otherwise(F.lit(1.0))
        return F.when(n > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / n).otherwise(F.lit(0.0)) + back * F.col(f"p{c}")

    pairs = common.join(contexts, "v").join(known, "w").select("v", "w", F.log(bigram("t") / bigram("o")).alias("r"))
    return (known.select("w", F.log(F.col("pt") / F.col("po")).alias("r")).collect(), pairs.collect(),
            pieces.select("w", F.log(unigram("t") / unigram("o")).alias("r")).collect())


def _reader(words: list, pairs: list, pieces: list) -> Callable[[bytes], list[float]]:
    """Features of a text: mean ratio, and the highest mean over windows."""
    number = {r.w.encode(): i + 1 for i, r in enumerate(words)}
    ratio = np.array([0.0, *[r.r for r in words]])
    stride = len(number) + 1
    keyed = sorted((number[r.v.encode()] * stride + number[r.w.encode()], r.r)
                   for r in pairs if r.v.encode() in number and r.w.encode() in number)
    keys = np.array([k for k, _ in keyed] + [np.iinfo(np.int64).max])
    values = np.array([x for _, x in keyed] + [0.0])
    begun, told = {r.w: r.r for r in pieces}, {}

    def by_beginning(word: bytes) -> float:
        if word not in told:
            text = word.decode()
            told[word] = next((begun[text[:n]] for n in reversed(PIECES) if len(text) > n and text[:n] in begun), 0.0)
        return told[word]

    def features(text: bytes) -> list[float]:
        tokens = text.lower().split()
        if not tokens:
            return [0.0] * (1 + len(WINDOWS))
        ids = np.fromiter((number.get(t, 0) for t in tokens), np.int64, len(tokens))
        r = ratio[ids]
        rare = np.flatnonzero(ids == 0)
        r[rare] = [by_beginning(tokens[k]) for k in rare.tolist()]
        pair = ids[:-1] * stride + ids[1:]
        at = np.searchsorted(keys, pair)
        hit = (keys[at] == pair) & (ids[:-1] > 0) & (ids[1:] > 0)
        r[1:][hit] = values[at[hit]]
        sums = np.r_[0.0, np.cumsum(r)]
        out = [sums[-1] / len(r)]
        for w in WINDOWS:
            n = min(w, len(r))
            out.append(float((sums[n:] - sums[:-n]).max()) / w)
        return out

    return features


def text_features(text: Column, models: tuple[list, list, list]) -> Column:
    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        read = _reader(*models)
        return pa.array([read(t.as_py() or b"") for t in batch.cast(pa.large_binary())], pa.list_(pa.float64()))

    return run(text)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design = np.c_[x / scale, np.ones(len(x))]
    beta = np.zeros(design.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + penalty @ beta
        step = np.linalg.solve(design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + penalty, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[beta[:-1] / scale, beta[-1]]


def toxicity(
    docs: DataFrame, labels: DataFrame, train: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", class_texts: int = 4_000, least: int = 8, discount: float = 0.75,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    ``train`` tells by the id which rows to learn from; labels of other rows are not read.
    The models learn from up to ``class_texts`` texts of each class, those with
    the smallest hash of their id: the documented bound of the classifier,
    which bounds its expressions too, as each occurs ``least`` times in them.
    Half of the texts
    give the counts, the other half the weights that turn likelihoods into a
    probability at the share of toxic rows among all training labels.

    Ids, labels, languages and sources are no input of a score. Null and empty
    texts score as texts without evidence. Null ids are never trained on, null
    labels are no labels, several labels of an id count as toxic if one is.
    Without training rows of both classes, all rows score the share of toxic
    ones (0 without labels). Repeated rows score alike, an empty table gives
    no rows, other columns are left out.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col)).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col), F.coalesce(train(F.col(id_col)), F.lit(False)).alias("_train"), text_of(text_col).alias("_text"))
    chosen = marks.where(train(F.col("_id")))
    counts = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    sample = None
    for kind in (0, 1):
        part = chosen.where(F.col("toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(class_texts)
        sample = part if sample is None else sample.unionByName(part)
    learned = durable(rows.join(durable(sample), F.col(id_col) == F.col("_id")).select(
        "toxic", "_text", (F.xxhash64(F.lit(1), "_id") % 2 == 0).alias("_count")))
    models = class_models(learned.where("_count"), least, discount)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    fitted = learned.where("NOT _count").select("toxic", text_features(F.col("_text"), models).alias("x")).collect() if models[0] else []
    y = np.array([r.toxic for r in fitted], float)
    if len(y) and 0 < y.sum() < len(y):
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        beta = _fit(np.array([r.x for r in fitted]), y, weight)
        found = text_features(F.col("_text"), models)
        line = F.lit(float(beta[-1]))
        for i, b in enumerate(beta[:-1]):
            line = line + float(b) * F.get("_x", F.lit(i))
        score = 1 / (1 + F.exp(-line))
        scored = rows.withColumn("_x", found).withColumn("score", score)
    else:
        scored = rows.withColumn("score", F.lit(float(share)))
    return scored.select(id_col, (~F.col("_train")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
