"""URL filters: rules for hosts and paths, boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, lower_az

#: A rule: verdict and ``host/path``.
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]
FEATURES = [
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "hyphens",
    "entropy", "parameters", "has_fragment", "secure", "suffix_length", "suffix_urls", "suffix_mean_length",
    "last_is_page", "segment_length",
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_replace(url, r"^(?s:.*?)://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.when(known, lower_az(host)).otherwise(F.lit("")),
            F.when(known, path).otherwise(F.lit("")))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. Of equally long rules the first in code-point order counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _suffix(host: Column) -> Column:
    return F.coalesce(F.element_at(F.split(host, r"\."), -1), F.lit(""))


def lexical_features(urls: DataFrame, url: str, host: str, path: str, suffixes: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES``; ``suffixes`` has statistics of host suffixes."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    runs = F.transform(F.array_distinct(chars), lambda c: (
        F.length(u) - F.length(F.replace(u, c, F.lit("")))) / F.length(u))
    entropy = F.aggregate(runs, F.lit(0.0), lambda s, x: s - x * F.log2(x))
    n = F.greatest(F.length(u), F.lit(1))
    segments = F.filter(F.split(p, "/"), lambda x: x != "")
    return urls.join(suffixes, _suffix(h) == F.col("_suffix"), "left").withColumns({
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p),
        "host_labels": F.size(F.split(h, r"\.")), "path_depth": F.size(segments),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]+", "")) / n,
        "hyphens": F.length(F.regexp_replace(u, "[^-]+", "")),
        "entropy": F.when(F.length(u) > 0, entropy).otherwise(F.lit(0.0)),
        "parameters": F.regexp_count(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("[^&]+")),
        "has_fragment": u.contains("#").cast("int"), "secure": u.startswith("https:").cast("int"),
        "suffix_length": F.length("_suffix"),
        "suffix_urls": F.log1p(F.coalesce("_suffix_urls", F.lit(0))),
        "suffix_mean_length": F.coalesce("_suffix_mean", F.lit(0.0)),
        "last_is_page": p.rlike(r"\.[A-Za-z0-9]+$").cast("int"),
        "segment_length": F.length(F.coalesce(F.element_at(F.when(F.size(segments) > 0, segments), 1), F.lit(""))),
    }).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def filter_urls(
    pages: DataFrame, keep: Sequence[str] = ("page_id",), url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, train_rows: int = 20_000, trees: int = 8, depth: int = 4,
    threshold: float = 0.5, otherwise: str = "allow",
) -> DataFrame:
    """The ``keep`` columns of every row, host, path, rule, block_score and verdict.

    URLs that a rule fits are the labelled ones: their verdict is the rule's.
    Boosted trees learn from them and judge the others by the probability of
    ``block``. They are fitted on ``train_rows`` labelled rows, those with the
    smallest hash of their URL, which is the documented bound of the training
    set; the suffix statistics count all rows. If the labelled rows have one
    verdict only, the others get that one; without labelled rows, ``otherwise``.

    A null URL or one without ``://`` has an empty host and path and is judged
    by the trees. Repeated rows are judged alike (ties of the hash are equal
    URLs), an empty table gives no rows. Columns not in ``keep`` are left out.
    """
    host, path = url_parts(F.col("_url"))
    parsed = pages.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(url_col).cast("string").alias("_url"))
    parsed = parsed.withColumn("host", host).withColumn("path", path)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("_verdict", verdict)
    suffixes = durable(parsed.groupBy(_suffix(F.col("host")).alias("_suffix")).agg(
        F.count("*").alias("_suffix_urls"), F.avg(F.length("_url")).alias("_suffix_mean")))
    labelled = parsed.where(F.col("_verdict").isNotNull()).orderBy(
        F.xxhash64("_url"), "_url").limit(train_rows)
    train = durable(lexical_features(labelled.drop("_row"), "_url", "host", "path", suffixes).select(
        *FEATURES, (F.col("_verdict") == "block").cast("double").alias("label")))
    seen = [r.label for r in train.select("label").distinct().collect()]
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    if len(seen) < 2:
        alone = {0.0: "allow", 1.0: "block"}[seen[0]] if seen else otherwise
        scored = parsed.withColumn("block_score", F.lit(1.0 if alone == "block" else 0.0))
    else:
        trainer = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7)
        model = trainer.fit(vectors.transform(train))
        features = vectors.transform(lexical_features(parsed, "_url", "host", "path", suffixes))
        scored = model.transform(features).withColumn("block_score", vector_to_array("probability")[1])
    judged = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "_row.*", "host", "path", "rule", "block_score", F.coalesce("_verdict", judged).alias("verdict"))
