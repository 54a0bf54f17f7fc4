"""The corpus pipeline: each stage is one operator over what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinsift.llm import credentials, mixing, near_copies, quality, tiling
from twinsift.llm.common import new_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has neither the hashes of the near-duplicate stage nor tiling.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that only equal rows share: the id, and a hash of the rest.

    The hash passes over nulls, so it is told where they are.
    """
    rest = F.hex(F.xxhash64(*[x for c in COLUMNS[1:] for x in (F.col(c), F.isnull(c))]))
    return docs.select(*COLUMNS, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), rest).alias("_k"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null texts count as empty and go."""
    keyed = _keyed(docs)
    kept = quality.quality_rules(keyed, ["_k"]).where("kept").select("_k")
    return keyed.join(kept, "_k", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near are texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more. Fingerprints of the sets propose the pairs: that similarity
    is an angle of 38.8 of 256 bits on average, with a standard deviation of
    5.7, so pairs of up to 60 bits are compared. Of repeated rows one stays;
    of a group without ids, one of each set.
    """
    keyed = _keyed(docs)
    found = near_copies.near_copies(keyed, "_k", ("doc_id", "_k"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("node")).alias("_c")).agg(
        F.min("_k").alias("_k")).select("_k")
    return keyed.join(stays, "_k", "left_semi").dropDuplicates(["_k"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item of ``benchmark`` go."""
    keyed = _keyed(docs)
    found = tiling.contaminated(keyed, table(spark, sf_dir, "benchmark"), ["_k"]).select("_k").distinct()
    return keyed.join(found, "_k", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, secrets in their texts are replaced by a mark."""
    return credentials.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; 0 where it takes none."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
