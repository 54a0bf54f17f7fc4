"""One query per operator over the given tables, named ``opN_...``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    alignment, chat, credentials, digest_runs, language_model, merkle, mixing, quality, simhash, suffixes, tiling, toxicity,
    urls)
from .common import lower_az, table

TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix to target weights takes of each document."""
    return mixing.mix_sources(table(spark, folder, "documents"))


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of each document: strong patterns and linked weak parts."""
    found = credentials.secret_spans(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind_no"] < 3)

    def count(kind_no: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind_no"] == kind_no)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        _sha(credentials.span_text(base)).alias("base_sha256"), credentials.span_text(F.col("found")).alias("spans"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and the verdict on each document."""
    return quality.quality_rules(table(spark, folder, "documents")).drop("char_distance", "word_distance")


@query
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation formatted, and what is read back from it."""
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"""SELECT -1L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text
        FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    chats = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    back = chats.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn(
        "_loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), _sha(flat).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), _sha(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of each page."""
    return urls.filter_urls(table(spark, folder, "pages"))


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of each document and the smallest id it is linked to."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex(F.get("code", F.lit(0)))), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain benchmark items, reordered or not."""
    return tiling.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probability that each document is toxic; every fifth id is held out."""
    return toxicity.toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels"),
        lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 0)


@query
def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of each document without strings of 50 bytes that an earlier one has."""
    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query
def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Model and base log-probability of each document; every seventh id is held out."""
    return language_model.score_texts(
        table(spark, folder, "documents"), lambda i: F.crc32(i.cast("string").cast("binary")) % 7 == 2)


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of each document; every fifth is verified against a changed text."""
    fields = {c: F.col(c) for c in merkle.FIELDS}
    changed = merkle.leaf_digest(list({**fields, "text": lower_az(F.col("text"))}.values()))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, folder, "documents"), carry={"claimed": F.when(tampered, changed)})
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of each document, and which one stays."""
    return digest_runs.exact_duplicates(table(spark, folder, "documents"))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of each document."""
    return alignment.align(
        table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
