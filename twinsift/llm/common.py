"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.durable import durable, new_folder, shared_folder

__all__ = ["WORD", "durable", "new_folder", "shared_folder", "table", "text_of", "word_list", "lower_az"]

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a text in order, by splitting at single spaces."""
    spaced = F.regexp_replace(text, r"[\x09-\x0D]", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def lower_az(text: Column) -> Column:
    """Lower-case the ASCII letters and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())
