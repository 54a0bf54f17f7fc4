"""Exact duplicates by a tree merge of sorted digest runs.

What one partition reads is a run: its digests in order, each once, with the
row that stays and the number of rows. Runs meet in rounds, ``fan`` of them at
a time, and every merge keeps one row per digest again. So a text that a third
of all rows share is ``fan`` rows to any merge, and no key is ever hot. The
verdicts go down the same tree, run by run, until they reach the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, lower_az, text_of

_KEY = ["digest", "bytes"]


def _merged(rows: DataFrame, best: Column, count: Column) -> DataFrame:
    """One sorted run per ``run``: each digest once, with the best of its rows."""
    return rows.groupBy("run", *_KEY).agg(F.max(best).alias("best"), count.alias("n"))


def exact_duplicates(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
    largest: bool = True, fan: int = 16,
) -> DataFrame:
    """The ``keep`` columns of every row, keep_id, group_size, kept and text_sha256.

    Texts are equal if they are identical after lower-casing A-Z: by SHA-256
    and their length in bytes, which every merge compares. ``keep_id`` is the
    largest id of the group (the smallest with ``largest=False``), ``kept``
    marks the one row that stays.

    Null texts are equal to empty ones. A row without id stays only where no
    row of its group has one; then ``keep_id`` is null. Of several rows with
    the id that stays one is kept. An empty table gives no rows. Columns not
    in ``keep`` are left out, whatever their names.
    """
    text = lower_az(text_of(text_col)).cast("binary")
    rows = durable(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).cast("long").alias("bytes"),
        F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("at")))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    id_ = F.col("id")
    # Of structs the largest wins; a missing id is the smallest in both orders.
    order = F.struct(id_.isNotNull().alias("has"), (id_ if largest else -id_).alias("order"), id_.alias("id"), F.col("at"))
    levels = [durable(_merged(rows, order, F.count("*")))]
    while runs > 1:
        runs = -(-runs // fan)
        above = levels[-1].withColumn("run", F.floor(F.col("run") / fan))
        levels.append(durable(_merged(above, F.col("best"), F.sum("n"))))
    verdicts = levels.pop()
    while levels:
        below = levels.pop().select(F.col("run").alias("_run"), *_KEY, F.floor(F.col("run") / fan).alias("run"))
        verdicts = below.join(verdicts, ["run", *_KEY]).drop("run").withColumnRenamed("_run", "run")
    return rows.join(verdicts, ["run", *_KEY]).select(
        "_row.*", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("best.at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
