"""The given tables seen as items, entries, fingerprints and sequences.

Every view is derived by Spark from whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import content_hash, sign_hash
from ..operators import global_position, skew
from ..operators.durable import reused

EPOCH = 1_704_067_200       # 2024-01-01, first modification time
DAY = 86_400


def frame_index(rows: DataFrame, key: str, order: list[str], hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """0-based position of each row within its key, and the key's ``frames``.

    Taken from a global order, so one key with most of the rows is as well
    divided as any other.
    """
    placed = global_position(rows, [F.col(c).asc() for c in [key, *order]])
    starts = placed.groupBy(key).agg(F.min("position").alias("_start"), F.count("*").alias("frames"))
    joined = skew.join_to_groups(placed, starts, key, "frames", "position", hot_rows)
    return joined.withColumn("frame", F.col("position") - F.col("_start")).drop("position", "_start")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- items -----------------------------------------------------------

    @staticmethod
    def _item_name() -> Column:
        doc = F.col("doc_id").cast("string")
        names = [
            ("IMG_", ".JPG"), ("clip_", ".mp4"), ("bundle_", ".zip"), ("note ", " copy.txt"),
            ("report_", "(1).pdf"), ("Makefile", ""), ("draft_", ".tmp"), ("d", "/Thumbs.db"),
            ("node_modules/m", ".js"), ("page_", "_20240101.html"), ("photo_", ".webp"), ("plain_", ".txt"),
        ]
        name = F.lit(None).cast("string")
        for i, (before, after) in enumerate(names):
            name = F.when(F.col("doc_id") % len(names) == i, F.concat(F.lit(before), doc, F.lit(after))).otherwise(name)
        return name

    @property
    def items(self) -> DataFrame:
        """Documents as files: doc_id, path, size, content, inode, mtime."""
        folder = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"))
        return self.table("documents").select(
            "doc_id",
            F.concat(folder, self._item_name()).alias("path"),
            F.octet_length("text").cast("bigint").alias("size"),
            F.col("text").alias("content"),
            (F.col("doc_id") + 5_000_000).alias("inode"),
            F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("mtime"),
        )

    @property
    def hashed(self) -> DataFrame:
        return self.items.withColumn("hash", content_hash(F.col("content"))).drop("content")

    @property
    def linked(self) -> DataFrame:
        """Items, and a second name for every labelled one (same inode)."""
        items = self.hashed.select("doc_id", "path", "size", "inode", "hash")
        labelled = items.join(self.table("labels").select("doc_id"), "doc_id", "left_semi")
        return items.unionByName(labelled.withColumn("path", F.concat("path", F.lit(".hl"))))

    # -- containers ------------------------------------------------------

    @property
    def packed(self) -> DataFrame:
        """Document lines as entries of one container per document."""
        container = F.concat(
            F.lit("/data/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".zip")
        )
        lines = self.table("documents").select(
            "doc_id", container.alias("container"), F.posexplode(F.split("text", "\n", -1)).alias("_at", "line")
        )
        return lines.where(F.octet_length("line") > 0).select(
            "doc_id", "container", F.concat(F.lit("part"), (F.col("_at") + 1).cast("string")).alias("entry"), "line"
        )

    @property
    def entries(self) -> DataFrame:
        return self.packed.select(
            "container", "entry",
            F.concat_ws("::", "container", "entry").alias("path"),
            F.lit("zip_entry").alias("type"),
            F.octet_length("line").cast("bigint").alias("size"),
            content_hash(F.col("line")).alias("hash"),
        )

    @property
    def baskets(self) -> DataFrame:
        """Orders as containers of parts."""
        return self.table("lineitem").select(
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("container"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("hash"),
        )

    @property
    def basket_sizes(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("container")
        ).agg(F.sum("l_quantity").cast("bigint").alias("size"))

    # -- fingerprints ----------------------------------------------------

    @property
    def vectors(self) -> DataFrame:
        """Each vector, a disturbed copy and an equal or opposite copy.

        The disturbance flips every 16th element, every second one where the
        vector's number is a multiple of three.
        """
        v = F.col("embedding").cast("array<double>")
        n = F.col("vec_id")
        step = F.when(n % 3 == 0, 2).otherwise(16)
        disturbed = F.transform(v, lambda x, j: F.when((n + j) % step == 0, -x).otherwise(x))
        opposite = F.transform(v, lambda x: F.when(n % 5 == 0, x).otherwise(-x))
        copies = F.array(
            F.struct(F.lit(0).alias("k"), v.alias("v")),
            F.struct(F.lit(1).alias("k"), disturbed.alias("v")),
            F.struct(F.lit(2).alias("k"), opposite.alias("v")),
        )
        return self.table("embeddings").select("vec_id", F.explode(copies).alias("c")).select(
            (F.col("vec_id") * 3 + F.col("c.k")).alias("id"), "vec_id", F.col("c.k").alias("k"), F.col("c.v").alias("v")
        )

    @cached_property
    def fingerprints(self) -> DataFrame:
        """id, h: narrow, and read by both passes of the grouping."""
        return reused(self.vectors.select("id", "vec_id", "k", sign_hash(F.col("v")).alias("h")))

    @property
    def frames(self) -> DataFrame:
        """Fingerprints as frames of sequences: (seq, frame, h).

        Blocks of five vectors (kind 0), of seven disturbed vectors (kind 1),
        and the blocks of five with some bits changed (kind 2).
        """
        fp = self.fingerprints
        five = F.floor(F.col("vec_id") / 5)
        seven = F.floor(F.col("vec_id") / 7)
        change = (
            F.when(five % 4 == 0, F.lit(0)).when(five % 4 == 1, F.lit(1)).when(five % 4 == 2, F.lit(63))
            .otherwise(F.lit(-1)).cast("bigint")
        )
        base = fp.where("k = 0")
        return (
            base.select((five * 4).alias("seq"), (F.col("vec_id") % 5).alias("frame"), "h")
            .unionByName(
                fp.where("k = 1").select((seven * 4 + 1).alias("seq"), (F.col("vec_id") % 7).alias("frame"), "h")
            )
            .unionByName(
                base.select((five * 4 + 2).alias("seq"), (F.col("vec_id") % 5).alias("frame"),
                            F.col("h").bitwiseXOR(change).alias("h"))
            )
        )

    @property
    def sequences(self) -> DataFrame:
        """(id, frames): at most seven frames each by construction."""
        ordered = F.sort_array(F.collect_list(F.struct("frame", "h")))
        return self.frames.groupBy(F.col("seq").alias("id")).agg(
            F.transform(ordered, lambda f: f["h"]).alias("frames")
        )

    # -- snapshots -------------------------------------------------------

    @property
    def cache(self) -> DataFrame:
        """What an earlier run stored: the labelled documents.

        Toxic ones have changed since; good ones have a content hash, the
        others a fingerprint.
        """
        moved = F.timestamp_seconds(F.unix_timestamp("mtime") - F.col("toxic") * DAY)
        return self.hashed.join(self.table("labels"), "doc_id").select(
            "doc_id", "path", "size", moved.alias("mtime"),
            F.when(F.col("quality") == 1, F.col("hash")).alias("hash"),
            F.when(F.col("quality") == 0, F.left("hash", F.lit(16))).alias("phash"),
        )

    @property
    def inventory_now(self) -> DataFrame:
        """Items that are still there: the toxic ones have been removed."""
        gone = self.table("labels").where("toxic = 1").select("doc_id")
        return self.hashed.join(gone, "doc_id", "left_anti").select("path", "size")
