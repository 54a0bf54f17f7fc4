"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are handed out in equal blocks. The highest quotients ``votes / (2k-1)``
decide how many blocks each source gets, then, within a source, how many each
of its shards gets. Which blocks of a shard are taken is a seeded choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import global_position
from .common import WORD, durable, text_of

#: Multiplier of the block permutation: a prime above any number of blocks in a shard.
_PRIME = 2_147_483_647
#: Equal rows that go to one shard together.
_RUN = 64


def _seat_range(votes: Column, all_votes: Column, parties: Column, seats: Column) -> tuple[Column, Column]:
    """Seats a party has for certain, and the last seat it can possibly get.

    Rounding ``votes / divisor`` changes a sum over ``parties`` by half of
    their number at most, which brackets the divisor.
    """
    low = F.greatest(seats - parties / 2 - 1, F.lit(0.0))
    high = seats + parties / 2 + 1
    sure = F.floor(votes * low / all_votes + 0.5)
    return F.when(low > 0, sure).otherwise(F.lit(0)).cast("long"), (F.floor(votes * high / all_votes + 0.5) + 1).cast("long")


def sainte_lague(parties: DataFrame, group: Sequence[str], key: str, votes: str, seats: str,
                 ranked_globally: bool = False) -> DataFrame:
    """Add ``quota``: the seats of each party by the highest quotients.

    ``seats`` is the same in all rows of a group; ``key`` names the party and
    settles ties. Seats that are certain are computed, only about two disputed
    seats per party are ranked. A group without votes gets no seats. With
    ``ranked_globally`` there is one group of any size, ranked over all tasks.
    """
    per = [F.col(c) for c in group]
    sums = parties.where(F.col(votes) > 0).groupBy(*per).agg(
        F.sum(votes).alias("_votes"), F.count("*").alias("_parties"))
    if group:
        joined = parties.join(sums, list(group)).where(F.col(votes) > 0)
    else:
        one = sums.first()
        joined = parties.where(F.col(votes) > 0).withColumns(
            {"_votes": F.lit(one["_votes"] or 0), "_parties": F.lit(one["_parties"])})
    sure, last = _seat_range(F.col(votes), F.col("_votes"), F.col("_parties"), F.col(seats))
    bounds = joined.select(*per, key, votes, seats, sure.alias("_sure"), last.alias("_last"))
    given = bounds.groupBy(*per).agg(F.sum("_sure").alias("_given"))
    disputed = bounds.select(*per, key, votes, seats, F.explode(
        F.when(F.col("_last") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_last")))).alias("_k"))
    disputed = disputed.withColumn("_quotient", F.col(votes) / (2 * F.col("_k") - 1))
    order = [F.col("_quotient").desc(), F.col(key), F.col("_k")]
    if ranked_globally:
        ranked = global_position(disputed, order, "_rank").withColumn("_given", F.lit(given.first()[0] or 0))
    else:
        ranked = disputed.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
        ranked = ranked.join(given, list(group))
    won = ranked.where(F.col("_rank") <= F.col(seats) - F.col("_given")).groupBy(*per, key).agg(F.count("*").alias("_won"))
    names = [*group, key]
    return (
        parties.join(bounds.select(*names, "_sure"), names, "left").join(won, names, "left")
        .withColumn("quota", F.coalesce("_sure", F.lit(0)) + F.coalesce("_won", F.lit(0)))
        .drop("_sure", "_won")
    )


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(_s, source_size, _docs, target) of each source.

    Sources by code point, null last, take the weights in turn. What a source
    would get above ``cap`` times its size goes to the others by weight; each
    round is one sum over the sources, until nobody is above.
    """
    sources = sized.groupBy("_s", "_null").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    placed = global_position(sources, [F.col("_null"), F.col("_s")], "_place")
    given = F.array(*[F.lit(float(w)) for w in weights])
    placed = durable(placed.withColumn(
        "_weight", F.element_at(given, ((F.col("_place") - 1) % len(weights) + 1).cast("int")))
        .select("_s", "source_size", "_docs", "_weight"))
    most = F.lit(float(cap)) * F.col("source_size")
    first = placed.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("open")).first()
    wanted = share * (first.size or 0)
    level, capped = (wanted / first.open if first.open else 0.0), 0
    while True:
        above = F.col("_weight") * F.lit(level) > most
        row = placed.agg(
            F.count(F.when(above, 1)).alias("capped"), F.sum(F.when(above, most)).alias("fixed"),
            F.sum(F.when(~above, F.col("_weight"))).alias("open")).first()
        if row.capped == capped:
            break
        capped = row.capped
        level = (wanted - row.fixed) / row.open if row.open else 0.0
        if not row.open:
            break
    if row.open is None:
        return placed.withColumn("target", most)
    return placed.withColumn("target", F.when(above, most).otherwise(F.col("_weight") * F.lit(level)))


def text_hash(text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text_of(text_col))


def in_runs(sized: DataFrame) -> DataFrame:
    """Equal rows of a source as runs: ``_run`` numbers them, ``_copies`` is their length.

    Equal rows are counted first, so no task gathers them, and reruns give the
    same runs. A run has up to ``_RUN`` rows and is dealt as one.
    """
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("_n"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_RUN}"))))
    return runs.withColumn("_copies", F.least(F.lit(_RUN).cast("long"), F.col("_n") - F.col("_run") * _RUN)).drop("_n")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    block_words: int = 32, shard_docs: int = 512, seed: int = 17,
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row.

    ``size`` counts words (null text: 0). ``taken`` counts the words that the
    mix takes of the row, repeats included: whole passes over its shard plus
    the seeded blocks of the last pass. At most ``floor(cap)`` passes are made.
    Null sources form one source, null ids are ordinary values, repeated rows
    are separate rows (which of two equal rows comes first makes no
    difference). An empty table gives no rows; other columns are ignored.

    A shard holds about ``shard_docs`` rows whatever the size of its source,
    so no task gathers a source. Rows of one id, or of none, are dealt to
    shards by their texts too, and equal rows in runs of up to 64.
    """
    sized = durable(docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_s"),
        F.col(source_col).isNull().alias("_null"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_key"),
        text_hash(text_col, seed).alias("_by_text"),
    ))
    targets = durable(source_targets(sized, weights, share, cap))
    wanted = targets.agg(F.sum("target")).first()[0] or 0.0
    blocks = int(wanted / block_words + 0.5)
    sources = durable(sainte_lague(
        targets.withColumn("_seats", F.lit(blocks)), [], "_s", "target", "_seats", ranked_globally=True
    ).select("_s", "source_size", "target", F.ceil(F.col("_docs") / shard_docs).alias("_shards"),
             F.col("quota").alias("_seats")))

    placed = durable(
        in_runs(sized).join(sources, "_s")
        .withColumn("_shard", F.pmod(F.xxhash64("_key", "_by_text", "_run"), F.col("_shards")))
        .repartition("_s", "_shard")    # the join leaves a whole source together
        .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .withColumn("_end", F.sum("size").over(
            Window.partitionBy("_s", "_shard").orderBy("_key", "_id", "_by_text", "_run", "_nth", "size")
            .rowsBetween(Window.unboundedPreceding, 0)))
        .select("_id", "_s", "_shard", "size", "source_size", "target", "_seats", "_end"))
    shards = placed.groupBy("_s", "_shard").agg(
        F.sum("size").alias("_words"), F.first("_seats").alias("_seats"))
    quotas = sainte_lague(shards, ["_s"], "_shard", "_words", "_seats")
    n = F.greatest(F.ceil(F.col("_words") / block_words), F.lit(1))
    quotas = quotas.select("_s", "_shard", n.alias("_n"), F.least("quota", n * int(cap)).alias("_quota"))
    quotas = quotas.select(
        "_s", "_shard", "_n", F.expr("_quota div _n").alias("_passes"), (F.col("_quota") % F.col("_n")).alias("_rest"),
        F.pmod(F.xxhash64(F.lit(seed), "_s", "_shard"), F.col("_n")).alias("_shift"))

    begin = F.col("_end") - F.col("size")
    block = F.lit(block_words)

    def words_in(b: Column) -> Column:
        chosen = F.pmod(b * _PRIME + F.col("_shift"), F.col("_n")) < F.col("_rest")
        part = F.least(F.col("_end"), (b + 1) * block) - F.greatest(begin, b * block)
        return F.when(chosen, part).otherwise(F.lit(0))

    inside = F.sequence(F.floor(begin / block), F.floor((F.col("_end") - 1) / block))
    extra = F.when(
        (F.col("size") > 0) & (F.col("_rest") > 0),
        F.aggregate(inside, F.lit(0).cast("long"), lambda total, b: total + words_in(b)),
    ).otherwise(F.lit(0))
    return placed.join(quotas, ["_s", "_shard"]).select(
        F.col("_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("_passes") * F.col("size") + extra).cast("long").alias("taken"))
