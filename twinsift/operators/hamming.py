"""Pairs of 64-bit fingerprints within a Hamming distance.

Multi-index hashing (Norouzi, Punjani, Fleet 2012) written as an equi-join.
The 64 bits are cut into bands. Bands get radii whose sizes plus one add up to
threshold + 1; two fingerprints within the threshold must be within the radius
in at least one band. A band of radius r is matched by letting the left side
emit all keys within r // 2 of its own value and the right side all within the
rest.

How many bands there are follows the data. Wide bands mean many keys per
fingerprint, narrow ones many strangers at each key; both are computed from
the number of fingerprints and from how often two of them agree in each bit,
and the cheapest cut is taken. Bits are dealt to the bands by how much they
tell, so that a band of constant bits does not gather the table.

Every qualifying pair meets at many keys, but only one meeting counts: the one
in its first qualifying band, at the key obtained by moving the lowest
differing bits to the left side. That makes a later de-duplication of the
pairs unnecessary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb, prod

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hamming
from .durable import durable

BITS = 64
MOST_BANDS = 16
MOST_KEYS = 25_000                  # keys of a fingerprint, both sides
MOST_MOVED = 4                      # bits the left side moves
KEY_COST = 20                       # a shuffled and sorted key, in compared pairs
HOT_BUCKETS = 262_144               # bound on the list of buckets to divide
MAX_THRESHOLD = 35                  # above it most pairs match, and no key tells them apart
WIDE_ROWS = 4_000                   # fingerprints of a side in one task of such a join
HOT_BUCKET = 50_000                 # buckets with more rows are divided further


@dataclass(frozen=True)
class _Band:
    bits: tuple[int, ...]
    radius: int

    @property
    def left(self) -> int:
        return self.radius // 2

    @property
    def right(self) -> int:
        return self.radius - self.left

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def keys(self, side: str) -> int:
        return sum(comb(len(self.bits), k) for k in range(getattr(self, side) + 1))

    def flips(self, side: str) -> list[int]:
        """Bits to flip for each key that a side emits."""
        return [
            _signed(sum(1 << b for b in chosen))
            for size in range(getattr(self, side) + 1) for chosen in combinations(self.bits, size)
        ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _cut(bits: Sequence[int], agree: Sequence[float], threshold: int, count: int) -> list[_Band]:
    """``count`` bands that tell about the same, with threshold + 1 shared out over them."""
    telling = sorted(bits, key=lambda b: (agree[b], b))
    dealt: list[list[int]] = [[] for _ in range(count)]
    for at, b in enumerate(telling):
        turn, place = divmod(at, count)
        dealt[place if turn % 2 == 0 else count - 1 - place].append(b)
    share, extra = divmod(threshold + 1, count)
    return [_Band(tuple(sorted(d)), share + (1 if i < extra else 0) - 1) for i, d in enumerate(dealt)]


def _emitted(bands: Sequence[_Band]) -> int:
    """Keys of one fingerprint on both sides."""
    return sum(band.keys("left") + band.keys("right") for band in bands)


def _expected_meetings(bands: Sequence[_Band], agree: Sequence[float], rows: int) -> float:
    """Fingerprints that one meets, if bits were independent of each other."""
    return sum(
        band.keys("left") * band.keys("right") * min(1.0, prod(agree[b] for b in band.bits)) * rows
        for band in bands)


def _plan(bits: Sequence[int], agree: Sequence[float], threshold: int, rows: int) -> list[_Band]:
    """The cheapest cut of the bits for a table of that many fingerprints."""
    if threshold == 0:
        return [_Band(tuple(bits), 0)]
    cuts = [_cut(bits, agree, threshold, n) for n in range(2, min(threshold + 1, len(bits), MOST_BANDS) + 1)]
    fitting = [c for c in cuts if _emitted(c) <= MOST_KEYS and max(b.left for b in c) <= MOST_MOVED]
    # Few bits are left below a hot bucket at high limits: then the most bands have the fewest keys.
    return min(fitting or cuts[-1:],
               key=lambda c: KEY_COST * _emitted(c) + _expected_meetings(c, agree, rows))


def _agreement(ones: Sequence[int], rows: int) -> list[float]:
    """How often two fingerprints of the table have the same bit, for each bit."""
    shares = [n / max(rows, 1) for n in ones]
    return [p * p + (1 - p) * (1 - p) for p in shares]


def _longs(values: Sequence[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def _moves(bands: Sequence[_Band], side: str) -> tuple[list[int], list[int], list[int]]:
    """Of every key that a side emits: its band, the band's mask, the bits to flip."""
    flips = [(i, band.mask, flip) for i, band in enumerate(bands) for flip in band.flips(side)]
    return [f[0] for f in flips], [f[1] for f in flips], [f[2] for f in flips]


def _same(a: Column, b: Column) -> Column:
    """Equality that is checked on the joined row, not made a join key."""
    return (a - b) == 0


def _lowest_bits(diff: Column, count: int) -> Column:
    """The ``count`` lowest set bits of ``diff``."""
    rest = diff
    for _ in range(count):
        # Only the highest bit alone has no predecessor; it is the lowest one then.
        rest = F.coalesce(rest.bitwiseAND(F.try_subtract(rest, F.lit(1).cast("long"))), F.lit(0).cast("long"))
    return diff.bitwiseXOR(rest)


def _counts_here(a: Column, b: Column, band_no: Column, key: Column, bands: Sequence[_Band]) -> Column:
    """True at the one (band, key) where the pair (a, b) is to be reported."""
    diff = a.bitwiseXOR(b)
    here = None
    for i, band in enumerate(bands):
        mask = F.lit(band.mask).cast("long")
        part = diff.bitwiseAND(mask)
        reported = (band_no == i) & (key == a.bitwiseAND(mask).bitwiseXOR(_lowest_bits(part, band.left)))
        within = F.bit_count(part) <= band.radius
        here = F.when(within, reported) if here is None else here.when(within, reported)
    return here.otherwise(F.lit(False))


def _wide_pairs(fingerprints: DataFrame, threshold: int, columns: list[str], both_ways: bool,
                condition: Column | None) -> DataFrame:
    """Pairs at limits that random fingerprints keep: the answer is most of all pairs.

    The table is cut into parts, and every part of one side meets every part
    of the other in a task of its own.
    """
    kept = list(dict.fromkeys(["h", *columns]))
    rows = fingerprints.select(*kept)
    n = max(1, -(-rows.count() // WIDE_ROWS))
    part = F.pmod(F.xxhash64("h"), F.lit(n))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumns({"_i": part}).withColumn("_j", every)
    right = rows.withColumns({"_j": part}).withColumn("_i", every)
    a, b = F.col("l.h"), F.col("r.h")
    matched = (F.col("l._i") == F.col("r._i")) & (F.col("l._j") == F.col("r._j")) & (
        (a != b) if both_ways else (a < b)) & (hamming(a, b) <= threshold)
    if condition is not None:
        matched = matched & condition
    pairs = left.alias("l").join(right.alias("r").hint("merge"), matched)
    picked = [F.col(f"{s}.{c}").alias(f"{c}_{t}") for c in kept for s, t in (("l", "a"), ("r", "b"))]
    return pairs.select(*picked, hamming(a, b).cast("bigint").alias("dist"))


def near_pairs(
    fingerprints: DataFrame,
    threshold: int,
    columns: list[str] = ["h"],
    hot_bucket: int = HOT_BUCKET,
    both_ways: bool = False,
    condition: Column | None = None,
) -> DataFrame:
    """All pairs of different fingerprints within ``threshold`` bits.

    ``fingerprints`` holds each fingerprint once, in column ``h``, and is read
    several times: pass something stored. The result
    has ``<column>_a``, ``<column>_b`` for the given columns and ``dist``, with
    ``h_a < h_b`` unless ``both_ways``. ``condition`` may restrict the pairs in
    terms of the aliases ``l`` and ``r``.

    Buckets above ``hot_bucket`` rows are divided by the bits outside their
    band, so that a band value shared by a large part of the table is not
    compared pair by pair. The list of such buckets is broadcast; the limit
    rises where there would be more than ``HOT_BUCKETS`` of them.
    """
    if not 0 <= threshold <= 64:
        raise ValueError("64-bit fingerprints differ in 0 to 64 bits")
    if threshold > MAX_THRESHOLD:
        return _wide_pairs(fingerprints, threshold, columns, both_ways, condition)
    kept = list(dict.fromkeys(["h", *columns]))
    rows = fingerprints.select(*kept)
    h = F.col("h")
    ones = F.expr("array(" + ", ".join(f"sum(getbit(h, {b}))" for b in range(BITS)) + ")")
    n, ones = rows.agg(F.count("*"), ones).first()
    agree = _agreement([v or 0 for v in ones], n)
    bands = _plan(range(BITS), agree, threshold, n)

    def side(name: str) -> DataFrame:
        numbers, masks, flips = _moves(bands, name)
        moved = rows.select(*kept, F.posexplode(_longs(flips)).alias("_at", "_flip"))
        return moved.select(
            *kept, F.get(_longs(numbers), F.col("_at")).cast("int").alias("band"),
            h.bitwiseAND(F.get(_longs(masks), F.col("_at"))).bitwiseXOR(F.col("_flip")).alias("key"))

    left, right = side("left"), side("right")
    a, b = F.col("l.h"), F.col("r.h")
    band_no = F.col("l.band")
    # Bands have no bit in common, so their keys differ but for zero: one long
    # is what rows are dealt and sorted by.
    matched = (
        (F.col("l.key") == F.col("r.key")) & _same(band_no, F.col("r.band"))
        & ((a != b) if both_ways else (a < b))
        & (hamming(a, b) <= threshold)
        & _counts_here(a, b, band_no, F.col("l.key"), bands)
    )
    if condition is not None:
        matched = matched & condition

    # A fingerprint is in a bucket once at most, so small tables have no hot one.
    limit = max(hot_bucket, n * sum(band.keys("right") for band in bands) // HOT_BUCKETS)
    hot = None if n <= limit or len(bands) < 2 else durable(
        right.groupBy("key", "band").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        .select("key", "band", F.lit(True).alias("_hot"))
    )
    if hot is not None and not hot.isEmpty():
        others = [
            _plan([x for x in range(BITS) if x not in band.bits], agree, threshold, limit) for band in bands]

        def divide(rows_of_side: DataFrame, name: str) -> DataFrame:
            """Give rows of a hot bucket one sub-key per near value of the other bits."""
            plans = [_moves(rest, name) for rest in others]

            def of_band(part: int) -> Column:
                chosen = F.when(F.col("band") == 0, _longs(plans[0][part]))
                for i, plan in enumerate(plans[1:], 1):
                    chosen = chosen.when(F.col("band") == i, _longs(plan[part]))
                return chosen

            marked = rows_of_side.join(F.broadcast(hot), ["key", "band"], "left")
            flips = F.when(F.col("_hot"), of_band(2)).otherwise(_longs([0]))
            moved = marked.select("*", F.posexplode(flips).alias("_at", "_flip"))
            number = F.when(F.col("_hot"), F.get(of_band(0), F.col("_at"))).otherwise(-1).cast("int")
            value = h.bitwiseAND(F.get(of_band(1), F.col("_at"))).bitwiseXOR(F.col("_flip"))
            return moved.select(
                *kept, "key", "band", number.alias("sub"),
                F.when(F.col("_hot"), value).otherwise(F.lit(0).cast("long")).alias("sub_key"))

        left, right = divide(left, "left"), divide(right, "right")
        sub, sub_key = F.col("l.sub"), F.col("l.sub_key")
        once = F.when(band_no == 0, _counts_here(a, b, sub, sub_key, others[0]))
        for i, rest in enumerate(others[1:], 1):
            once = once.when(band_no == i, _counts_here(a, b, sub, sub_key, rest))
        matched = matched & (sub_key == F.col("r.sub_key")) & (sub == F.col("r.sub")) & ((sub == -1) | once)

    # Sizes are estimated before the keys are multiplied, so the exploded side
    # would look small enough to broadcast when it is not: ask for a merge.
    pairs = left.alias("l").join(right.alias("r").hint("merge"), matched)
    picked = [F.col(f"{s}.{c}").alias(f"{c}_{t}") for c in kept for s, t in (("l", "a"), ("r", "b"))]
    return pairs.select(*picked, hamming(a, b).cast("bigint").alias("dist"))


def collapse(items: DataFrame, fingerprint: str = "h", item: str = "id") -> DataFrame:
    """Each fingerprint once, with its smallest item and its number of items."""
    return (
        items.where(F.col(fingerprint).isNotNull())
        .groupBy(F.col(fingerprint).alias("h"))
        .agg(F.min(item).alias("rep"), F.count("*").alias("n"))
    )


def hamming_join(items: DataFrame, threshold: int = 10, fingerprint: str = "h", item: str = "id",
                 hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs of fingerprints within the threshold, with their item counts.

    Equal fingerprints are one row: ``n_a`` items carry ``h_a``. That says the
    same as listing item pairs and does not grow with the square of the copies.
    """
    return near_pairs(durable(collapse(items, fingerprint, item)), threshold, ["h", "rep", "n"], hot_bucket)
