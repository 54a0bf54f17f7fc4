"""Containers (archives, orders, documents) that share entries.

``entries`` tables have ``container`` and ``hash``, one row per entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import container_of, is_entry
from . import skew
from .components import connected_components
from .durable import durable
from .ranking import global_position

HEAVY_ENTRY = 1_000     # entries found in more containers are treated apart
PART_ROWS = 1_000       # rows of one key that a task has on its divided side
FEW_ENTRIES = 8         # containers with no more different entries may meet at pairs of entries
CELL_ROWS = 250         # contents of one pattern that meet as a whole; a task holds the pairs of two such lots
PAIR_COST = 2           # a pair of entries costs about as much as this many meetings of two containers
LIST_ROWS = 1_000       # shared entries of two contents that are one row until the end
SMALL_TABLE = 1_000_000     # a list of no more numbers may be sent to all tasks
FACTS = ["rep", "total", "copies"]
COPIES_BITS = 54        # a content's number has the bit length of its copies from this bit on
LOT_BITS = 8            # names of a content's containers that are one row: fewer than 2 to this power, or half of them and more


def _parts(count: str, rows: int = PART_ROWS) -> Column:
    """Parts of a key by the number of its rows."""
    return F.ceil(F.col(count) / F.lit(rows)).cast("int")


def container_entry_total(entries: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Attach the number of entries of the row's container."""
    totals = entries.groupBy("container").agg(F.count("*").alias("total"))
    return skew.join_to_groups(entries, totals, "container", "total", "path", hot_rows, settle=True)


def min_container_entries(entries: DataFrame, least: int, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Only entries of containers that have at least ``least`` entries."""
    if least <= 0:
        return entries
    big = (
        entries.where(F.col("hash").isNotNull())
        .groupBy("container").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    )
    return skew.join_to_groups(entries, big, "container", "_n", "hash", hot_rows, settle=True).drop("_n")


@dataclass(frozen=True)
class _Profile:
    """An entry table in the forms the overlap operators need.

    Different contents are numbered, those with more copies higher. Everything
    between the entry table and the result works on these numbers, which are a
    fraction of the names.
    """

    contents: DataFrame     # container, hash, m: each hash once with its multiplicity
    kinds: DataFrame        # id, rep, kinds, total, copies: each content once
    copied: DataFrame       # id, container, kinds, total, copies: contents with several copies
    any_copied: bool

    @property
    def classes(self) -> DataFrame:
        """(container, id, rep, kinds, total, copies) for every container."""
        single = self.kinds.where("copies = 1").withColumn("container", F.col("rep"))
        return single.unionByName(self.copied) if self.any_copied else single

    @property
    def lots(self) -> DataFrame:
        """(id, lot, names, total): the containers of every content, in ``_lots`` rows."""
        single = self.kinds.where("copies = 1").select("id", F.lit(0).alias("lot"), F.array("rep").alias("names"), "total")
        if not self.any_copied:
            return single
        lot = F.pmod(F.xxhash64("container"), _lots(F.col("id"))).cast("int").alias("lot")
        return single.unionByName(
            self.copied.groupBy("id", lot).agg(F.collect_list("container").alias("names"), F.max("total").alias("total")))


def _lots(content: Column) -> Column:
    """In how many lots the containers of a content are, told by its number."""
    return F.pow(F.lit(2), F.greatest(F.shiftright(content, COPIES_BITS) - LOT_BITS, F.lit(0))).cast("int")


def _every_lot(content: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), _lots(content) - 1))


def _profile(entries: DataFrame) -> _Profile:
    """Find containers with equal contents.

    ``rep`` is the smallest container with the same contents. Equality is
    decided on the number of hashes and two 64-bit combinations of row hashes,
    all plain aggregates: no set is collected.
    """
    contents = durable(
        entries.where(F.col("hash").isNotNull())
        .groupBy("container", "hash").agg(F.count("*").alias("m"))
    )
    signature = F.struct(
        F.count("*").alias("kinds"),
        F.sum("m").alias("total"),
        F.bit_xor(F.xxhash64("hash", "m")).alias("x"),
        F.bit_xor(F.xxhash64("m", "hash")).alias("y"),
    )
    profile = durable(contents.groupBy("container").agg(signature.alias("_key")))
    twins = durable(
        profile.groupBy("_key").agg(F.min("container").alias("rep"), F.count("*").alias("copies"))
        .withColumn("id", F.shiftleft(F.length(F.bin("copies")).cast("bigint"), COPIES_BITS) + F.monotonically_increasing_id())
    )
    facts = ["id", "rep", "_key.kinds", "_key.total", "copies"]
    several = twins.where("copies > 1")
    any_copied = not several.isEmpty()
    copied = twins.limit(0).select(F.col("rep").alias("container"), *facts)
    if any_copied:
        # Only contents with several copies need their containers looked up again.
        copied = durable(
            skew.join_to_groups(profile, several, "_key", "copies", "container", settle=True).select("container", *facts)
        )
    return _Profile(contents, twins.select(*facts), copied, any_copied)


def container_classes(entries: DataFrame) -> DataFrame:
    """(container, rep, kinds, total, copies): containers with equal contents share ``rep``."""
    return _profile(entries).classes.drop("id")


def _shared_entries(found: _Profile, few: int = 0, *more: str) -> DataFrame:
    """(id, entry, in_, m, big): numbered entries that several contents have, and in how many they are."""
    numbered = found.contents.join(
        found.kinds.select(F.col("rep").alias("container"), "id", (F.col("kinds") > few).alias("big")), "container"
    ).select("id", "hash", "m", "big")
    # In how many different contents an entry is; in one only is never shared.
    spread = (
        numbered.groupBy("hash").agg(F.count("*").alias("in_")).where("in_ > 1")
        .withColumn("entry", F.monotonically_increasing_id())
    )
    return durable(
        skew.join_to_groups(numbered, spread, "hash", "in_", "id", settle=True).select("id", "entry", "in_", "m", "big", *more)
    )


def _overlapping(found: _Profile, least: int, heavy_entry: int, weighted: bool = False,
                 few_entries: int = FEW_ENTRIES, named: bool = False) -> DataFrame:
    """Overlapping pairs a, b of different contents, each once, with what is known of both.

    Columns are ``a``, ``b``, ``common`` and, with ``_a`` and ``_b``, ``rep``,
    ``total`` and ``copies``. ``common`` counts different shared hashes. With
    ``weighted`` there are also ``common_a``, the entries of a that have one
    of them, and ``common_b``; the larger of the two is compared with ``least``.

    With ``named`` there are ``names`` and ``total`` instead, for every lot of
    a's containers with every lot of b's.

    Where two shared entries are asked for, contents of at most ``few_entries``
    entries meet at pairs of entries, so those that share a single one never
    do; unless the counts say that meeting as in ``_blocks`` is cheaper. The
    others, ``big`` ones, meet all contents there. The result is the same.
    """
    few = few_entries if least > 1 and not weighted else 0
    known = _shared_entries(found, few)
    light = F.when(~F.col("big") & (F.col("in_") <= heavy_entry), F.col("in_") - 1)
    seen = known.agg(F.sum(light).alias("light"), F.bool_or("big").alias("big"), F.max("in_").alias("most")).first()
    any_heavy = (seen.most or 0) > heavy_entry
    woven = _patterns(known, heavy_entry, weighted) if any_heavy else None
    by_pairs = None
    if few:
        heavy = woven.rows.agg(F.sum(F.when(~F.col("big"), F.col("in_") - 1)).alias("met")).first().met if any_heavy else 0
        by_pairs = _met_at_pairs(known.where("NOT big"), least, ((seen.light or 0) + (heavy or 0)) // 2)
        if by_pairs is None:
            known = known.withColumn("big", F.lit(True))
            woven = woven and _Patterns(*(x.withColumn("big", F.lit(True)) for x in (woven.members, woven.patterns, woven.rows)))
        elif not seen.big:
            return _with_names(by_pairs, found) if named else _with_facts(by_pairs, found)
    shared = ["common", "common_a", "common_b"] if weighted else ["common"]
    if any_heavy:
        blocks = _blocks(known, woven, least, heavy_entry, weighted)
        listed = blocks.pairs.select("a", "b", *shared)
    else:
        listed = _met(known, weighted).where(_measure(weighted) >= least)
    if by_pairs is not None:
        listed = listed.unionByName(by_pairs)
    listed = _with_names(listed, found) if named else _with_facts(listed, found)
    return listed.unionByName(_written_out(blocks, found, least, shared, named)) if any_heavy else listed


def _with_facts(pairs: DataFrame, found: _Profile) -> DataFrame:
    """Attach representative, number of entries and number of copies of both contents."""
    for s in ("a", "b"):
        pairs = pairs.join(found.kinds.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in FACTS]), s)
    return pairs


def _with_names(pairs: DataFrame, found: _Profile) -> DataFrame:
    """Attach number of entries and containers of both contents, a row for two lots of them.

    The side with fewer copies, ``a``, comes first, so that what is exchanged
    for the other one is a short list, and never the pairs of containers.
    """
    for s in ("a", "b"):
        of_s = found.lots.select(F.col("id").alias(s), "lot", F.col("names").alias(f"names_{s}"), F.col("total").alias(f"total_{s}"))
        pairs = pairs.withColumn("lot", _every_lot(F.col(s))).join(of_s, [s, "lot"]).drop("lot")
    return pairs


def _once() -> Column:
    """Of a big content ``l`` and any content ``r``: each pair in one order only."""
    return (F.col("l.id") < F.col("r.id")) | (~F.col("r.big") & (F.col("l.id") > F.col("r.id")))


def _ordered_ids() -> tuple[Column, Column]:
    # Two big contents are in order already, as _once asks for it.
    return F.least("l.id", "r.id"), F.greatest("l.id", "r.id")


def _met_at_pairs(known: DataFrame, least: int, singly: int) -> DataFrame | None:
    """Overlaps of contents with few entries, found at their pairs of entries.

    None if that costs more than ``singly`` meetings. Contents that share n
    entries meet at n (n - 1) / 2 pairs, which tells n. Most pairs of entries
    are in one content only and leave before the join; those in many contents
    are divided by their number.
    """
    entries, size = F.col("_entries"), F.size("_entries").cast("bigint")
    lists = durable(known.groupBy("id").agg(F.sort_array(F.collect_list("entry")).alias("_entries")).where(size >= least))
    rows = lists.agg(F.sum(size * (size - 1) / 2).cast("bigint")).first()[0] or 0
    if singly <= PAIR_COST * rows:
        return None
    pairs = lists.select("id", F.inline(F.flatten(F.transform(entries, lambda x, i: F.transform(
        F.slice(entries, i + 2, F.size(entries)), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    ).withColumn("pair", F.xxhash64("x", "y"))
    counts = durable(pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"))
    seen = counts.agg(F.count("*").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("met")).first()
    if singly <= PAIR_COST * (rows + (seen.met or 0)):
        return None
    # Few pairs of entries are in several contents, as a rule: then the others need not be exchanged.
    kept = pairs.join(F.broadcast(counts), "pair") if seen.n <= SMALL_TABLE else skew.join_to_groups(pairs, counts, "pair", "n", "id")
    shared = durable(kept)
    same = (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y"))
    met = skew.spread_self_join(shared, shared, "pair", "id", _parts("n"), same & (F.col("l.id") < F.col("r.id")))
    number = F.round((F.sqrt(F.count("*") * 8 + 1) + 1) / 2).cast("bigint")
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).groupBy("a", "b").agg(
        number.alias("common")).where(F.col("common") >= least)


def _heavy_meetings(meetings: DataFrame, heavy: DataFrame, needed: int, met: Callable[..., list]) -> DataFrame:
    """Meetings at heavy entries, of the pairs that can still reach the result."""
    probes = heavy
    if needed > 1:
        order = Window.partitionBy("id").orderBy(F.col("in_").desc(), F.col("entry").desc())
        left_out = heavy.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") < needed)
        probes = heavy.join(left_out.select("id", "entry"), ["id", "entry"], "left_anti")
    low, high = _ordered_ids()
    by_heavy = skew.spread_self_join(
        probes.where("big"), probes, "entry", "id", _parts("in_"), _once()
    ).select(low.alias("a"), high.alias("b"))
    having = heavy.select("id").distinct()
    by_light = (
        meetings.select("a", "b")
        .join(having.withColumnRenamed("id", "a"), "a", "left_semi")
        .join(having.withColumnRenamed("id", "b"), "b", "left_semi")
    )
    candidates = by_light.unionByName(by_heavy).distinct()
    return (
        candidates.alias("p")
        .join(heavy.alias("l"), F.col("p.a") == F.col("l.id"))
        .join(heavy.alias("r"), (F.col("p.b") == F.col("r.id")) & (F.col("l.entry") == F.col("r.entry")))
        .select(*met(F.col("p.a"), F.col("p.b")))
    )


@dataclass(frozen=True)
class _Patterns:
    """Contents by their heavy entries: those with the same ones have one pattern."""

    members: DataFrame      # id, pattern, width, weight: width is the number of heavy entries, weight how often they occur
    patterns: DataFrame     # pattern, width, weight, first, size, big: first is the smallest content of the size ones
    rows: DataFrame         # id, entry, in_, m, big: the entries of a pattern (id), and in how many patterns each is


def _patterns(known: DataFrame, heavy_entry: int, weighted: bool = False) -> _Patterns:
    """The patterns of all contents with heavy entries.

    Big and other contents have patterns of their own and, where entries are
    ``weighted``, so have contents in which they occur differently often.
    """
    heavy = known.where(F.col("in_") > heavy_entry)
    told = ["entry", "m"] if weighted else ["entry"]
    signature = F.struct(
        F.count("*").alias("width"), (F.sum("m") if weighted else F.count("*")).alias("weight"), F.bool_or("big").alias("big"),
        F.bit_xor(F.xxhash64(*told)).alias("x"), F.bit_xor(F.xxhash64(*told, F.lit(1))).alias("y"),
    )
    signed = durable(heavy.groupBy("id").agg(signature.alias("_key")))
    patterns = durable(
        signed.groupBy("_key").agg(F.min("id").alias("first"), F.count("*").alias("size"))
        .withColumn("pattern", F.monotonically_increasing_id())
    )
    members = durable(
        skew.join_to_groups(signed, patterns.select("_key", "pattern", "size"), "_key", "size", "id", settle=True)
        .select("id", "pattern", "_key.width", "_key.weight")
    )
    patterns = patterns.select("pattern", "_key.width", "_key.weight", "first", "size", "_key.big")
    rows = durable(heavy.select(F.col("id").alias("first"), "entry", "m").join(patterns, "first").select(
        F.col("pattern").alias("id"), "entry", "m", "big"))
    spread = rows.groupBy("entry").agg(F.count("*").alias("in_"))
    return _Patterns(members, patterns, durable(rows.join(spread, "entry").select("id", "entry", "in_", "m", "big")))


@dataclass(frozen=True)
class _Blocks:
    """All overlapping pairs of different contents, in a form that grows with the entries.

    ``pairs`` has those that meet at a light entry, with all they share. The
    others share heavy entries alone, so what they share depends on their
    patterns only. With weights there are ``common_a`` and ``common_b`` of a
    and b, or of p and q, as well.
    """

    pairs: DataFrame        # a, b, common: contents that meet at a light entry
    known: DataFrame        # p, u, q, v: those among them, u of p and v of q, whose heavy entries suffice
    members: DataFrame      # id, pattern, width: contents with heavy entries; width is their number
    patterns: DataFrame     # pattern, width, weight, first, size, big, see _Patterns
    touching: DataFrame     # p, q, common: different patterns, what their contents share at least
    placed: DataFrame       # a, b, common, p, q, both: the pairs and their patterns, if both have one


def _blocks(known: DataFrame, woven: _Patterns, least: int, heavy_entry: int, weighted: bool = False) -> _Blocks:
    """The overlaps of big contents without the pairs that heavy entries alone make.

    A light entry makes at most ``heavy_entry`` pairs for each of its rows. Of
    patterns, those are compared that a pair needs, or that share ``least``
    entries and so still meet after each leaves out its ``least - 1`` most
    frequent ones (prefix filter: Chaudhuri, Ganti, Kaushik 2006). An entry
    present in most containers thus costs next to nothing.
    """
    members, patterns = woven.members, woven.patterns
    # Most contents that meet at a single entry have no frequent ones in common: those pairs are not written.
    light = known.where(F.col("in_") <= heavy_entry).join(members.select("id", "pattern"), "id", "left")
    low, high = F.least("p_a", "p_b"), F.greatest("p_a", "p_b")
    both = F.col("p_a").isNotNull() & F.col("p_b").isNotNull()
    met = _met(light, weighted, True).where(both | (_measure(weighted) >= least))
    told = [c for c in met.columns if c not in ("p_a", "p_b")]
    placed = durable(met.select(
        *told, F.when(both, low).alias("p"), F.when(both, high).alias("q"),
        both.alias("both"), F.coalesce(both & (F.col("p_a") > F.col("p_b")), F.lit(False)).alias("turned")))
    wanted = placed.where("both AND p < q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    shared = durable(
        _heavy_meetings(wanted, woven.rows, 1 if weighted else least, lambda a, b: [
            a.alias("p"), b.alias("q"), F.col("l.m").alias("more_p"), F.col("r.m").alias("more_q")])
        .groupBy("p", "q").agg(F.count("*").alias("more"), *_sums(weighted, "more_p", "more_q"))
    )
    more = ["more", "more_p", "more_q"] if weighted else ["more"]
    alike = patterns.select(F.col("pattern").alias("p"), F.col("pattern").alias("q"), F.col("width").alias("more"),
                            F.col("weight").alias("more_p"), F.col("weight").alias("more_q"))
    heavy = {"common": F.col("more")}
    if weighted:
        heavy["common_a"] = F.when(F.col("turned"), F.col("more_q")).otherwise(F.col("more_p"))
        heavy["common_b"] = F.when(F.col("turned"), F.col("more_p")).otherwise(F.col("more_q"))
    heavy = {c: F.coalesce(x, F.lit(0)) for c, x in heavy.items()}
    measured = F.greatest(heavy["common_a"], heavy["common_b"]) if weighted else heavy["common"]
    columns = ["a", "b", "p", "q", *heavy, "turned", "both", "covered"]
    with_both = placed.where("both").join(shared.unionByName(alike.select("p", "q", *more)), ["p", "q"], "left").select(
        "a", "b", "p", "q", *[(F.col(c) + x).alias(c) for c, x in heavy.items()], "turned", "both", (measured >= least).alias("covered"))
    pairs = durable(
        with_both.where(_measure(weighted) >= least)
        .unionByName(placed.where("NOT both").withColumn("covered", F.lit(False)).select(*columns))
    )
    flip = F.col("turned")
    already = pairs.where("covered").select(
        "p", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("u"),
        "q", F.when(flip, F.col("a")).otherwise(F.col("b")).alias("v"),
    )
    touching = shared.withColumnsRenamed({"more": "common", "more_p": "common_a", "more_q": "common_b"}).where(
        _measure(weighted) >= least)
    return _Blocks(pairs.select(*told), already, members, patterns, touching,
                   pairs.select("a", "b", "common", "p", "q", "both"))


def _met(rows: DataFrame, weighted: bool, woven: bool = False) -> DataFrame:
    """a, b, common: big contents and those they meet at an entry; with weights as in ``_overlapping``.

    ``woven`` rows have the ``pattern`` of their content, if there is one: ``p_a`` and ``p_b`` are those of a and b.
    """
    low, high = _ordered_ids()
    turned = F.col("l.id") > F.col("r.id")

    def of_both(column: str, name: str) -> list[Column]:
        left, right = F.col(f"l.{column}"), F.col(f"r.{column}")
        return [F.when(turned, right).otherwise(left).alias(f"{name}_a"), F.when(turned, left).otherwise(right).alias(f"{name}_b")]

    return (
        rows.where("big").alias("l").join(rows.alias("r"), (F.col("l.entry") == F.col("r.entry")) & _once()).select(
            low.alias("a"), high.alias("b"), *of_both("m", "common"), *(of_both("pattern", "p") if woven else []),
        ).groupBy("a", "b").agg(F.count("*").alias("common"), *_sums(weighted, "common_a", "common_b"),
                                *([F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b")] if woven else []))
    )


def _sums(weighted: bool, *names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names] if weighted else []


def _measure(weighted: bool) -> Column:
    return F.greatest("common_a", "common_b") if weighted else F.col("common")


def _cells(blocks: _Blocks, sets: DataFrame, links: DataFrame, named: bool) -> DataFrame:
    """Pairs x, y of ``sets`` elements for the linked patterns, less those that ``blocks.pairs`` has.

    Patterns are divided into parts of about ``CELL_ROWS`` contents or names, and
    what is exchanged are pairs of parts: elements meet within a row, so that all
    the pairs a part takes part in cost as much as its elements. ``sets`` is made
    by ``_elements``, ``links`` has p, q and columns that are kept.
    """
    kept = [c for c in links.columns if c not in ("p", "q")]
    sizes = durable(sets.groupBy("pattern").agg(F.sum("weight").alias("size")).select("pattern", _parts("size", CELL_ROWS).alias("parts")))

    def part_of(element: str, lot: str, parts: str = "parts") -> Column:
        return F.pmod(F.xxhash64(element, lot), F.col(parts)).cast("int")

    parts = durable(
        sets.join(sizes, "pattern").groupBy("pattern", part_of("id", "lot").alias("part")).agg(F.collect_list("item").alias("items"))
    )
    of_p = sizes.select(F.col("pattern").alias("p"), F.col("parts").alias("parts_p"))
    of_q = sizes.select(F.col("pattern").alias("q"), F.col("parts").alias("parts_q"))
    numbers = links.join(of_p, "p").join(of_q, "q").withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("parts_p") - 1))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("parts_q") - 1))).where("p <> q OR i <= j")
    lots = blocks.known
    for x in ("u", "v"):
        lots = lots.withColumn(f"lot_{x}", _every_lot(F.col(x)) if named else F.lit(0))
    placed = lots.join(of_p, "p").join(of_q, "q").withColumns(
        {"i": part_of("u", "lot_u", "parts_p"), "j": part_of("v", "lot_v", "parts_q")})
    turned = "p = q AND (i > j OR (i = j AND u > v))"
    known = placed.select("p", "q", *[
        F.when(F.expr(turned), F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("i", "j"), ("j", "i"), ("u", "v"), ("v", "u"))
    ]).groupBy("p", "q", "i", "j", "u").agg(F.collect_set("v").alias("vs")).groupBy("p", "q", "i", "j").agg(
        F.map_from_entries(F.collect_list(F.struct("u", "vs"))).alias("known"))
    # Rows are few and long, so their number says how to deal them, not their size.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = (
        numbers.join(known, ["p", "q", "i", "j"], "left")
        .join(parts.select(F.col("pattern").alias("p"), F.col("part").alias("i"), F.col("items").alias("xs")), ["p", "i"])
        .join(parts.select(F.col("pattern").alias("q"), F.col("part").alias("j"), F.col("items").alias("ys")), ["q", "j"])
        .repartition(tasks, "p", "q", "i", "j")
    )
    same = F.col("_same")
    return (
        cells.select(*kept, "ys", "known", ((F.col("p") == F.col("q")) & (F.col("i") == F.col("j"))).alias("_same"),
                     F.explode("xs").alias("x"))
        .select(*kept, "ys", "_same", "x", F.try_element_at("known", F.col("x.id")).alias("_known"))
        .select(*kept, "_same", "x", "_known", F.explode("ys").alias("y"))
        # Lots of one content are in different parts, or in the same one.
        .where((~same | (F.col("x.id") < F.col("y.id"))) & (F.col("x.id") != F.col("y.id")) & ~F.coalesce(F.array_contains("_known", F.col("y.id")), F.lit(False)))
        .select("x", "y", *kept)
    )


def _links(blocks: _Blocks, least: int, shared: list[str]) -> DataFrame:
    """Patterns whose contents overlap, and what they share; a wide one with itself."""
    own = {"common": "width", "common_a": "weight", "common_b": "weight"}
    alike = blocks.patterns.where(F.col("big") & (F.col("size") > 1) & (F.col(own[shared[-1]]) >= least)).select(
        F.col("pattern").alias("p"), F.col("pattern").alias("q"), *[F.col(own[c]).alias(c) for c in shared])
    return blocks.touching.select("p", "q", *shared).unionByName(alike)


def _elements(blocks: _Blocks, found: _Profile, named: bool) -> DataFrame:
    """(pattern, id, lot, weight, item): the contents of each pattern, as a whole or by lots of their containers."""
    of = found.lots if named else found.kinds.withColumn("lot", F.lit(0))
    facts = ["names", "total"] if named else FACTS
    return blocks.members.join(of, "id").select(
        "pattern", "id", "lot", (F.size("names") if named else F.lit(1)).alias("weight"), F.struct("id", *facts).alias("item"))


def _written_out(blocks: _Blocks, found: _Profile, least: int, shared: list[str], named: bool) -> DataFrame:
    """The pairs of contents that share heavy entries alone, as in ``_overlapping``."""
    return _cells(blocks, _elements(blocks, found, named), _links(blocks, least, shared), named).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), *shared,
        *[F.col(f"{x}.{c}").alias(f"{c}_{s}") for x, s in (("x", "a"), ("y", "b")) for c in (["names", "total"] if named else FACTS)],
    )


def overlap_classes(entries: DataFrame, min_overlap: int = 2, heavy_entry: int = HEAVY_ENTRY) -> DataFrame:
    """Overlap in compact form: one row per pair of different contents.

    ``copies_a`` containers have the contents of ``rep_a``. Contents with
    several copies overlap with themselves: those rows have ``rep_a = rep_b``.
    Nothing is lost against the pair listing, and nothing grows with the square
    of the number of copies.
    """
    found = _profile(entries)
    pairs = _overlapping(found, min_overlap, heavy_entry)
    swap = F.col("rep_a") > F.col("rep_b")

    def ordered(name: str, first: str, second: str) -> Column:
        return F.when(swap, F.col(second)).otherwise(F.col(first)).alias(name)

    columns = [
        ordered(f"{c}_{s}", f"{c}_{s}", f"{c}_{o}")
        for c in ("rep", "total", "copies") for s, o in (("a", "b"), ("b", "a"))
    ]
    across = pairs.select("common", *columns)
    within = found.kinds.where((F.col("copies") > 1) & (F.col("kinds") >= min_overlap)).select(
        F.col("kinds").alias("common"),
        F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"),
        F.col("total").alias("total_a"), F.col("total").alias("total_b"),
        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"),
    )
    return across.unionByName(within)


def _listed(pairs: DataFrame, found: _Profile, weighted: bool, least: int) -> DataFrame:
    """Write content pairs with ``names`` out as container pairs, smaller name first."""
    shared = ["common_a", "common_b"] if weighted else ["common"]
    facts = ["total_a", "total_b", *shared]
    across = pairs.select(*facts, "names_b", F.explode("names_a").alias("x")).select(*facts, "x", F.explode("names_b").alias("y"))
    forward = F.col("x") < F.col("y")

    def first(a: str, b: str) -> Column:
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    across = across.select(
        F.least("x", "y").alias("container_a"), F.greatest("x", "y").alias("container_b"),
        (first("common_a", "common_b") if weighted else F.col("common")).alias("common"),
        first("total_a", "total_b").alias("total_a"), first("total_b", "total_a").alias("total_b"),
    ).where(F.col("common") >= least)
    if not found.any_copied:
        return across
    own = "total" if weighted else "kinds"
    same = found.copied.where(F.col(own) >= least)
    twins = skew.spread_self_join(
        same, same, "id", "container", _parts("copies"),
        F.col("l.container") < F.col("r.container"),
    ).select(
        F.col("l.container").alias("container_a"), F.col("r.container").alias("container_b"),
        F.col(f"l.{own}").alias("common"),
        F.col("l.total").alias("total_a"), F.col("r.total").alias("total_b"),
    )
    return across.unionByName(twins)


def container_overlap(entries: DataFrame, min_overlap: int = 2, heavy_entry: int = HEAVY_ENTRY,
                      few_entries: int = FEW_ENTRIES) -> DataFrame:
    """All pairs of containers sharing at least ``min_overlap`` different entries.

    One row per pair: the report form. Its length is that of the answer, which
    for many identical containers is large; ``overlap_classes`` says the same
    compactly.
    """
    found = _profile(entries)
    return _listed(_overlapping(found, min_overlap, heavy_entry, few_entries=few_entries, named=True), found, False, min_overlap)


def container_overlap_entries(entries: DataFrame, min_overlap: int = 2,
                              heavy_entry: int = HEAVY_ENTRY) -> DataFrame:
    """As ``container_overlap``, counting entries of the first container.

    An entry that occurs three times in the first container counts three
    times when the second one has it. Containers are ordered by name.
    """
    found = _profile(entries)
    return _listed(_overlapping(found, min_overlap, heavy_entry, True, named=True), found, True, min_overlap)


def overlap_ratios(pairs: DataFrame) -> DataFrame:
    """Shared part of either container in percent, one decimal, 0 for empty ones."""
    def ratio(total: str):
        share = F.try_divide(F.col("common"), F.col(total)) * 100
        return F.coalesce(F.bround(share, 1), F.lit(0.0))

    return pairs.withColumn("ratio_a", ratio("total_a")).withColumn("ratio_b", ratio("total_b"))


def shared_hashes(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shared hashes of the given pairs, one row each.

    Long form on purpose: two large copies of one container share everything,
    which does not belong into a single array.
    """
    contents = entries.where(F.col("hash").isNotNull()).select("container", "hash").distinct()
    of_a = contents.select(F.col("container").alias("container_a"), "hash")
    of_b = contents.select(F.col("container").alias("container_b"), "hash")
    return (
        pairs.select("container_a", "container_b")
        .join(of_a, "container_a").join(of_b, ["container_b", "hash"])
        .select("container_a", "container_b", "hash")
    )


def _lists(rows: DataFrame, key: list[str], value: str, number: str) -> DataFrame:
    """The values of each key in lists of about ``LIST_ROWS``; ``number`` says how many it has at most."""
    part = F.pmod(F.xxhash64(value), _parts(number, LIST_ROWS)).alias("_list")
    return rows.groupBy(*key, part).agg(F.collect_list(value).alias("shared")).drop("_list")


def _spelled(lists: DataFrame, name: str) -> DataFrame:
    """(container_a, container_b, name): the ``shared`` lists of pairs of contents, for all their containers."""
    return lists.select("names_b", "shared", F.explode("names_a").alias("x")).select(
        "shared", "x", F.explode("names_b").alias("y")).select(
        F.least("x", "y").alias("container_a"), F.greatest("x", "y").alias("container_b"), F.explode("shared").alias(name))


def overlap_hashes(entries: DataFrame, min_overlap: int = 2, heavy_entry: int = HEAVY_ENTRY) -> DataFrame:
    """``shared_hashes`` of all pairs of ``container_overlap``.

    The pairs are not joined with the entries. What two contents share at light
    entries is told where they meet; their frequent entries are those of their
    patterns, listed once for two patterns. Lists are taken apart in the end.
    """
    found = _profile(entries)
    spelled = _shared_entries(found, 0, "hash")
    known = spelled.drop("hash")
    woven = _patterns(known, heavy_entry)
    blocks = _blocks(known, woven, min_overlap, heavy_entry)
    pairs = blocks.placed

    light = spelled.where(F.col("in_") <= heavy_entry)
    met = light.alias("l").join(
        light.select("id", "entry").alias("r"), (F.col("l.entry") == F.col("r.entry")) & (F.col("l.id") < F.col("r.id"))
    ).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "hash")
    at_light = _with_names(_lists(met.join(pairs, ["a", "b"]), ["a", "b"], "hash", "common"), found)

    of = woven.rows.select("id", "entry")
    touching = blocks.touching.select("p", "q").unionByName(pairs.where("both AND p < q").select("p", "q")).distinct()
    shared = (
        touching.join(of.withColumnRenamed("id", "p"), "p").join(of.withColumnRenamed("id", "q"), ["q", "entry"])
        .select("p", "q", "entry").unionByName(of.select(F.col("id").alias("p"), F.col("id").alias("q"), "entry"))
    )
    widths = blocks.patterns.select(F.col("pattern").alias("p"), "width")
    lists = durable(_lists(shared.join(widths, "p"), ["p", "q"], "entry", "width"))
    links = _links(blocks, min_overlap, ["common"]).select("p", "q").join(lists, ["p", "q"])
    alone = _cells(blocks, _elements(blocks, found, True), links, True).select(
        F.col("x.names").alias("names_a"), F.col("y.names").alias("names_b"), "shared")
    named = _with_names(pairs.where("both").select("a", "b", "p", "q"), found)
    at_heavy = named.join(lists, ["p", "q"]).select("names_a", "names_b", "shared").unionByName(alone)

    names = durable(spelled.where(F.col("in_") > heavy_entry).select("entry", "hash").distinct())
    if names.count() <= SMALL_TABLE:
        names = F.broadcast(names)
    columns = ["container_a", "container_b", "hash"]
    out = _spelled(at_light, "hash").unionByName(_spelled(at_heavy, "entry").join(names, "entry").select(*columns))
    if not found.any_copied:
        return out
    same = found.copied.where(F.col("kinds") >= min_overlap)
    own = found.contents.join(
        found.kinds.where((F.col("copies") > 1) & (F.col("kinds") >= min_overlap)).select(
            F.col("rep").alias("container"), "id", "kinds"), "container")
    listed = same.join(_lists(own, ["id"], "hash", "kinds"), "id")
    twins = skew.spread_self_join(listed, same, "id", "container", _parts("copies"), F.col("l.container") < F.col("r.container"))
    return out.unionByName(twins.select(
        F.col("l.container").alias("container_a"), F.col("r.container").alias("container_b"), F.explode("l.shared").alias("hash")))


def top_overlaps(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.orderBy(F.col("common").desc(), "container_a", "container_b").limit(n)


def strongest_overlaps(entries: DataFrame, min_overlap: int = 2, n: int = 5, heavy_entry: int = HEAVY_ENTRY) -> DataFrame:
    """``top_overlaps`` of ``container_overlap`` without the pairs in between.

    Of two sets of containers whose pairs share equally much, the first n + 1
    names of either hold the first n pairs: a pair with a later name has n
    pairs of earlier ones before it, which share as much or more.
    """
    found = _profile(entries)
    entries_of = _shared_entries(found)
    blocks = _blocks(entries_of, _patterns(entries_of, heavy_entry), min_overlap, heavy_entry)
    twins = found.kinds.where((F.col("copies") > 1) & (F.col("kinds") >= min_overlap)).select(
        F.col("id").alias("a"), F.col("id").alias("b"), F.col("kinds").alias("common"))
    listed = blocks.pairs.unionByName(twins)
    best = listed.select("common").orderBy(F.col("common").desc()).limit(n).collect()
    enough = F.col("common") >= (best[-1].common if len(best) == n else min_overlap)
    names = found.classes.select("id", "container")

    def firsts(of: DataFrame) -> DataFrame:
        order = Window.partitionBy("set").orderBy("container")
        return of.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n + 1).drop("_at")

    def written(sets: DataFrame, of: DataFrame) -> DataFrame:
        few = sets.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        first = durable(firsts(of.join(few, "set")))
        x, y = F.col("l.container"), F.col("r.container")
        return sets.join(first.alias("l"), F.col("a") == F.col("l.set")).join(first.alias("r"), F.col("b") == F.col("r.set")).where(
            (x < y) | ((F.col("a") != F.col("b")) & (x > y))
        ).select(F.least(x, y).alias("container_a"), F.greatest(x, y).alias("container_b"), "common")

    by_content = written(listed.where(enough), names.withColumnRenamed("id", "set"))
    alike = blocks.patterns.where(F.col("width") >= min_overlap).select(
        F.col("pattern").alias("a"), F.col("pattern").alias("b"), F.col("width").alias("common"))
    touching = blocks.touching.select(F.col("p").alias("a"), F.col("q").alias("b"), "common")
    by_pattern = written(
        touching.unionByName(alike).where(enough),
        names.join(blocks.members, "id").select(F.col("pattern").alias("set"), "container"),
    )
    # Pairs of both kinds: what they share at a light entry counts as well.
    found_pairs = by_content.unionByName(by_pattern).groupBy("container_a", "container_b").agg(F.max("common").alias("common"))
    return top_overlaps(found_pairs, n)


def container_groups(entries: DataFrame, min_overlap: int = 2, heavy_entry: int = HEAVY_ENTRY,
                     sizes: DataFrame | None = None, few_entries: int = FEW_ENTRIES) -> DataFrame:
    """Containers joined to groups through overlapping pairs.

    ``root`` is the smallest container of the group, ``shared`` the largest
    overlap of a pair in it, ``total`` the container's number of entries. The
    largest container (by ``sizes``, then by name) is kept; ``savable`` is the
    size of the others. Works on distinct contents; copies are linked to
    their representative only, and of contents that share frequent entries
    alone, one stands for all with the same ones. Contents of few entries meet
    at pairs of entries where that is less, as in ``_overlapping``.
    """
    found = _profile(entries)
    few = few_entries if min_overlap > 1 else 0
    entries_of = _shared_entries(found, few)
    by_pairs = None
    if few:
        light = F.when(~F.col("big") & (F.col("in_") <= heavy_entry), F.col("in_") - 1)
        met = entries_of.agg(F.sum(light).alias("n")).first().n or 0
        by_pairs = _met_at_pairs(entries_of.where("NOT big"), min_overlap, met // 2)
    if by_pairs is None:
        entries_of = entries_of.withColumn("big", F.lit(True))
    blocks = _blocks(entries_of, _patterns(entries_of, heavy_entry), min_overlap, heavy_entry)
    # Contents of one pattern that is wide enough all overlap: each is linked to the first of them.
    wide = blocks.patterns.where((F.col("size") > 1) & (F.col("width") >= min_overlap))
    inside = skew.join_to_groups(blocks.members, wide.select("pattern", "first", "size"), "pattern", "size", "id", settle=True)
    first = blocks.patterns.select("pattern", "first")
    across = blocks.touching.join(first.toDF("p", "a"), "p").join(first.toDF("q", "b"), "q").select("a", "b", "common")
    pairs = durable(
        blocks.pairs.unionByName(across)
        .unionByName(inside.select(F.col("first").alias("a"), F.col("id").alias("b"), F.col("width").alias("common")))
        .unionByName(blocks.pairs.limit(0) if by_pairs is None else by_pairs)
    )
    parts = connected_components(pairs, "a", "b").withColumnRenamed("node", "id")
    twins = found.kinds.where((F.col("copies") > 1) & (F.col("kinds") >= min_overlap))
    strongest = (
        pairs.select(F.explode(F.array("a", "b")).alias("id"), "common")
        .unionByName(twins.select("id", F.col("kinds").alias("common")))
        .groupBy("id").agg(F.max("common").alias("best"))
    )
    # Copies of one content are a group even when nothing else overlaps with it.
    labelled = strongest.join(parts, "id", "left").join(found.kinds.select("id", "copies"), "id").select(
        "id", "best", F.coalesce("component", "id").alias("part"), "copies"
    )
    named = durable(
        skew.join_to_groups(found.classes.select("container", "id", "total"), labelled, "id", "copies", "container", settle=True)
    )
    roots = named.groupBy("part").agg(F.min("container").alias("root"), F.count("*").alias("_n"))
    placed = durable(
        skew.join_to_groups(named, roots, "part", "_n", "container", settle=True).select("container", "root", "best", "total")
    )
    if sizes is None:
        placed = placed.withColumn("size", F.lit(0).cast("bigint"))
    else:
        placed = placed.join(sizes.select("container", "size"), "container", "left").fillna(0, ["size"])
    groups = placed.groupBy("root").agg(
        F.max("best").alias("shared"), F.count("*").alias("n"),
        (F.sum("size") - F.max("size")).alias("savable"),
        F.min(F.struct((-F.col("size")).alias("_size"), F.col("container").alias("name"))).alias("_kept"),
    )
    joined = skew.join_to_groups(placed.drop("best"), groups, "root", "n", "container", settle=True)
    return joined.select(
        "container", "root", "n", "shared", "total", "size", "savable",
        (F.col("container") == F.col("_kept.name")).alias("keep"),
    )


def container_pair_groups(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """One group per overlapping pair: the first is kept, the smaller size is savable."""
    a = sizes.select(F.col("container").alias("container_a"), F.col("size").alias("size_a"))
    b = sizes.select(F.col("container").alias("container_b"), F.col("size").alias("size_b"))
    return (
        pairs.join(a, "container_a", "left").join(b, "container_b", "left")
        .withColumn("size_a", F.coalesce("size_a", F.lit(0).cast("bigint")))
        .withColumn("size_b", F.coalesce("size_b", F.lit(0).cast("bigint")))
        .withColumn("savable", F.least("size_a", "size_b"))
    )


def container_collapse(members: DataFrame, key: str = "hash") -> DataFrame:
    """Per group: plain items as they are, entries folded into their container.

    ``matched`` is the number of entries of the container in the group,
    ``total`` the number of entries it has in all. ``created`` of plain items
    is kept where there is such a column.
    """
    dated = "created" in members.columns
    inside = is_entry(F.col("path"))
    return (
        members.withColumn("_inside", inside)
        .groupBy(key, F.when(F.col("_inside"), container_of(F.col("path"))).otherwise(F.col("path")).alias("path"),
                 "_inside")
        .agg(F.count("*").alias("_n"), F.max("size").alias("size"), F.max("total").alias("_total"),
             *([F.min("created").alias("_created")] if dated else []))
        .select(
            key, "path", "size",
            F.when(F.col("_inside"), "archive").otherwise("file").alias("type"),
            F.when(F.col("_inside"), F.col("_n")).alias("matched"),
            F.when(F.col("_inside"), F.col("_total")).alias("total"),
            *([F.when(~F.col("_inside"), F.col("_created")).alias("created")] if dated else []),
        )
    )


def container_pair_rollup(members: DataFrame, key: str = "hash", heavy_entry: int = HEAVY_ENTRY,
                          placed: bool = False) -> DataFrame:
    """Pairs of containers with the number of groups found in nothing but entries.

    Groups that also have a plain item are left out: their copy to keep is a
    file, and they are reported as ordinary groups.

    With ``placed`` a container is a struct of its ``position`` in the order of
    names and its ``name``, by which pairs are sorted without comparing names.
    """
    only_entries = members.groupBy(F.col(key).alias("hash")).agg(
        F.count("*").alias("_n"), F.bool_and(is_entry(F.col("path"))).alias("_inside")
    ).where("_inside").select("hash", "_n")
    entries = members.select(container_of(F.col("path")).alias("container"), F.col(key).alias("hash"))
    inner = skew.join_to_groups(entries, only_entries, "hash", "_n", "container", settle=True)
    if placed:
        inner = durable(inner)
        names = global_position(inner.groupBy("container").agg(F.count("*").alias("_n")), [F.col("container").asc()])
        inner = skew.join_to_groups(inner, names.withColumn("_of", F.struct("position", F.col("container").alias("name"))),
                                    "container", "_n", "hash").select(F.col("_of").alias("container"), "hash")
    return container_overlap(inner, 1, heavy_entry).select(
        "container_a", "container_b", F.col("common").alias("shared")
    )
