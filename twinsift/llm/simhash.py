"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint is the majority of its shingles' hashes, bit by bit. To find
fingerprints that differ in a few bits, they are dealt to top nodes by masked
bit patterns; below a top node they stand in Gray order, which keeps those
that share bits together. Groups of neighbours form nodes that hold the bits
all their members share, and groups of nodes form the nodes above. Two nodes
are compared by the bits both have fixed; the differences found on the way
down add up, and where they exceed the limit, whole groups are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import skew
from ..operators.components import connected_components
from .common import durable, text_of

SEED = 42
HOT_ROWS = 1_024            # rows of a group that one task joins to the group's facts
_CHUNK = 255 * 64           # shingles taken at once: 255 ones fit in a byte
_LEAF, _FAN = 32, 8
_FRONTIER = 1 << 20         # node pairs held at once


# -- fingerprints ------------------------------------------------------------


def _words_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """(len, n) words: the hashes themselves, and n - 1 remixed ones."""
    out = np.empty((len(hashes), n), np.uint64)
    out[:, 0] = hashes
    for k in range(1, n):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def majority(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of ``64 * n`` bits of a set of hashes; zero of none."""
    ones = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_words_of(hashes[at:at + _CHUNK], n).view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += bits[low:low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def simhash(text: bytes, shingle: int, n: int) -> np.ndarray:
    """Fingerprint of ``64 * n`` bits as n words; zero without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(n, np.uint64)
    size = max(1, len(words) - shingle + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones = np.zeros(64 * n, np.int64)
    for at in range(0, size, _CHUNK):
        part = words[at:at + _CHUNK + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = _words_of(np.fromiter(map(digest, joined), np.uint64), n)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += bits[low:low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > size, bitorder="little").view(np.uint64)


def _raw_texts(batch: pa.Array) -> Iterator[bytes]:
    for value in batch.cast(pa.large_binary()):
        yield value.as_py() or b""


def fingerprint(text: Column, shingle: int = 3, n: int = 1) -> Column:
    """Fingerprint words (array of long) of a text; null reads as empty."""

    @F.arrow_udf("array<bigint>")
    def bits(batch: pa.Array) -> pa.Array:
        words = [simhash(t, shingle, n) for t in _raw_texts(batch)]
        flat = np.concatenate(words).view(np.int64) if words else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))

    return bits(text)


# -- the index below one top node --------------------------------------------


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Positions of the codes (rows of words) sorted by their Gray rank."""
    ranks, odd = [], np.zeros(len(codes), bool)
    for k in range(codes.shape[1]):
        rank = codes[:, k].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        ranks.append(np.where(odd, ~rank, rank))
        odd ^= (np.bitwise_count(codes[:, k]) & 1).astype(bool)
    return np.lexsort(ranks[::-1])


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the smaller label of the two, as far as it reaches."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


class GrayIndex:
    """Nodes over codes in Gray order: shared bits (mask, value) of each level."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels = codes, []
        starts = np.arange(0, len(codes), _LEAF)
        ones, anyone = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        while True:
            self.levels.append((~(ones ^ anyone), ones, starts))
            if len(starts) <= _FAN:
                break
            above = np.arange(0, len(starts), _FAN)
            ones, anyone = np.bitwise_and.reduceat(ones, above), np.bitwise_or.reduceat(anyone, above)
            starts = starts[above]

    def _single_label(self, labels: np.ndarray, level: int) -> np.ndarray:
        """Label of a node whose rows all have one, else -1."""
        starts = self.levels[level][2]
        low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        return np.where(low == high, low, -1)

    def _rows(self, leaves_a: np.ndarray, leaves_b: np.ndarray, limit: int, labels: np.ndarray) -> None:
        """Compare the rows of leaf pairs and link those within the limit."""
        n, inner = len(self.codes), np.arange(_LEAF)
        step = max(1, _FRONTIER // (_LEAF * _LEAF))
        for at in range(0, len(leaves_a), step):
            a = np.repeat(leaves_a[at:at + step, None] * _LEAF + inner, _LEAF, axis=1).ravel()
            b = np.tile(leaves_b[at:at + step, None] * _LEAF + inner, (1, _LEAF)).ravel()
            valid = (a < b) & (b < n)
            a, b = a[valid], b[valid]
            new = labels[a] != labels[b]
            a, b = a[new], b[new]
            near = _differing(self.codes[a], self.codes[b]) <= limit
            _link(labels, a[near], b[near])

    def components(self, limit: int) -> np.ndarray:
        """Smallest row number of the component of each row."""
        labels = np.arange(len(self.codes))
        leaves = np.arange(len(self.levels[0][2]))
        for step in (0, 1):     # neighbours first: what they link needs no further look
            self._rows(leaves[:len(leaves) - step], leaves[step:], limit, labels)
        top = np.arange(len(self.levels[-1][2]))
        a, b = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
        pending = [(len(self.levels) - 1, a[a <= b], b[a <= b], None, None)]
        while pending:
            level, a, b, shared, known = pending.pop()
            mask, value, _ = self.levels[level]
            single = self._single_label(labels, level)
            both = mask[a] & mask[b]
            fresh = both if shared is None else both & ~shared
            known = np.bitwise_count((value[a] ^ value[b]) & fresh).sum(axis=1, dtype=np.int64) + (0 if known is None else known)
            open_ = (known <= limit) & ~((single[a] >= 0) & (single[a] == single[b]))
            a, b, both, known = a[open_], b[open_], both[open_], known[open_]
            if not len(a):
                continue
            if level == 0:
                self._rows(a, b, limit, labels)
                continue
            below = len(self.levels[level - 1][2])
            for at in range(0, len(a), _FRONTIER // (_FAN * _FAN)):
                part = slice(at, at + _FRONTIER // (_FAN * _FAN))
                inner = np.arange(_FAN)
                ca = np.repeat(a[part, None] * _FAN + inner, _FAN, axis=1).ravel()
                cb = np.tile(b[part, None] * _FAN + inner, (1, _FAN)).ravel()
                up = np.repeat(np.arange(len(a[part])), _FAN * _FAN)
                valid = (ca <= cb) & (cb < below)
                up = up[valid]
                pending.append((level - 1, ca[valid], cb[valid], both[part][up], known[part][up]))
        return labels


def _small_groups(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, limit: int, labels: np.ndarray) -> None:
    """All groups of up to ``_LEAF`` rows at once, by their distance in the table."""
    for shift in range(1, _LEAF):
        larger = sizes > shift
        starts, sizes = starts[larger], sizes[larger]
        if not len(starts):
            return
        a = np.repeat(starts, sizes - shift) + _ramp(sizes - shift)
        near = _differing(codes[a], codes[a + shift]) <= limit
        _link(labels, a[near], a[near] + shift)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0..s-1 for each s of sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _linked_rows(tops: np.ndarray, nodes: np.ndarray, codes: np.ndarray, limit: int) -> pa.RecordBatch:
    """Links (node, smallest node it is linked with) of complete groups of equal tops."""
    starts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    sizes = np.diff(np.r_[starts, len(tops)])
    labels = np.arange(len(tops))
    small = sizes <= _LEAF
    _small_groups(starts[small], sizes[small], codes, limit, labels)
    for start, size in zip(starts[~small], sizes[~small]):
        rows = start + gray_order(codes[start:start + size])
        labels[rows] = rows[GrayIndex(codes[rows]).components(limit)]
    # Named by the smallest node, a dense group is called the same below most of its top nodes.
    low = nodes.copy()
    np.minimum.at(low, labels, nodes)
    names = low[labels]
    moved = np.flatnonzero(names != nodes)
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(names[moved])], names=["src", "dst"])


def _search(limit: int, n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held))

        for batch in batches:
            if not batch.num_rows:
                continue
            tops = batch.column("top").to_numpy(zero_copy_only=False)
            rows = (tops, batch.column("node").to_numpy(zero_copy_only=False),
                    batch.column("code").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n))
            last = np.searchsorted(tops, tops[-1])      # the last group may go on in the next batch
            if last or (held and held[0][0][-1] != tops[-1]):
                held.append(tuple(x[:last] for x in rows))
                yield _linked_rows(*joined(), limit)
                held = []
            held.append(tuple(x[last:] for x in rows))
        if held:
            yield _linked_rows(*joined(), limit)

    return run


# -- top nodes ---------------------------------------------------------------


def _as_long(word: int) -> int:
    return word - 2**64 if word >= 2**63 else word


def _split(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` near-equal runs, each with ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def exact_tops(nodes: DataFrame, limit: int, hot_nodes: int) -> DataFrame:
    """Top nodes for one-word codes: of limit + 1 runs of bits one is equal.

    A top node over ``hot_nodes`` codes is divided again by its other bits,
    with the same argument, until it is small or all bits are fixed. So every
    pair within the limit meets at one top node at least.
    """
    done, masks, level = None, [_split(0, limit + 1)], 0
    rows = nodes.withColumn("_m", F.lit(0))
    while True:
        table = F.array(*[F.array(*[F.lit(_as_long(m)) for m in row]) for row in masks])
        word = F.get("code", F.lit(0))
        rows = rows.select("node", "code", F.posexplode(F.get(table, "_m")).alias("_k", "_mask"), "_m").select(
            "node", "code", (F.col("_m") * (limit + 1) + F.col("_k")).alias("_m"),
            F.xxhash64("_mask", word.bitwiseAND(F.col("_mask"))).alias("top"))
        flat = [m for row in masks for m in row]
        level += 1
        free = 64 - max(m.bit_count() for m in flat)
        hot = durable(rows.groupBy("top").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_nodes))
        last = free <= limit + 1 or hot.isEmpty()
        cold = rows if last else rows.join(hot, "top", "left_anti")
        cold = cold.select("top", "node", "code")
        done = cold if done is None else done.unionByName(cold)
        if last:
            return done
        rows = durable(rows.join(hot, "top", "left_semi").select("node", "code", "_m"))
        masks = [_split(m, limit + 1) for m in flat]


def banded_tops(nodes: DataFrame, bands: int, width: int, n: int) -> DataFrame:
    """Top nodes for longer codes: ``bands`` seeded choices of ``width`` bits.

    Codes that agree in all bits of a choice meet. A pair that differs in a
    share p of its bits is missed with probability (1 - (1-p)^width)^bands.
    """
    random = np.random.default_rng(SEED)
    choices = [sorted(int(x) for x in random.choice(64 * n, width, replace=False)) for _ in range(bands)]
    keys = []
    for k, bits in enumerate(choices):
        masks = [sum(1 << (i % 64) for i in bits if i // 64 == w) for w in range(n)]
        keys.append(F.xxhash64(F.lit(k), *[
            F.get("code", F.lit(w)).bitwiseAND(F.lit(_as_long(m))) for w, m in enumerate(masks) if m]))
    return nodes.select(F.explode(F.array(*keys)).alias("top"), "node", "code")


def bands_needed(width: int, bits: int, limit: int, miss: float) -> int:
    """Choices of ``width`` bits until a pair ``limit`` bits apart is missed with probability ``miss`` at most."""
    meet = math.prod((bits - limit - i) / (bits - i) for i in range(width))
    return math.ceil(math.log(miss) / math.log1p(-meet))


def in_cells(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows (node, left, ...) dealt to ``top``s so that each with ``left`` meets every row of its key.

    The rows of a key are cut into blocks of about ``size``, and so are those
    with ``left``; a block of each meets in one cell. Keys without ``left`` rows
    are left out.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("left").alias("_few")).where("_few > 0").select(
        key, "_n", *[F.ceil(F.col(c) / size).cast("int").alias(name) for c, name in (("_n", "_all"), ("_few", "_few"))])
    rows = skew.join_to_groups(rows, sizes, key, "_n", "node", HOT_ROWS, settle=True).drop("_n")
    block = lambda c: F.pmod(F.xxhash64("node", F.lit(SEED)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every = rows.withColumn("_i", block("_all")).withColumn("_j", each("_few")).withColumn("left", F.lit(False))
    few = rows.where("left").withColumn("_j", block("_few")).withColumn("_i", each("_all"))
    return every.unionByName(few).withColumn("top", F.xxhash64(key, "_i", "_j")).drop(key, "_i", "_j", "_all", "_few")


def banded_links(tops: DataFrame, count: int, limit: int, n: int, hot_nodes: int) -> DataFrame:
    """Links below the ``count`` rows of ``tops``; those of a top node over ``hot_nodes`` codes in parts.

    The codes of a hot top node that are near its smallest one are linked by
    that; the others meet all codes of the node, in cells. So the components
    are those of an undivided search. Hot ones are looked for by counts of
    slots that hold many top nodes, as most top nodes have one code.
    """
    slot = F.pmod("top", F.lit(8 * count // hot_nodes + 1)).alias("_slot")
    crowded = tops.groupBy(slot).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_nodes).select("_slot")
    hot = durable(tops.withColumn("_slot", slot).join(crowded, "_slot", "left_semi").groupBy("top").agg(
        F.count("*").alias("_n"), F.min(F.struct("node", "code")).alias("_low")).where(F.col("_n") > hot_nodes))
    search = lambda x: x.select("top", "node", "code").repartition("top").sortWithinPartitions("top").mapInArrow(
        _search(limit, n), "src long, dst long")
    if hot.isEmpty():
        return search(tops)
    apart = sum((F.bit_count(F.get("code", F.lit(k)).bitwiseXOR(F.get("_low.code", F.lit(k)))) for k in range(n)), F.lit(0))
    rows = durable(tops.join(hot.drop("_n"), "top").where(F.col("node") != F.col("_low.node")).select(
        "top", "node", "code", F.col("_low.node").alias("dst"), (apart > limit).alias("left")))
    return search(tops.join(hot, "top", "left_anti")).unionByName(
        rows.where("NOT left").select(F.col("node").alias("src"), "dst").distinct()).unionByName(
        search(in_cells(rows.drop("dst").withColumnRenamed("top", "_top"), "_top", hot_nodes)))


# -- the operator ------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 3, limit: int = 2, words64: int = 1, bands: int | None = None, width: int | None = None,
    hot_nodes: int = 16_384, miss: float | None = None,
) -> DataFrame:
    """The ``keep`` columns of every row, ``code`` (fingerprint words) and ``component_id``.

    Rows link if their fingerprints differ in at most ``limit`` bits;
    ``component_id`` is the smallest id reachable, null if there is none.
    Without ``bands`` and ``miss``, fingerprints of one word are searched
    exactly. Otherwise fingerprints of ``words64`` words meet by bands of
    ``width`` bits (by default eight less than the bits of the number of
    fingerprints, 12 at least): as many as ``bands`` says, or as a pair at the
    limit needs to be missed with probability ``miss`` at most.

    Null and empty texts have fingerprint zero and link like any other. Null
    ids are never the smallest. Repeated rows are one fingerprint; the links
    of a group of copies are those of its one code. An empty table gives no
    rows. Columns not in ``keep`` are left out.
    """
    marked = durable(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("_id"),
        fingerprint(text_of(text_col), shingle, words64).alias("code"),
    ).withColumn("node", F.get("code", F.lit(0)) if words64 == 1 else F.xxhash64("code")))
    nodes = durable(marked.groupBy("node").agg(F.first("code").alias("code"), F.min("_id").alias("_first")))
    codes = nodes.select("node", "code")
    if bands is None and miss is None:
        tops = exact_tops(codes, limit, hot_nodes)
        links = tops.repartition("top").sortWithinPartitions("top").mapInArrow(
            _search(limit, words64), "src long, dst long")
    else:
        links = near_links(codes, limit, words64, hot_nodes, limit, miss, bands, width)
    return marked.join(_lowest_ids(nodes, links), "node").select("_row.*", "code", "component_id")


def near_links(
    codes: DataFrame, limit: int, words64: int, hot_nodes: int, aim: int, miss: float | None,
    bands: int | None = None, width: int | None = None,
) -> DataFrame:
    """Links that join codes within ``limit`` bits; bands follow the width for pairs ``aim`` bits apart."""
    count = codes.count()
    width = width or max(12, count.bit_length() - 8)
    bands = bands or bands_needed(width, 64 * words64, aim, miss)
    return banded_links(banded_tops(codes, bands, width, words64), bands * count, limit, words64, hot_nodes)


def _lowest_ids(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id): the smallest id (``_first``) of what the links join."""
    named = connected_components(links)
    members = durable(nodes.select("node", "_first").join(named, "node", "left").select(
        "node", F.coalesce("component", "node").alias("_c"), "_first"))
    lowest = members.groupBy("_c").agg(F.min("_first").alias("component_id"))
    return members.join(lowest, "_c").select("node", "component_id")
