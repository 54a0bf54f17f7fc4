"""Benchmark decontamination by greedy string tiling.

Seeds are windows of ``seed`` words. Documents are joined with the test items
that share seeds with them; pairs whose shared seeds could cover enough of the
item are tiled: the longest match of words not yet marked is marked again and
again, found by running Karp-Rabin hashes, so passages are recognised in any
order. The covered share of the item decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import durable, text_of

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words of test items that one pass over the documents looks for.
BLOCK_WORDS = 1_000_000


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def running_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2^64) of each window of ``size`` ids."""
    if len(ids) < size:
        return np.empty(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    if size <= 8:
        out = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            out = out * _BASE + x[k:len(ids) - size + 1 + k]
        return out
    # Running sums of x[j] * base^(n-1-j): a window is a difference, brought to one power.
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(ids) - 1, _BASE)])
    sums = np.r_[np.uint64(0), np.cumsum(x * powers[::-1])]
    back = np.uint64(pow(int(powers[len(ids) - size]), -1, 2**64))
    return (sums[size:] - sums[:-size]) * powers[:len(sums) - size] * back


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    sums = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(sums[size:] == sums[:-size]) if len(marked) >= size else np.empty(0, np.int64)


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), longest first, not overlapping.

    Equal lengths go by their start in the item, then in the document. A tile
    has ``least`` words or more.
    """
    marked_i, marked_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        fi, fd = _free(marked_i, size), _free(marked_d, size)
        hi, hd = running_hashes(item, size), running_hashes(doc, size)
        hi, hd = hi[fi], hd[fd]
        ki, kd = np.isin(hi, hd), np.isin(hd, hi)
        return fi[ki], hi[ki], fd[kd], hd[kd]

    longest = min(len(item), len(doc))
    while longest >= least:
        low, high, size = least, longest, 0
        while low <= high:              # a match of a length has matches of all shorter lengths in it
            middle = (low + high) // 2
            found = common(middle)
            if len(found[0]):
                size, (fi, hi, fd, hd), low = middle, found, middle + 1
            else:
                high = middle - 1
        if not size:
            break
        places = defaultdict(list)
        for at, h in zip(fd[::-1].tolist(), hd[::-1].tolist()):
            places[h].append(at)
        for i, h in zip(fi.tolist(), hi.tolist()):
            while places[h] and not marked_i[i:i + size].any():
                d = places[h].pop()
                if not marked_d[d:d + size].any() and np.array_equal(item[i:i + size], doc[d:d + size]):
                    marked_i[i:i + size] = marked_d[d:d + size] = True
                    tiles.append((i, d, size))
        longest = size - 1              # nothing of this length is left
    return tiles


class ItemIndex:
    """Seeds and words of a block of test items."""

    def __init__(self, items: Sequence[tuple[int, bytes]], seed: int):
        self.seed, self.vocabulary, self.items = seed, {}, []
        hashes, owners, places = [], [], []
        for key, text in items:
            words = _words(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            size = min(seed, len(ids))
            h = running_hashes(ids, size) + np.uint64(size)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((key, ids))
        self.sizes = sorted({min(seed, len(ids)) for _, ids in self.items}, reverse=True)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate(owners)[order] if hashes else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.empty(0, np.int64)
        # A table of the hashes' high bits, so that most windows are refused by one look.
        self.bits = max(16, int(max(1, len(flat))).bit_length() + 4)
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def matches(self, text: bytes, threshold: float) -> Iterator[tuple[int, int, float, int, int, int, int]]:
        """(item, words covered, coverage, tiles, longest, first word, last word) of items that reach the threshold."""
        words = _words(text)
        get = self.vocabulary.get
        doc = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for size in self.sizes:
            if len(doc) < size:
                continue
            runs = _free(doc == 0, size)
            if not len(runs):
                continue
            h = np.unique(running_hashes(doc, size)[runs] + np.uint64(size))
            h = h[self.there[(h >> np.uint64(64 - self.bits)).astype(np.int64)]]
            low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            for lo, hi in zip(low[high > low].tolist(), high[high > low].tolist()):
                for owner, place in zip(self.owners[lo:hi].tolist(), self.places[lo:hi].tolist()):
                    found[owner].append((place, size))
        for owner, seeds in found.items():
            key, ids = self.items[owner]
            reach = np.zeros(len(ids) + 1, np.int64)
            for place, size in seeds:
                reach[place] += 1
                reach[place + size] -= 1
            if (np.cumsum(reach)[:-1] > 0).sum() < threshold * len(ids):
                continue                # tiles consist of shared seeds and can't cover more
            tiles = greedy_tiles(ids, doc, min(self.seed, len(ids)))
            covered = sum(t[2] for t in tiles)
            if covered >= threshold * len(ids):
                yield (key, covered, covered / len(ids), len(tiles), max(t[2] for t in tiles),
                       min(t[1] for t in tiles), max(t[1] + t[2] for t in tiles))


_FOUND = {
    "item_id": pa.int64(), "covered_words": pa.int64(), "coverage": pa.float64(), "n_tiles": pa.int64(),
    "longest_tile": pa.int64(), "first_word": pa.int64(), "end_word": pa.int64(),
}


def _scan(items: Sequence[tuple[int, bytes]], seed: int, threshold: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, seed)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column("_text").cast(pa.large_binary())):
                for match in index.matches(text.as_py() or b"", threshold):
                    at.append(k)
                    found.append(match)
            if at:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), _FOUND.values())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").take(pa.array(at)), *columns], names=["_row", *_FOUND])

    return run


def contaminated(
    docs: DataFrame, tests: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, threshold: float = 0.6,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and test item whose words the document covers.

    The ``keep`` columns, ``item_id``, ``covered_words``, ``coverage`` (share
    of the item's words in tiles of ``seed`` words or more), ``n_tiles``,
    ``longest_tile``, and from which to which word of the document tiles reach.
    Words are ASCII-lower-cased; an item shorter than a seed has to occur whole.

    The test items are the stated query set: it goes to all tasks in blocks of
    about ``block_words`` words, each block in a pass over the documents. With
    several blocks a pass is written before the next block is read, so the
    driver and the tasks hold one block at a time, however many there are.
    Whole documents are looked at.

    Null and empty documents match nothing, null and empty items match
    nothing; a null item id is an id like others. Repeated documents are
    reported each, repeated items too. Empty tables give no rows. Columns not
    in ``keep`` are left out, whatever their names.
    """
    items = durable(tests.select(
        F.col(item_col).cast("long").alias("item"), text_of(item_text_col).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("place")))
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-words // (6 * block_words)))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), text_of(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_row"], *[
        T.StructField(c, T.DoubleType() if t == pa.float64() else T.LongType()) for c, t in _FOUND.items()]])
    out = None
    for b in range(blocks):
        # By place, so that repeated items are dealt like others.
        block = items.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).select("item", "text").collect()
        found = rows.mapInArrow(_scan([(r.item, bytes(r.text)) for r in block], seed, threshold), schema)
        if blocks > 1:
            found = durable(found)
        out = found if out is None else out.unionByName(found)
    return out.select("_row.*", *_FOUND)
