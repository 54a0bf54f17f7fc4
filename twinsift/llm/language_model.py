"""Language-model scores from an Elias-Fano n-gram trie.

Documents are dealt in parts. Each part counts its n-grams and sends one row
of counts per bucket of n-grams; the buckets add up and answer with the counts
in the whole corpus. With its share of the model, a part builds a trie:
sorted levels whose successors and pointers are monotone and Elias-Fano coded,
with quantised log-probabilities, in one memory-mapped file. Words of the
third level are numbered by their place among the successors of the context's
last word, and looked up by successor search below their context.

Probabilities are hierarchical Dirichlet estimates: the count of an n-gram,
plus ``mu`` times the probability by the shorter context, over the context's
count plus ``mu``. They sum to one whatever is unseen.
"""

from __future__ import annotations

import tempfile
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, text_of

ORDER = 3
_END = xxhash.xxh64_intdigest(b"\n")        # no word has a line break in it
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sorted_order(keys: np.ndarray, universe: int) -> np.ndarray:
    """Like argsort of numbers below ``universe``, by one sort of keys that carry their places."""
    bits = len(keys).bit_length()
    spare = max(0, bits + (universe - 1).bit_length() - 64)
    packed = (keys.astype(np.uint64) >> np.uint64(spare)) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    if spare:
        there = keys[order]
        if (there[1:] < there[:-1]).any():          # some differ in the bits that gave way only
            order = order[np.argsort(there, kind="stable")]
    return order


# -- Elias-Fano --------------------------------------------------------------


class EliasFano:
    """A sorted sequence of distinct numbers: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.shift = max(0, (universe // max(1, self.n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = values & np.uint64((1 << self.shift) - 1)
        bits = np.unpackbits(low.view(np.uint8).reshape(-1, 8), axis=1, count=self.shift, bitorder="little")
        self.low = np.r_[np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)]
        high = (values >> np.uint64(self.shift)).astype(np.int64)
        self.last = int(high[-1]) if self.n else 0
        unary = np.zeros(self.n + self.last + 65, np.uint8)
        unary[high + np.arange(self.n)] = 1
        unary = unary[:len(unary) // 64 * 64]
        self.high = np.packbits(unary, bitorder="little").view(np.uint64)
        self.zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))].astype(np.uint32)
        # The word that holds every 32nd zero, and beyond the last one.
        self.hints = np.r_[np.searchsorted(self.zeros, np.arange(0, int(self.zeros[-1]), 32), "right") - 1, len(self.high) - 1]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros, "hints": self.hints}

    def _word(self, asked: np.ndarray) -> np.ndarray:
        """The word that holds each of these zeros."""
        lo, hi = self.hints[asked >> 5], self.hints[(asked >> 5) + 1]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            middle = (lo[open_] + hi[open_] + 1) // 2
            before = self.zeros[middle] <= asked[open_]
            lo[open_[before]] = middle[before]
            hi[open_[~before]] = middle[~before] - 1

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits of at most ``high`` (-1: none)."""
        asked = np.clip(high, 0, self.last)
        word = self._word(asked)
        rest = asked - self.zeros[word].astype(np.int64)      # which zero of the word, from 0
        flipped, at = ~self.high[word], np.zeros(len(asked), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << width) - 1)
            here = np.bitwise_count((flipped >> at.astype(np.uint64)) & mask).astype(np.int64)
            over = rest >= here
            rest -= np.where(over, here, 0)
            at += np.where(over, width, 0)
        return np.where(high < 0, 0, word * 64 + at - asked)

    def _run_end(self, begin: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``begin`` plus the ones that follow there: as ``_upto(high)``, mostly from one word."""
        at = np.minimum(begin + np.maximum(high, 0), len(self.high) * 64 - 1)
        zeros = ~self.high[at >> 6] >> (at & 63).astype(np.uint64)
        ones = np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end = begin + ones
        further = np.flatnonzero(zeros == 0)
        end[further] = self._upto(high[further])
        return end

    def _low_at(self, index: np.ndarray) -> np.ndarray:
        bit = index * self.shift
        eights = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))
        return (eights[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.shift) - 1)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= key among those with its high bits, whether it is the key)."""
        keys = keys.astype(np.uint64)
        high = (keys >> np.uint64(self.shift)).astype(np.int64)
        low = keys & np.uint64((1 << self.shift) - 1)
        beyond = high > self.last
        lo = self._upto(high - 1)
        end = self._run_end(lo, high)
        lo, end = np.where(beyond, self.n, lo), np.where(beyond, self.n, end)
        hi = end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            less = self._low_at(middle) < low[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        found = lo < end
        at = np.flatnonzero(found)
        found[at] = self._low_at(lo[at]) == low[at]
        return lo, found


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, means of the bins): bins of equal width over the values."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1)
    low, high = float(values.min()), float(values.max())
    codes = np.minimum((values - low) * (levels / max(high - low, 1e-12)), levels - 1).astype(np.uint8)
    sums, counts = np.bincount(codes, values, levels), np.bincount(codes, minlength=levels)
    return codes, np.where(counts > 0, sums / np.maximum(counts, 1), 0.0)


class Trie:
    """Three levels of n-grams with their counts: what a part of the documents asks for."""

    def __init__(self, words: np.ndarray, pairs: tuple, triples: tuple, total: int, types: int, mu: Sequence[float]):
        """``words``: count of each word id; ``pairs``: (u, w, count), sorted.

        ``triples``: (index of the pair (u, v), index of (v, w), count).
        Counts are above 0. A triple without its pairs (index -1), which a
        digest that two n-grams share can leave, is passed over.
        """
        self.size, self.mu = len(words), mu
        unigram = np.log10((words + 1) / (total + types + 1))
        u, w, n = pairs
        p1 = 10.0 ** unigram
        p2 = (n + mu[0] * p1[w]) / (words[u] + mu[0])
        self.second = EliasFano(u * self.size + w, max(1, self.size) ** 2)
        begins = np.searchsorted(u, np.arange(self.size + 1))
        self.widest = int(np.diff(begins).max(initial=0)) or 1
        first, after, m = triples
        there = (first >= 0) & (after >= 0)
        first, after, m = first[there], after[there], m[there]
        place = first * self.widest + after - begins[w[first]]        # relative to the context's successors
        order = sorted_order(place, max(1, len(u) * self.widest))
        place, first, after, m = place[order], first[order], after[order], m[order]
        p3 = (m + mu[1] * p2[after]) / (n[first] + mu[1])
        self.third = EliasFano(place, max(1, len(u) * self.widest))
        self.pointers = EliasFano(begins + np.arange(self.size + 1), len(u) + self.size + 2)
        self.books, codes = [], []
        for values in (unigram, np.log10(p2), np.log10(p3), np.log10(mu[0] / (words + mu[0])), np.log10(mu[1] / (n + mu[1]))):
            code, book = quantise(values)
            codes.append(code)
            self.books.append(book)
        self._map({"p1": codes[0], "p2": codes[1], "p3": codes[2], "b1": codes[3], "b2": codes[4]})

    def _map(self, codes: dict[str, np.ndarray]) -> None:
        """Write all levels into one unnamed file and read them by mapping it."""
        parts = {(None, k): v for k, v in codes.items()}
        for name in ("second", "third", "pointers"):
            parts |= {(name, k): v for k, v in getattr(self, name).arrays().items()}
        with tempfile.TemporaryFile() as file:
            places = {}
            for key, values in parts.items():
                file.write(b"\0" * (-file.tell() % 8))
                places[key] = (file.tell(), values.dtype, len(values))
                file.write(np.ascontiguousarray(values).tobytes())
            file.write(b"\0" * 8)
            file.flush()
            self.file = np.memmap(file, np.uint8, "r")
        for (name, key), (at, kind, n) in places.items():
            values = np.frombuffer(self.file, kind, n, at)
            setattr(self if name is None else getattr(self, name), key, values)

    def scores(self, grams: "PartGrams") -> np.ndarray:
        """log10 probability of each token. Every n-gram of the part is asked for once."""
        tokens, place = grams.tokens, grams.place
        one = self.books[0][self.p1[tokens]]
        u = np.r_[0, tokens[:-1]]
        two = one + np.where(place > 0, self.books[3][self.b1[u]], 0.0)
        where = grams.levels[1][3]
        at, seen = self.second.successor(u[where] * self.size + tokens[where])
        at, seen = grams.spread(1, at), grams.spread(1, seen)
        two[seen] = self.books[1][self.p2[at[seen]]]
        # Below the context (u, v): its index, and the token's place among v's successors.
        context, known = np.r_[0, at[:-1]], np.r_[False, seen[:-1]] & (place > 1)
        three = two.copy()
        three[known] += self.books[4][self.b2[context[known]]]
        where = grams.levels[2][3]
        asked = np.flatnonzero(known[where] & seen[where])
        where = where[asked]
        begins = self._begin(np.arange(self.size))
        found, hits = self.third.successor(context[where] * self.widest + at[where] - begins[u[where]])
        values = np.full(len(grams.levels[2][0]), np.nan)
        values[asked[hits]] = self.books[2][self.p3[found[hits]]]
        values = grams.spread(2, values)
        hit = ~np.isnan(values) & (place > 1)
        three[hit] = values[hit]
        return three

    def _begin(self, words: np.ndarray) -> np.ndarray:
        """Where the successors of words begin: the pointer's value, read from its code."""
        # The k-th value has its high bits as the k-th one of the unary code.
        ones = np.arange(len(self.pointers.high)) * 64 - self.pointers.zeros[:-1].astype(np.int64)
        word = np.searchsorted(ones, words, "right") - 1
        rest, at = words - ones[word], np.zeros(len(words), np.int64)
        bits = self.pointers.high[word]
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            over = rest >= here
            rest -= np.where(over, here, 0)
            at += np.where(over, width, 0)
        high = word * 64 + at - words
        return (high << self.pointers.shift) + self.pointers._low_at(words).astype(np.int64) - words


# -- n-grams of a part -------------------------------------------------------


class PartGrams:
    """Tokens of a part's documents and its distinct n-grams, in an order that depends on them alone.

    ``levels`` has per length: keys in order, the bucket's bounds among them,
    how often each is learnt from, one place of each, and at each place the
    number of the n-gram that ends there.
    """

    def __init__(self, docs: pa.Table, buckets: int):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        flat, self.lengths = array("q"), []
        expand = zstandard.ZstdDecompressor().decompress
        for data in docs["_data"]:
            words = expand(data.as_py()).lower().split()
            flat.extend(map(numbers.__getitem__, words))
            flat.append(-1)
            self.lengths.append(len(words) + 1)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        keys = np.r_[keys, np.uint64(_END)]
        tokens = np.frombuffer(flat, np.int64).copy()
        tokens[tokens < 0] = len(numbers)
        lengths = np.array(self.lengths, np.int64)
        self.place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        learnt = ~np.repeat(docs["_held"].to_numpy(zero_copy_only=False).astype(bool), lengths)
        order = sorted_order(keys, 1 << 64)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.tokens, self.keys = back[tokens], keys[order]
        where = np.zeros(len(self.keys), np.int64)
        where[self.tokens] = np.arange(len(tokens))
        counts = np.bincount(self.tokens, learnt, len(self.keys)).astype(np.int32)
        self.levels = [(self.keys, _bounds(self.keys, buckets), counts, where, self.tokens)]
        mine = self.keys[self.tokens]
        grams = mine
        for level in range(2, ORDER + 1):
            x = (np.r_[np.uint64(0), grams[:-1]] ^ np.uint64(level * int(_B) % 2**64)) * _A
            grams = ((x ^ (x >> np.uint64(29))) * _B + mine) * _A
            grams ^= grams >> np.uint64(32)
            there = np.flatnonzero(self.place >= level - 1)
            there = there[sorted_order(grams[there], 1 << 64)]
            ordered = grams[there]
            new = np.ones(len(there), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(learnt[there], starts, dtype=np.int32) if len(starts) else np.empty(0, np.int32)
            number = np.zeros(len(tokens), np.int64)
            number[there] = np.cumsum(new) - 1
            self.levels.append((ordered[starts], _bounds(ordered[starts], buckets), counts, there[starts], number))

    def spread(self, level: int, values: np.ndarray) -> np.ndarray:
        """Values of the distinct n-grams at every place; where none ends, zero."""
        out = np.zeros(len(self.tokens), values.dtype)
        there = self.place >= level
        out[there] = values[self.levels[level][4][there]]
        return out


def _bucket_starts(buckets: int) -> np.ndarray:
    """First key of each bucket: buckets are equal ranges of keys."""
    return np.arange(buckets, dtype=np.uint64) * np.uint64(-(-2**64 // buckets) % 2**64)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.r_[np.searchsorted(keys, _bucket_starts(buckets)), len(keys)]


_COUNTS = "dest int, part int, level int, keys binary, n binary"
_ANSWER = "dest int, part int, level int, c binary, total bigint, types bigint"


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are dealt twice, as a whole."""
    shrink = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data = pa.array([shrink(x.as_py()) for x in batch.column("_data")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_held", "_part")), data], names=["_id", "_held", "_part", "_data"])


def _packer() -> Callable[[np.ndarray], bytes]:
    """Numbers as one compressed string, byte by byte of their width: most are small."""
    shrink = zstandard.ZstdCompressor(level=1).compress

    def pack(values: np.ndarray) -> bytes:
        return shrink(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())

    return pack


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_counts(pack: Callable[[np.ndarray], bytes], counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one of them needs that; the first byte says which."""
    kind = np.int32 if not len(counts) or counts.max() < 2**31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + pack(counts.astype(kind, copy=False))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data[1:], np.int64 if data[0] == 8 else np.int32)


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _count(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(docs: pa.Table) -> pa.Table:
        part, out, pack, first = docs["_part"][0].as_py(), [], _packer(), _bucket_starts(buckets)
        spare = np.uint64(max(0, (-(-2**64 // buckets) - 1).bit_length() - 32))
        for level, (keys, bounds, counts, _, _) in enumerate(PartGrams(docs, buckets).levels, 1):
            for k in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                a, b = bounds[k], bounds[k + 1]
                # The bucket and 32 bits after it tell longer n-grams apart; words take all 64.
                sent = keys[a:b] if level == 1 else ((keys[a:b] - first[k]) >> spare).astype(np.uint32)
                out.append((k, part, level, pack(_gaps(sent)), pack(counts[a:b])))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["dest", "part", "level", "keys", "n"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of a bucket over all parts, answered to each in its own order."""
    dest, pack, parts, levels, answers, totals, types = table["dest"][0].as_py(), _packer(), [], [], [], [], []
    for level in range(1, ORDER + 1):
        rows = table.filter(pa.compute.equal(table["level"], level))
        if not rows.num_rows:
            continue
        kind = np.uint64 if level == 1 else np.uint32
        keys = [np.cumsum(_unpack(k.as_py(), kind), dtype=kind) for k in rows["keys"]]
        n = np.concatenate([_unpack(x.as_py(), np.int32) for x in rows["n"]]).astype(np.int64)
        every = np.concatenate(keys)
        order = sorted_order(every, 1 << (64 if level == 1 else 32))
        every = every[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        sums = np.add.reduceat(n[order], starts)
        found = np.empty(len(every), np.int32 if not len(sums) or sums.max() < 2**31 else np.int64)
        found[order] = np.repeat(sums, np.diff(np.r_[starts, len(every)]))
        parts += [*rows["part"].to_pylist(), -1]
        levels += [level] * (rows.num_rows + 1)
        each = np.split(found, np.cumsum([len(k) for k in keys])[:-1])
        answers += [*(_pack_counts(pack, c) for c in each), b""]
        totals += [None] * rows.num_rows + [int(sums.sum())]
        types += [None] * rows.num_rows + [int((sums > 0).sum())]
    return pa.Table.from_arrays(
        [pa.array([dest] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array(levels, pa.int32()),
         pa.array(answers, pa.binary()), pa.array(totals, pa.int64()), pa.array(types, pa.int64())],
        names=["dest", "part", "level", "c", "total", "types"])


_SCORED = "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(buckets: int, total: int, types: int, mu: Sequence[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], pa.schema(_SCORED_ARROW))
        grams = PartGrams(docs, buckets)
        counts = []
        for level in range(1, ORDER + 1):
            rows = answers.filter(pa.compute.equal(answers["level"], level)).sort_by("dest")
            counts.append(np.concatenate([np.empty(0, np.int32), *[_unpack_counts(c.as_py()) for c in rows["c"]]]).astype(np.int64))
        # Pairs by their words, triples by the numbers of their pairs.
        t, words = grams.tokens, counts[0]
        seen = [np.flatnonzero(c > 0) for c in counts]
        at2, at3 = grams.levels[1][3][seen[1]], grams.levels[2][3][seen[2]]
        keys = t[at2 - 1] * len(words) + t[at2]
        order = sorted_order(keys, max(1, len(words)) ** 2)
        at2, pair_counts = at2[order], counts[1][seen[1]][order]
        rank = np.full(len(counts[1]), -1)
        rank[seen[1][order]] = np.arange(len(order))
        pair = rank[grams.levels[1][4]] if len(rank) else np.full(len(t), -1)
        trie = Trie(words, (t[at2 - 1], t[at2], pair_counts), (pair[at3 - 1], pair[at3], counts[2][seen[2]]), total, types, mu)
        starts = np.r_[0, np.cumsum(grams.lengths)[:-1]].astype(np.int64)
        c = words[t]
        base = np.add.reduceat(np.log10((c + 1) / (total + types + 1)), starts)
        score = np.add.reduceat(trie.scores(grams), starts)
        return pa.Table.from_arrays(
            [docs["_id"], docs["_held"], pa.array(np.array(grams.lengths, np.int64)),
             pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(base), pa.array(score)],
            schema=pa.schema(_SCORED_ARROW))

    return run


_SCORED_ARROW = [("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                 ("base_score", pa.float64()), ("score", pa.float64())]


def score_texts(
    docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text",
    mu: Sequence[float] = (200.0, 50.0), part_bytes: int = 8 << 20,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that ``held_out`` (a condition on the id;
    null: learnt from) does not take. Words are ASCII-lower-cased, each text
    ends with an end token. ``base_score`` is the add-one unigram score,
    ``score`` the trigram model's log10 probability.

    Counts cover the whole table; nothing is pruned. Words are told apart by
    64 bits, longer n-grams by 32 bits within a bucket, so one in some
    thousands of unseen ones takes the count of another.

    Null and empty texts are an end token. Null ids are ordinary rows, repeated
    rows are counted and scored each. An empty table gives no rows; other
    columns are left out. A task holds a part of about ``part_bytes`` of text
    or a bucket, and the number of both grows with the table; a common n-gram
    is one entry per part.
    """
    text = text_of(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("_held"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(parts)).cast("int").alias("_part"), text.cast("binary").alias("_data")).mapInArrow(_compressed, "_id long, _held boolean, _part int, _data binary")
    counts = rows.groupBy("_part").applyInArrow(_count(parts), _COUNTS)
    answers = durable(counts.groupBy("dest").applyInArrow(_add_up, _ANSWER))
    sums = answers.where("part = -1 AND level = 1").agg(F.sum("total").alias("n"), F.sum("types").alias("v")).first()
    total, types = sums.n or 0, sums.v or 0
    scored = rows.groupBy("_part").cogroup(answers.where("part >= 0").groupBy("part")).applyInArrow(
        _score(parts, total, types, tuple(mu)), _SCORED)
    return scored.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
