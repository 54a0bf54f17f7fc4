"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``depth`` bytes only, by passes of
most significant digits; what stays equal to the end are the repeated windows.

* A window of ``depth`` bytes has one anchor: its ``DIGIT``-byte run with the
  smallest hash. Equal windows have equal anchors at equal places, so it is
  enough to sort the suffixes at anchors, a fourteenth of all.
* First pass, by the anchor's bytes: suffixes alone in their group are unique
  and leave. Groups are split on by all bytes that windows with this anchor
  can have: equal contexts repeat all windows of the anchor, and the one with
  the smallest id keeps them.
* Second pass, for one suffix of each context of a divided group: its windows
  by their whole bytes. Equal groups are the repeated windows.

Digits are told apart by 32 bits on top of the bucket's, which only decide what
is looked at further; contexts and windows, by which text goes, by 96 bits.
Every task first keeps the smallest id of each key it meets, so a passage that
many documents share is few rows by the time it is shuffled. A digit with many
different contexts (a phrase in changing surroundings) is dealt by context: its
rows all go to the second pass, and one mark tells the digit's own bucket so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import durable, text_of

DIGIT = 24
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PIECE = 1 << 18            # bytes of text hashed at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _start(size: int, seed: int) -> np.uint64:
    return np.uint64((size * 1000003 + seed) * int(_M1) % 2**64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,)).astype(np.uint64)


def run_hashes(eights: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes (8 or more) at each position."""
    n = max(0, len(eights) + 8 - size)
    h = np.full(n, _start(size, seed))
    for at in [*range(0, size - 8, 8), size - 8]:
        h = _mix(h ^ eights[at:at + n]) * _M1
    return h


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """Best of each run of ``size`` values, by doubling."""
    have, out = 1, x
    while have * 2 <= size:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[:len(x) - size + 1], out[size - have:]) if have < size else out


def anchors(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each anchor.

    ``hashes`` are those of the digits; a window has ``span`` of them. Of
    equal smallest hashes the last one is the anchor.
    """
    if len(hashes) < span:
        return (np.empty(0, np.int64),) * 3
    low = _sliding(hashes, span, np.minimum)
    windows = np.arange(len(low))
    where = np.flatnonzero(hashes[:len(hashes)] == _reach(low, span, len(hashes)))
    # The last candidate within each window that has the window's minimum.
    at = np.searchsorted(where, windows + span, "left") - 1
    chosen = where[at]
    while True:
        wrong = hashes[chosen] != low
        if not wrong.any():
            break
        at[wrong] -= 1
        chosen = where[at]
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return chosen[first], first, np.r_[first[1:], len(low)] - 1


def _reach(low: np.ndarray, span: int, n: int) -> np.ndarray:
    """For each digit the largest window minimum among the windows that hold it."""
    padded = np.r_[np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)]
    return _sliding(padded, span, np.maximum)[:n]


class _Text:
    """A text's bytes, eight at a time."""

    def __init__(self, data: bytes, depth: int):
        self.depth, self.data = depth, np.frombuffer(data, np.uint8)
        self.eights = _eights(self.data)

    def _at(self, where: np.ndarray, size: int, seed: int) -> np.ndarray:
        h = np.full(len(where), _start(size, seed))
        for k in [*range(0, size - 8, 8), size - 8]:
            h = _mix(h ^ self.eights[where + k]) * _M1
        return h

    def windows(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each position."""
        return self._at(where, self.depth, 2), self._at(where, self.depth, 3)


class Anchored(_Text):
    """Anchors of one text and the hashes of their digits, contexts and windows."""

    def __init__(self, data: bytes, depth: int):
        super().__init__(data, depth)
        span = depth - DIGIT + 1
        digits = run_hashes(self.eights, DIGIT)
        at, first, last = [], [], []
        step = _PIECE
        for begin in range(0, max(0, len(digits) - span + 1), step):
            a, f, e = anchors(digits[begin:begin + step + span - 1], span)
            at.append(a + begin)
            first.append(f + begin)
            last.append(e + begin)
        none = np.empty(0, np.int64)
        self.at, self.first, self.last = (np.concatenate(x) if x else none for x in (at, first, last))
        self.digit = digits[self.at]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes (64 and 32 bits) of all bytes that windows with the anchor can have, cut at the ends."""
        span = self.depth - DIGIT
        size = self.depth + span
        lo = self.at - span
        whole = (lo >= 0) & (lo + size <= len(self.data))
        out, more = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint32)
        out[whole] = self._at(lo[whole], size, 1)
        more[whole] = self._at(lo[whole], size, 4) >> np.uint64(32)
        for k in np.flatnonzero(~whole).tolist():
            a = int(self.at[k])
            piece = self.data[max(0, a - span):a + self.depth].tobytes()
            digest = hashlib.blake2b(piece, digest_size=12, salt=min(a, span).to_bytes(8, "little")).digest()
            out[k], more[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
        return out.view(np.int64), more.view(np.int32)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_KINDS = {"digit": np.int32, "hot": np.int8, "c0": np.int64, "c1": np.int32, "id": np.int64, "tag": np.int32, "low": np.int32, "n": np.int32}
_SCHEMA = "dest int, settled boolean, columns string, data array<binary>"
_PACKED = pa.schema([("dest", pa.int32()), ("settled", pa.bool_()), ("columns", pa.string()), ("data", pa.list_(pa.binary()))])


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, to be dealt by part."""
    shrink = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data = pa.array([shrink(x.as_py()) for x in batch.column("_data")], pa.binary())
        names = ["_id", "_tag", "_part"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), data], names=[*names, "_data"])


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(dest: np.ndarray, settled: bool, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per destination: its columns byte by byte of their width, each compressed by itself."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    starts = _group_starts(dest)
    names, shrink = [c for c in _KINDS if c in columns], zstandard.ZstdCompressor(level=1).compress
    values = [np.ascontiguousarray(columns[c][order], _KINDS[c]) for c in names]
    planes = [v.view(np.uint8).reshape(len(v), v.itemsize).T for v in values]
    data = [[shrink(p[:, a:b].tobytes()) for p in planes]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(dest)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(dest[starts], pa.int32()), pa.array(np.full(len(starts), settled)),
         pa.array([" ".join(names)] * len(starts), pa.string()), pa.array(data, pa.list_(pa.binary()))], schema=_PACKED)


def _flat(table: pa.Table) -> dict[str, np.ndarray]:
    """All values of packed rows; columns that they lack are empty."""
    found: dict[str, list[np.ndarray]] = {c: [np.empty(0, t)] for c, t in _KINDS.items()}
    for names, data in zip(table["columns"].to_pylist(), table["data"]):
        for c, column in zip(names.split(), data.as_py()):
            kind = np.dtype(_KINDS[c])
            planes = np.frombuffer(_expand(column), np.uint8).reshape(kind.itemsize, -1)
            found[c].append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return {c: np.concatenate(v) for c, v in found.items()}


def _part(ids: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    return ((ids % parts) * 31 + tags % parts) % parts


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    changed = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        changed |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, changed]) if len(keys[0]) else np.empty(0, np.int64)


def _smallest(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For rows sorted by (key, id): the smallest id of each row's key."""
    return np.repeat(ids[starts], np.diff(np.r_[starts, len(ids)])) if len(ids) else ids


def _settle(rows: dict[str, np.ndarray], depth: int, parts: int) -> pa.RecordBatch:
    """Windows low..low+n-1 of these rows are repeated: the bytes that go."""
    return _packed(_part(rows["id"], rows["tag"], parts), True, id=rows["id"], tag=rows["tag"],
                   low=rows["low"], n=rows["n"] + depth - 1)


def _first_pass(depth: int, buckets: int, parts: int, flush: int, hot_digit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        held.clear()
        order = np.lexsort((rows["id"], rows["c1"], rows["c0"], rows["whole"]))
        sorted_ids = rows["id"][order]
        least = np.empty_like(sorted_ids)
        least[order] = _smallest(sorted_ids, _group_starts(*(rows[c][order] for c in ("whole", "c0", "c1"))))
        gone = rows["id"] > least
        del order, sorted_ids, least
        yield _settle({c: v[gone] for c, v in rows.items()}, depth, parts)
        rest = {c: v[~gone] for c, v in rows.items()}
        del rows
        whole = rest.pop("whole")
        bucket = (whole % np.uint64(buckets)).astype(np.int64)
        rest["digit"] = (whole >> np.uint64(32)).astype(np.uint32).view(np.int32)
        digits, which, count = np.unique(whole, return_inverse=True, return_counts=True)
        hot = count[which] > hot_digit
        rest["hot"] = hot.astype(np.int8)
        if hot.any():
            bucket[hot] = rest["c0"][hot] % buckets
            marks = digits[count > hot_digit]
            yield _packed((marks % np.uint64(buckets)).astype(np.int64), False, **{
                c: np.zeros(len(marks), t) for c, t in _KINDS.items()} | {
                "hot": np.ones(len(marks), np.int8), "digit": (marks >> np.uint64(32)).astype(np.uint32).view(np.int32)})
        yield _packed(bucket, False, **rest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, tag, data in zip(*(batch.column(c) for c in ("_id", "_tag", "_data"))):
                text = Anchored(data.as_py(), depth)
                if not len(text.at):
                    continue
                n = len(text.at)
                c0, c1 = text.contexts()
                held.append({
                    "whole": text.digit, "c0": c0, "c1": c1, "id": np.full(n, i.as_py()),
                    "tag": np.full(n, tag.as_py(), np.int32), "low": text.first.astype(np.int32),
                    "n": (text.last - text.first + 1).astype(np.int32)})
                size += len(text.data)
                if size > flush:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    return run


def _taken_apart(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows that are settled and only pass through, and the group's own."""
    table = table.select(_PACKED.names)
    settled = table["settled"]
    return table.filter(settled), table.filter(pa.compute.invert(settled))


def _first_groups(depth: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        done, table = _taken_apart(table)
        rows = _flat(table)
        order = np.lexsort((rows["id"], rows["c1"], rows["c0"], rows["digit"]))
        rows = {c: v[order] for c, v in rows.items() if len(v)}
        if not rows:
            return done
        real = rows["n"] > 0            # the others mark hot digits
        marked = np.zeros(len(order), bool)
        if rows["hot"].any():
            marked = np.isin(rows["digit"], rows["digit"][rows["hot"] > 0])
            rows = {c: v[real] for c, v in rows.items()}
            marked = marked[real]
        inner = _group_starts(rows["digit"], rows["c0"], rows["c1"])
        gone = rows["id"] > _smallest(rows["id"], inner)
        outer = _group_starts(rows["digit"])
        if not len(outer):
            return done
        sizes = np.diff(np.r_[outer, len(gone)])
        first = np.repeat(np.minimum.reduceat(rows["id"], outer), sizes)
        last = np.repeat(np.maximum.reduceat(rows["id"], outer), sizes)
        begins = np.zeros(len(gone), np.int64)
        begins[inner] = 1
        contexts = np.repeat(np.add.reduceat(begins, outer), sizes)
        divided = ~gone & (marked | ((contexts > 1) & (first < last)))
        open_ = {c: rows[c][divided] for c in ("id", "tag", "low", "n")}
        return pa.concat_tables([done, pa.Table.from_batches([
            _settle({c: v[gone] for c, v in rows.items()}, depth, parts),
            _packed(_part(open_["id"], open_["tag"], parts), False, **open_)])])

    return run


def _by_document(rows: dict[str, np.ndarray]) -> dict[tuple[int, int], slice]:
    starts = _group_starts(rows["id"], rows["tag"])
    ends = np.r_[starts[1:], len(rows["id"])].astype(np.int64)
    return {(int(rows["id"][s]), int(rows["tag"][s])): slice(int(s), int(e)) for s, e in zip(starts, ends)}


def _sorted_ranges(table: pa.Table, settled: bool) -> dict[str, np.ndarray]:
    rows = _flat(table.filter(pa.compute.equal(table["settled"], settled)))
    rows = {c: rows[c] for c in ("id", "tag", "low", "n")}
    order = np.lexsort((rows["low"], rows["tag"], rows["id"]))
    return {c: v[order] for c, v in rows.items()}


def _second_pass(depth: int, buckets: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Windows of the divided groups that nothing has settled yet, by their bytes."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        settled, open_ = _sorted_ranges(marks, True), _sorted_ranges(marks, False)
        done, todo = _by_document(settled), _by_document(open_)
        held = []
        for i, tag, data in zip(*(docs[c] for c in ("_id", "_tag", "_data"))):
            key = (i.as_py(), tag.as_py())
            if key not in todo:
                continue
            rows = todo.pop(key)            # equal rows of an id have equal windows
            low, n = open_["low"][rows].astype(np.int64), open_["n"][rows].astype(np.int64)
            where = np.unique(np.repeat(low, n) + _ramp(n))
            if key in done:
                lows, highs = _merged(settled["low"][done[key]].astype(np.int64),
                                      (settled["low"][done[key]] + settled["n"][done[key]]).astype(np.int64))
                at = np.searchsorted(lows, where, "right") - 1
                where = where[(at < 0) | (where + depth > highs[at])]
            h0, h1 = _Text(_expand(data.as_py()), depth).windows(where)
            held.append({"c0": h0.view(np.int64), "c1": (h1 >> np.uint64(32)).astype(np.uint32).view(np.int32), "id": np.full(len(where), key[0]),
                         "tag": np.full(len(where), key[1], np.int32), "low": where.astype(np.int32)})
        if not held:
            return pa.Table.from_batches([_packed(np.empty(0, np.int64), True)])
        rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        order = np.lexsort((rows["id"], rows["c1"], rows["c0"]))
        sorted_ids = rows["id"][order]
        least = np.empty_like(sorted_ids)
        least[order] = _smallest(sorted_ids, _group_starts(rows["c0"][order], rows["c1"][order]))
        gone = rows["id"] > least
        rest = {c: v[~gone] for c, v in rows.items()}
        rows["n"] = np.ones(len(gone), np.int32)
        return pa.Table.from_batches([
            _settle({c: v[gone] for c, v in rows.items()}, depth, parts),
            _packed(rest["c0"] % buckets, False, **rest)])

    return run


def _second_groups(depth: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        done, table = _taken_apart(table)
        rows = _flat(table)
        order = np.lexsort((rows["id"], rows["c1"], rows["c0"]))
        rows = {c: v[order] for c, v in rows.items() if c in ("c0", "c1", "id", "tag", "low")}
        gone = rows["id"] > _smallest(rows["id"], _group_starts(rows["c0"], rows["c1"]))
        rows["n"] = np.ones(len(gone), np.int32)
        return pa.concat_tables([done, pa.Table.from_batches([_settle({c: v[gone] for c, v in rows.items()}, depth, parts)])])

    return run


def _finish(names: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        settled = _sorted_ranges(marks, True)
        done, out = _by_document(settled), []
        for i, tag, data in zip(*(docs[c] for c in ("_id", "_tag", "_data"))):
            text, rows = _expand(data.as_py()), done.get((i.as_py(), tag.as_py()))
            low = high = np.empty(0, np.int64)
            if rows is not None:
                low, high = _merged(settled["low"][rows].astype(np.int64), (settled["low"][rows] + settled["n"][rows]).astype(np.int64))
            kept = b"".join(text[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(text)]))
            out.append((i.as_py(), len(text), len(text) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) if out else [[]] * 6
        fields = [(k, f) for k, f in enumerate(_FINAL) if f.name in names]
        return pa.Table.from_arrays([pa.array(columns[k], f.type) for k, f in fields], schema=pa.schema([f for _, f in fields]))

    return run


_FINAL = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges [low, high), given in any order."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    start = np.flatnonzero(np.r_[True, low[1:] > high[:-1]]) if len(low) else np.empty(0, np.int64)
    return low[start], high[np.r_[start[1:], len(low)] - 1] if len(low) else high


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50,
    part_bytes: int = 16 << 20, with_text: bool = False, hot_digit: int = 256,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, ``kept`` too if wanted.

    A byte goes if a string of ``depth`` bytes over it also starts in a row
    with a smaller id. Texts are UTF-8, null is empty, strings do not cross
    rows and are judged on the input. ``n_spans`` counts maximal removed runs.

    Rows of equal ids take nothing from each other. A row without id takes
    nothing away and loses nothing. Texts shorter than ``depth`` stay. An
    empty table gives no rows; other columns are left out. Documents are dealt
    in parts of about ``part_bytes``, so tasks hold a part each, whatever the
    size of the table. A digit with more than ``hot_digit`` contexts in a part
    is dealt by context. ``depth`` is at least twice ``DIGIT``.
    """
    text = text_of(text_col)
    sizes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-sizes // part_bytes))
    data = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_tag"),
        text.cast("binary").alias("_data"))
    placed = data.withColumn("_part", F.pmod(
        F.pmod("_id", F.lit(parts)) * 31 + F.pmod("_tag", F.lit(parts)), F.lit(parts)).cast("int")).select(
        "_id", "_tag", "_part", "_data").mapInArrow(_compressed, "_id long, _tag int, _part int, _data binary")
    long_enough = data.where(F.length("_data") >= depth)
    first = long_enough.mapInArrow(_first_pass(depth, parts, parts, part_bytes, hot_digit), _SCHEMA)
    # Groups and documents are dealt over the same numbers, so what a pass has
    # settled goes along with its groups and no pass is read twice.
    marks = durable(first.groupBy("dest").applyInArrow(_first_groups(depth, parts), _SCHEMA))
    second = placed.groupBy("_part").cogroup(marks.groupBy("dest")).applyInArrow(
        _second_pass(depth, parts, parts), _SCHEMA)
    settled = marks.where("settled").unionByName(
        second.groupBy("dest").applyInArrow(_second_groups(depth, parts), _SCHEMA))
    names = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    if with_text:
        names["kept"] = "binary"
    out = placed.groupBy("_part").cogroup(settled.groupBy("dest")).applyInArrow(
        _finish(["_id", *names]),
        "_id long, " + ", ".join(f"{c} {t}" for c, t in names.items()))
    alone = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"), text.cast("binary").alias("kept"))
    every = out.unionByName(alone.select(*out.columns))
    if with_text:
        every = every.withColumn("kept", F.col("kept").cast("string"))
    return every.withColumnRenamed("_id", id_col)
