"""Alignment of two tokenizers by pointer jumping.

Both cut the same bytes into tokens. Every token points to the token that
overlaps it and reaches farthest to the right; following two pointers at once,
for all tokens of many texts together, ends at the last token of a group. A
group is what stands between two places where tokens of both sides end.

A task encodes texts part by part and counts, for each pair of linked ids, the
texts of the part that have it. These counts are added up by pair, and each
part gets back the totals of its own pairs: one row per part and pair, never
one per text and pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import new_folder, text_of

_CHUNK = 2 << 20            # bytes of text aligned at once
_WIDE = 256                 # groups with more links are counted by distinct ids
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
# Fixed value: how the byte-level vocabulary cuts a text before merging.
_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ids of a text, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode, self.entries = encode, entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        names = [str(i) for i in range(len(entries))]
        self.inner = np.array([f"{x}," for x in names], object)
        self.end_a = np.array([f"{x}|" for x in names], object)
        self.end_b = np.array([f"{x};" for x in names], object)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE from its JSON file, special tokens being plain text."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # Printable characters stand for themselves, the other bytes for characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    size = 1 + max(model["vocab"].values())
    entries, ranks = [b""] * size, {}
    for piece, i in model["vocab"].items():
        if all(c in byte_of for c in piece):
            entries[i] = bytes(byte_of[c] for c in piece)
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    single = {c: model["vocab"][c] for c in byte_of if c in model["vocab"]}
    ids = [model["vocab"][m] for m in made]
    if len(single) == 256 and ids == sorted(ids) and max(single.values()) < ids[0]:
        # Ids ascend in the order of the merges, so they are ranks.
        ranks = {entries[i]: i for i in [*single.values(), *ids]}
        tool = tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary(lambda texts: [tool.encode_ordinary(t) for t in texts], entries)
    slow = tokenizers.Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return Vocabulary(lambda texts: [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)], entries)


@lru_cache(maxsize=2)
def pieces(path: str) -> Vocabulary:
    """A sentence-piece model; it puts a space before the text itself."""
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(tool.get_piece_size()):
        piece = tool.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if tool.is_byte(i) else piece.replace("▁", " ").encode())
    return Vocabulary(lambda texts: tool.encode(texts, num_threads=1), entries)


def farthest(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token of A, then of B, the last token of its group, by pointer doubling.

    ``ends`` are the byte offsets after each token; both end at the same byte.
    """
    n = len(ends_a)
    after = np.searchsorted(ends_a, ends_b, "left")
    own = n + np.arange(len(ends_b))
    points = np.r_[n + np.searchsorted(ends_b, ends_a, "left"), np.where(ends_a[after] > ends_b, after, own)]
    while True:
        jumped = points[points]
        if np.array_equal(jumped, points):
            return points
        points = jumped


def _ramp(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights


class Aligned:
    """Groups of some texts and their links; ``rows`` tells the texts of the tokens apart."""

    def __init__(self, a: Vocabulary, b: Vocabulary, ids_a: list[list[int]], ids_b: list[list[int]]):
        self.va, self.vb = a, b
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat = lambda ids: np.fromiter((i for x in ids for i in x), np.int64)
        self.a, self.b = flat(ids_a), flat(ids_b)
        last = farthest(np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])) - len(self.a)
        ends = np.zeros(len(self.b), bool)
        ends[last] = True
        group = np.cumsum(ends) - 1
        self.group_a, self.group_b = group[last[:len(self.a)]], group[last[len(self.a):]]
        count = int(ends.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=count), np.bincount(self.group_b, minlength=count)
        self.row = np.repeat(np.arange(len(ids_b)), self.n_b)[ends]
        self.n_groups = np.bincount(self.row, minlength=len(ids_b))
        self.n_links = np.zeros(len(ids_b), np.int64)
        np.add.at(self.n_links, self.row, self.in_a * self.in_b)

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text, empty without tokens."""
        out = np.empty(len(self.a) + len(self.b), object)
        last_a = np.r_[self.group_a[1:] != self.group_a[:-1], True][:len(self.a)]
        last_b = np.r_[self.group_b[1:] != self.group_b[:-1], True][:len(self.b)]
        before_b = np.cumsum(self.in_b) - self.in_b
        upto_a = np.cumsum(self.in_a)
        out[np.arange(len(self.a)) + before_b[self.group_a]] = np.where(last_a, self.va.end_a[self.a], self.va.inner[self.a])
        out[np.arange(len(self.b)) + upto_a[self.group_b]] = np.where(last_b, self.vb.end_b[self.b], self.vb.inner[self.b])
        cuts = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return ["".join(out[x:y].tolist())[:-1] for x, y in zip(cuts, cuts[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, links) of the different pairs of each text, sorted; pair is A's id times B's number of ids plus B's id."""
        ids_b = len(self.vb.entries)
        span = len(self.va.entries) * ids_b
        links = self.in_a * self.in_b
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        few = np.flatnonzero(links <= _WIDE)
        group = np.repeat(few, links[few])
        at = _ramp(links[few])
        width = self.in_b[group]
        keys = [self.row[group] * span + self.a[first_a[group] + at // width] * ids_b + self.b[first_b[group] + at % width]]
        weights = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > _WIDE).tolist():
            x, nx = np.unique(self.a[first_a[g]:first_a[g] + self.in_a[g]], return_counts=True)
            y, ny = np.unique(self.b[first_b[g]:first_b[g] + self.in_b[g]], return_counts=True)
            keys.append((self.row[g] * span + x[:, None] * ids_b + y).ravel())
            weights.append((nx[:, None] * ny).ravel())
        key, weight = _summed(np.concatenate(keys), np.concatenate(weights))
        return key // span, key % span, weight


def _packed(*arrays: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, compressed."""
    planes = [np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(data: bytes, count: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(count, 4, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.uint32)[:, :, 0].astype(np.int64)


class _Part:
    """Texts of a part: their counts, and their pairs until the part is full."""

    def __init__(self) -> None:
        self.rows: list[pa.Array] = []
        self.size = self.texts = 0
        self.counts: list[np.ndarray] = []
        self.sums: list[str] = []
        self.groups: list[str] = []
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: pa.Array, texts: list[str | None], a: Vocabulary, b: Vocabulary, with_groups: bool) -> None:
        given = [t or "" for t in texts]
        ids_a, ids_b = a.encode([" " + t for t in given]), b.encode(given)
        for k, t in enumerate(given):
            raw = (" " + t).encode()
            if not t or b"".join(map(a.entries.__getitem__, ids_a[k])) != raw or b"".join(map(b.entries.__getitem__, ids_b[k])) != raw:
                ids_a[k], ids_b[k] = [], []
        done = Aligned(a, b, ids_a, ids_b)
        groups = done.texts()
        self.rows.append(rows)
        self.counts.append(np.stack([getattr(done, c) for c in _COUNTS]))
        self.sums += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.groups += groups if with_groups else []
        row, pair, links = done.pairs()
        self.found.append((row + self.texts, pair, links))
        self.texts += len(texts)
        self.size += sum(map(len, given))

    def record(self, part: int, schema: pa.Schema) -> pa.RecordBatch:
        row, pair, links = (np.concatenate(x) for x in zip(*self.found))
        pairs, at = np.unique(pair, return_inverse=True)
        counts = np.concatenate(self.counts, axis=1)
        step = np.r_[at[:1], np.diff(at)] % 2**32       # ascending within a text, so mostly small
        values = [part, pa.concat_arrays(self.rows), *counts, self.sums, np.bincount(row, minlength=self.texts),
                  _packed(step, links), pairs, np.bincount(at, minlength=len(pairs)), self.groups]
        arrays = []
        for field, value in zip(schema, values):
            if pa.types.is_list(field.type):
                flat = pa.array(value, field.type.value_type) if not isinstance(value, pa.Array) else value
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat, type=field.type))
            else:
                arrays.append(pa.array([value], field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _encode(a_path: str, b_path: str, part_bytes: int, with_groups: bool, columns: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        number, held = TaskContext.get().partitionId() << 32, _Part()
        for batch in batches:
            rows = batch.column("_row")
            long_, text = pa.list_(pa.int64()), pa.list_(pa.string())
            kinds = [pa.int64(), pa.list_(rows.type), *[long_] * len(_COUNTS), text, long_, pa.binary(), long_, long_, text]
            schema = pa.schema(list(zip(columns, kinds)))
            texts = batch.column("_text").cast(pa.large_binary())
            begin = size = 0
            for k in range(batch.num_rows):
                size += len(texts[k].as_buffer() or b"")
                if size < _CHUNK and k + 1 < batch.num_rows:
                    continue
                chunk = [(x.as_py() or b"").decode("utf-8", "replace") for x in texts[begin:k + 1]]
                held.add(rows[begin:k + 1], chunk, a, b, with_groups)
                begin, size = k + 1, 0
                if held.size >= part_bytes:
                    yield held.record(number, schema)
                    number, held = number + 1, _Part()
        if held.texts:
            yield held.record(number, schema)

    return run


def _finish(with_groups: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        pair = answers["pair"].to_numpy()
        order = np.argsort(pair, kind="stable")
        count, best = answers["n"].to_numpy()[order], answers["best"].to_numpy()[order].astype(np.int64)
        flat = lambda c: parts[c].combine_chunks().flatten()
        sizes = flat("n_pairs").to_numpy()
        step, links = _unpacked(parts["packed"][0].as_py(), 2)
        at = np.cumsum(step) % 2**32
        row = np.repeat(np.arange(len(sizes)), sizes)
        totals = []
        for value in (best, count):
            out = np.zeros(len(sizes), np.int64)
            np.add.at(out, row, value[at] * links)
            totals.append(pa.array(out))
        columns = {"_row": flat("rows"), **{c: flat(c) for c in _COUNTS}, "n_best": totals[0], "count_sum": totals[1],
                   "groups_sha256": flat("sums")}
        if with_groups:
            columns["groups"] = flat("groups")
        return pa.table(columns)

    return run


def align(
    docs: DataFrame, a_path: str, b_path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
    part_bytes: int = 16 << 20, with_groups: bool = False,
) -> DataFrame:
    """The ``keep`` columns of every row, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A is the byte-level BPE at ``a_path`` over a space and the text, B the
    sentence-piece model at ``b_path`` over the text, before which it puts
    the space itself. Every token of A is linked with all tokens of B of its
    group. A pair of ids counts the rows that have it linked; ``n_best`` counts
    links with a pair that no other pair of the same A id exceeds, ``count_sum``
    adds up the counts over the links. ``groups`` (``with_groups``) spells the
    groups out as ``a1,a2|b1;a3|b2``, ``groups_sha256`` is its hex digest.

    Null and empty texts, and texts whose tokens do not spell them, have no
    tokens: zeros and empty strings. Repeated rows count each. An empty table
    gives no rows. Columns not in ``keep`` are left out. A task holds
    ``part_bytes`` of text, or one text that is longer.
    """
    spark = docs.sparkSession
    given = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), text_of(text_col).alias("_text"))
    row = given.schema["_row"].dataType
    longs, texts = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    kinds = {"part": T.LongType(), "rows": T.ArrayType(row), **{c: longs for c in _COUNTS}, "sums": texts,
             "n_pairs": longs, "packed": T.BinaryType(), "pairs": longs, "docs": longs, "groups": texts}
    folder = new_folder(spark, "alignment")
    given.mapInArrow(
        _encode(a_path, b_path, part_bytes, with_groups, list(kinds)), T.StructType([T.StructField(c, k) for c, k in kinds.items()]),
    ).write.option("compression", "zstd").parquet(folder)
    parts = spark.read.parquet(folder)
    pairs = spark.read.parquet(folder).select("part", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(
        "part", "x.pairs", "x.docs")
    counts = pair_counts(pairs, len(pieces(b_path).entries))
    answers = pairs.select("part", F.col("pairs").alias("pair")).join(counts.select("pair", "n", "best"), "pair")
    names = [*_COUNTS, "n_best", "count_sum"]
    schema = T.StructType([T.StructField("_row", row), *[T.StructField(c, T.LongType()) for c in names],
                           T.StructField("groups_sha256", T.StringType()),
                           *([T.StructField("groups", T.StringType())] if with_groups else [])])
    out = parts.drop("pairs", "docs").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_finish(with_groups), schema)
    return out.select("_row.*", *schema.names[1:])


def pair_counts(pairs: DataFrame, ids_b: int) -> DataFrame:
    """(a, pair, n, best) of rows (pairs, docs): all rows that have a pair, and whether no pair of its A id has more.

    An A id has at most as many pairs as B has ids, which bounds the window.
    """
    counts = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")).withColumn(
        "a", F.floor(F.col("pair") / ids_b))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
