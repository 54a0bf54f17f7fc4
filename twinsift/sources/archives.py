"""Entries inside zip and tar containers as rows."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zipfile
from collections import namedtuple
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_ENTRIES = "container string, entry string, path string, type string, size bigint, hash string"
_COLUMNS = ["container", "entry", "path", "type", "size", "hash"]
_CHUNK = 1 << 20
_ROWS_PER_FRAME = 5_000
SLICE_ENTRIES = 1_000
SLICE_BYTES = 256 << 20


def _sha256(stream) -> str:
    digest = hashlib.sha256()
    while chunk := stream.read(_CHUNK):
        digest.update(chunk)
    return digest.hexdigest()


def _row(container: str, name: str, kind: str, size: int, digest: str) -> tuple:
    return container, name, f"{container}::{name}", kind, size, digest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=_COLUMNS)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS_PER_FRAME:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows with named fields; Python has one row's values at a time, not a batch of them."""
    for batch in batches:
        kind = namedtuple("Container", batch.schema.names)
        for at in range(batch.num_rows):
            yield kind(*(column[at].as_py() for column in batch.columns))


def _open(row) -> object:
    content = getattr(row, "content", None)
    return row.path if content is None else io.BytesIO(content)


def _zip_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for row in one_by_one(batches):
        try:
            archive = zipfile.ZipFile(_open(row))
        except (OSError, zipfile.BadZipFile):
            continue
        with archive:
            files = [i for i in archive.infolist() if not i.is_dir()]
            for info in files[getattr(row, "first", 0):getattr(row, "last", None)]:
                try:
                    with archive.open(info) as stream:
                        digest = _sha256(stream)
                except (OSError, RuntimeError, NotImplementedError, EOFError, zipfile.BadZipFile, zipfile.zlib.error):
                    continue
                yield _row(row.path, info.filename, "zip_entry", info.file_size, digest)


def _zip_slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut each container into runs of entries, from its directory alone."""
    for frame in frames:
        out = []
        for path in frame["path"]:
            try:
                with zipfile.ZipFile(path) as archive:
                    sizes = [i.file_size for i in archive.infolist() if not i.is_dir()]
            except (OSError, zipfile.BadZipFile):
                continue
            first = held = 0
            for at, size in enumerate(sizes):
                if at > first and (at - first >= SLICE_ENTRIES or held + size > SLICE_BYTES):
                    out.append((path, first, at))
                    first, held = at, 0
                held += size
            if sizes:
                out.append((path, first, len(sizes)))
        yield pd.DataFrame(out, columns=["path", "first", "last"])


def zip_entries(containers: DataFrame) -> DataFrame:
    """Entries of zip containers with size and SHA-256.

    ``containers`` has ``path`` and perhaps ``content``. Without content the
    files are opened in place, and a large container is divided among tasks
    by its entries. Directories, damaged entries and damaged containers are
    passed over.
    """
    if "content" not in containers.columns:
        containers = (
            containers.select("path").repartition("path")
            .mapInPandas(_zip_slices, "path string, first bigint, last bigint")
            .repartition("path", "first")
        )
    else:
        containers = containers.select("path", "content")
    return containers.mapInArrow(lambda batches: _batches(_zip_rows(batches)), _ENTRIES)


def _tar_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for row in one_by_one(batches):
        try:
            source = _open(row)
            where = {"name": source} if isinstance(source, str) else {"fileobj": source}
            with tarfile.open(mode="r:*", **where) as archive:
                for info in archive:
                    if not info.isfile():
                        continue
                    stream = archive.extractfile(info)
                    if stream is not None:
                        yield _row(row.path, info.name, "tar_entry", info.size, _sha256(stream))
        except (OSError, EOFError, tarfile.TarError, zipfile.zlib.error):
            continue


def tar_entries(containers: DataFrame) -> DataFrame:
    """Entries of tar containers, compressed or not, with size and SHA-256.

    A tar file can only be read from front to back, so it is one task's work.
    """
    columns = [c for c in ("path", "content") if c in containers.columns]
    spread = containers.select(*columns)
    if "content" not in columns:
        spread = spread.repartition("path")
    return spread.mapInArrow(lambda batches: _batches(_tar_rows(batches)), _ENTRIES)


def union_items(files: DataFrame, *entries: DataFrame) -> DataFrame:
    """Files and container entries as one item table."""
    out = files
    for more in entries:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def in_containers(entries: DataFrame) -> DataFrame:
    """Entries that can count as shared content: empty ones are left out."""
    return entries.where((F.col("size") > 0) & F.col("hash").isNotNull())
