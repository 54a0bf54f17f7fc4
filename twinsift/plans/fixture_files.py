"""Given tables written as files and containers, for the queries that read those."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import new_folder
from ..sources.archives import one_by_one
from .tables import Tables


def _local(folder: str) -> str:
    return folder[len("file:"):] if folder.startswith("file:") else folder


def write_texts(t: Tables) -> str:
    """Documents as text files, one directory per source and language."""
    folder = new_folder(t.spark, "texts")
    t.table("documents").select(F.col("text").alias("value"), "source", "lang").write.partitionBy(
        "source", "lang"
    ).text(folder)
    return _local(folder)


def write_one_file_each(t: Tables) -> str:
    """Every document as a file of its own; tasks write their rows in place."""
    folder = _local(new_folder(t.spark, "files"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, source, text in zip(frame["doc_id"], frame["source"], frame["text"]):
                os.makedirs(f"{folder}/{source}", exist_ok=True)
                with open(f"{folder}/{source}/{doc}.txt", "wb") as file:
                    file.write(text.encode())
            yield frame[["doc_id"]]

    written = t.table("documents").select("doc_id", "source", "text").mapInPandas(write, "doc_id bigint")
    written.agg(F.count("*")).collect()
    return folder


_CONTAINERS = "path string, content binary"
PACK_BYTES = 4 << 20


def _named_lines(text: str) -> list[tuple[str, bytes]]:
    """Non-empty lines with the entry names they have in the entry view."""
    return [(f"part{i}", line.encode()) for i, line in enumerate(text.split("\n"), 1) if line]


def _packed(rows: Iterator[tuple], write: Callable[[io.BytesIO, list[tuple[str, bytes]]], None]) -> Iterator[pa.RecordBatch]:
    """Containers of (path, text) rows, handed on whenever they have ``PACK_BYTES``."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for row in rows:
        buffer = io.BytesIO()
        write(buffer, _named_lines(row.text))
        held.append((row.path, buffer.getvalue()))
        size += len(held[-1][1])
        if size >= PACK_BYTES:
            yield _containers(held)
            held, size = [], 0
    if held:
        yield _containers(held)


def _containers(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    paths, contents = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


def _pack(t: Tables, write: Callable[[io.BytesIO, list[tuple[str, bytes]]], None]) -> DataFrame:
    """(path, content): each document as a container of its lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(one_by_one(batches), write)

    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".zip"))
    documents = t.table("documents").select(path.alias("path"), "text").repartition("path")
    return documents.mapInArrow(run, _CONTAINERS)


def _write_zip(buffer: io.BytesIO, lines: list[tuple[str, bytes]]) -> None:
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in lines:
            archive.writestr(name, data)


def _write_tar(buffer: io.BytesIO, lines: list[tuple[str, bytes]]) -> None:
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w") as archive:
        for name, data in lines:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    # Compressed at once: header by header takes a third longer.
    with gzip.GzipFile(fileobj=buffer, mode="wb") as packed:
        packed.write(plain.getbuffer())


def zipped(t: Tables) -> DataFrame:
    return _pack(t, _write_zip)


def tarred(t: Tables) -> DataFrame:
    return _pack(t, _write_tar)


def write_json_cache(t: Tables) -> str:
    """The cache as JSON documents of at most 500 entries each."""
    folder = new_folder(t.spark, "json-cache")
    key = F.concat_ws("|", "path", F.col("size").cast("string"), F.unix_timestamp("mtime").cast("string"))
    entries = t.cache.select(
        F.floor(F.col("doc_id") / 500).alias("part"), key.alias("key"), F.struct("hash", "phash").alias("entry")
    )
    documents = entries.groupBy("part").agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("entries"))).alias("value")
    )
    documents.select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder
