"""Flat token files: unsigned ids of all documents in id order, with 64-bit offsets, readable by memory mapping.

A set of files is a folder with, for each part, ``part-N.bin`` (ids, 16 bits if the vocabulary fits, else 32) and
``part-N.idx`` (documents, then offsets of every document and the end within the part as unsigned 64-bit integers, the
document ids as signed 64-bit integers, and a byte per document that is 1 where the id is null). The base of a part,
the ids before it, is a prefix sum over the counts of the parts before; there is one row per part.

Defined results: a null text counts as empty and gives the end id alone; null ids come first; rows with one id follow each
other by a hash of the text; columns other than id and text are left out; texts of any length are written whole; an empty
table gives no row. Files are written under another name and then renamed, so a
lost or repeated task leaves whole files with the same content.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.bpe import tokenizer_path, worker_encoder
from vidspark.llm.common import batch_of, documents, scratch_path, text_slices


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def token_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
                 tokenizer: str | None = None) -> list[dict]:
    """Encodes docs, appends the end id to each and writes the parts; gives the parts in order, with their bases."""
    tokenizer = tokenizer or tokenizer_path()
    schema = pa.schema([("part", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("kind", pa.string()),
                        ("path", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        encoder = worker_encoder(tokenizer)
        kind = token_type(encoder.vocabulary.size)
        part = TaskContext.get().partitionId()
        own = f"{base}/.{uuid.uuid4().hex}"
        names, empty, offsets = [], [], [0]
        out = None
        for batch, texts in text_slices(batches, "text"):
            out = out or store.open_output_stream(f"{own}.bin")
            for ids in encoder.encode([t or b"" for t in texts]):
                out.write(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())
                offsets.append(offsets[-1] + len(ids) + 1)
            column = batch.column(0)
            names.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            empty.append(column.is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{own}.idx") as f:
            f.write(np.array([len(offsets) - 1], "<u8").tobytes())
            f.write(np.array(offsets, "<u8").tobytes())
            f.write(np.concatenate(names).astype("<i8").tobytes())
            f.write(np.concatenate(empty).astype("u1").tobytes())
        for end in ("bin", "idx"):
            store.move(f"{own}.{end}", f"{base}/part-{part:06d}.{end}")
        yield batch_of(schema, [[part], [len(offsets) - 1], [offsets[-1]], [kind], [f"part-{part:06d}"]])

    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text")))
    written = ordered.mapInArrow(write, "part long, documents long, tokens long, kind string, path string")
    parts, base = [], 0
    for row in sorted(written.collect()):  # one row per part
        parts.append(row.asDict() | {"base": base})
        base += row["tokens"]
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/parts.json") as f:
        f.write(json.dumps(parts).encode())
    return parts


def open_part(folder: str, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (memory-mapped where the store is a local or mounted folder), offsets, document ids, null marks."""
    store, base = _store(folder)
    name = f"{base}/{part['path']}"
    with store.open_input_stream(f"{name}.idx") as f:
        raw = f.read()
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    offsets = np.frombuffer(raw, "<u8", n + 1, 8)
    names = np.frombuffer(raw, "<i8", n, 8 * (n + 2))
    empty = np.frombuffer(raw, "u1", n, 8 * (2 * n + 2))
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name + ".bin", part["kind"], "r"), offsets, names, empty
    with store.open_input_stream(f"{name}.bin") as f:
        return np.frombuffer(f.read(), part["kind"]), offsets, names, empty


def read_tokens(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """One row per document: doc_id, start among all ids, n_tokens, crc32 of its ids as 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part = parts[k]
                ids, offsets, names, empty = open_part(folder, part)
                for a in range(0, len(names), 10_000):
                    at = offsets[a:a + 10_001].astype(np.int64)
                    crcs = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at, at[1:])]
                    yield batch_of(schema, [
                        pa.array(names[a:a + 10_000].astype(np.int64), mask=empty[a:a + 10_000].astype(bool)),
                        pa.array(at[:-1] + part["base"]), pa.array(np.diff(at)), crcs])

    return (spark.range(0, len(parts), 1, max(1, len(parts)))
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(documents(spark, sf_dir), folder))
