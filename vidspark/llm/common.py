"""Reading, text as bytes, and scratch tables: what several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.session import materialize, scratch_path, shared_dir  # noqa: F401

# Rows of an Arrow batch are handled in slices of about so many bytes of text; bounds memory only.
SLICE_BYTES = 2 << 20
# What [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ leaves apart after A-Z are lower-cased: everything else becomes a space.
LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns what a worker's allocators hold unused to the system: an idle worker counts for its executor's memory too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts batches into slices of bounded text; gives each slice and its texts as UTF-8 bytes (None: null). Memory of the
    batches goes back to the system after the last."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        column = column.cast(kind)
        start, size = 0, 0
        for i in range(batch.num_rows):
            size += len(column[i].as_buffer()) if column[i].is_valid else 0
            if size >= SLICE_BYTES or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), column.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
        del column
    batch = None
    give_back()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema)], schema=schema)


def lower_ascii(column):
    """A-Z only, as a column."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
