"""Tables of vectors: which rows count, and batches of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors that are handled at once in a task; bounds memory only.
BLOCK = 4096


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def finite_vectors(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has only finite entries, and the number of entries.

    That is the largest length found; a shorter vector lacks entries and goes like one with null entries. 0: no vector.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & finite)
    size = kept.agg(F.max(F.size(vector))).first()[0] or 0
    return kept.where(F.size(vector) == size) if size else kept.where(F.lit(False)), size


def blocks(batches: Iterator[pa.RecordBatch], vector: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Cuts batches into at most BLOCK rows; gives each cut and its vectors as rows of doubles."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            cut = batch.slice(start, BLOCK)
            flat = cut.column(cut.schema.get_field_index(vector)).flatten()
            yield cut, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(cut.num_rows, size)


def scaled_floor(values: np.ndarray, factor: float, limit: int) -> np.ndarray:
    """floor(factor * value) as long, held to [-limit, limit]."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * factor), -float(limit), float(limit)).astype(np.int64)
