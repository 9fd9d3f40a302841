"""Product codes of integer vectors, with exact distances from float64 matrix products.

Entries become integers floor(256 * x), vectors are cut into consecutive parts, and each part position has a codebook of
its own. Distances need dot products of integers; BLAS has them for float64 only, which is exact below 2^53. So integers
are broken into limbs of so few bits that a product's sums stay below 2^53, the products of limbs are float64 matrix
products, and they are put together again in int64. The first smallest distance names the code, so ties go to the lower
index. No rounding happens anywhere, and the result is the same on any cluster.

A round of training is one pass: each task adds up its rows by (part, entry), Spark adds up the tasks. What reaches the
driver is the codebooks, parts x entries x positions numbers whatever the number of rows.

Defined results: vectors that are null or have null or non-finite entries go, shorter ones than the longest too; integers
are held to a magnitude at which squared distances of whole vectors fit a long (2^27.5 for 64 entries, that is 741,000
before scaling). With fewer vectors than entries the codebook has one entry a vector. A part count that does not divide the
size gives the first parts one position more; parts may be empty. Ties in the order of ids, null ids last, are broken by
the integers. Repeated rows count as often as they stand there. Other columns are left out. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import batch_of, materialize
from vidspark.llm.vectors import blocks, embeddings, finite_vectors, scaled_floor

SCALE, PARTS, ENTRIES, ROUNDS = 256.0, 16, 64, 2
EXACT_BITS = 53

SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])
CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def largest(size: int) -> int:
    """The magnitude below which the squared distance of two vectors fits a long."""
    return isqrt((2**63 - 1) // (4 * max(size, 1)))


def _limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """a = sum of limb i times 2^(i bits); all limbs but the last lie in [0, 2^bits), that one has the sign."""
    limbs, top = [], int(max(-int(a.min(initial=0)), int(a.max(initial=0)))).bit_length()
    while top > bits:
        limbs.append((a & ((1 << bits) - 1)).astype(np.float64))
        a, top = a >> bits, top - bits
    return [*limbs, a.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact as long as the result fits int64."""
    inner = max(a.shape[1], 1)
    bits = (EXACT_BITS - (inner - 1).bit_length()) // 2
    out = np.zeros((a.shape[0], b.shape[0]), np.int64)
    right = [limb.T for limb in _limbs(b, bits)]
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << ((i + j) * bits)
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance."""
    partial = (book * book).sum(axis=1) - 2 * exact_products(rows, book)
    codes = partial.argmin(axis=1)
    return codes, partial[np.arange(len(rows)), codes] + (rows * rows).sum(axis=1)


def part_slices(size: int, parts: int) -> list[slice]:
    edges = [0]
    for p in range(parts):
        edges.append(edges[-1] + size // parts + (p < size % parts))
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def trained(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
            scale: float = SCALE) -> list[np.ndarray]:
    """A codebook for each part, from (vec_id, vector); the first is the vectors of the smallest ids."""
    cuts, limit = part_slices(size, parts), largest(size)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("vector", lambda x: F.floor(
        x.cast("double") * scale))).limit(entries).collect()  # as many rows as a codebook has entries
    start = scaled_floor(np.array([r["vector"] for r in first], np.float64).reshape(len(first), size), scale, limit)
    books = [start[:, c] for c in cuts]
    for _ in range(rounds if first else 0):
        now = books

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(now), len(now[0])), np.int64)
            sums = [np.zeros(b.shape, np.int64) for b in now]
            for _, values in blocks(batches, "vector", size):
                whole = scaled_floor(values, scale, limit)
                for p, c in enumerate(cuts):
                    codes = nearest(whole[:, c], now[p])[0]
                    counts[p] += np.bincount(codes, minlength=len(now[p]))
                    np.add.at(sums[p], codes, whole[:, c])
            part, entry = counts.nonzero()
            yield batch_of(SUMS, [part.astype(np.int32), entry.astype(np.int32), counts[part, entry],
                                  [sums[p][e].tolist() for p, e in zip(part, entry)]])

        added = vectors.select("vector").mapInArrow(summed, "part int, entry int, count long, sums array<long>")
        width = max(c.stop - c.start for c in cuts)
        found = added.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*[
            F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()  # parts x entries rows
        books = [b.copy() for b in books]
        for r in found:
            book = books[r["part"]]
            book[r["entry"]] = np.array(r["sums"][:book.shape[1]], np.int64) // r["count"]
    return books


def encoded(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
            vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label as text, code, error) of every vector, the codebooks)."""
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"),
                        F.col(label).cast("string").alias("label"))
    plain, size = finite_vectors(plain, "vector")
    cuts, limit = part_slices(size, parts), largest(size)
    books = trained(plain.select("vec_id", "vector"), size, parts, entries, rounds, scale)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in blocks(batches, "vector", size):
            whole = scaled_floor(values, scale, limit)
            codes = np.empty((len(whole), len(cuts)), np.uint8 if entries <= 256 else ">u2")
            error = np.zeros(len(whole), np.int64)
            for p, c in enumerate(cuts):
                codes[:, p], off = nearest(whole[:, c], books[p])
                error += off
            digits, width = codes.tobytes().hex(), 2 * codes.itemsize * len(cuts)
            yield batch_of(CODED, [batch.column(0), batch.column(2),
                                   [digits[i:i + width] for i in range(0, len(digits), width)], error])

    return plain.mapInArrow(coded, "vec_id long, label string, code string, error long"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encoded(embeddings(spark, sf_dir))
    coded = materialize(coded, "codes")  # read twice: sums by label, rows
    text = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds as joins: for vectors of any size that PARTS divides, all of one size."""
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label,
      list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    part AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x
      FROM kept, (SELECT unnest(range({PARTS})) AS p)),
    first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept
      QUALIFY e < {ENTRIES}),
    book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN first USING (r))"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min((d, e)) AS best FROM (
      SELECT r, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM part JOIN book{k} USING (p)) GROUP BY r, p)""")
        if k < ROUNDS:
            ctes.append(f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(c2, c) AS c FROM book{k} LEFT JOIN (
      SELECT p, e, list(m ORDER BY j) AS c2 FROM (
        SELECT p, e, j, (sum(x) - (sum(x) % count(*) + count(*)) % count(*))::BIGINT // count(*) AS m
        FROM (SELECT p, best[2] AS e, unnest(x) AS x, unnest(range(len(x))) AS j FROM near{k}) GROUP BY p, e, j)
      GROUP BY p, e) USING (p, e))""")
    return "WITH " + ",\n".join(ctes) + f""",
    coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
      FROM near{ROUNDS} GROUP BY r),
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), books"""


SQL = _sql()
