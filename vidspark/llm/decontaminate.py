"""Benchmark decontamination by word n-grams.

The windows of the test items are cut into blocks of bounded size. One block is broadcast at a time; each document's words
are looked up in the block's vocabulary, windows of known words are hashed, and every hash hit is compared word by word.
A pass over the documents needs no shuffle, and several blocks are several passes in one plan.

Defined results: a null text has no words; an empty text neither; a null item text gives no window; an item without words
is never found; repeated items with one id are one item, a null id counts as an item called "null"; an empty benchmark
leaves every document clean; repeated rows of documents give repeated rows; columns other than id and text are kept by
``clean_documents`` and ignored elsewhere; texts of any length are scanned whole; an empty table of documents gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import LOWER_WORDS, batch_of, documents, text_slices

WINDOW = 10
#: Windows in one broadcast block; 10 words of some 8 bytes each keep a block near 50 MB in a worker.
BLOCK_WINDOWS = 200_000
_WORD = re.compile(rb"[^ ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, words) of all windows; words joined by one space."""
    schema = pa.schema([("item", pa.string()), ("words", pa.binary())])

    def cut(batches):
        for batch, texts in text_slices(batches, "text"):
            names, found = [], []
            for name, data in zip(batch.column(0).to_pylist(), texts):
                words = (data or b"").translate(LOWER_WORDS).split()
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    names.append(name)
                    found.append(b" ".join(words[k:k + window]))
            yield batch_of(schema, [names, found])

    picked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                          F.col(text).alias("text"))
    return picked.mapInArrow(cut, "item string, words binary").distinct()


class _Block:
    """One broadcast block: vocabulary, and by window length the sorted hashes, word ids and items."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for item, words in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words.split()]
            by_length.setdefault(len(ids), []).append((ids, item))
        self.tables = {}
        for length, found in by_length.items():
            ids = np.array([x[0] for x in found], np.int32).reshape(len(found), length)
            hashes = _hashed(ids)
            order = np.argsort(hashes, kind="stable")
            self.tables[length] = (hashes[order], ids[order], [found[i][1] for i in order])

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges covered by verified windows, and the items they belong to."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        ranges, items = [], set()
        for length, (hashes, windows, names) in self.tables.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            for part in np.array_split(at, len(at) // 65_536 + 1):
                if not len(part):
                    continue
                rows = ids[part[:, None] + np.arange(length)]
                keys = _hashed(rows)
                first = np.searchsorted(hashes, keys, "left")
                last = np.searchsorted(hashes, keys, "right")
                for i in np.flatnonzero(last > first):
                    same = [j for j in range(first[i], last[i]) if np.array_equal(windows[j], rows[i])]
                    if same:
                        ranges.append((int(part[i]), int(part[i]) + length))
                        items.update(names[j] for j in same)
        return ranges, items


def _hashed(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        total = total * _BASE + rows[:, k].astype(np.uint64) + np.uint64(1)
        total ^= total >> np.uint64(29)
    return total


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
              block_windows: int = BLOCK_WINDOWS, name: str = "hits") -> DataFrame:
    """The rows of docs plus ``hits``: n_words, word ranges [start, end) covered by windows, ids of the items found.

    A column of docs called like ``name`` is replaced.
    """
    spark = docs.sparkSession
    windows = item_windows(items, window)
    blocks = max(1, -(-windows.count() // block_windows))
    docs = docs.drop(name).withColumn(name, F.lit(None).cast(
        "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"))
    schema = docs.schema
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                      ("items", pa.list_(pa.string()))])
    for k in range(blocks):
        of_block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k
        # at most about block_windows rows of at most `window` words
        rows = [(r[0], bytes(r[1])) for r in windows.where(of_block).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared):
            block = _Block(shared.value)
            for batch, texts in text_slices(batches, text):
                hits = []
                for data, before in zip(texts, batch.column(batch.num_columns - 1).to_pylist()):
                    words = (data or b"").translate(LOWER_WORDS).split()
                    ranges, found = block.matches(words) if words else ([], set())
                    if before:
                        ranges += list(zip(before["starts"], before["ends"]))
                        found |= set(before["items"])
                    ranges = _united(ranges)
                    hits.append({"n_words": len(words), "starts": [a for a, _ in ranges], "ends": [b for _, b in ranges],
                                 "items": sorted(found)})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)],
                                                 names=batch.schema.names)

        docs = docs.mapInArrow(scan, schema)
    return docs


def covered_words(name: str) -> Column:
    return F.aggregate(F.zip_with(f"{name}.starts", f"{name}.ends", lambda a, b: b - a), F.lit(0).cast("long"),
                       lambda a, b: a + b)


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
                    mode: str = "spans", max_share: float = 0.5) -> DataFrame:
    """docs without what the benchmark contains; same columns.

    ``spans``: covered words go, with what lies between them, and a document whose covered share exceeds ``max_share``
    goes as a whole. ``documents``: any document with a hit goes.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"unknown mode {mode}")
    name = max([*docs.columns, "hits"], key=len) + "_"  # no column of docs
    found = find_hits(docs, items, window, text, name=name)
    if mode == "documents":
        return found.where(F.size(f"{name}.items") == 0).select(*docs.columns)
    kept = found.where(covered_words(name) <= max_share * F.col(f"{name}.n_words"))

    def strip(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_slices(batches, text):
            k = batch.schema.get_field_index(text)
            out = []
            for data, hits in zip(texts, batch.column(batch.num_columns - 1).to_pylist()):
                if data and hits["starts"]:
                    at = [m.span() for m in _WORD.finditer(data.translate(LOWER_WORDS))]
                    pieces, last = [], 0
                    for a, b in zip(hits["starts"], hits["ends"]):
                        pieces.append(data[last:at[a][0]])
                        last = at[b - 1][1]
                    data = b"".join([*pieces, data[last:]])
                out.append(None if data is None else data.decode())
            columns = list(batch.columns[:-1])
            columns[k] = pa.array(out, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return kept.mapInArrow(strip, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = covered_words("hits")
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
