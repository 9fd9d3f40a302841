"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. If two differ in at most ``max_bits``, then among max_bits // 2 + 1 segments one differs by at
most one bit. So each fingerprint is indexed under its segments with one bit left out, for every bit in turn, and
fingerprints that share such a key are compared. Equal fingerprints count once.

Keys with one fingerprint are dropped, and keys with two are settled at once. In larger keys the smallest and the largest
fingerprint are compared with the others first, which joins groups of near copies in as many rows as they have members;
after components are known, only keys that still hold several components go on, and there only members outside the
largest component are paired, each pair under the first key it shares. In large keys the bits outside the segment are cut
once more, into max_bits + 1 pieces of which one is equal. No link is lost: two fingerprints within max_bits share a key,
and either have a label in common by then or are compared.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows are copies; a null id
takes part but is no component's name unless the component has no other; texts of any length count whole; columns other
than id and text are left out; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidspark.llm.common import batch_of, documents, materialize, text_slices
from vidspark.llm.graph import components

SEED = 42
#: Keys with more fingerprints than this are cut once more; the result is the same at any value.
LARGE_KEY = 128


def bit_majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    total = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        rows = hashes[part:part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): A-Z lower-cased, shingles of so many words with repeats, XXH64 with seed 42."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        from xxhash import xxh64_intdigest
        for batch, texts in text_slices(batches, "text"):
            out = []
            for data in texts:
                found = (data or b"").lower().split()
                if not found:
                    out.append(0)
                    continue
                joined = b" ".join(found)
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
                size = min(words, len(found))
                starts = [0, *(ends[:len(found) - size] + 1).tolist()]
                hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())]
                out.append(bit_majority(np.array(hashes, np.uint64)))
            yield batch_of(schema, [batch.column(0), out])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _segments(n: int, bits: range | list[int]) -> list[list[int]]:
    bits = list(bits)
    edges = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def variant_keys(fps: DataFrame, max_bits: int) -> DataFrame:
    """(variant, part, fp): for each segment and each of its bits the segment without that bit."""
    keys = []
    for segment in _segments(max_bits // 2 + 1, range(64)):
        for bit in segment:
            masked = F.col("fp").bitwiseAND(F.lit(_mask([b for b in segment if b != bit])))
            keys.append(F.struct(F.lit(bit).cast("tinyint").alias("variant"), masked.alias("part")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.variant", "k.part", "fp")


def _first_shared(max_bits: int):
    """Whether ``variant`` is the first under which fingerprints a.fp and b.fp, which share it, meet."""
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    out, earlier = F.lit(False), F.lit(True)
    for segment in _segments(max_bits // 2 + 1, range(64)):
        own = differ.bitwiseAND(F.lit(_mask(segment)))
        here = F.when(own == 0, F.col("a.variant") == segment[0]).otherwise(
            own == F.expr("shiftleft(1L, cast(a.variant AS int))"))
        out = F.when(F.col("a.variant").between(segment[0], segment[-1]), earlier & here).otherwise(out)
        earlier = earlier & (F.bit_count(own) > 1)
    return out


def linked(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, label) of the distinct fingerprints that have a link; the label is the smallest one reachable."""
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_bits
    keys = variant_keys(fps, max_bits)
    key = ["variant", "part"]
    own = Window.partitionBy(*key)
    members = keys.withColumns({"low": F.min("fp").over(own), "high": F.max("fp").over(own), "n": F.count("*").over(own)})
    # of two fingerprints all is known here; chance pairs that are not near end here
    members = materialize(members.where((F.col("n") > 2) | (F.col("n") == 2) & near("low", "high")), "members")
    stars = members.where("n = 2 AND fp = high").select(F.col("high").alias("u"), F.col("low").alias("v"))
    members = members.where("n > 2")
    for pivot in ("low", "high"):
        stars = stars.unionByName(members.where((F.col("fp") != F.col(pivot)) & near("fp", pivot)).select(
            F.col("fp").alias("u"), F.col(pivot).alias("v")))
    first = materialize(components(stars), "labels")

    known = members.drop("low", "high", "n").join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    mixed = (known.groupBy(*key, "label").agg(F.count("*").alias("n")).groupBy(*key)
             .agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"),
                  F.count("*").alias("labels")).where("labels > 1").drop("labels"))
    rest = materialize(known.join(mixed, key), "mixed")
    pieces = F.array([F.lit(0).cast("long")])
    for segment in _segments(max_bits // 2 + 1, range(64)):
        outside = _segments(max_bits + 1, [b for b in range(64) if b not in segment])
        cut = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_mask(p)))) for k, p in enumerate(outside)])
        pieces = F.when(F.col("variant").between(segment[0], segment[-1]), cut).otherwise(pieces)
    rest = (rest.where(F.col("size") <= LARGE_KEY).withColumn("piece", F.lit(0).cast("long"))
            .unionByName(rest.where(F.col("size") > LARGE_KEY).withColumn("piece", F.explode(pieces))))
    a, b = rest.where("label <> main").alias("a"), rest.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "piece")]
    cross = (a.join(b, [*same, F.col("a.label") != F.col("b.label"), near("a.fp", "b.fp"), _first_shared(max_bits)])
             .select(F.col("a.label").alias("u"), F.col("b.label").alias("v")))
    second = components(cross)
    # labels of the first round that met others get their common label; fingerprints without a star are their own label
    merged = (first.join(second.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
              .select(F.col("node").alias("fp"), F.coalesce("final", "label").alias("label")))
    alone = (second.join(first.select("node"), "node", "left_anti")
             .select(F.col("node").alias("fp"), "label"))
    return merged.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest id of the documents that can be reached by links."""
    marked = materialize(fingerprints(docs, words, doc_id, text), "fingerprints")
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labelled = firsts.join(linked(firsts.select("fp"), max_bits), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
