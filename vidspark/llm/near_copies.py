"""Texts of a Jaccard similarity of MIN_SHARE and more over distinct word shingles, verified exactly.

SimHash comes first: texts whose fingerprints are linked, as in ``simhash``, are compared with the smallest of their class.
At a similarity of 0.8 two fingerprints differ in some 10 of 64 bits, so links between texts further apart are left to keys.

Each text has BANDS keys, each of the minima of its shingles' hashes under ROWS seeded permutations. Two texts of
similarity s miss each other with probability (1 - s ** ROWS) ** BANDS: 2e-10 at 0.8, less above. Every link is verified by
the whole shingle sets, so none is below MIN_SHARE.

Keys are not paired within, as many texts of a lower similarity may share one. Every text is compared with one
other besides, its star: of the texts that lead one of its keys, by the number of texts they share keys with, the first. That joins
a group around a common original in as many comparisons as it has members. Texts whose keys still hold several components
are then joined by the prefix principle: with shingles in the order of how many of these texts have them, the rarest first,
two similar texts have one in common among the first of each, and the places at which it stands bound the sizes that the
two may have. A text that differs from its group in a fifth of its shingles thus meets no one by what the group shares,
only by what few others have. Texts of the largest component among those that have a shingle don't meet each other there.

Defined results: A-Z are lower-cased, words end at white space; a text of fewer words than a shingle is one shingle; texts
without words, null among them, are copies of each other; repeated rows are one node; other columns are left out; whole
texts count, however long; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.llm import simhash
from vidspark.llm.common import batch_of, materialize, text_slices
from vidspark.llm.graph import components

SEED = 42
#: Least similarity as a fraction, permutations of a key, keys of a text.
MIN_SHARE, ROWS, BANDS = (4, 5), 5, 56
#: Shingles taken at once; bounds memory only.
CHUNK = 512
#: Sizes within this factor are of one class when shingles are looked up; it decides how much is looked up, not what is found.
SIZE_STEP = 1.03

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 32, ROWS * BANDS, np.uint32)[:, None]
_TIMES = _rng.integers(0, 1 << 32, ROWS * BANDS, np.uint32)[:, None] | np.uint32(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(data: bytes | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    from xxhash import xxh64_intdigest
    found = (data or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:len(found) - size] + 1).tolist()]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())],
                              np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(ROWS * BANDS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(short), CHUNK):
        mixed = (short[k:k + CHUNK] ^ _FLIP) * _TIMES
        least = np.minimum(least, (mixed ^ (mixed >> np.uint32(15))).min(axis=1))
    keys = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * MIN_SHARE[1] >= (len(a) + len(b) - both) * MIN_SHARE[0]


def _keys(rows: DataFrame, words: int) -> DataFrame:
    """(node, key) of the distinct nodes."""
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_slices(batches, "text"):
            yield batch_of(schema, [batch.column(0), [band_keys(shingles(data, words)) for data in texts]])

    marked = rows.select("node", "text").mapInArrow(run, "node long, keys array<long>")
    return marked.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, size, hashes) from (node, text): the distinct shingles of a text as 64-bit hashes."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, found in text_slices(batches, "text"):
            hashes = [shingles(data, words).view(np.int64) for data in found]
            yield batch_of(schema, [batch.column(0), [len(h) for h in hashes], hashes])

    return texts.select("node", "text").mapInArrow(run, "node long, size int, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar; ``sets`` has one row per node. Sizes are compared before sets are sent."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (2, 3))
                if similar(a, b):
                    kept.append(k)
            rows = pa.array(kept, pa.int64())
            yield batch_of(schema, [batch.column(0).take(rows), batch.column(1).take(rows)])

    def side(x: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])

    near = pairs.join(side("u", "size", "hashes"), "u").join(side("v", "size", "hashes"), "v").where(
        (F.col("u_size") * MIN_SHARE[1] >= F.col("v_size") * MIN_SHARE[0])
        & (F.col("v_size") * MIN_SHARE[1] >= F.col("u_size") * MIN_SHARE[0]))
    return near.select("u", "v", "u_hashes", "v_hashes").mapInArrow(run, "u long, v long")


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _size_class(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int")


def prefix_candidates(texts: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of different labels that may be similar, from (node, size, hashes, label); none is missed.

    A shingle at place p of a text of n may be the first that is common with a text of m only if 4 (n + m) / 9 of them
    can still be common (for MIN_SHARE = 4 / 5), that is m <= 1.25 n - 2.25 p. Texts outside a shingle's largest label
    look for it in the classes of such sizes; shingles that one text alone has come first and are never sent.
    """
    top, low = MIN_SHARE[1], MIN_SHARE[0]
    each = texts.select("node", F.explode("hashes").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    known = each.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    rows = texts.select("node", "size", "label").join(known, "node")
    lone = F.col("size") - F.size("shared")
    last = F.floor(F.col("size") * (top - low) / F.lit(top)).cast("int")  # places 0 to last
    first = F.slice("shared", F.lit(1), F.greatest(last - lone + 1, F.lit(0)))
    placed = rows.select("node", "size", "label", lone.alias("lone"), F.posexplode(first).alias("at", "t")).select(
        "node", "size", "label", (F.col("lone") + F.col("at")).alias("place"), F.col("t.token").alias("token"))
    # the largest size of a partner by this place: m <= (n (top) - p (top + low)) / low
    most = F.floor((F.col("size") * top - F.col("place") * (top + low)) / F.lit(low)).cast("int")
    placed = materialize(placed.withColumn("most", most), "prefixes")
    sizes = placed.groupBy("token", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")) \
        .where("labels > 1").drop("labels")
    mixed = materialize(placed.join(main, "token").withColumn("class", _size_class(F.col("size"))), "mixed")
    least = F.ceil(F.col("size") * low / F.lit(top)).cast("int")
    asking = mixed.where((F.col("label") != F.col("main")) & (F.col("most") >= least)).withColumn(
        "class", F.explode(F.sequence(_size_class(least), _size_class(F.col("most")))))
    a, b = asking.alias("a"), mixed.alias("b")
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    fits = (F.col("b.size") <= F.col("a.most")) & (F.col("a.size") <= F.col("b.most"))
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.class") == F.col("b.class"))
                  & (F.col("a.label") != F.col("b.label")) & once & fits).select(*_pair("a.node", "b.node")).distinct()


def fingerprint_pairs(rows: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(u, v): each node, and the smallest one of those that links of at most ``max_bits`` between SimHash fingerprints reach."""
    prints = materialize(simhash.fingerprints(rows, words, "node", "text").select(F.col("doc_id").alias("node"), "fp").distinct(),
                         "fingerprints")
    labels = simhash.linked(prints.select("fp").distinct(), max_bits)
    named = materialize(prints.join(labels, "fp", "left").select("node", F.coalesce("label", "fp").alias("label")), "classes")
    first = named.groupBy("label").agg(F.min("node").alias("first"))
    return named.join(first, "label").where("node <> first").select(*_pair("node", "first"))


def linked(rows: DataFrame, words: int, max_bits: int = 4) -> DataFrame:
    """(node, label) of the nodes that have a link, from (node, text) with one text to a node; rows may repeat."""
    prints = materialize(fingerprint_pairs(rows, words, max_bits), "pairs")
    keys = materialize(_keys(rows, words), "keys")
    held = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(held, "key"), "members")
    shared = materialize(members.groupBy("node").agg(F.sum("n").alias("shared")), "shared")
    wanted = shared.select("node").union(prints.select("u")).union(prints.select("v"))
    texts = rows.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(_sets(texts, words), "sets")
    # each node's star: the best of the leaders of its keys
    leader = members.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node")).alias("leader"))
    stars = members.join(leader, "key").groupBy("node").agg(F.max("leader").alias("star")) \
        .select("node", F.col("star.node").alias("star")).where("node <> star")
    pairs = prints.union(stars.select(*_pair("node", "star"))).distinct()
    first = materialize(components(verified(pairs, sets)), "labels")

    named = members.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    open_ = named.join(mixed, "key").groupBy("node").agg(F.min("label").alias("label"))
    left = materialize(open_.join(sets, "node"), "open")
    links = materialize(verified(prefix_candidates(left), sets), "links")
    label = lambda x: first.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    told = links.join(label("u"), "u", "left").join(label("v"), "v", "left").select(
        F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    second = materialize(components(told), "labels")
    # labels of the first round that met others get their common label; nodes without a star are their own label
    merged = (first.join(second.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
              .select("node", F.coalesce("final", "label").alias("label")))
    return merged.unionByName(second.join(first.select("node"), "node", "left_anti"))
