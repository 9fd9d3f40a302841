"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are dealt to source partitions by a hash of the row. The number of rows that goes from each source to each shard is
drawn at once: the rows of a matrix with the sources' counts as row sums and the shard sizes, at most one apart, as column
sums follow a multivariate hypergeometric law, which is what a uniform permutation gives. Each source is permuted locally
(ordered by a seeded hash), its first rows go to shard 0 and so on; after the exchange each shard is permuted again.
The draw takes one count per source and so many numbers per shard; rows never leave the executors, and everything but the
draw is DataFrame functions.

Positions in a source or a shard come from windows over (source or shard, bucket of the hash) plus the rows in earlier
buckets, so no task sorts a whole shard.

Defined results: a null text has no bytes (its crc32 is that of the empty string); null ids are hashed like a value;
rows that are equal in id, size and crc32 are numbered by ``copy``, so a third of all rows may be equal; other columns are
left out; an empty table gives no row.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidspark.llm.common import documents, materialize

SHARDS = 24
#: Source partitions; a bound on the matrix, sources x shards. More rows make sources larger, and they are cut by buckets.
SOURCES = 64


def _hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of ``draws`` taken without return from good + bad are good: inversion from the mode outwards."""
    from math import exp, lgamma
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def log_mass(k: int) -> float:
        return (lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + lgamma(bad + 1) - lgamma(draws - k + 1)
                - lgamma(bad - draws + k + 1) - lgamma(good + bad + 1) + lgamma(draws + 1) + lgamma(good + bad - draws + 1))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    left, up, down = rng.random(), mode, mode - 1
    up_mass = exp(log_mass(mode))
    down_mass = up_mass * mode * (bad - draws + mode) / max(1, (good - mode + 1) * (draws - mode + 1))
    while True:
        if up > high and down < low:
            return mode
        if up <= high:
            left -= up_mass
            if left <= 0:
                return up
            up_mass *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
        if down >= low:
            left -= down_mass
            if left <= 0:
                return down
            down_mass *= down * (bad - draws + down) / max(1, (good - down + 1) * (draws - down + 1))
            down -= 1
        if up_mass < 1e-300 and down_mass < 1e-300:
            return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """counts[p] rows of source p over shards whose sizes are at most one apart, drawn as a uniform permutation does."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in counts:
        row, left, places = [], count, sum(room)
        for s in range(shards):
            drawn = _hypergeometric(room[s], places - room[s], left, rng)
            places -= room[s]
            left -= drawn
            room[s] -= drawn
            row.append(drawn)
        matrix.append(row)
    return matrix


def _numbered(rows: DataFrame, group: str, key: str, name: str, buckets: int) -> DataFrame:
    """Adds the place of each row in its group by key, from 0; windows hold one bucket of the key at most."""
    rows = rows.withColumn("_bucket", F.pmod(F.shiftright(F.col(key), 20), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(key, *ROW)) - 1
    return (rows.withColumn("_local", local).join(before, [group, "_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_bucket", "_before", "_local"))


ROW = ["doc_id", "size", "text_crc32", "copy"]


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *ROW)


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = 7, sources: int = SOURCES, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, copy, shard, slot) of every row."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"),
                       F.crc32(whole.cast("binary")).alias("text_crc32"))
    rows = (rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"))
    rows = materialize(rows.withColumn("source", F.pmod(_row_hash(seed), F.lit(sources)).cast("int")), "rows")
    found = {r[0]: r[1] for r in rows.groupBy("source").count().collect()}  # one count per source
    matrix = communication_matrix([found.get(p, 0) for p in range(sources)], shards, seed)
    values = ", ".join(f"({p}, array({', '.join(f'{sum(row[:s + 1])}L' for s in range(shards))}))"
                       for p, row in enumerate(matrix))
    limits = spark.sql(f"SELECT * FROM VALUES {values} AS t(source, limits)")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    permuted = _numbered(rows.withColumn("_key", _row_hash(seed + 1)), "source", "_key", "_place", buckets)
    dealt = permuted.join(limits, "source").withColumn(
        "shard", F.size(F.filter("limits", lambda x: x <= F.col("_place"))).cast("int"))
    dealt = dealt.select(*ROW, "shard").withColumn("_key", _row_hash(seed + 2))
    return _numbered(dealt, "shard", "_key", "slot", buckets).select(*ROW, "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
