"""Positions and running totals over whole tables or large groups.

A plain window sorts each group in one task, and one group may hold a third of all rows. Here every row first gets a
bucket that is a function of the row alone and follows the wanted order. Windows then run inside (group, bucket), and
the totals of the buckets before are added from a small table. No task sees more than one bucket, nothing depends on
where rows happened to lie, and so a lost task can be run again.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.functions.hashing import seeded_hash
from vidspark.session import materialize


def _shuffle_width(df: DataFrame) -> int:
    """Reduce tasks the cluster is set up for; it grows with the data, and the number of buckets follows it."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def hash_digits(df: DataFrame) -> int:
    """Hex digits of the hash that name a bucket: 4,096 buckets per group, 65,536 on wide clusters."""
    return 3 if _shuffle_width(df) <= 1024 else 4


def value_buckets(df: DataFrame) -> int:
    """Buckets by value: two per reduce task, at least 256, at most 20,000 (a sketch of about a megabyte)."""
    return min(max(256, 2 * _shuffle_width(df)), 20_000)


def add_value_bucket(df: DataFrame, column: str, name: str = "_bucket", buckets: int | None = None,
                     sketch_from: DataFrame | None = None) -> DataFrame:
    """Bucket by value at approximate quantiles: a bounded sketch comes to the driver, never rows.

    Equal values share a bucket, and larger values never lie in a lower one, so the sketch's error shifts load only.
    ``sketch_from`` is a cheaper table with the same column to take the quantiles from, such as rows not yet grouped.
    """
    buckets = buckets or value_buckets(df)
    probs = [i / buckets for i in range(1, buckets)]
    source = df if sketch_from is None else sketch_from
    numeric = source.select(F.col(column).cast("double").alias("v"))
    cuts = sorted(set(numeric.approxQuantile("v", probs, 1.0 / (2 * buckets))))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    value = f"_{name}_value"
    bucketizer = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol=name,
                            handleInvalid="keep")
    # never NULL: a join on a nullable bucket would push a filter below one of two equal shuffles, and so run both
    return bucketizer.transform(df.withColumn(value, F.col(column).cast("double"))).drop(value) \
        .withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1)))


def _with_offsets(df: DataFrame, groups: list[str], bucket: str, values: dict[str, Column],
                  order: list[Column], totals: bool) -> DataFrame:
    """Running sums of ``values`` by (groups, bucket, order); with totals also the sum of the whole group."""
    # NULL groups become a text of their own, so that windows and join agree on one partitioning: a null-safe join
    # would shuffle the rows a second time.
    keys = [f"_k{i}" for i in range(len(groups))]
    keyed = df.withColumns({k: F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for k, g in zip(keys, groups)})
    sums = keyed.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_o_{n}") for n, v in values.items()])
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    cols = [F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values]
    if totals:
        cols += [F.sum(f"_o_{n}").over(everything).alias(f"_t_{n}") for n in values]
    offsets = sums.select(*keys, bucket, *cols)

    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = keyed.select("*", *[F.sum(v).over(inside).alias(f"_l_{n}") for n, v in values.items()])
    joined = local.join(offsets, [*keys, bucket], "inner")
    out = [F.col(c) for c in df.columns if c != bucket]
    out += [(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in values]
    if totals:
        out += [F.col(f"_t_{n}").alias(f"{n}_total") for n in values]
    return joined.select(*out)


def rank_by_hash(df: DataFrame, groups: list[str], keys: list[str], seed=42, name: str = "rn",
                 digits: int | None = None) -> DataFrame:
    """1-based position in the group after a seeded shuffle, and ``<name>_total``, the size of the group.

    The order is that of md5(seed-key), then the key.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, *[F.col(k) for k in keys])) \
        .withColumn("_bucket", F.coalesce(F.substring("_h", 1, digits or hash_digits(df)), F.lit("")))
    order = [F.col("_h"), *[F.col(k) for k in keys]]
    return _with_offsets(hashed, groups, "_bucket", {name: F.lit(1).cast("bigint")}, order, True).drop("_h")


def running_totals(df: DataFrame, values: dict[str, Column], order: str, groups: list[str] = (),
                   ties: list[str] = (), descending: bool = False, totals: bool = False,
                   buckets: int | None = None, sketch_from: DataFrame | None = None) -> DataFrame:
    """Running sums in the order of a numeric column over the whole table or within groups."""
    if not groups:
        df, groups = df.withColumn("_all", F.lit(0)), ["_all"]
    bucketed = add_value_bucket(df, order, buckets=buckets, sketch_from=sketch_from)
    if descending:
        bucketed = bucketed.withColumn("_bucket", -F.col("_bucket"))
    first = F.col(order).desc() if descending else F.col(order).asc()
    out = _with_offsets(bucketed, list(groups), "_bucket", values, [first, *[F.col(t) for t in ties]], totals)
    return out.drop("_all")


def row_index(df: DataFrame, order: str, name: str = "idx", totals: bool = True) -> DataFrame:
    """0-based position in the order of a unique numeric column, and the number of rows."""
    out = running_totals(df, {name: F.lit(1).cast("bigint")}, order, totals=totals)
    return out.withColumn(name, F.col(name) - 1)


def index_range(df: DataFrame, order: str, start: int = 0, end: int | None = None, reverse: bool = False) -> DataFrame:
    """Rows [start, end) of the table, bounds clamped to it; reverse counts the position from the range's end (K6)."""
    indexed = row_index(df, order)
    low = F.greatest(F.lit(start), F.lit(0))
    high = F.least(F.lit(end), F.col("idx_total")) if end is not None else F.col("idx_total")
    kept = indexed.where((F.col("idx") >= low) & (F.col("idx") < high))
    position = (high - 1 - F.col("idx")) if reverse else (F.col("idx") - low)
    return kept.withColumn("position", position).drop("idx_total")


def equal_ranges(df: DataFrame, order: str, parts: int, name: str = "part") -> DataFrame:
    """Number of the equal share a row belongs to; the last share takes the remainder (K7)."""
    indexed = row_index(df, order)
    share = F.greatest(F.floor(F.col("idx_total") / F.lit(parts)), F.lit(1))
    return indexed.withColumn(name, F.least(F.floor(F.col("idx") / share), F.lit(parts - 1)).cast("int"))


# Cumulative frames at which each of the eight ranges ends.
FRAME_CAPACITIES = [720000, 1440000, 3600000, 5760000, 7920000, 10080000, 12240000, 14400000]


def capacity_ranges(df: DataFrame, order: str, weight: str | None, capacities=FRAME_CAPACITIES,
                    name: str = "work_range") -> DataFrame:
    """Number of the range whose capacity covers the running weight.

    Beyond the last bound ranges go on in steps of the last two bounds' distance, so every row has a range. Without a
    weight column the rows go to the ranges in equal counts, rounded up.
    """
    if weight is None:
        indexed = row_index(df, order)
        size = F.greatest(F.ceil(F.col("idx_total") / F.lit(len(capacities))), F.lit(1))
        return indexed.withColumn(name, F.floor(F.col("idx") / size).cast("int")).drop("idx", "idx_total")
    summed = running_totals(df, {"running": F.coalesce(F.col(weight), F.lit(0)).cast("bigint")}, order)
    last = capacities[-1]
    step = last - capacities[-2] if len(capacities) > 1 else last
    picked = (F.lit(len(capacities)) + F.floor((F.col("running") - last - 1) / step)).cast("int")
    for i in range(len(capacities) - 1, -1, -1):
        picked = F.when(F.col("running") <= capacities[i], F.lit(i)).otherwise(picked)
    return summed.withColumn(name, picked)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, at any number of rows per group.

    Values are counted first, then the two ranks each quantile lies between are looked up in the running counts.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    keys = list(groups) or ["_one"]
    clean = clean if groups else clean.withColumn("_one", F.lit(1))
    counts = clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, {"upto": F.col("_n")}, value, keys, totals=True, sketch_from=clean)
    v = F.col(value).cast("double")
    first = F.col("upto") - F.col("_n")

    def at(rank: Column) -> Column:
        return (first <= rank) & (rank < F.col("upto"))

    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("upto_total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        part = pos - low
        cols.append((F.sum(F.when(at(low), v * (F.lit(1.0) - part)))
                     + F.coalesce(F.sum(F.when(at(high) & (part > 0), v * part)), F.lit(0.0))).alias(name))
    out = ranked.groupBy(*keys).agg(*cols)
    return out if groups else out.drop("_one")


def _cover_cut(sizes: DataFrame, groups: list[str], bucket: str, n: Column) -> DataFrame:
    """(groups, _cut, _left) from (groups, bucket, _n): buckets below _cut are taken whole, of the cut _left rows are wanted.

    Groups with no more than n rows are not listed: they are taken whole. sizes has a row for each group and bucket.
    """
    keys = groups or ["_one"]
    sizes = sizes if groups else sizes.withColumn("_one", F.lit(0))
    order = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = sizes.withColumn("_upto", F.sum("_n").over(order)).where(F.col("_upto") > n)
    first = reached.groupBy(*keys).agg(F.min(F.struct(F.col(bucket).alias("cut"), (n - F.col("_upto") + F.col("_n")).alias("left")))
                                       .alias("_c"))
    return first.select(*groups, F.col("_c.cut").alias("_cut"), F.col("_c.left").alias("_left"))


def shuffled_sample(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """The n rows that come first in seeded random order (K8, D7), in no order.

    Rows are counted by the first digits of their hash. The counts tell up to which digits the n rows reach: what lies
    below is taken as it is, what lies above is filtered out, and only the rows of the cut itself, one in 4,096 or
    65,536 of the table, are exchanged and ranked. Nothing else moves, whether n is ten or the whole table. The table is
    read three times, and only its key for the counts.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(key)))
    digits = F.substring("_h", 1, hash_digits(df))
    sizes = hashed.groupBy(digits.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    found = _cover_cut(sizes, [], "_bucket", F.lit(n).cast("bigint"))
    cut, left = found.select("_cut").scalar(), found.select("_left").scalar()
    below = hashed.where(digits < F.coalesce(cut, F.lit("g")))  # beyond all digits: every row
    order = [F.col("_h"), F.col(key), *[F.col(c) for c in df.columns if c != key]]
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    at = hashed.withColumn("_bucket", digits).where(F.col("_bucket") == cut).withColumn("_rn", place) \
        .where(F.col("_rn") <= left)
    return below.drop("_h").unionByName(at.drop("_h", "_bucket", "_rn"))


def value_splitters(df: DataFrame, column: str, buckets: int | None = None, oversample: int = 16) -> list:
    """Values that cut an orderable column of any type into buckets of about as many distinct values each.

    The sample is the distinct values whose hash falls into one of m classes, so it is the same on any cluster; m is such
    that the driver gets about buckets x oversample values. Small tables send all their values.
    """
    buckets = buckets or value_buckets(df)
    distinct = df.agg(F.approx_count_distinct(column)).first()[0]
    share = max(1, distinct // (buckets * oversample))
    values = df.select(column).where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(share)) == 0)) \
        .distinct().orderBy(column)
    found = [r[0] for r in values.collect()]
    return found[::max(1, len(found) // buckets)][1:]


def splitter_bucket(column: str, splitters: list) -> Column:
    """How many splitters are no larger than the value, by binary search; 0 for no value."""
    if not splitters:
        return F.lit(0)
    cuts = F.array(*[F.lit(x) for x in splitters])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high"))

    def halve(at, _):
        middle = F.floor((at["low"] + at["high"]) / F.lit(2)).cast("int")
        more = F.get(cuts, middle) <= F.col(column)
        return F.when(at["low"] >= at["high"], at).when(more, F.struct((middle + 1).alias("low"), at["high"].alias("high"))) \
            .otherwise(F.struct(at["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    return F.coalesce(F.aggregate(steps, start, halve, lambda at: at["low"]), F.lit(0))


def order_index(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """0-based position in the order of a unique column of any orderable type; NULL comes first.

    Windows hold one range of values, the sizes of the ranges before are added.
    """
    bucketed = df.withColumn("_all", F.lit(0)).withColumn("_bucket", splitter_bucket(column, value_splitters(df, column)))
    out = _with_offsets(bucketed, ["_all"], "_bucket", {name: F.lit(1).cast("bigint")}, [F.col(column)], False)
    return out.withColumn(name, F.col(name) - 1).drop("_all")


#: A table of cuts, one row a class, is sent to all tasks up to so many rows; beyond, classes are joined by key.
SENT_CLASSES = 10_000


def first_per_class(df: DataFrame, label: str, order: str, k: int, enabled: bool = True) -> DataFrame:
    """The first k rows of every class by a column of any orderable type when test mode is on (K5).

    Rows are counted by class and range of the order. Ranges below the one in which a class reaches k rows are taken as
    they are, ranges above are filtered out before any exchange, and only rows of that range are ranked. Equal orders are
    told apart by the other columns; NULL orders come first; rows without a class go.
    """
    if not enabled:
        return df
    rows = df.where(F.col(label).isNotNull())
    rows = rows.withColumn("_bucket", splitter_bucket(order, value_splitters(rows, order)))
    sizes = materialize(rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
    cuts = _cover_cut(sizes, [label], "_bucket", F.lit(k).cast("bigint"))
    few = sizes.select(label).distinct().count() <= SENT_CLASSES
    known = rows.join(F.broadcast(cuts) if few else cuts, label, "left")
    below = known.where(F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")))
    ties = [F.col(order), *[F.col(c) for c in df.columns if c not in (order, label)]]
    at = known.where(F.col("_bucket") == F.col("_cut")) \
        .withColumn("_rn", F.row_number().over(W.partitionBy(label).orderBy(*ties))).where(F.col("_rn") <= F.col("_left"))
    return below.select(*df.columns).unionByName(at.select(*df.columns))
