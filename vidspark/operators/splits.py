"""Stratified, grouped, deterministic splits and samples."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.functions.hashing import seeded_hash, uniform
from vidspark.operators.merging import group_representatives
from vidspark.operators.ranking import hash_digits, rank_by_hash
from vidspark.session import materialize


@dataclass(frozen=True)
class SplitConfig:
    train_size: float = 0.7
    val_size: float = 0.2
    test_size: float = 0.1
    seed: int = 42


def strata_key(label: str = "label", platform: str | None = "platform") -> Column:
    """NULL is a value of its own, so that (NULL, a) and (a, NULL) stay apart."""
    names = [label] + ([platform] if platform else [])
    return F.concat_ws("__", *[F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in names])


def _units(df: DataFrame, key: str, label: str, platform: str | None, group: str | None) -> DataFrame:
    """What is shuffled: groups of copies by their first row's stratum; a row without a group is a unit of its own, and
    rows without key and group are one unit."""
    strata = strata_key(label, platform).alias("stratum")
    keyed = df.select(_unit(key, group).alias("unit"), F.col(key), strata)
    return group_representatives(keyed, "unit", key, ["stratum"])


def _unit(key: str, group: str | None) -> Column:
    alone = F.coalesce(F.concat(F.lit("r:"), F.col(key).cast("string")), F.lit("r"))
    if group is None:
        return alone
    return F.when(F.col(group).isNotNull(), F.concat(F.lit("g:"), F.col(group).cast("string"))).otherwise(alone)


def _assign(df: DataFrame, key: str, group: str | None, units: DataFrame, column: str) -> DataFrame:
    return df.withColumn("unit", _unit(key, group)).join(units.select("unit", column), "unit").drop("unit")


def train_val_test(df: DataFrame, key: str, label: str = "label", platform: str | None = "platform",
                   group: str | None = "dup_group", cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Adds ``split``. Sizes per stratum are rounded half to even; train comes first, then val, then test."""
    ranked = rank_by_hash(_units(df, key, label, platform, group), ["stratum"], ["unit"], cfg.seed)
    n = F.col("rn_total").cast("double")
    n_test = F.bround(n * cfg.test_size)
    n_val = F.bround(n * cfg.val_size)
    n_train = F.col("rn_total") - n_test - n_val
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return _assign(df, key, group, ranked.withColumn("split", split), "split")


def stratified_folds(df: DataFrame, key: str, k: int = 5, label: str = "label", platform: str | None = "platform",
                     group: str | None = "dup_group", seed: int = 42, repair: bool = True) -> DataFrame:
    """Adds ``fold``, 0 .. k-1, round robin inside each stratum (D2); empty folds are filled (D3)."""
    strata = _units(df, key, label, platform, group)
    ranked = rank_by_hash(strata, ["stratum"], ["unit"], seed)
    units = ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int"))
    if repair:
        units = fill_empty_folds(units, strata, k)
    return _assign(df, key, group, units, "fold")


def fill_empty_folds(units: DataFrame, strata: DataFrame, k: int) -> DataFrame:
    """Moves one whole unit into each empty fold, always out of the fullest fold (D3).

    Fold i gets a unit from every stratum with more than i units, so a fold is empty only if all strata have fewer
    than k. Then no stratum has two units in a fold, and (stratum, fold) names a unit. At most k units move, each the
    last of its fold in the order of strata, so k strata of each size are enough to name them, however many there are.
    """
    sizes = strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(k))).scalar()
    last = F.row_number().over(W.partitionBy("n").orderBy(F.col("stratum").desc()))
    few = sizes.where(largest < k).withColumn("_rn", last).where(F.col("_rn") <= k)
    named = few.agg(F.collect_list("stratum").alias("_s"), F.collect_list("n").alias("_n"))
    members = sizes.agg(F.array(*[F.count_if(F.col("n") > i) for i in range(k)])).scalar()
    moves = named.select(_refill_moves(k)(F.col("_s"), F.col("_n"), members).alias("_m")).scalar()
    place = F.concat_ws("\x00", F.col("stratum"), F.col("fold").cast("string"))
    return units.withColumn("fold", F.coalesce(F.try_element_at(moves, place), F.col("fold")))


def _refill_moves(k: int):
    """UDF for the one row of strata named above: '<stratum>\\0<fold>' to the fold the unit goes to."""
    @F.udf("map<string,int>")
    def moves(strata, sizes, members):
        if not strata:
            return None
        fill = list(members)
        names = [sorted(s for s, n in zip(strata, sizes) if n > i)[-k:] for i in range(k)]
        out = {}
        for target in [i for i in range(k) if not fill[i]]:
            donor = max(range(k), key=lambda i: fill[i])
            if fill[donor] < 2:
                break
            out[f"{names[donor].pop()}\x00{donor}"] = target
            fill[donor] -= 1
            fill[target] += 1
        return out
    return moves


def two_cut_split(df: DataFrame, key: str, label: str = "label", train: float = 0.6, val: float = 0.2,
                  test: float = 0.2, seed: int = 42) -> DataFrame:
    """60/20/20 by label: first train against the rest, then the rest in two."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError(f"ratios must sum to 1.0, got {train + val + test}")
    if not all(0 < r < 1 for r in (train, val, test)):
        raise ValueError("ratios must lie between 0 and 1")
    ranked = rank_by_hash(df, [label], [key], seed)
    n_rest = F.bround(F.col("rn_total").cast("double") * (val + test))
    n_test = F.bround(n_rest * (test / (val + test)))
    n_train = F.col("rn_total") - n_rest
    split = F.when(F.col("rn") <= n_train, "train") \
        .when(F.col("rn") <= n_train + n_rest - n_test, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rn", "rn_total")


def stratified_sample(df: DataFrame, key: str, label: str = "label", fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``in_sample``: exactly round(n * fraction) rows of every class (D5); the others are the holdout's rest."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1, got {fraction}")
    ranked = rank_by_hash(df, [label], [key], seed)
    return ranked.withColumn("in_sample", F.col("rn") <= F.bround(F.col("rn_total").cast("double") * fraction)) \
        .drop("rn", "rn_total")


def search_fraction(fraction: float) -> float:
    """The share of rows a parameter search may take: 0.05 to 0.5."""
    return min(max(fraction, 0.05), 0.5)


def balanced_batches(df: DataFrame, key: str, label: str = "label", batch_size: int = 8,
                     samples_per_class: int | None = None, seed: int = 42) -> DataFrame:
    """Adds ``batch``; every batch has the same number of rows of both classes, rows beyond the last one drop out."""
    if batch_size % 2:
        raise ValueError(f"batch_size must be even, got {batch_size}")
    two = df.where(F.col(label).isin(0, 1))
    wanted = samples_per_class or batch_size // 2
    ranked = rank_by_hash(two, [label], [key], seed)
    sizes = two.agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("smallest"))
    smallest = sizes.scalar()
    per_class = F.least(F.lit(wanted).cast("bigint"), smallest)
    batch = F.floor((F.col("rn") - 1) / F.nullif(per_class, F.lit(0).cast("bigint")))
    return ranked.withColumn("batch", batch) \
        .where(F.col("batch") < F.floor(smallest / F.nullif(per_class, F.lit(0).cast("bigint")))) \
        .drop("rn", "rn_total")


def fold_balance(folded: DataFrame, label: str = "label", limit: float = 0.2) -> DataFrame:
    """Share of every class in training and validation rows per fold, with what is wrong."""
    cells = folded.groupBy("fold", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    row = cells.agg(F.collect_list(F.struct("fold", "label", "n")).alias("_c"))  # folds x labels entries
    grid = row.withColumn("fold", F.explode(F.array_distinct(F.col("_c.fold")))) \
        .withColumn("label", F.explode(F.array_distinct(F.col("_c.label"))))

    def total(test) -> Column:
        return F.aggregate(F.filter("_c", test), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])

    counted = grid.select(
        "fold", "label", total(lambda c: c["n"] >= 0).alias("_all"),
        total(lambda c: c["fold"] == F.col("fold")).alias("_fold"),
        total(lambda c: c["label"].eqNullSafe(F.col("label"))).alias("_label"),
        total(lambda c: (c["fold"] == F.col("fold")) & c["label"].eqNullSafe(F.col("label"))).alias("val_count"))
    train, rest = F.col("_label") - F.col("val_count"), F.col("_all") - F.col("_fold")
    train_share = F.when(rest > 0, train.cast("double") / F.when(rest > 0, rest)).otherwise(0.0)
    val_share = F.col("val_count").cast("double") / F.col("_fold")
    verdict = F.when(train == 0, "missing in training").when(F.col("val_count") == 0, "missing in validation") \
        .when(F.abs(train_share - val_share) > limit, "imbalanced").otherwise("ok")
    return counted.select("fold", F.col("label").alias(label), train.alias("train_count"), "val_count",
                          train_share.alias("train_share"), val_share.alias("val_share"), verdict.alias("verdict"))


def weighted_draws(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are rows, each class as likely as its weight says.

    All rows of a class weigh the same, so a draw picks the class, then a position in it: an equality join on
    (class, position) instead of a range join over cumulative weights.
    """
    from vidspark.operators.metrics import class_weights

    classes = class_weights(df, label).orderBy(label).collect()  # one row per class
    total = sum(c["weight"] * c["n"] for c in classes)
    bounds = [b / total for b in accumulate(c["weight"] * c["n"] for c in classes)][:-1]
    rows = df.where(F.col(label).isNotNull())
    draws = rows.select(F.col(key).alias("draw"), uniform(f"{seed}-class", F.col(key)).alias("_u1"),
                        uniform(f"{seed}-row", F.col(key)).alias("_u2"))
    place = F.lit(1)
    for bound in bounds:
        place = place + (F.col("_u1") >= F.lit(bound)).cast("int")
    size = F.element_at(F.array(*[F.lit(c["n"]) for c in classes]), place)
    chosen = draws.select("draw", F.element_at(F.array(*[F.lit(c[label]) for c in classes]), place).alias(label),
                          F.least(F.floor(F.col("_u2") * size) + 1, size).alias("rn"))
    ranked = rank_by_hash(rows, [label], [key], f"{seed}-rows")
    return chosen.join(ranked.select(label, "rn", key), [label, "rn"]).select("draw", F.col(key), label)


#: Weights are counted in so many units per 1, as whole numbers, so that sums are exact in any order.
WEIGHT_UNITS = 10 ** 9


def row_weighted_draws(df: DataFrame, key: str, weight: str, seed: int = 42, units: int = WEIGHT_UNITS) -> DataFrame:
    """As many draws with replacement as there are rows, each row as likely as its weight says.

    Rows lie one after the other in the order of a hash, each as long as its weight; a draw is a place on that line.
    Hash digits cut the line into buckets, whose lengths are added up in a table of one row a bucket; a draw finds its
    bucket through a grid of as many cells, a table of at most twice as many rows, and its row inside by the last one
    before it among the sorted places of rows and draws, so the interval join is a sort. A bucket that draws more than its share, one with a row of a third of all weight, is dealt
    to several tasks, its rows to each of them and its draws to one: at most twice the rows in all.

    Weights are rounded to whole units; rows whose weight is null, NaN, negative or rounds to 0 draw, but are never drawn.
    Returns (draw, key): the drawing row's key and the drawn one's. No weight at all: no row.
    """
    rows = df.select(F.col(key).alias("_key"), F.round(F.col(weight).cast("double") * F.lit(float(units))).alias("_w"))
    drawn = rows.where((F.col("_w") >= 1) & ~F.isnan("_w")).select("_key", F.col("_w").cast("decimal(38,0)").alias("_w")) \
        .withColumn("_h", seeded_hash(f"{seed}-line", F.col("_key")))
    digits = hash_digits(df)
    drawn = materialize(drawn.withColumn("_bucket", F.substring("_h", 1, digits)), "line")
    sizes = drawn.groupBy("_bucket").agg(F.sum("_w").alias("_size"))
    upto = F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    line = sizes.withColumn("_upto", upto)  # a row for each bucket of the hash
    total = line.agg(F.max("_upto").cast("double")).scalar()
    cells = 16 ** digits

    def cell(place: Column) -> Column:
        return F.least(F.floor(place / total * F.lit(cells)), F.lit(cells - 1)).cast("int")

    salts = F.greatest(F.lit(1), F.ceil(F.col("_size").cast("double") / total * F.lit(cells))).cast("int")
    table = line.select("_bucket", (F.col("_upto") - F.col("_size")).alias("_before"), "_upto", salts.alias("_salts"))
    low, high = F.col("_before").cast("double"), F.col("_upto").cast("double")
    grid = table.select("_bucket", "_salts", low.alias("_from"), high.alias("_to"),
                        F.explode(F.sequence(cell(low), cell(high))).alias("_cell"))  # two rows a cell at most on average

    draws = rows.select("_key", (uniform(f"{seed}-place", F.col("_key")) * total).alias("_place")) \
        .withColumn("_cell", cell(F.col("_place"))).join(F.broadcast(grid), "_cell") \
        .where((F.col("_from") <= F.col("_place")) & (F.col("_place") < F.col("_to"))).select(
        "_bucket", F.pmod(F.xxhash64("_key"), F.col("_salts")).cast("int").alias("_salt"), "_place",
        F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_h"), F.col("_key").alias("draw"),
        F.lit(None).cast(df.schema[key].dataType).alias("_row"))

    inside = W.partitionBy("_bucket").orderBy("_h", "_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = drawn.withColumn("_in", F.sum("_w").over(inside)).join(F.broadcast(table), "_bucket")
    laid = laid.select("_bucket", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
                       (F.col("_before") + F.col("_in") - F.col("_w")).cast("double").alias("_place"), F.lit(0).alias("_kind"),
                       "_h", F.lit(None).cast(df.schema[key].dataType).alias("draw"), F.col("_key").alias("_row"))
    merged = W.partitionBy("_bucket", "_salt").orderBy("_place", "_kind", "_h", "_row") \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_row")), ignorenulls=True).over(merged)
    return draws.unionByName(laid).withColumn("_hit", last).where("_kind = 1") \
        .select("draw", F.col("_hit._row").alias(key))

