"""Unions, de-duplication and resume joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.functions.text import augmented_name_parts, clip_id, scaled_name, stem


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Only one row per key and task goes through the shuffle, so a hot key does no harm."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def concat_rows(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_group_copies(df: DataFrame, group: str = "dup_group", order: str = "video_id",
                      null_is_group: bool = False) -> DataFrame:
    """First row per group. Rows without a group are no copies of each other and all stay, unless asked otherwise."""
    total = [F.col(order), *[F.col(c) for c in df.columns if c not in (group, order)]]
    if null_is_group:
        return one_per_key(df, [group], total)
    # a row without a group is a group of its own: one pass over the input
    alone = F.when(F.col(group).isNull(), F.monotonically_increasing_id())
    return one_per_key(df.withColumn("_alone", alone), [group, "_alone"], total).drop("_alone")


def group_representatives(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The columns of the row with the smallest ``order`` per group (M3), combined on the map side."""
    best = F.min_by(F.struct(*columns), F.col(order)).alias("_best")
    return df.groupBy(group).agg(best).select(group, *[F.col(f"_best.{c}").alias(c) for c in columns])


def merge_keep(existing: DataFrame, new: DataFrame, keys: list[str], keep: str = "existing") -> DataFrame:
    """Union in which one side wins on equal keys.

    ``existing``: resumed runs add only what is missing. ``latest``: rewritten rows replace the old ones.
    """
    if keep == "existing":
        return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    if keep != "latest":
        raise ValueError(f"keep must be 'existing' or 'latest', not {keep!r}")
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in both.columns if c not in (*keys, "_gen")]  # ties inside a side end alike in every run
    return one_per_key(both, keys, [F.col("_gen").desc(), *rest]).drop("_gen")


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those done. Keys may be NULL, and equal NULLs match."""
    wanted = done.select(*[F.col(k).alias(f"_d_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(wanted[f"_d_{k}"]) for k in keys])
    return rows.join(wanted, same, "left_anti")


def missing_augmentations(videos: DataFrame, stage1: DataFrame, n: int) -> DataFrame:
    """Videos that do not yet have n augmented clips."""
    complete = stage1.where(F.col("augmentation_idx") >= 0) \
        .groupBy(clip_id(F.col("original_video")).alias("_clip")).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") >= n)
    return videos.withColumn("_clip", clip_id(F.col("video_path"))).join(complete, "_clip", "left_anti").drop("_clip")


def scaling_state(clips: DataFrame, scaled: DataFrame) -> DataFrame:
    """Every clip with its output name and whether that output exists."""
    out_name = scaled_name(F.col("video_path"), F.col("augmentation_idx"), F.col("is_original"))
    done = scaled.select(F.concat(stem(F.col("video_path")), F.lit(".mp4")).alias("output_name")).distinct() \
        .withColumn("is_complete", F.lit(True))
    return clips.withColumn("output_name", out_name).join(done, "output_name", "left") \
        .withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))


def cached_verdicts(rows: DataFrame, cache: DataFrame, validate, key: str = "video_path") -> DataFrame:
    """Verdicts from the cache where it has one, from ``validate`` for the rest."""
    verdict = [key, "is_valid", "error_reason"]
    hits = cache.select(*verdict).join(rows.select(key), key, "left_semi").withColumn("from_cache", F.lit(True))
    misses = validate(rows.join(cache.select(key), key, "left_anti")).select(*verdict) \
        .withColumn("from_cache", F.lit(False))
    return hits.unionByName(misses)


def rebuilt_stage1(files: DataFrame, index: DataFrame, existing: DataFrame) -> DataFrame:
    """Stage-1 rows derived from file names and the index, for files the table does not list yet."""
    parsed = files.withColumn("_s", stem(F.col("video_path"))).withColumn("_p", augmented_name_parts(F.col("_s"))) \
        .where(F.col("_p").isNotNull()).select("video_path", "_p.*")
    known = one_per_key(index.select(clip_id(F.col("video_path")).alias("video_id"), "label",
                                     F.col("video_path").alias("original_video")), ["video_id"],
                        [F.col("original_video").desc()])
    rows = parsed.join(known, "video_id").select("video_path", "label", "original_video", "augmentation_idx",
                                                 "is_original")
    return unprocessed(rows, existing, ["video_path"])


def referenced_files(rows: DataFrame, listing: DataFrame, column: str, suffix: str = ".mp4") -> DataFrame:
    """Each row with ``file_found``: the listing has its file, with or without the suffix."""
    names = F.when(F.col(column).endswith(suffix), F.array(F.col(column))) \
        .otherwise(F.array(F.col(column), F.concat(F.col(column), F.lit(suffix))))
    tries = rows.select(column).where(F.col(column).isNotNull()).distinct() \
        .select(column, F.explode(names).alias("path"))
    found = tries.join(listing.select("path"), "path", "left_semi").select(column).distinct() \
        .withColumn("file_found", F.lit(True))
    return rows.join(found, column, "left").withColumn("file_found", F.coalesce("file_found", F.lit(False)))


def file_consistency(rows: DataFrame, listing: DataFrame, column: str, suffix: str = ".mp4") -> DataFrame:
    """One row: how many referenced files were found or are missing."""
    state = referenced_files(rows, listing, column, suffix)
    return state.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("file_found").alias("files_found"),
                     F.count_if(~F.col("file_found")).alias("files_missing")) \
        .withColumn("is_consistent", F.col("files_missing") == 0)


def existing_paths(rows: DataFrame, listing: DataFrame, candidates: Column, key: str) -> DataFrame:
    """Rows with a file at one of their candidate paths, and the first such path."""
    tries = rows.select(key, F.posexplode(candidates).alias("_pos", "path"))
    hits = tries.join(listing.select("path"), "path", "left_semi") \
        .groupBy(key).agg(F.min_by("path", "_pos").alias("resolved_path"))
    return rows.join(hits, key)


def resolved_paths(rows: DataFrame, listing: DataFrame, candidates: Column, key: str) -> DataFrame:
    """All rows; where no candidate exists the likeliest one is given."""
    found = existing_paths(rows.select(key, candidates.alias("_c")), listing, F.col("_c"), key) \
        .select(key, "resolved_path")
    return rows.withColumn("_first", F.get(candidates, F.lit(0))).join(found, key, "left") \
        .withColumn("resolved_path", F.coalesce("resolved_path", "_first")).drop("_first")


def leaked_groups(assigned: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split (M5); empty for a sound split."""
    return assigned.where(F.col(group).isNotNull()).groupBy(group) \
        .agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where(F.col("_a") != F.col("_b")).select(group)


def coverage(all_rows: DataFrame, split_rows: DataFrame, key: str) -> DataFrame:
    """One row: keys lost and keys added by a split (M7); both 0 for a sound split."""
    both = all_rows.select(key, F.lit(1).alias("n")).unionByName(split_rows.select(key, F.lit(-1).alias("n")))
    left = both.groupBy(key).agg(F.sum("n").alias("n"))
    return left.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("lost"),
                    F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("added"))


def training_rows(folded: DataFrame, keys: list[str], k: int, fold: str = "fold") -> DataFrame:
    """Rows that train in any fold, once each (M2). Every row trains in the k-1 folds it is not held out of."""
    if k < 2:
        return folded.where("false")
    return one_per_key(folded, keys, [F.col(fold)])


def last_values(log: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Last value per key in log order (W6); combined on the map side."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value))
