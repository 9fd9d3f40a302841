"""Table sinks (S12-S19). Every table goes through Spark's commit protocol, single files through the one of write_files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.operators.merging import merge_keep
from vidspark.session import materialize
from vidspark.sources.listing import arrow_reads, opened, qualified
from vidspark.sources.readers import _fs, exists

#: Names that a broadcast holds at most.
FEW = 10_000


def write_metadata(df: DataFrame, path: str, append: bool = False, keys: list[str] = ("video_path",)) -> None:
    """Overwrite, or merge so that the newest row per key stays.

    The merged table is written beside the old one and takes its place only when it is complete.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    if append and exists(spark, path):
        df = merge_keep(spark.read.parquet(path), df, list(keys), keep="latest")
    df.write.parquet(staged)
    fs, target = _fs(spark, path)
    old = None
    if fs.exists(target):
        old = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
        fs.rename(target, old)
    if not fs.rename(_fs(spark, staged)[1], target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"could not put {staged} in place of {path}")
    if old is not None:
        fs.delete(old, True)


def write_features(df: DataFrame, path: str, stage: str = "stage", rows_per_file: int = 1_000_000) -> None:
    """One Snappy dataset, a folder per stage, few large files."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy") \
        .partitionBy(stage).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, read back alone or together."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_manifest(df: DataFrame, base: str, name: str = "video_index_input") -> None:
    """The manifest as CSV and as JSON records."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{base}/{name}.csv")
    df.write.mode("overwrite").json(f"{base}/{name}.json")


def write_files(rows: DataFrame, path: str, key: str, value: str) -> None:
    """A text file ``<key>=<its value>.txt`` per key, with a line for each of its rows.

    Spark's writer spends some 20 ms on a file: a folder, a checksum and a process that sets permissions for each, and a
    rename of each by the driver. Here a task writes its files through Arrow into a hidden folder; the folders of the tasks
    that ended well, one a task, get their names when all have. Only rows whose key repeats are exchanged. Keys are escaped
    as for a URL, NULL and empty ones named as Spark names them. A file system that Arrow does not know is left to Spark's
    writer, which makes a folder ``<key>=<its value>`` per key.
    """
    spark, path = rows.sparkSession, qualified(rows.sparkSession, path)
    if not arrow_reads(spark, path):
        rows.select(key, F.col(value).alias("value")).repartition(key).write.partitionBy(key).text(path)
        return
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    named = rows.select(name.alias("name"), F.col(value).alias("value"))
    repeated = materialize(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")
    n = repeated.count()
    some = F.broadcast(repeated) if n <= FEW else repeated
    dealt = [named.join(some, "name", "left_anti"), named.join(some, "name", "left_semi").repartition("name").sortWithinPartitions("name")]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, out, last = f"{path}/.staged-{uuid.uuid4().hex}", None, None
        system, inside = opened(folder)
        for batch in batches:
            for this, text in zip(batch["name"].to_pylist(), batch["value"].cast(pa.binary()).to_pylist()):
                if this != last:
                    if out is None:
                        system.create_dir(inside)
                    else:
                        out.close()
                    out, last = system.open_output_stream(f"{inside}/{key}={quote(this, safe='')}.txt", compression=None), this
                out.write((text or b"") + b"\n")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([folder])], ["folder"])

    fs, base = _fs(spark, path)
    fs.mkdirs(base)
    done = [r["folder"] for part in (dealt if n else [named]) for r in part.mapInArrow(written, "folder string").collect()]
    for k, folder in enumerate(done):  # one a task
        if not fs.rename(_fs(spark, folder)[1], _fs(spark, f"{path}/part-{k:05d}")[1]):
            raise OSError(f"could not rename {folder}")


def append_metrics(rows: DataFrame, path: str) -> None:
    """(run_id, step, epoch, phase, metric, value) rows to the log, time-stamped."""
    rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) \
        .write.mode("append").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """A result table as one CSV file; result tables have a row per model."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def validation_cache(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts kept so far, newest per path; empty at first."""
    schema = "video_path string, options string, is_valid boolean, error_reason string, cache_timestamp bigint"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    cache = spark.read.schema(schema).parquet(path)
    newest = F.max_by(F.struct("is_valid", "error_reason", "cache_timestamp"), "cache_timestamp")
    return cache.groupBy("video_path", "options").agg(newest.alias("_v")).select("video_path", "options", "_v.*")


def save_verdicts(verdicts: DataFrame, path: str, options: str) -> None:
    """Appends verdicts under their options. Keys are per row: no list of all paths is ever built."""
    verdicts.select("video_path", F.lit(options).alias("options"), "is_valid",
                    F.coalesce("error_reason", F.lit("")).alias("error_reason"),
                    F.lit(int(time.time())).cast("bigint").alias("cache_timestamp")).write.mode("append").parquet(path)


def register_version(spark: SparkSession, path: str, kind: str, name: str, config_hash: str, location: str,
                     meta: dict[str, str]) -> None:
    """One more row in the registry of splits and augmentations."""
    row = [(kind, name, config_hash, location, int(time.time()), {k: str(v) for k, v in meta.items()})]
    schema = "kind string, name string, config_hash string, path string, ts bigint, meta map<string,string>"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)
