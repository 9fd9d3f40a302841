"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidspark.functions.text import (GROUP_COLUMNS, LABEL_COLUMNS, URL_COLUMNS, find_column, label_from_number,
                                     label_from_text, url_parts)

# File names tried for the main metadata list, after the configured one.
MAIN_NAMES = ["metadata.csv", "labels.csv"]
FORMATS = ("parquet", "csv", "json")

METRICS_SCHEMA = "run_id string, timestamp string, step bigint, epoch int, phase string, metric string, value double"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return bool(fs.exists(hpath))


def size_of(spark: SparkSession, path: str) -> int:
    fs, hpath = _fs(spark, path)
    return int(fs.getContentSummary(hpath).getLength()) if fs.exists(hpath) else 0


def find_table(spark: SparkSession, base: str, name: str) -> str | None:
    """First non-empty file or folder ``base/name.<format>``, formats in order of preference (S3)."""
    for fmt in FORMATS:
        path = f"{base.rstrip('/')}/{name}.{fmt}"
        if size_of(spark, path) > 0:
            return path
    return None


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: tuple[str, ...] = ("label",),
             line_breaks: bool = False) -> DataFrame:
    """CSV with a header. Give a schema for large files; without one every column is read as text.

    Line breaks inside quotes must be asked for: such a file cannot be split among tasks.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks)
    df = (reader.schema(schema) if schema else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"CSV must contain the columns {missing}")
    return df


def read_table(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame | None:
    """Reads what find_table finds, None when there is nothing."""
    path = find_table(spark, base, name)
    if path is None:
        return None
    fmt = path.rsplit(".", 1)[1]
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return read_csv(spark, path, schema, required=())
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and broken ones are skipped."""
    return spark.read.schema(METRICS_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def read_fold_results(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """``base/<model>/fold_results.csv`` of all models, with the model's name from its folder."""
    df = spark.read.option("header", True).schema(schema).csv(f"{base.rstrip('/')}/*/fold_results.csv")
    return df.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/fold_results\.csv", 1))


def read_fold_logs(spark: SparkSession, base: str) -> DataFrame:
    """``base/<model>/fold_<k>/metrics.jsonl`` of all models and folds."""
    df = read_metrics(spark, f"{base.rstrip('/')}/*/fold_*/metrics.jsonl")
    path = F.col("_metadata.file_path")
    return df.withColumns({"model": F.regexp_extract(path, r"([^/]+)/fold_\d+/metrics\.jsonl", 1),
                           "fold": F.regexp_extract(path, r"/fold_(\d+)/metrics\.jsonl", 1).cast("int")})


def _labels(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    return label_from_text(F.col(column)) if isinstance(kind, T.StringType) else label_from_number(F.col(column))


def main_metadata(df: DataFrame) -> DataFrame:
    """(video_id, label, subset, platform) from a list of URLs; rows whose URL gives no id are dropped."""
    url, label = find_column(df.columns, URL_COLUMNS), find_column(df.columns, LABEL_COLUMNS)
    subset = F.col("subset") if "subset" in df.columns else F.lit(None).cast("string")
    return df.select(url_parts(F.col(url)).alias("_u"), _labels(df, label).alias("label"), subset.alias("subset")) \
        .where(F.col("_u.video_id").isNotNull()) \
        .select("_u.video_id", "label", "subset", "_u.platform")


def copies_metadata(df: DataFrame) -> DataFrame:
    """(video_id, dup_group, label, platform) from the list of copies."""
    url, label = find_column(df.columns, URL_COLUMNS), find_column(df.columns, LABEL_COLUMNS)
    group = find_column(df.columns, GROUP_COLUMNS)
    return df.select(url_parts(F.col(url)).alias("_u"), F.col(group).alias("dup_group"), _labels(df, label).alias("label")) \
        .where(F.col("_u.video_id").isNotNull()) \
        .select("_u.video_id", "dup_group", "label", "_u.platform")


def load_main_metadata(spark: SparkSession, folder: str, name: str = "metadata.csv", schema: str | None = None) -> DataFrame:
    for candidate in [name, *MAIN_NAMES]:
        path = f"{folder.rstrip('/')}/{candidate}"
        if exists(spark, path):
            return main_metadata(read_csv(spark, path, schema, required=()))
    raise FileNotFoundError(f"no metadata list in {folder}; tried {[name, *MAIN_NAMES]}")


def load_duplicates(spark: SparkSession, folder: str, name: str = "duplicates.csv", schema: str | None = None) -> DataFrame:
    """The list of copies, an empty table when there is none."""
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, path):
        return spark.createDataFrame([], "video_id string, dup_group string, label int, platform string")
    return copies_metadata(read_csv(spark, path, schema, required=()))
