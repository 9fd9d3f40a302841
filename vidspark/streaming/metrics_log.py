"""The metrics log as a file stream: each run takes the new files once, like the batch resume joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vidspark.sources.readers import METRICS_SCHEMA


def metrics_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(METRICS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger) \
        .option("mode", "DROPMALFORMED").json(path)


def ingest_new(spark: SparkSession, log: str, table: str, checkpoint: str) -> None:
    """Appends what is new in the log to a Parquet table, exactly once, and returns."""
    metrics_stream(spark, log).writeStream.format("parquet").option("path", table) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
