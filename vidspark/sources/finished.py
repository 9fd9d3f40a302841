"""Keys of finished work, bucketed, so that a resumed run moves only its new rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def resume_key(*parts: Column) -> Column:
    """One text for a key of several parts; missing parts are a value of their own."""
    return F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])


@dataclass
class FinishedWork:
    """A growing Parquet table of finished rows, dealt to buckets by their resume key.

    Joins by that key read the table bucket by bucket where it lies: the new rows are exchanged to its buckets, the
    finished ones never are, however many there are. The catalog entry only names the folder and its buckets; any session
    that is given the same folder, columns and bucket count sees the same table.
    """

    spark: SparkSession
    path: str
    columns: str
    keys: list[str]
    buckets: int = BUCKETS
    name: str = field(default_factory=lambda: f"finished_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self.spark.sql(f"CREATE TABLE {self.name} ({self.columns}, resume_key STRING) USING parquet "
                       f"CLUSTERED BY (resume_key) SORTED BY (resume_key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def add(self, rows: DataFrame) -> None:
        """Appends rows; one file a bucket."""
        keyed = rows.withColumn("resume_key", resume_key(*[F.col(k) for k in self.keys]))
        names = [f.name for f in self.spark.table(self.name).schema]
        keyed.select(*names).repartition(self.buckets, "resume_key").write.mode("append").insertInto(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _joined(self, rows: DataFrame, how: str, done: DataFrame) -> DataFrame:
        keyed = rows.withColumn("_resume", resume_key(*[F.col(k) for k in self.keys]))
        return keyed.join(done, F.col("_resume") == F.col("resume_key"), how).drop("_resume")

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not finished."""
        return self._joined(rows, "left_anti", self.table().select("resume_key"))

    def lacking(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows whose key has been finished fewer than n times (J7); counted inside the buckets."""
        full = self.table().groupBy("resume_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
        return self._joined(rows, "left_anti", full.select("resume_key"))

    def marked(self, rows: DataFrame, flag: str) -> DataFrame:
        """Every row with whether its key is finished."""
        done = self.table().groupBy("resume_key").agg(F.lit(True).alias(flag))
        return self._joined(rows, "left", done).drop("resume_key").withColumn(flag, F.coalesce(flag, F.lit(False)))

    def known_or(self, rows: DataFrame, columns: list[str], work) -> DataFrame:
        """(keys, columns, from_cache): stored columns where the key is finished, those of ``work`` on the rest.

        Of a key finished twice one row is taken, the largest. ``work`` maps rows to rows with the columns.
        """
        newest = self.table().groupBy("resume_key").agg(F.max(F.struct(*columns)).alias("_c"))
        hits = self._joined(rows.select(*self.keys), "inner", newest) \
            .select(*self.keys, "_c.*", F.lit(True).alias("from_cache"))
        misses = work(self.missing(rows)).select(*self.keys, *columns, F.lit(False).alias("from_cache"))
        return hits.unionByName(misses)

    def forget(self) -> None:
        """Drops the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
