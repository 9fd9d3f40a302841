"""A Parquet table that merges new rows by key and rewrites only what they touch.

Rows lie in parts by a hash of their key. A merge reads and rewrites the parts that new rows fall into, under a new
generation; the other parts keep their files. Which generation of each part counts is said by the newest pointer, a small
file with a line for each part that is created once and never changed. So a reader sees one whole version, a writer that
fails leaves nothing behind that counts, and of two writers that start from one version the second fails and may try again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vidspark.operators.merging import merge_keep
from vidspark.sources.readers import _fs, exists

PARTS = 64


class Conflict(RuntimeError):
    """Another writer has put out the version that this one was about to."""


@dataclass
class MergedTable:
    spark: SparkSession
    path: str
    keys: list[str]
    parts: int = PARTS

    def _pointers(self) -> list[int]:
        folder = f"{self.path}/_versions"
        if not exists(self.spark, folder):
            return []
        fs, hpath = _fs(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(hpath)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The newest version's number (0: none yet) and what it says: schema, and the folder of each part."""
        known = self._pointers()
        number = version if version is not None else (known[-1] if known else 0)
        if not number:
            return 0, {"schema": None, "parts": {}}
        text = self.spark.read.text(f"{self.path}/_versions/{number:08d}.json", wholetext=True).head()[0]
        return number, json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version)[1], None)

    def _rows(self, said: dict, wanted: set[int] | None) -> DataFrame:
        if said["schema"] is None:
            raise FileNotFoundError(f"nothing has been merged into {self.path}")
        schema = StructType.fromJson(said["schema"])
        folders = [f"{self.path}/{f}" for p, f in said["parts"].items() if wanted is None or int(p) in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def merge(self, rows: DataFrame) -> int:
        """Puts rows in; they replace those with the same key. Equal keys among the new rows: the largest row stays.

        Returns the new version. New rows are written once, by part, and merged from there.
        """
        number, said = self.state()
        generation = f"gen={uuid.uuid4().hex}"
        new = f"{self.path}/_new/{generation}"
        rows.withColumn("_part", self._part()).repartition("_part").write.partitionBy("_part").parquet(new)
        fresh = self.spark.read.schema(f"{_ddl(rows)}, _part int").parquet(new)
        touched = {r["_part"] for r in fresh.select("_part").distinct().collect()}  # at most one number a part
        if not touched and said["schema"] is not None:
            return number
        schema = said["schema"] or json.loads(rows.schema.json())
        if touched:
            old = self._rows(said, touched) if said["schema"] else fresh.drop("_part").limit(0)
            both = merge_keep(old, fresh.drop("_part"), self.keys, keep="latest")
            schema = json.loads(both.schema.json())
            both.withColumn("_part", self._part()).repartition(len(touched), "_part").write.partitionBy("_part") \
                .parquet(f"{self.path}/{generation}")
        parts = said["parts"] | {str(p): f"{generation}/_part={p}" for p in sorted(touched)}
        self._put_out(number + 1, {"schema": schema, "parts": parts})
        return number + 1

    def _put_out(self, number: int, said: dict) -> None:
        fs, target = _fs(self.spark, f"{self.path}/_versions/{number:08d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:  # noqa: BLE001  the file system's own exception, by way of the JVM
            raise Conflict(f"version {number} of {self.path} is there already") from e
        out.write(bytearray(json.dumps(said).encode()))
        out.close()


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
