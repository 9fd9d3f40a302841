"""File listings as tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.session import materialize
from vidspark.sources.readers import _fs

# Names a clip may have inside its folder, best first.
VIDEO_NAMES = ["video.mp4", "video.mkv", "video.webm"]


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path below the root, length, modificationTime); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", r"^[a-z0-9]+:/*" + "/".join([""] + [_quoted(p) for p in root.strip("/").split("/")]) + "/", "")
    return files.withColumn("path", below)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def clip_files(files: DataFrame, names: list[str] = VIDEO_NAMES) -> DataFrame:
    """One file per folder: the first of the accepted names, in any case."""
    name = F.lower(F.substring_index("path", "/", -1))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.where(name.isin(names)).groupBy(folder.alias("folder")) \
        .agg(F.min_by("path", place).alias("path")).select("folder", "path")


def scanned_videos(files: DataFrame) -> DataFrame:
    """subset/platform/video_id/file and subset/video_id/file paths to manifest rows.

    In the short layout an id of digits only points to facebook, others are unknown.
    """
    clips = clip_files(files)
    parts = F.split("path", "/")
    depth = F.size(parts)
    video_id = F.element_at(parts, -2)
    platform = F.when(depth >= 4, F.get(parts, F.lit(1))) \
        .when(video_id.rlike(r"^\d+$"), F.lit("facebook")).otherwise(F.lit("unknown"))
    return clips.where(depth.isin(3, 4)).select(
        F.get(parts, F.lit(0)).alias("subset"), platform.alias("platform"), video_id.alias("video_id"),
        F.concat(F.lit("videos/"), F.col("path")).alias("video_path"))


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


#: Bytes of a file that a task holds at once.
CHUNK = 8 << 20


def file_hashes(spark: SparkSession, root: str, chunk: int = CHUNK) -> DataFrame:
    """(name, path, length, sha256) of each file below the root, of any size.

    Files are listed by tasks and dealt out by path; each task opens its files through Arrow's file systems and reads them
    piece by piece in constant memory. Neither names nor a split per file come to the driver. As in Spark's listings there
    are no hidden files and none without a byte. A file system that Arrow does not know is read by Spark, a file a row,
    which holds files of up to 2 GB.
    """
    name = F.substring_index("path", "/", -1).alias("name")
    if not arrow_reads(spark, root):
        content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return content.select(name, "path", "length", F.sha2("content", 256).alias("sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(
                [_streamed_sha256(p, chunk) for p in batch["path"].to_pylist()], pa.string())], ["path", "length", "sha256"])

    dealt = _listed(spark, root).repartition(_shuffle_tasks(spark), "path")
    return dealt.mapInArrow(hashed, "path string, length long, sha256 string").select(name, "path", "length", "sha256")


_ENTRY = "path string, length long, is_folder boolean"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files below the root. Each level of folders is listed by tasks, a folder a row, and written."""
    fs, pattern = _fs(spark, root)
    starts = [(x.getPath().toString(), x.getLen(), x.isDirectory()) for x in fs.globStatus(pattern) or []]
    if not starts:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    level, found = spark.createDataFrame(starts, _ENTRY), []
    while True:
        found.append(level.where(~F.col("is_folder") & (F.col("length") > 0)).select("path", "length"))
        folders = level.where("is_folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = materialize(folders.repartition(_shuffle_tasks(spark), "path").mapInArrow(_entries, _ENTRY), "listing")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, but for what Spark's listings leave out."""
    from pyarrow import fs
    for batch in batches:
        for folder in batch["path"].to_pylist():
            system, inside = opened(folder)
            inner = [x for x in system.get_file_info(fs.FileSelector(inside)) if not _hidden(x)]
            for i in range(0, len(inner), 10_000):
                some = inner[i:i + 10_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder.rstrip('/')}/{x.base_name}" for x in some], pa.string()), pa.array([x.size or 0 for x in some], pa.int64()),
                    pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())], ["path", "length", "is_folder"])


def _hidden(entry) -> bool:
    name = entry.base_name
    if entry.size is None and name.startswith(("_metadata", "_common_metadata")):  # a folder
        return False
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def opened(path: str):
    """The Arrow file system of a path as Spark writes it, that is unescaped, and the path inside."""
    from pyarrow import fs
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&"))


def arrow_reads(spark: SparkSession, root: str) -> bool:
    try:
        opened(qualified(spark, root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's listings have it."""
    fs, plain = _fs(spark, path)
    return fs.makeQualified(plain).toString()


def _streamed_sha256(path: str, chunk: int) -> str:
    system, inside = opened(path)
    digest = hashlib.sha256()
    with system.open_input_stream(inside, compression=None) as stream:
        while piece := stream.read(chunk):
            digest.update(piece)
    return digest.hexdigest()
