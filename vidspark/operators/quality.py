"""Checks of tables, files and stages (DQ1-DQ9, F19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidspark.operators.merging import drop_group_copies, referenced_files

# Stage contracts: (column, type, may be NULL), as the stages write them.
CONTRACTS = {
    "stage1": [("video_path", "string", False), ("label", "int", False), ("original_video", "string", True),
               ("augmentation_idx", "int", True), ("is_original", "boolean", True)],
    "stage2": [("video_path", "string", False), ("label", "int", False), ("feature_path", "string", False)],
    "stage3": [("video_path", "string", False), ("label", "int", False), ("original_video", "string", True),
               ("augmentation_idx", "int", True), ("is_original", "boolean", True),
               ("original_width", "int", True), ("original_height", "int", True)],
    "stage4": [("video_path", "string", False), ("label", "int", False), ("feature_path", "string", False),
               ("is_upscaled", "int", True), ("is_downscaled", "int", True)],
    "stage5": [("video_path", "string", False), ("label", "int", False)],
}
OPEN_STAGES = {"stage2", "stage4"}  # any number of feature columns may follow

INDEX_COLUMNS = ["subset", "platform", "video_id", "video_path", "label", "width", "height", "fps", "frame_count",
                 "duration_sec", "codec_name", "codec_long_name", "bitrate", "total_bitrate", "file_size_bytes",
                 "pixel_format", "aspect_ratio", "dup_group"]


def check_table(df: DataFrame, required: list[str], min_rows: int = 1, max_rows: int | None = None) -> DataFrame:
    """One row (n_rows, is_valid, message), from one count (DQ1)."""
    absent = [c for c in required if c not in df.columns]
    n = F.col("n_rows")
    message = F.when(n == 0, F.lit("table is empty"))
    if absent:
        message = message.when(F.lit(True), F.lit("missing columns: " + ", ".join(absent)))
    message = message.when(n < min_rows, F.concat(F.lit("too few rows: "), n.cast("string"), F.lit(f" < {min_rows}")))
    if max_rows is not None:
        message = message.when(n > max_rows, F.concat(F.lit("too many rows: "), n.cast("string"), F.lit(f" > {max_rows}")))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("message", F.coalesce(message, F.lit("OK"))) \
        .select("n_rows", (F.col("message") == "OK").alias("is_valid"), "message")


def check_columns(df: DataFrame, required: list[str]) -> bool:
    """Required columns are there and the table has a row (DQ5)."""
    return all(c in df.columns for c in required) and not df.isEmpty()


def check_contract(df: DataFrame, stage: str) -> DataFrame:
    """One row per column: what is wrong with it, and how many values break the contract (DQ2). One pass."""
    contract = CONTRACTS[stage]
    known = {name for name, _, _ in contract}
    aggs: list[Column] = []
    rows: list[tuple[str, str]] = []
    for name, kind, nullable in contract:
        if name not in df.columns:
            rows.append((name, "missing"))
            aggs.append(F.lit(0).cast("bigint"))
            continue
        bad = F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
        if not nullable:
            bad = bad | F.col(name).isNull()
        rows.append((name, "present"))
        aggs.append(F.count_if(bad))
    if stage not in OPEN_STAGES:
        for name in [c for c in df.columns if c not in known]:
            rows.append((name, "unexpected"))
            aggs.append(F.lit(0).cast("bigint"))
    entries = [F.struct(F.lit(name).alias("column"), F.lit(state).alias("state"), agg.alias("violations"))
               for (name, state), agg in zip(rows, aggs)]
    return df.agg(F.count(F.lit(1)).alias("_n"), F.array(*entries).alias("_e")) \
        .select(F.explode("_e").alias("_e")).select("_e.*") \
        .withColumn("is_valid", (F.col("state") == "present") & (F.col("violations") == 0))


def check_features(df: DataFrame, expected: int, metadata=("video_path", "label", "feature_path"),
                   vector: str | None = None) -> DataFrame:
    """Number of features against what is expected, by columns or by vector length (DQ3)."""
    if vector is None:
        found = F.lit(len([c for c in df.columns if c not in metadata])).cast("bigint")
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", found.alias("n_features")) \
            .withColumn("is_valid", (F.col("n_features") == expected) & (F.col("n_rows") > 0))
    wrong = F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != expected)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), wrong.alias("n_wrong")) \
        .withColumn("is_valid", (F.col("n_wrong") == 0) & (F.col("n_rows") > 0))


def stage_report(tables: dict[str, DataFrame | None], min_rows: dict[str, int] | None = None) -> DataFrame:
    """One row per stage: rows, columns, verdict (DQ4, DQ6). Absent stages are given as None."""
    limits = min_rows or {}
    given = {s: t for s, t in tables.items() if t is not None}
    if not given:
        raise ValueError("no stage table given")
    parts = []
    for stage, df in given.items():
        need = limits.get(stage, 1)
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(stage).alias("stage"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
                                    F.when(F.col("n_rows") == 0, "empty").when(F.col("n_rows") < need, "too few rows")
                                    .otherwise("ok").alias("verdict")))
    any_spark = next(iter(given.values())).sparkSession
    absent = [(s, 0, 0, "missing") for s, t in tables.items() if t is None]
    if absent:
        schema = T.StructType([T.StructField("stage", T.StringType()), T.StructField("n_rows", T.LongType()),
                               T.StructField("n_columns", T.IntegerType()), T.StructField("verdict", T.StringType())])
        parts.append(any_spark.createDataFrame(absent, schema))
    return reduce(lambda a, b: a.unionByName(b), parts)


def file_verdicts(listing: DataFrame, wanted: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Verdict and reason for every wanted file, from the sizes in a listing (DQ7)."""
    sizes = listing.select("path", "length")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") < min_bytes, "too small") \
        .when(F.col("length") == 0, "empty").otherwise("OK")
    return wanted.select("path").join(sizes, "path", "left").withColumn("reason", state) \
        .withColumn("is_valid", F.col("reason") == "OK")


def verify_index(index: DataFrame, listing: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """(check, item, value) rows: files, labels and column coverage of an index, in one pass over it (DQ8)."""
    state = referenced_files(index, listing, "video_path")
    present = [c for c in required + optional if c in index.columns]
    checks = [("rows", "total", F.count(F.lit(1))), ("files", "missing", F.count_if(~F.col("file_found"))),
              ("label", "0", F.count_if(F.col("label") == 0)), ("label", "1", F.count_if(F.col("label") == 1)),
              ("label", "null", F.count_if(F.col("label").isNull()))]
    checks += [("required", c, F.lit(1 if c in index.columns else 0).cast("bigint")) for c in required]
    checks += [("filled", c, F.count(c)) for c in present]
    entries = F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("item"), v.alias("value"))
                        for a, b, v in checks])
    return state.agg(entries.alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


def known_first(df: DataFrame, order: list[str] = INDEX_COLUMNS) -> DataFrame:
    """Known columns in their order, then the rest."""
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])


def complete_rows(df: DataFrame, required: list[str]) -> tuple[DataFrame, Observation]:
    """Rows with a value in every required column, and what will have been counted once they are written or collected.

    n_rows, and no_<column> for each column: a row counts for the first column it lacks.
    """
    counts = Observation()
    whole, cols = F.lit(True), [F.count(F.lit(1)).alias("n_rows")]
    for c in required:
        cols.append(F.count_if(whole & F.col(c).isNull()).alias(f"no_{c}"))
        whole = whole & F.col(c).isNotNull()
    return df.observe(counts, *cols).where(whole), counts


def told(counts: Observation, names: list[str]) -> dict[str, int]:
    """What an observation counted; a plan that turned out empty has counted nothing."""
    found = counts.get
    return {n: int(found.get(n) or 0) for n in names}


def video_index(scanned: DataFrame, main: DataFrame, copies: DataFrame | None = None,
                drop_duplicates: bool = False, null_is_group: bool = False, joined: Observation | None = None,
                labelled: Observation | None = None) -> DataFrame:
    """The manifest: scanned files with labels, subsets, platforms and copy groups (DQ9, J1-J3, W1, P2, P3).

    What the folder says wins over the metadata, the main list over the list of copies. An id listed twice in either
    list yields two rows. Rows that stay without a label are dropped. ``joined`` counts the rows before copies go,
    ``labelled`` those after it and the ones without a label, both in the pass that computes the index.
    """
    info = main.select("video_id", F.col("label").alias("_m_label"), F.col("subset").alias("_m_subset"),
                       F.col("platform").alias("_m_platform"))
    out = scanned.join(info, "video_id", "left") \
        .withColumns({"subset": F.coalesce("subset", "_m_subset"), "platform": F.coalesce("platform", "_m_platform"),
                      "label": F.col("_m_label")}).drop("_m_label", "_m_subset", "_m_platform")
    if copies is not None:
        extra = copies.select("video_id", "dup_group", F.col("label").alias("_c_label"),
                              F.col("platform").alias("_c_platform"))
        out = out.join(extra, "video_id", "left") \
            .withColumns({"label": F.coalesce("label", "_c_label"), "platform": F.coalesce("platform", "_c_platform")}) \
            .drop("_c_label", "_c_platform")
    if joined is not None:
        out = out.observe(joined, F.count(F.lit(1)).alias("n_rows"))
    if copies is not None and drop_duplicates:
        out = drop_group_copies(out, null_is_group=null_is_group)
    if labelled is not None:
        out = out.observe(labelled, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label").isNull()).alias("no_label"))
    return known_first(out.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("int")))


# Which stages each kind of model reads.
MODEL_STAGES = {
    "logistic_regression": ["stage3", "stage2"], "logistic_regression_stage2": ["stage3", "stage2"],
    "logistic_regression_stage2_stage4": ["stage3", "stage2", "stage4"],
    "svm": ["stage3", "stage2"], "svm_stage2": ["stage3", "stage2"],
    "svm_stage2_stage4": ["stage3", "stage2", "stage4"],
    "pretrained_embeddings": ["stage3"],
}


def runnable_models(tables: dict[str, DataFrame], models: dict[str, list[str]] = MODEL_STAGES) -> DataFrame:
    """Per model whether all stages it reads have rows, and which are missing."""
    counts = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(s).alias("stage"), "n_rows") for s, df in tables.items()])
    spark = counts.sparkSession
    needs = spark.createDataFrame([(m, s) for m, ss in models.items() for s in ss], "model string, stage string")
    state = needs.join(counts, "stage", "left").withColumn("lacking", F.coalesce("n_rows", F.lit(0)) == 0)
    missing = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("lacking"), F.col("stage")))))
    return state.groupBy("model").agg(F.count(F.lit(1)).alias("stages"), missing.alias("missing")) \
        .withColumn("runnable", F.col("missing") == "")
