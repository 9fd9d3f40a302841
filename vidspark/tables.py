"""Views over the given tables in the shape of the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.functions.arrays import augmentation_plan
from vidspark.functions.hashing import seed_of
from vidspark.functions.numeric import letterbox, scaling_flags

FRAME_SIDE = 24
FRAME_BYTES = FRAME_SIDE * FRAME_SIDE * 3


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def video_path_of(doc_id="doc_id"):
    return F.concat_ws("/", F.lit("videos"), F.col("source"), F.col("lang"), F.col(doc_id).cast("string"),
                       F.lit("video.mp4"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as clips: source is the subset, language the platform, quality the label, length the frames."""
    docs = load(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = load(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    fps = (F.lit(24) + F.col("doc_id") % 7).cast("double")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("video_id"), video_path_of().alias("video_path"),
        F.col("source").alias("subset"), F.col("lang").alias("platform"), "label",
        F.col("n_chars").alias("frame_count"), (F.lit(320) + F.col("doc_id") * 37 % 1601).cast("int").alias("width"),
        (F.lit(240) + F.col("doc_id") * 53 % 1001).cast("int").alias("height"), fps.alias("fps"),
        (F.col("n_chars") / fps).alias("duration_sec"))


def copies(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, video_id, dup_group) of documents whose text occurs more than once."""
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("dup_group"))
    repeated = docs.groupBy("dup_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("dup_group")
    return docs.join(repeated, "dup_group", "left_semi") \
        .select("doc_id", F.col("doc_id").cast("string").alias("video_id"), "dup_group")


def stage1(rows: DataFrame, n: int = 10) -> DataFrame:
    """Augmentation manifest: idx -1 for the original, 0 .. n-1 for the planned clips."""
    seed = seed_of(F.col("video_path"))
    planned = rows.select("video_id", "video_path", "label", "width", "height", seed.alias("seed"),
                          augmentation_plan(seed, n).alias("plan"))
    clips = planned.withColumn("augmentation_idx", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    original = F.col("augmentation_idx") < 0
    name = F.concat(F.lit("augmented/"), F.col("video_id"), F.when(original, F.lit("_original"))
                    .otherwise(F.concat(F.lit("_aug"), F.col("augmentation_idx").cast("string"))), F.lit(".mp4"))
    return clips.select(
        name.alias("video_path"), "label", F.col("video_path").alias("original_video"), "augmentation_idx",
        original.alias("is_original"),
        F.when(~original, F.get("plan", F.col("augmentation_idx"))).alias("augmentation_type"),
        F.when(~original, (F.col("seed") + F.col("augmentation_idx"))).alias("seed"), "width", "height")


def scaled(rows: DataFrame, target: int = 640) -> DataFrame:
    """Scaled-clip table with sizes before and after."""
    box = letterbox(F.col("width"), F.col("height"), target)
    out = rows.withColumns({"scaled_width": box["new_width"], "scaled_height": box["new_height"]})
    flags = scaling_flags(F.col("width"), F.col("height"), F.col("scaled_width"), F.col("scaled_height"))
    return out.withColumns(flags).withColumnsRenamed({"width": "original_width", "height": "original_height"})


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a large, stratified, grouped manifest."""
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_orderstatus").alias("label"),
        F.col("o_orderpriority").alias("platform"), F.col("o_custkey").alias("dup_group"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Line items as predictions with many ties."""
    return load(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_quantity") / 50.0).alias("p1"),
        (F.col("l_quantity") / 50.0 > 0.5).cast("int").alias("y_pred"), (F.col("l_discount") * 10.0).alias("p_alt"))


def folds(spark: SparkSession, d: str) -> DataFrame:
    """Events as fold results of one model per type; some scores are NaN."""
    ev = load(spark, d, "events")
    f1 = F.avg(F.col("value")) / 600.0
    cells = ev.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("fold")).agg(
        (F.avg("value") / 500.0).alias("val_acc"), (F.stddev_pop("value") / 100.0).alias("val_loss"), f1.alias("_f1"))
    return cells.withColumn("val_f1", F.when((F.col("fold") == 3) & (F.col("model") == "click"), F.lit(float("nan")))
                            .otherwise(F.col("_f1"))).drop("_f1")


def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of metrics."""
    return load(spark, d, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("step"),
        (F.col("event_id") % 20).cast("int").alias("epoch"),
        F.when(F.col("event_id") % 3 == 0, "train").otherwise("val").alias("phase"),
        F.col("event_type").alias("metric"), "value")


def stage2_features(spark: SparkSession, d: str) -> DataFrame:
    """Line items averaged per order."""
    li = load(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("lines")).select(
        F.concat(F.lit("features/"), F.col("l_orderkey").cast("string"), F.lit("_aug1.mp4")).alias("video_path"),
        F.col("l_orderkey").alias("seq"), "quantity", "price", "discount", "tax", "lines",
        (F.col("price") * 2.0 + F.col("tax")).alias("price_twice"), F.lit(1.0).alias("constant"))


def stage4_features(spark: SparkSession, d: str) -> DataFrame:
    """Order values."""
    return load(spark, d, "orders").select(
        F.concat(F.lit("scaled/"), F.col("o_orderkey").cast("string"), F.lit("_aug1_scaled_aug1.mp4")).alias("video_path"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("total"),
        (F.col("o_custkey") % 97).cast("double").alias("customer"))


def feature_targets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.concat(F.lit("clips/"), F.col("o_orderkey").cast("string"), F.lit("_Aug1.mp4")).alias("video_path"),
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Whole document texts as frames of 24 x 24 pixels; the last frame of a text is filled up with zeros."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.encode("text", "UTF-8").alias("_b"))
    count = F.ceil(F.length("_b") / F.lit(float(FRAME_BYTES))).cast("int")
    cut = docs.where(F.length("_b") > 0).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), count - 1)))
    piece = F.substring(F.col("_b"), F.col("frame_idx") * FRAME_BYTES + 1, F.lit(FRAME_BYTES))
    return cut.select("video_id", "frame_idx", F.lit(FRAME_SIDE).alias("h"), F.lit(FRAME_SIDE).alias("w"),
                      F.rpad(piece, FRAME_BYTES, F.unhex(F.lit("00"))).alias("pixels"))


def probe_texts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as probe output: a sound stream first, sizes and rates of all kinds, some fields absent or broken."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    t = k.cast("string")

    def number(x):
        return x.cast("bigint").cast("string")

    rate = F.when(k % 11 == 0, F.lit("0/0")).when(k % 13 == 0, F.lit("n/a")) \
        .when(k % 2 == 0, F.lit("30000/1001")).otherwise(F.lit("25/1"))
    frames_part = F.when(k % 3 == 0, F.concat(F.lit(', "nb_frames": "'), number(k % 900), F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"format": {"duration": "'), F.when(k % 17 == 0, F.lit("N/A")).otherwise(number(k % 600)),
        F.lit('", "bit_rate": "'), number(F.col("o_custkey") * 10), F.lit('", "size": "'), t,
        F.lit('"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", '
              '"width": '), number(k % 1920 + 1), F.lit(', "height": '), number(k % 1080 + 1),
        F.lit(', "r_frame_rate": "'), rate, F.lit('"'), frames_part, F.lit(', "pix_fmt": "yuv420p"}]}'))
    return o.select(k.alias("video_id"), text.alias("probe"))
