"""Readers, listings and sinks, each written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.operators import splits as sp
from vidspark.operators.results import confidence_summary
from vidspark.plans.manifest import _SCAN, main_list, scanned
from vidspark.plans.metrics import SCORED  # noqa: F401
from vidspark.plans.registry import query
from vidspark.plans.reports import rounded
from vidspark.plans.scalars import _URLS
from vidspark.plans.splits import _SPLIT
from vidspark.plans.views import CORPUS, FOLDS, LOG, MANIFEST, STAGE2
from vidspark.session import scratch_path
from vidspark.sources import listing as ls
from vidspark.sources import readers as rd
from vidspark.sources import sinks as sk
from vidspark.sources.merged import MergedTable
from vidspark.streaming.metrics_log import ingest_new

_MANIFEST_SCHEMA = "doc_id bigint, video_id string, video_path string, subset string, platform string, label int, frame_count bigint"
_BASIC = f"WITH {MANIFEST} SELECT doc_id, video_id, video_path, subset, platform, label, frame_count FROM manifest"


def basic(spark, d):
    return t.manifest(spark, d).select("doc_id", "video_id", "video_path", "subset", "platform", "label", "frame_count")


@query("s1_csv_scan", _BASIC)
def s1(spark, d):
    base = scratch_path(spark, "s1")
    sk.write_manifest(basic(spark, d), base)
    return rd.read_csv(spark, f"{base}/video_index_input.csv", _MANIFEST_SCHEMA)


@query("s2_first_format", _BASIC)
def s2(spark, d):
    """The format tried first is an empty file and passed over."""
    base = scratch_path(spark, "s2")
    basic(spark, d).write.option("header", True).csv(f"{base}/index.csv")
    fs, path = rd._fs(spark, f"{base}/index.parquet")
    fs.create(path).close()
    return rd.read_table(spark, base, "index", _MANIFEST_SCHEMA)


@query("s3_found_table", _BASIC.replace("SELECT doc_id, video_id", "SELECT 'index.csv' AS found, doc_id, video_id"))
def s3(spark, d):
    base = scratch_path(spark, "s3")
    basic(spark, d).write.option("header", True).csv(f"{base}/index.csv")
    found = rd.find_table(spark, base, "index")
    return rd.read_table(spark, base, "index", _MANIFEST_SCHEMA).select(F.lit(found.rsplit("/", 1)[1]).alias("found"), "*")


@query("s4_metrics_scan", f"WITH {LOG} SELECT * FROM log")
def s4(spark, d):
    path = scratch_path(spark, "s4")
    sk.append_metrics(t.metrics_log(spark, d), path)
    spark.createDataFrame([("{broken",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    return rd.read_metrics(spark, path).where(F.col("run_id").isNotNull()).drop("timestamp")


@query("s5_fold_results_scan", f"WITH {FOLDS} SELECT model, fold, round(val_acc, 6) AS val_acc FROM folds")
def s5(spark, d):
    base = scratch_path(spark, "s5")
    rows = rounded(t.folds(spark, d).select("model", "fold", "val_acc"))
    for name in [r["model"] for r in rows.select("model").distinct().collect()]:  # one small file per model
        sk.write_results(rows.where(F.col("model") == name).drop("model"), f"{base}/{name}/fold_results.csv")
    return rd.read_fold_results(spark, base, "fold int, val_acc double")


@query("s6_fold_logs_scan", f"WITH {LOG} SELECT run_id, step, metric, value, 'events' AS model, CAST(step % 3 AS INTEGER) AS fold FROM log")
def s6(spark, d):
    base = scratch_path(spark, "s6")
    log = t.metrics_log(spark, d)
    for k in range(3):
        sk.append_metrics(log.where(F.col("step") % 3 == k), f"{base}/events/fold_{k}/metrics.jsonl")
    return rd.read_fold_logs(spark, base).select("run_id", "step", "metric", "value", "model", "fold")


def _folders(spark, d, name):
    """One folder tree with a file per part of the table: source/language/group/video.mp4."""
    base = scratch_path(spark, name)
    rows = t.manifest(spark, d).select("subset", "platform", F.col("video_id").alias("value"))
    rows.repartition("subset", "platform").write.partitionBy("subset", "platform").text(f"{base}/tree")
    return f"{base}/tree"


@query("s7_folder_scan", """SELECT 'subset=' || source AS subset, 'platform=' || lang AS platform, count(*) AS n FROM documents GROUP BY 1, 2""")
def s7(spark, d):
    root = _folders(spark, d, "s7")
    files = ls.list_files(spark, root, "*.txt")
    clips = files.select("path", F.concat(F.substring_index("path", "/", 2), F.lit("/clip/video.mp4")).alias("clip"))
    found = ls.scanned_videos(clips.select(F.col("clip").alias("path")))
    rows = t.load(spark, d, "documents").groupBy(F.concat(F.lit("subset="), F.col("source")).alias("subset"),
                                                 F.concat(F.lit("platform="), F.col("lang")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(found.select("subset", "platform"), ["subset", "platform"], "left_semi")


@query("s7_two_layouts", f"""SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE 'flat' END AS subset,
  CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN 'facebook' ELSE 'unknown' END AS platform,
  CASE WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 THEN 'v' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS video_id,
  'videos/' || CASE WHEN doc_id % 2 = 0 THEN source || '/' || lang || '/' || doc_id WHEN doc_id % 3 = 0 THEN 'flat/' || doc_id
    ELSE 'flat/v' || doc_id END || '/video.mp4' AS video_path FROM documents""")
def s7b(spark, d):
    k, i = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = F.when(k % 2 == 0, F.concat_ws("/", F.col("source"), F.col("lang"), i)) \
        .when(k % 3 == 0, F.concat(F.lit("flat/"), i)).otherwise(F.concat(F.lit("flat/v"), i))
    names = F.array(F.lit("/video.mp4"), F.lit("/video.avi"), F.lit("/notes.txt"))
    files = t.load(spark, d, "documents").select(F.explode(F.transform(names, lambda n: F.concat(folder, n))).alias("path"))
    return ls.scanned_videos(files)


@query("s8_video_file_per_folder", """SELECT 'f/' || doc_id AS folder, 'f/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/VIDEO.mp4' ELSE '/video.webm' END AS path FROM documents""")
def s8(spark, d):
    folder = F.concat(F.lit("f/"), F.col("doc_id").cast("string"))
    names = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("/video.webm"), F.lit("/VIDEO.mp4"), F.lit("/a.mp4"))) \
        .otherwise(F.array(F.lit("/video.webm"), F.lit("/video.mov"), F.lit("/b.txt")))
    files = t.load(spark, d, "documents").select(F.explode(F.transform(names, lambda n: F.concat(folder, n))).alias("path"))
    return ls.clip_files(files)


@query("s9_metadata_files", f"""WITH {_URLS} SELECT 'main' AS list,
  CASE page_id % 6 WHEN 0 THEN regexp_extract(u, 'v=([^&]+)', 1) WHEN 1 THEN regexp_extract(u, 'be/([^?]+)', 1)
    WHEN 2 THEN regexp_extract(u, 'status/([0-9]+)', 1) WHEN 3 THEN regexp_extract(u, 'videos/([0-9]+)', 1) END AS video_id,
  CAST(page_id % 2 AS INTEGER) AS label, CASE page_id % 6 WHEN 0 THEN 'youtube' WHEN 1 THEN 'youtube' WHEN 2 THEN 'twitter' WHEN 3 THEN 'facebook' END AS platform
FROM urls WHERE page_id % 6 < 4""")
def s9(spark, d):
    """The main list is found under another name, the list of copies nowhere."""
    from vidspark.plans.scalars import clip_urls
    base = scratch_path(spark, "s9")
    rows = clip_urls(spark, d).select(F.trim("u").alias("url"), (F.col("page_id") % 2).alias("label"))
    rows.write.option("header", True).csv(f"{base}/labels.csv")
    main = rd.load_main_metadata(spark, base, "absent.csv", "url string, label int")
    copies = rd.load_duplicates(spark, base, "absent.csv")
    columns = ["video_id", "label", "platform"]
    return main.select(F.lit("main").alias("list"), *columns).unionByName(copies.select(F.lit("copies").alias("list"), *columns))


@query("s12_newest_rows_kept", f"""WITH {MANIFEST} SELECT video_path, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS state FROM manifest""")
def s12(spark, d):
    path = scratch_path(spark, "s12")
    rows = t.manifest(spark, d)
    sk.write_metadata(rows.select("video_path", F.lit("first").alias("state")), path)
    sk.write_metadata(rows.where(F.col("doc_id") % 3 == 0).select("video_path", F.lit("second").alias("state")), path, append=True)
    return spark.read.parquet(path)


@query("s12_touched_parts", f"""WITH {MANIFEST} SELECT video_path, CASE WHEN doc_id % 100 = 0 THEN 'second' ELSE 'first' END AS state,
  doc_id % 100 = 0 AS second, true AS others_untouched FROM manifest""")
def s12b(spark, d):
    """Two merges; the parts that the second does not touch keep their files, names and all."""
    table = MergedTable(spark, scratch_path(spark, "s12b"), ["video_path"])
    rows = t.manifest(spark, d)
    table.merge(rows.select("video_path", F.lit("first").alias("state")))
    before = table.state()[1]["parts"]
    second = rows.where(F.col("doc_id") % 100 == 0).select("video_path", F.lit("second").alias("state"))
    table.merge(second)
    after = table.state()[1]["parts"]
    touched = {str(r[0]) for r in second.select(table._part()).distinct().collect()}  # at most 64 numbers
    same = all((before[p] == after[p]) == (p not in touched) for p in before)
    return table.read().select("video_path", "state", (F.col("state") == "second").alias("second"), F.lit(same).alias("others_untouched"))


@query("m4_merged_versions", f"""WITH {MANIFEST} SELECT video_path, doc_id % 3 AS state, doc_id % 3 = 0 AS in_first FROM manifest""")
def m4b(spark, d):
    """Rows that come twice, first with another value; the first version can still be read."""
    table = MergedTable(spark, scratch_path(spark, "m4b"), ["video_path"])
    rows = t.manifest(spark, d)
    table.merge(rows.where(F.col("doc_id") % 3 == 0).select("video_path", F.lit(9).cast("bigint").alias("state")))
    first = table.read(table.merge(rows.select("video_path", (F.col("doc_id") % 3).alias("state"))) - 1)
    return table.read().join(first.select("video_path", F.lit(True).alias("in_first")), "video_path", "left") \
        .withColumn("in_first", F.coalesce("in_first", F.lit(False)))


@query("s13_feature_dataset", f"""WITH {STAGE2} SELECT seq, round(quantity, 6) AS quantity, 'stage2' AS stage FROM stage2""")
def s13(spark, d):
    path = scratch_path(spark, "s13")
    sk.write_features(rounded(t.stage2_features(spark, d).select("seq", "quantity")).withColumn("stage", F.lit("stage2")), path)
    return spark.read.parquet(path)


@query("s14_split_dataset", f"WITH {CORPUS}, {_SPLIT} SELECT video_id, label, split FROM assigned")
def s14(spark, d):
    path = scratch_path(spark, "s14")
    sk.write_splits(sp.train_val_test(t.corpus(spark, d), "video_id").select("video_id", "label", "split"), path)
    return spark.read.parquet(path)


@query("s15_manifest_json", _BASIC)
def s15(spark, d):
    base = scratch_path(spark, "s15")
    sk.write_manifest(basic(spark, d), base)
    return spark.read.schema(_MANIFEST_SCHEMA).json(f"{base}/video_index_input.json")


@query("s16_appended_metrics", f"WITH {LOG} SELECT * FROM log")
def s16(spark, d):
    path = scratch_path(spark, "s16")
    log = t.metrics_log(spark, d)
    wide = log.withColumn("metrics", F.create_map("metric", "value"))
    rows = wide.select("run_id", "step", "epoch", "phase", F.explode("metrics").alias("metric", "value"))
    sk.append_metrics(rows.where(F.col("step") % 2 == 0), path)
    sk.append_metrics(rows.where(F.col("step") % 2 == 1), path)
    return rd.read_metrics(spark, path).drop("timestamp")


@query("s16_metrics_stream", f"WITH {LOG} SELECT * FROM log")
def s16b(spark, d):
    base = scratch_path(spark, "s16b")
    log = t.metrics_log(spark, d)
    for half in range(2):
        sk.append_metrics(log.where(F.col("step") % 2 == half), f"{base}/log")
        ingest_new(spark, f"{base}/log", f"{base}/table", f"{base}/state")
    return spark.read.parquet(f"{base}/table").drop("timestamp")


@query("s17_result_table", f"""WITH {FOLDS} SELECT model, round(avg(val_acc), 4) AS mean, count(*) AS folds FROM folds GROUP BY model""")
def s17(spark, d):
    path = scratch_path(spark, "s17")
    sk.write_results(rounded(confidence_summary(t.folds(spark, d)), 4), path)
    schema = "model string, mean double, std double, ci_lower double, ci_upper double, min double, max double, folds bigint"
    return spark.read.schema(schema).option("header", True).csv(path).select("model", "mean", "folds")


@query("s18_validation_cache", """SELECT options, is_valid, count(*) AS n FROM (
  SELECT 'frames' AS options, doc_id % 2 = 0 AS is_valid FROM documents UNION ALL SELECT 'exists', true FROM documents WHERE doc_id % 5 = 0) GROUP BY 1, 2""")
def s18(spark, d):
    path = scratch_path(spark, "s18")
    rows = t.manifest(spark, d).select("doc_id", "video_path", F.lit(None).cast("string").alias("error_reason"))
    sk.save_verdicts(rows.withColumn("is_valid", F.col("doc_id") % 2 == 0), path, "frames")
    sk.save_verdicts(rows.where(F.col("doc_id") % 5 == 0).withColumn("is_valid", F.lit(True)), path, "exists")
    return sk.validation_cache(spark, path).groupBy("options", "is_valid").agg(F.count(F.lit(1)).alias("n"))


@query("s18_merged_verdicts", f"""WITH {MANIFEST} SELECT video_path, o.options, CASE WHEN o.options = 'frames' THEN doc_id % 2 = 0 ELSE true END AS is_valid
FROM manifest, (SELECT unnest(['frames', 'exists']) AS options) o WHERE o.options = 'frames' OR doc_id % 5 = 0""")
def s18b(spark, d):
    """Verdicts merged by path and options: a later verdict replaces the earlier one and rewrites only its part."""
    table = MergedTable(spark, scratch_path(spark, "s18b"), ["video_path", "options"])
    rows = t.manifest(spark, d).select("doc_id", "video_path")

    def verdicts(some, options, valid):
        return some.select("video_path", F.lit(options).alias("options"), valid.alias("is_valid"))

    table.merge(verdicts(rows, "frames", F.lit(False)))
    table.merge(verdicts(rows.where(F.col("doc_id") % 5 == 0), "exists", F.lit(True)))
    table.merge(verdicts(rows, "frames", F.col("doc_id") % 2 == 0))
    return table.read()


@query("s19_version_registry", f"""WITH {CORPUS}, {_SPLIT} SELECT 'split' AS kind, split AS name, CAST(count(*) AS VARCHAR) AS n_rows FROM assigned GROUP BY split""")
def s19(spark, d):
    path = scratch_path(spark, "s19")
    sizes = sp.train_val_test(t.corpus(spark, d), "video_id").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()  # three rows
    for row in sizes:
        sk.register_version(spark, path, "split", row["split"], "h0", f"{path}/{row['split']}", {"rows": row["n"]})
    return spark.read.parquet(path).select("kind", "name", F.element_at("meta", "rows").alias("n_rows"))


@query("a31_cache_size", """SELECT count(*) > 0 AS has_files, (SELECT CAST(sum(strlen(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) FROM documents) AS bytes FROM documents""")
def a31(spark, d):
    return ls.total_bytes(ls.list_files(spark, _folders(spark, d, "a31"), "*.txt")).select((F.col("files") > 0).alias("has_files"), "bytes")


@query("x13_file_hashes")
def x13(spark, d):
    """Hash of the file of each table itself."""
    return ls.file_hashes(spark, d).select("name", "sha256")


@query("x13_written_file_hashes", """SELECT 'v' || doc_id AS clip, sha256(coalesce(text, '') || chr(10)) AS sha256,
  (strlen(coalesce(text, '')) + 1)::BIGINT AS length FROM documents WHERE NOT contains(coalesce(text, ''), chr(13))""")
def x13b(spark, d):
    """Every text as a file of its own, written and hashed in pieces of 1,000 bytes."""
    path = scratch_path(spark, "x13")
    docs = t.load(spark, d, "documents").where(~F.contains(F.coalesce("text", F.lit("")), F.lit("\r")))
    clips = docs.select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("clip"), F.coalesce("text", F.lit("")).alias("value"))
    sk.write_files(clips, path, "clip", "value")
    clip = F.regexp_extract("path", r"clip=([^/]*?)(\.txt|/[^/]*)$", 1).alias("clip")
    return ls.file_hashes(spark, path, chunk=1000).select(clip, "sha256", "length")


@query("j1_scanned_manifest", f"""WITH {MANIFEST}, {_SCAN} SELECT s.video_id, s.video_path, s.frame_count, m.label, coalesce(s.subset, m.subset) AS subset,
  coalesce(s.platform, m.platform) AS platform FROM scanned s JOIN main_list m ON s.video_id = m.video_id""")
def j1s(spark, d):
    """Every joined row, ids that the list has twice with both."""
    from vidspark.operators.quality import video_index
    return video_index(scanned(spark, d), main_list(spark, d)).select("video_id", "video_path", "frame_count", "label", "subset", "platform")
