"""Manifest joins, resume joins, unions and de-duplication (J1-J8, J12-J14, M1-M4, W1, P1-P7, DQ9)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.functions.text import (GROUP_COLUMNS, LABEL_COLUMNS, URL_COLUMNS, clip_id, find_column, path_candidates,
                                     scaled_name)
from vidspark.operators import merging as mg
from vidspark.operators import quality as q
from vidspark.operators import ranking as rk
from vidspark.operators import splits as sp
from vidspark.plans.registry import query
from vidspark.plans.scalars import _NAMES, _URLS, clip_names, clip_urls
from vidspark.plans.splits import _FOLD
from vidspark.plans.views import COPIES, CORPUS, MANIFEST, STAGE1
from vidspark.session import scratch_path
from vidspark.sources import readers as rd
from vidspark.sources.finished import FinishedWork


def scanned(spark, d):
    """Clips as a folder scan gives them; some folders do not tell the platform."""
    return t.manifest(spark, d).select("video_id", "video_path", F.when(F.col("doc_id") % 4 != 0, F.col("subset")).alias("subset"),
                                       F.when(F.col("doc_id") % 5 != 0, F.col("platform")).alias("platform"), "frame_count")


def main_list(spark, d):
    """The labelled documents; every tenth id is listed twice."""
    m = t.manifest(spark, d).where(F.col("label").isNotNull())
    row = m.select("doc_id", "video_id", "label", F.concat(F.lit("main-"), F.col("subset")).alias("subset"),
                   F.concat(F.lit("main-"), F.col("platform")).alias("platform"))
    return row.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1)))) \
        .drop("_n", "doc_id")


def copies_list(spark, d):
    """Documents with a repeated text; every third has no label."""
    return t.copies(spark, d).select(
        "video_id", "dup_group", F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 2).cast("int")).alias("label"),
        F.lit("copy").alias("platform"))


_SCAN = """scanned AS (SELECT doc_id, video_id, video_path, CASE WHEN doc_id % 4 <> 0 THEN subset END AS subset,
  CASE WHEN doc_id % 5 <> 0 THEN platform END AS platform, frame_count FROM manifest),
main_list AS (SELECT video_id, label, 'main-' || subset AS subset, 'main-' || platform AS platform FROM manifest
  WHERE label IS NOT NULL UNION ALL
  SELECT video_id, label, 'main-' || subset, 'main-' || platform FROM manifest WHERE label IS NOT NULL AND doc_id % 10 = 0)"""
_COPYLIST = COPIES + """, copies_list AS (SELECT video_id, dup_group,
  CAST(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 END AS INTEGER) AS label, 'copy' AS platform FROM copies)"""


@query("j1_metadata_join", f"""WITH {MANIFEST}, {_SCAN} SELECT s.video_id, s.video_path, s.subset, m.subset AS subset_main, m.label
FROM scanned s LEFT JOIN main_list m ON s.video_id = m.video_id""")
def j1(spark, d):
    info = main_list(spark, d).select("video_id", "label", F.col("subset").alias("subset_main"))
    return scanned(spark, d).join(info, "video_id", "left").select("video_id", "video_path", "subset", "subset_main", "label")


@query("j2_folder_values_first", f"""WITH {MANIFEST}, {_SCAN} SELECT s.video_id, m.label, coalesce(s.subset, m.subset) AS subset,
  coalesce(s.platform, m.platform) AS platform FROM scanned s JOIN main_list m ON s.video_id = m.video_id""")
def j2(spark, d):
    return q.video_index(scanned(spark, d), main_list(spark, d)).select("video_id", "label", "subset", "platform")


_INDEX = f"""{MANIFEST}, {_SCAN}, {_COPYLIST}, joined AS (
  SELECT s.video_id, s.video_path, s.frame_count, coalesce(s.subset, m.subset) AS subset,
         coalesce(s.platform, m.platform, c.platform) AS platform, coalesce(m.label, c.label) AS label, c.dup_group
  FROM scanned s LEFT JOIN main_list m ON s.video_id = m.video_id LEFT JOIN copies_list c ON s.video_id = c.video_id)"""


@query("j3_copies_join", f"""WITH {_INDEX} SELECT subset, platform, video_id, video_path, label, frame_count, dup_group FROM joined WHERE label IS NOT NULL""")
def j3(spark, d):
    return q.video_index(scanned(spark, d), main_list(spark, d), copies_list(spark, d))


@query("dq9_video_index", f"""WITH {_INDEX}, r AS (
  SELECT *, row_number() OVER (PARTITION BY dup_group ORDER BY video_id) AS rn FROM joined)
SELECT subset, platform, video_id, video_path, label, frame_count, dup_group FROM r
WHERE label IS NOT NULL AND (dup_group IS NULL OR rn = 1)""")
def dq9(spark, d):
    return q.video_index(scanned(spark, d), main_list(spark, d), copies_list(spark, d), drop_duplicates=True)


@query("p1_resolved_columns", f"WITH {_URLS} SELECT u AS video_url, page_id % 2 AS label, page_id % 9 AS dup_group FROM urls")
def p1(spark, d):
    raw = clip_urls(spark, d).select(F.col("u").alias("url"), (F.col("page_id") % 2).alias("is_fake"),
                                     (F.col("page_id") % 9).alias("cascadeId"))
    return raw.select(F.col(find_column(raw.columns, URL_COLUMNS)).alias("video_url"),
                      F.col(find_column(raw.columns, LABEL_COLUMNS)).alias("label"),
                      F.col(find_column(raw.columns, GROUP_COLUMNS)).alias("dup_group"))


@query("s9_main_metadata", f"""WITH {_URLS} SELECT
  CASE page_id % 6 WHEN 0 THEN regexp_extract(u, 'v=([^&]+)', 1) WHEN 1 THEN regexp_extract(u, 'be/([^?]+)', 1)
    WHEN 2 THEN regexp_extract(u, 'status/([0-9]+)', 1) WHEN 3 THEN regexp_extract(u, 'videos/([0-9]+)', 1) END AS video_id,
  CAST(CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS subset,
  CASE page_id % 6 WHEN 0 THEN 'youtube' WHEN 1 THEN 'youtube' WHEN 2 THEN 'twitter' WHEN 3 THEN 'facebook' END AS platform
FROM urls WHERE page_id % 6 < 4""")
def s9(spark, d):
    raw = clip_urls(spark, d).select(F.col("u").alias("video_url"), F.when(F.col("page_id") % 3 == 0, "real")
                                     .when(F.col("page_id") % 3 == 1, "Fake").otherwise("uncertain").alias("label"))
    return rd.main_metadata(raw)


@query("p2_known_columns_first", f"WITH {MANIFEST} SELECT * FROM manifest")
def p2(spark, d):
    return q.known_first(t.manifest(spark, d))


@query("p3_labelled_rows", f"WITH {MANIFEST} SELECT doc_id, label FROM manifest WHERE label IS NOT NULL")
def p3(spark, d):
    return t.manifest(spark, d).na.drop(subset=["video_id", "label"]).select("doc_id", "label")


@query("p3_dropped_rows", f"""WITH {MANIFEST}, gaps AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN video_id END AS video_id, label FROM manifest)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE video_id IS NULL) AS no_video_id,
  count(*) FILTER (WHERE video_id IS NOT NULL AND label IS NULL) AS no_label,
  count(*) FILTER (WHERE video_id IS NOT NULL AND label IS NOT NULL) AS kept FROM gaps""")
def p3b(spark, d):
    """What was dropped and why, counted while the kept rows are written."""
    rows = t.manifest(spark, d).select(F.when(F.col("doc_id") % 11 != 0, F.col("video_id")).alias("video_id"), "label")
    kept, counts = q.complete_rows(rows, ["video_id", "label"])
    path = scratch_path(spark, "p3")
    kept.write.parquet(path)
    told = q.told(counts, ["n_rows", "no_video_id", "no_label"])
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept")).select(
        *[F.lit(v).cast("bigint").alias(k) for k, v in told.items()], "kept")


@query("dq9_index_counts", f"""WITH {_INDEX}, r AS (
  SELECT *, row_number() OVER (PARTITION BY dup_group ORDER BY video_id) AS rn FROM joined),
k AS (SELECT * FROM r WHERE dup_group IS NULL OR rn = 1)
SELECT (SELECT count(*) FROM joined) AS n_joined, (SELECT count(*) FROM joined) - (SELECT count(*) FROM k) AS n_copies,
  (SELECT count(*) FROM k WHERE label IS NULL) AS no_label, (SELECT count(*) FROM k WHERE label IS NOT NULL) AS kept""")
def dq9b(spark, d):
    """Copies and unlabelled rows dropped from the index, counted while it is written."""
    joined, labelled = Observation(), Observation()
    index = q.video_index(scanned(spark, d), main_list(spark, d), copies_list(spark, d), drop_duplicates=True,
                          joined=joined, labelled=labelled)
    path = scratch_path(spark, "dq9")
    index.write.parquet(path)
    n = q.told(joined, ["n_rows"])["n_rows"]
    left = q.told(labelled, ["n_rows", "no_label"])
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept")).select(
        F.lit(n).cast("bigint").alias("n_joined"), F.lit(n - left["n_rows"]).cast("bigint").alias("n_copies"),
        F.lit(left["no_label"]).cast("bigint").alias("no_label"), "kept")


@query("p4_membership", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def p4(spark, d):
    wanted = t.load(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(wanted, "l_orderkey", "left_semi")


@query("p6_subset_or_all", f"""WITH {MANIFEST} SELECT doc_id, subset FROM manifest
WHERE lower(subset) = 'src1' OR NOT EXISTS (SELECT 1 FROM manifest WHERE lower(subset) = 'src1')""")
def p6(spark, d):
    rows = t.manifest(spark, d).select("doc_id", "subset")
    hit = F.lower("subset") == "src1"
    found = rows.agg(F.coalesce(F.bool_or(hit), F.lit(False))).scalar()
    return rows.where(hit | ~found)


@query("p7_expected_clips", f"""WITH {STAGE1} SELECT count(*) FILTER (WHERE is_original) AS originals, count(*) FILTER (WHERE NOT is_original) AS augmented,
  count(*) FILTER (WHERE is_original) * 11 AS expected, count(*) FILTER (WHERE is_original) * 11 - count(*) AS missing FROM stage1""")
def p7(spark, d):
    n = F.count_if("is_original")
    return t.stage1(t.manifest(spark, d)).agg(n.alias("originals"), F.count_if(~F.col("is_original")).alias("augmented"),
                                              (n * 11).alias("expected"), (n * 11 - F.count(F.lit(1))).alias("missing"))


def listing(spark, d):
    """Files on disk: three quarters of the clips, some without the leading folder."""
    m = t.manifest(spark, d)
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/data/videos/"), F.col("video_path"))) \
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/data/"), F.col("video_path"))) \
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/data/"), F.substring("video_path", 8, 1 << 30)))
    return m.select(path.alias("path"), F.col("frame_count").alias("length")).where(F.col("path").isNotNull())


_LISTING = """listing AS (SELECT * FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '/data/videos/' || video_path WHEN 1 THEN '/data/' || video_path
  WHEN 2 THEN '/data/' || substr(video_path, 8) END AS path, frame_count AS length FROM manifest) WHERE path IS NOT NULL)"""


@query("j4_existing_videos", f"""WITH {MANIFEST}, {_LISTING} SELECT m.video_path, coalesce(a.path, b.path, c.path) AS resolved_path
FROM manifest m LEFT JOIN listing a ON a.path = '/data/videos/' || video_path LEFT JOIN listing b ON b.path = '/data/' || video_path
LEFT JOIN listing c ON c.path = '/data/' || substr(video_path, 8) WHERE coalesce(a.path, b.path, c.path) IS NOT NULL""")
def j4(spark, d):
    rows = t.manifest(spark, d).select("video_path")
    return mg.existing_paths(rows, listing(spark, d), path_candidates(F.col("video_path"), "/data"), "video_path")


@query("j4_resolved_paths", f"""WITH {MANIFEST}, {_LISTING} SELECT m.video_path, coalesce(a.path, b.path, c.path, '/data/videos/' || video_path) AS resolved_path
FROM manifest m LEFT JOIN listing a ON a.path = '/data/videos/' || video_path LEFT JOIN listing b ON b.path = '/data/' || video_path
LEFT JOIN listing c ON c.path = '/data/' || substr(video_path, 8)""")
def j4b(spark, d):
    rows = t.manifest(spark, d).select("video_path")
    return mg.resolved_paths(rows, listing(spark, d), path_candidates(F.col("video_path"), "/data"), "video_path")


@query("j5_cached_verdicts", f"""WITH {MANIFEST} SELECT video_path, CASE WHEN label IS NOT NULL THEN label = 1 ELSE frame_count >= 100 END AS is_valid,
  CASE WHEN label IS NOT NULL THEN 'cached' WHEN frame_count < 100 THEN 'no frames' END AS error_reason, label IS NOT NULL AS from_cache FROM manifest""")
def j5(spark, d):
    rows = t.manifest(spark, d)
    cache = rows.where(F.col("label").isNotNull()).select("video_path", (F.col("label") == 1).alias("is_valid"), F.lit("cached").alias("error_reason"))

    def validate(missing):
        return missing.withColumn("is_valid", F.col("frame_count") >= 100) \
            .withColumn("error_reason", F.when(~F.col("is_valid"), "no frames"))

    return mg.cached_verdicts(rows, cache, validate)


@query("j6_unprocessed_clips", f"""WITH {STAGE1} SELECT video_path, original_video, augmentation_idx FROM stage1 WHERE NOT (augmentation_idx % 2 = 0 AND label = 1)
  OR label IS NULL""")
def j6(spark, d):
    clips = t.stage1(t.manifest(spark, d))
    done = clips.where((F.col("augmentation_idx") % 2 == 0) & (F.col("label") == 1))
    keys = ["video_path", "original_video", "augmentation_idx"]
    return mg.unprocessed(clips.select(*keys), done, keys)


@query("j6_resumed_table", f"""WITH {MANIFEST} SELECT video_path, CASE WHEN label IS NOT NULL THEN 'old' ELSE 'new' END AS state FROM manifest""")
def j6b(spark, d):
    rows = t.manifest(spark, d)
    old = rows.where(F.col("label").isNotNull()).select("video_path", F.lit("old").alias("state"))
    return mg.merge_keep(old, rows.select("video_path", F.lit("new").alias("state")), ["video_path"], "existing")


@query("j7_missing_augmentations", f"""WITH {STAGE1}, kept AS (SELECT original_video FROM stage1 s JOIN manifest m ON s.original_video = m.video_path
  WHERE augmentation_idx >= 0 AND augmentation_idx < m.doc_id % 13)
SELECT doc_id, video_path FROM manifest WHERE video_path NOT IN (SELECT original_video FROM kept GROUP BY 1 HAVING count(*) >= 10)""")
def j7(spark, d):
    rows = t.manifest(spark, d)
    made = t.stage1(rows).join(rows.select(F.col("video_path").alias("original_video"), "doc_id"), "original_video") \
        .where(F.col("augmentation_idx") < F.col("doc_id") % 13)
    return mg.missing_augmentations(rows.select("doc_id", "video_path"), made, 10)


def _finished(spark, name, columns, keys, rows):
    """A bucketed table of finished rows."""
    work = FinishedWork(spark, scratch_path(spark, name), columns, keys, buckets=8)
    work.add(rows)
    return work


@query("j5_bucketed_verdicts", f"""WITH {MANIFEST} SELECT video_path, CASE WHEN label IS NOT NULL THEN label = 1 ELSE frame_count >= 100 END AS is_valid,
  CASE WHEN label IS NOT NULL THEN 'cached' WHEN frame_count < 100 THEN 'no frames' END AS error_reason, label IS NOT NULL AS from_cache FROM manifest""")
def j5b(spark, d):
    rows = t.manifest(spark, d)
    cache = rows.where(F.col("label").isNotNull()).select("video_path", (F.col("label") == 1).alias("is_valid"), F.lit("cached").alias("error_reason"))
    work = _finished(spark, "j5", "video_path STRING, is_valid BOOLEAN, error_reason STRING", ["video_path"], cache)

    def validate(missing):
        return missing.withColumn("is_valid", F.col("frame_count") >= 100) \
            .withColumn("error_reason", F.when(~F.col("is_valid"), "no frames"))

    return work.known_or(rows, ["is_valid", "error_reason"], validate)


@query("j6_bucketed_resume", f"""WITH {STAGE1} SELECT video_path, original_video, augmentation_idx FROM stage1 WHERE NOT (augmentation_idx % 2 = 0 AND label = 1)
  OR label IS NULL""")
def j6c(spark, d):
    clips = t.stage1(t.manifest(spark, d))
    done = clips.where((F.col("augmentation_idx") % 2 == 0) & (F.col("label") == 1))
    keys = ["video_path", "original_video", "augmentation_idx"]
    work = _finished(spark, "j6", "video_path STRING, original_video STRING, augmentation_idx INT", keys, done)
    return work.missing(clips.select(*keys))


@query("j7_bucketed_augmentations", f"""WITH {STAGE1}, kept AS (SELECT original_video FROM stage1 s JOIN manifest m ON s.original_video = m.video_path
  WHERE augmentation_idx >= 0 AND augmentation_idx < m.doc_id % 13)
SELECT doc_id, video_path FROM manifest WHERE video_path NOT IN (SELECT original_video FROM kept GROUP BY 1 HAVING count(*) >= 10)""")
def j7b(spark, d):
    rows = t.manifest(spark, d)
    made = t.stage1(rows).join(rows.select(F.col("video_path").alias("original_video"), "doc_id"), "original_video") \
        .where((F.col("augmentation_idx") < F.col("doc_id") % 13) & (F.col("augmentation_idx") >= 0))
    work = _finished(spark, "j7", "clip STRING", ["clip"], made.select(clip_id(F.col("original_video")).alias("clip")))
    return work.lacking(rows.select("doc_id", "video_path", clip_id(F.col("video_path")).alias("clip")), 10).drop("clip")


@query("j8_bucketed_scaling", f"""WITH {STAGE1}, o AS (SELECT video_path, label, regexp_replace(regexp_replace(video_path, '^.*/', ''), '\\.mp4$', '')
  || CASE WHEN is_original THEN '_scaled_original.mp4' ELSE '_scaled_aug' || augmentation_idx || '.mp4' END AS output_name FROM stage1)
SELECT video_path, output_name, coalesce(label = 0, false) AS is_complete FROM o""")
def j8b(spark, d):
    name = scaled_name(F.col("video_path"), F.col("augmentation_idx"), F.col("is_original"))
    clips = t.stage1(t.manifest(spark, d)).select("video_path", "label", name.alias("output_name"))
    work = _finished(spark, "j8", "output_name STRING", ["output_name"], clips.where(F.col("label") == 0))
    return work.marked(clips.select("video_path", "output_name"), "is_complete")


@query("j8_scaling_state", f"""WITH {STAGE1}, o AS (SELECT video_path, label, regexp_replace(regexp_replace(video_path, '^.*/', ''), '\\.mp4$', '')
  || CASE WHEN is_original THEN '_scaled_original.mp4' ELSE '_scaled_aug' || augmentation_idx || '.mp4' END AS output_name FROM stage1)
SELECT video_path, output_name, coalesce(label = 0, false) AS is_complete FROM o""")
def j8(spark, d):
    clips = t.stage1(t.manifest(spark, d)).select("video_path", "label", "augmentation_idx", "is_original")
    from vidspark.functions.text import scaled_name
    made = clips.where(F.col("label") == 0).select(F.concat(F.lit("scaled/"), scaled_name(
        F.col("video_path"), F.col("augmentation_idx"), F.col("is_original"))).alias("video_path"))
    return mg.scaling_state(clips, made).select("video_path", "output_name", "is_complete")


@query("j12_rebuilt_rows", f"""WITH {_NAMES}, f AS (SELECT o_orderkey, path, CASE o_orderkey % 6 WHEN 1 THEN -1 WHEN 5 THEN o_orderkey % 12 END AS idx FROM names
  WHERE o_orderkey % 6 IN (1, 5))
SELECT path AS video_path, CAST(o_orderkey % 2 AS INTEGER) AS label, 'in/Clip' || o_orderkey || '/video.mp4' AS original_video,
  CAST(idx AS INTEGER) AS augmentation_idx, idx = -1 AS is_original FROM f WHERE o_orderkey % 3 = 1 AND o_orderkey % 4 <> 1""")
def j12(spark, d):
    names = clip_names(spark, d)
    files = names.select(F.col("path").alias("video_path"))
    k = F.col("o_orderkey")
    index = names.where(k % 3 == 1).select((k % 2).cast("int").alias("label"), F.concat(
        F.lit("in/Clip"), k.cast("string"), F.lit("/video.mp4")).alias("video_path"))
    existing = names.where(k % 4 == 1).select(F.col("path").alias("video_path"))
    return mg.rebuilt_stage1(files, index, existing)


@query("j13_fold_clips", f"""WITH {CORPUS}, {_FOLD} SELECT l_orderkey, count(*) AS n FROM lineitem
WHERE l_orderkey IN (SELECT video_id FROM folded WHERE fold <> 0) GROUP BY l_orderkey""")
def j13(spark, d):
    train = sp.stratified_folds(t.corpus(spark, d), "video_id").where(F.col("fold") != 0).select(F.col("video_id").alias("l_orderkey"))
    return t.load(spark, d, "lineitem").select("l_orderkey").join(train, "l_orderkey", "left_semi") \
        .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("j14_file_consistency", """SELECT count(*) AS total_rows, count(*) FILTER (WHERE doc_id % 3 <> 0) AS files_found, count(*) FILTER (WHERE doc_id % 3 = 0) AS files_missing,
  count(*) FILTER (WHERE doc_id % 3 = 0) = 0 AS is_consistent FROM documents""")
def j14(spark, d):
    docs, k = t.load(spark, d, "documents").select("doc_id"), F.col("doc_id")
    i = k.cast("string")
    rows = docs.select(F.when(k % 2 == 0, F.concat(F.lit("a/"), i)).otherwise(F.concat(F.lit("a/"), i, F.lit(".mp4"))).alias("file"))
    files = docs.where(k % 3 != 0).select(F.when(k % 4 == 0, F.concat(F.lit("a/"), i))
                                          .otherwise(F.concat(F.lit("a/"), i, F.lit(".mp4"))).alias("path"))
    return mg.file_consistency(rows, files, "file")


@query("m1_concat", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def m1(spark, d):
    a = t.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return mg.concat_rows(a, t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("m2_all_training_rows", f"WITH {CORPUS} SELECT video_id, label FROM corpus")
def m2(spark, d):
    folded = sp.stratified_folds(t.corpus(spark, d), "video_id").select("video_id", "label", "fold")
    return mg.training_rows(folded, ["video_id"], 5).select("video_id", "label")


@query("m3_group_representatives", f"WITH {CORPUS} SELECT dup_group, min(video_id) AS video_id, arg_min(label, video_id) AS label, arg_min(platform, video_id) AS platform FROM corpus GROUP BY dup_group")
def m3(spark, d):
    return mg.group_representatives(t.corpus(spark, d), "dup_group", "video_id", ["video_id", "label", "platform"])


@query("m4_keep_latest", f"""WITH {MANIFEST} SELECT video_path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM manifest""")
def m4(spark, d):
    rows = t.manifest(spark, d)
    return mg.merge_keep(rows.select("video_path", F.lit("old").alias("state")),
                         rows.where(F.col("doc_id") % 3 == 0).select("video_path", F.lit("new").alias("state")), ["video_path"], "latest")


@query("w1_without_copies", f"""WITH {MANIFEST}, {COPIES}, g AS (SELECT m.doc_id, m.video_id, c.dup_group FROM manifest m LEFT JOIN copies c ON m.doc_id = c.doc_id)
SELECT doc_id, dup_group FROM g QUALIFY dup_group IS NULL OR row_number() OVER (PARTITION BY dup_group ORDER BY video_id) = 1""")
def w1(spark, d):
    rows = t.manifest(spark, d).select("doc_id", "video_id").join(t.copies(spark, d).select("doc_id", "dup_group"), "doc_id", "left")
    return mg.drop_group_copies(rows).select("doc_id", "dup_group")


@query("w1_nulls_as_one_group", f"""WITH {MANIFEST}, {COPIES}, g AS (SELECT m.doc_id, m.video_id, c.dup_group FROM manifest m LEFT JOIN copies c ON m.doc_id = c.doc_id)
SELECT doc_id, dup_group FROM g QUALIFY row_number() OVER (PARTITION BY dup_group ORDER BY video_id) = 1""")
def w1b(spark, d):
    rows = t.manifest(spark, d).select("doc_id", "video_id").join(t.copies(spark, d).select("doc_id", "dup_group"), "doc_id", "left")
    return mg.drop_group_copies(rows, null_is_group=True).select("doc_id", "dup_group")
