"""Checks (DQ1-DQ8, F19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.operators import quality as q
from vidspark.plans.manifest import _LISTING, listing
from vidspark.plans.registry import query
from vidspark.plans.views import MANIFEST, SCALED, STAGE1, STAGE2


@query("dq1_table_check", f"WITH {MANIFEST} SELECT count(*) AS n_rows, count(*) >= 3000 AS is_valid, CASE WHEN count(*) < 3000 THEN 'too few rows: ' || count(*) || ' < 3000' ELSE 'OK' END AS message FROM manifest")
def dq1(spark, d):
    return q.check_table(t.manifest(spark, d), ["video_path", "label"], min_rows=3000)


@query("dq1_missing_columns", "SELECT count(*) AS n_rows, false AS is_valid, 'missing columns: video_path, label' AS message FROM documents")
def dq1b(spark, d):
    return q.check_table(t.load(spark, d, "documents"), ["video_path", "label"])


@query("dq2_stage1_contract", f"""WITH {STAGE1}
SELECT 'video_path' AS "column", 'present' AS state, count(*) FILTER (WHERE video_path IS NULL) AS violations, count(*) FILTER (WHERE video_path IS NULL) = 0 AS is_valid FROM stage1
UNION ALL SELECT 'label', 'present', count(*) FILTER (WHERE label IS NULL), count(*) FILTER (WHERE label IS NULL) = 0 FROM stage1
UNION ALL SELECT 'original_video', 'present', 0, true UNION ALL SELECT 'augmentation_idx', 'present', 0, true
UNION ALL SELECT 'is_original', 'present', 0, true UNION ALL SELECT 'augmentation_type', 'unexpected', 0, false""")
def dq2(spark, d):
    return q.check_contract(t.stage1(t.manifest(spark, d)).drop("seed", "width", "height"), "stage1")


@query("dq2_text_columns", """SELECT 'video_path' AS "column", 'missing' AS state, 0::BIGINT AS violations, false AS is_valid
UNION ALL SELECT 'label', 'present', (SELECT count(*) FILTER (WHERE event_id % 10 = 0) FROM events), (SELECT count(*) FILTER (WHERE event_id % 10 = 0) = 0 FROM events)""")
def dq2b(spark, d):
    rows = t.load(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.col("event_type"))
                                             .otherwise((F.col("event_id") % 2).cast("string")).alias("label"))
    return q.check_contract(rows, "stage5")


@query("dq3_feature_count", f"WITH {STAGE2} SELECT count(*) AS n_rows, 7::BIGINT AS n_features, count(*) > 0 AS is_valid FROM stage2")
def dq3(spark, d):
    return q.check_features(t.stage2_features(spark, d).drop("seq"), 7)


@query("dq3_vector_length", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(embedding) <> 64) AS n_wrong, count(*) FILTER (WHERE len(embedding) <> 64) = 0 AS is_valid FROM embeddings")
def dq3b(spark, d):
    return q.check_features(t.load(spark, d, "embeddings"), 64, vector="embedding")


def stages(spark, d):
    rows = t.manifest(spark, d)
    return {"stage1": t.stage1(rows), "stage2": t.stage2_features(spark, d), "stage3": t.scaled(rows), "stage4": t.stage4_features(spark, d)}


@query("dq4_stage_report", f"""WITH {STAGE1}
SELECT 'stage1' AS stage, count(*) AS n_rows, 9 AS n_columns, 'ok' AS verdict FROM stage1
UNION ALL SELECT 'stage2', count(DISTINCT l_orderkey), 9, 'ok' FROM lineitem
UNION ALL SELECT 'stage3', count(*), 15, 'too few rows' FROM manifest
UNION ALL SELECT 'stage4', count(*), 4, 'ok' FROM orders UNION ALL SELECT 'stage5', 0, 0, 'missing'""")
def dq4(spark, d):
    return q.stage_report({**stages(spark, d), "stage5": None}, {"stage3": 1 << 40})


@query("dq5_required_columns", f"WITH {MANIFEST} SELECT count(*) AS n_rows, count(*) > 0 AS is_valid FROM manifest")
def dq5(spark, d):
    rows = t.manifest(spark, d)
    good = q.check_columns(rows, ["video_path", "label"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("is_valid", F.lit(good))


@query("dq6_feature_sanity", f"WITH {STAGE2} SELECT 'features' AS stage, count(*) AS n_rows, 9 AS n_columns, CASE WHEN count(*) < 3000 THEN 'too few rows' ELSE 'ok' END AS verdict FROM stage2")
def dq6(spark, d):
    return q.stage_report({"features": t.stage2_features(spark, d)}, {"features": 3000})


@query("dq7_file_verdicts", f"""WITH {MANIFEST}, {_LISTING}, w AS (SELECT '/data/' || video_path AS path FROM manifest), s AS (
  SELECT w.path, CASE WHEN length IS NULL THEN 'missing' WHEN length < 200 THEN 'too small' WHEN length = 0 THEN 'empty' ELSE 'OK' END AS reason,
  length FROM w LEFT JOIN listing USING (path))
SELECT path, length, reason, reason = 'OK' AS is_valid FROM s""")
def dq7(spark, d):
    wanted = t.manifest(spark, d).select(F.concat(F.lit("/data/"), F.col("video_path")).alias("path"))
    return q.file_verdicts(listing(spark, d), wanted, min_bytes=200)


@query("dq8_index_verification", f"""WITH {MANIFEST}
SELECT 'rows' AS "check", 'total' AS item, count(*) AS value FROM manifest
UNION ALL SELECT 'files', 'missing', count(*) FILTER (WHERE doc_id % 4 = 3) FROM manifest
UNION ALL SELECT 'label', '0', count(*) FILTER (WHERE label = 0) FROM manifest UNION ALL SELECT 'label', '1', count(*) FILTER (WHERE label = 1) FROM manifest
UNION ALL SELECT 'label', 'null', count(*) FILTER (WHERE label IS NULL) FROM manifest
UNION ALL SELECT 'required', 'video_path', 1 UNION ALL SELECT 'required', 'label', 1 UNION ALL SELECT 'required', 'codec_name', 0
UNION ALL SELECT 'filled', 'video_path', count(video_path) FROM manifest UNION ALL SELECT 'filled', 'label', count(label) FROM manifest
UNION ALL SELECT 'filled', 'fps', count(fps) FROM manifest""")
def dq8(spark, d):
    rows = t.manifest(spark, d)
    files = rows.where(F.col("doc_id") % 4 != 3).select(F.col("video_path").alias("path"))
    return q.verify_index(rows, files, ["video_path", "label", "codec_name"], ["fps"])


@query("f19_runnable_models", """SELECT * FROM (VALUES ('logistic_regression', 2::BIGINT, ''), ('logistic_regression_stage2', 2, ''),
  ('logistic_regression_stage2_stage4', 3, 'stage4'), ('svm', 2, ''), ('svm_stage2', 2, ''), ('svm_stage2_stage4', 3, 'stage4'),
  ('pretrained_embeddings', 1, '')) v(model, stages, missing), (SELECT count(*) > 0 AS ok FROM lineitem) x
  , LATERAL (SELECT x.ok AND missing = '' AS runnable) y""".replace("SELECT * FROM", "SELECT model, stages, missing, runnable FROM", 1))
def f19(spark, d):
    tables = stages(spark, d)
    tables["stage4"] = tables["stage4"].where(F.col("total") < 0)
    return q.runnable_models(tables)
