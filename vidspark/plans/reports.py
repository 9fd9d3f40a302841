"""Reports (A1-A8, A19-A23, A26, A30, A33, K1-K4, J15, J16, S10, S11, Y8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.functions.text import display_name
from vidspark.operators import results as r
from vidspark.plans.registry import query
from vidspark.plans.views import FOLDS, LOG, MANIFEST, SCALED, STAGE1, STAGE2


def rounded(df, places: int = 6):
    """Doubles rounded, and without negative zeros, so that two engines agree on them."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if c in doubles else F.col(c) for c in df.columns])


@query("a1_video_statistics", f"""WITH {STAGE1}
SELECT label, count(*) AS video_count, count(DISTINCT original_video) AS unique_originals,
       round(avg(CASE WHEN is_original THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS original_ratio
FROM stage1 GROUP BY label""")
def a1(spark, d):
    return rounded(r.video_statistics(t.stage1(t.manifest(spark, d))))


@query("a2_augmentation_distribution", f"""WITH {STAGE1}
SELECT augmentation_type, count(*) AS "count",
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM stage1), 6) AS percentage
FROM stage1 WHERE augmentation_type IS NOT NULL GROUP BY augmentation_type""")
def a2(spark, d):
    return rounded(r.augmentation_distribution(t.stage1(t.manifest(spark, d))))


@query("a3_scaling_statistics", f"""WITH {SCALED}
SELECT count(*) AS total_videos, CAST(sum(is_upscaled) AS BIGINT) AS upscaled_count,
       CAST(sum(is_downscaled) AS BIGINT) AS downscaled_count, round(avg(scaled_width), 6) AS avg_width,
       round(avg(scaled_height), 6) AS avg_height, round(avg(original_width), 6) AS avg_original_width,
       round(avg(original_height), 6) AS avg_original_height FROM scaled""")
def a3(spark, d):
    return rounded(r.scaling_statistics(t.scaled(t.manifest(spark, d))))


@query("a4_feature_statistics", f"""WITH {MANIFEST}
SELECT count(*) AS total_samples, count(DISTINCT video_path) AS unique_videos, count(DISTINCT label) AS unique_labels
FROM manifest""")
def a4(spark, d):
    return r.feature_statistics(t.manifest(spark, d))


@query("a5_training_summary", f"""WITH {FOLDS}
SELECT model AS model_type, round(avg(val_acc), 6) AS avg_val_acc, round(stddev_samp(val_acc), 6) AS std_val_acc,
       round(avg(val_loss), 6) AS avg_val_loss, round(stddev_samp(val_loss), 6) AS std_val_loss, count(*) AS fold_count
FROM folds GROUP BY model""")
def a5(spark, d):
    return rounded(r.training_summary(t.folds(spark, d).withColumnRenamed("model", "model_type")))


@query("a6_value_counts", f"""WITH {MANIFEST}
SELECT 'label' AS field, CAST(label AS VARCHAR) AS value, count(*) AS n FROM manifest GROUP BY label
UNION ALL SELECT 'subset', subset, count(*) FROM manifest GROUP BY subset
UNION ALL SELECT 'platform', platform, count(*) FROM manifest GROUP BY platform""")
def a6(spark, d):
    rows = t.manifest(spark, d)
    long = rows.select(F.col("label").cast("string").alias("label"), "subset", "platform") \
        .select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
                                    for c in ("label", "subset", "platform")])).alias("_v")).select("_v.*")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("a7_dataset_profile", f"""WITH {MANIFEST}
SELECT count(*) AS total_videos, count(*) FILTER (WHERE label = 0) AS real_count, count(*) FILTER (WHERE label = 1) AS fake_count,
       round(count(*) FILTER (WHERE label = 0)::DOUBLE / count(*) * 100, 6) AS real_pct,
       round(count(*) FILTER (WHERE label = 1)::DOUBLE / count(*) * 100, 6) AS fake_pct, round(avg(duration_sec), 4) AS avg_duration,
       round(sum(duration_sec) / 3600, 4) AS total_duration_hours FROM manifest""")
def a7(spark, d):
    out = r.dataset_profile(t.manifest(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("real_pct", "fake_pct")}) \
        .withColumns({c: F.round(c, 4) for c in ("avg_duration", "total_duration_hours")})


@query("a8_column_coverage", f"""WITH {MANIFEST}
SELECT 'label' AS "column", count(label) AS non_null, round(count(label) * 100.0::DOUBLE / count(*), 6) AS percent
FROM manifest
UNION ALL SELECT 'platform', count(platform), round(count(platform) * 100.0::DOUBLE / count(*), 6) FROM manifest
UNION ALL SELECT 'frame_count', count(frame_count), round(count(frame_count) * 100.0::DOUBLE / count(*), 6) FROM manifest""")
def a8(spark, d):
    return rounded(r.column_coverage(t.manifest(spark, d), ["label", "platform", "frame_count"]))


@query("a19_fold_averages", f"""WITH {FOLDS}
SELECT model, round(avg(val_acc), 6) AS avg_val_acc, round(avg(val_loss), 6) AS avg_val_loss,
       round(stddev_samp(val_acc), 6) AS std_val_acc, round(stddev_samp(val_loss), 6) AS std_val_loss
FROM folds GROUP BY model""")
def a19(spark, d):
    return rounded(r.fold_averages(t.folds(spark, d), ["val_acc", "val_loss"], ["model"]))


@query("a20_valid_fold_means", f"""WITH {FOLDS}
SELECT model, round(avg(CASE WHEN NOT isnan(val_loss) THEN val_loss END), 6) AS avg_val_loss,
       round(avg(CASE WHEN NOT isnan(val_f1) THEN val_f1 END), 6) AS avg_val_f1 FROM folds GROUP BY model""")
def a20(spark, d):
    return rounded(r.valid_fold_means(t.folds(spark, d), ["val_loss", "val_f1"]))


@query("p8_valid_folds", f"""WITH {FOLDS}
SELECT model, fold, round(val_f1, 6) AS val_f1 FROM folds WHERE val_f1 IS NOT NULL AND NOT isnan(val_f1)""")
def p8(spark, d):
    rows = t.folds(spark, d)
    return rounded(rows.where(F.col("val_f1").isNotNull() & ~F.isnan("val_f1")).select("model", "fold", "val_f1"))


def _summary(col: str) -> str:
    return f"""SELECT '{col}' AS "column", round(avg({col}), 4) AS mean, round(stddev_pop({col}), 4) AS std,
       round(min({col}), 4) AS min, round(max({col}), 4) AS max, round(quantile_cont({col}, 0.25), 4) AS q25,
       round(quantile_cont({col}, 0.5), 4) AS median, round(quantile_cont({col}, 0.75), 4) AS q75 FROM lineitem"""


@query("a21_summary_stats", _summary("l_quantity") + " UNION ALL " + _summary("l_extendedprice"))
def a21(spark, d):
    return rounded(r.summary_stats(t.load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 4)


@query("a22_confidence_summary", f"""WITH {FOLDS}
SELECT model, round(avg(val_acc), 6) AS mean, round(stddev_pop(val_acc), 6) AS std,
       round(avg(val_acc) - 2.7764451051977934 * stddev_samp(val_acc) / sqrt(count(*)), 6) AS ci_lower,
       round(avg(val_acc) + 2.7764451051977934 * stddev_samp(val_acc) / sqrt(count(*)), 6) AS ci_upper,
       round(min(val_acc), 6) AS min, round(max(val_acc), 6) AS max, count(*) AS folds FROM folds GROUP BY model""")
def a22(spark, d):
    return rounded(r.confidence_summary(t.folds(spark, d)))


@query("a23_pairwise_t", f"""WITH {FOLDS}, m AS (
  SELECT model, count(*) AS n, avg(val_acc) AS mean, var_samp(val_acc) AS v FROM folds GROUP BY model)
SELECT a.model AS model_1, b.model AS model_2,
       round((a.mean - b.mean) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 4) + 0.0::DOUBLE
       AS t_statistic, CAST(a.n + b.n - 2 AS DOUBLE) AS dof
FROM m a JOIN m b ON a.model < b.model""")
def a23(spark, d):
    return rounded(r.pairwise_t_tests(t.folds(spark, d)).select("model_1", "model_2", "t_statistic", "dof"), 4)


# With 8 degrees of freedom, five folds a model, the distribution of t has a closed form in the angle whose tangent is
# t / sqrt(8).
@query("a23_pairwise_p_values", f"""WITH {FOLDS}, m AS (
  SELECT model, count(*) AS n, avg(val_acc) AS mean, var_samp(val_acc) AS v FROM folds GROUP BY model),
t AS (SELECT a.model AS model_1, b.model AS model_2, (a.mean - b.mean) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)
    * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t, CAST(a.n + b.n - 2 AS DOUBLE) AS dof FROM m a JOIN m b ON a.model < b.model),
p AS (SELECT *, atan(abs(t) / sqrt(dof)) AS w FROM t WHERE dof = 8),
q AS (SELECT *, 1 - sin(w) * (1 + cos(w) ** 2 / 2 + 3 * cos(w) ** 4 / 8 + 15 * cos(w) ** 6 / 48) AS p_value FROM p)
SELECT model_1, model_2, round(t, 4) + 0.0::DOUBLE AS t_statistic, dof, round(p_value, 4) + 0.0::DOUBLE AS p_value,
  CASE WHEN p_value < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM q""")
def a23p(spark, d):
    return rounded(r.pairwise_t_tests(t.folds(spark, d)), 4)


@query("j15_model_pairs", f"""WITH {FOLDS}, m AS (SELECT DISTINCT model FROM folds)
SELECT a.model AS model_1, b.model AS model_2, upper(substr(a.model, 1, 1)) || substr(a.model, 2) AS name_1
FROM m a JOIN m b ON a.model < b.model""")
def j15(spark, d):
    pairs = r.pairwise_t_tests(t.folds(spark, d))
    return pairs.select("model_1", "model_2", display_name(F.col("model_1")).alias("name_1"))


@query("a26_validity_rate", """SELECT count(*) AS checked, count(*) FILTER (WHERE quality = 1) AS valid,
       count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS corrupted,
       round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS valid_rate,
       count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*) >= 0.9 AS keep_all FROM labels""")
def a26(spark, d):
    verdicts = t.load(spark, d, "labels").select(
        (F.col("quality") == 1).alias("is_valid"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "moov atom not found").when(F.col("quality") == 0, "no frames")
        .alias("error_reason"))
    return rounded(r.validity(verdicts))


def _sampled_sql(valid: str, sample: int, threshold: float, required: int) -> str:
    return f"""WITH v AS (SELECT o_orderkey AS k, {valid} AS ok FROM orders),
smp AS (SELECT ok FROM v ORDER BY md5('42-' || k), k LIMIT {sample}),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS good, (SELECT count(*) FROM v) AS total,
  (SELECT count(*) FILTER (WHERE ok) FROM v) AS all_good FROM smp),
b AS (SELECT *, good::DOUBLE / n AS p, 1.96::DOUBLE * 1.96::DOUBLE / n AS s FROM c),
w AS (SELECT *, ((p + s / 2) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + s / (4 * n))) / (1 + s) AS lo,
  ((p + s / 2) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + s / (4 * n))) / (1 + s) AS hi FROM b),
d AS (SELECT *, n < total AND (lo >= {threshold} OR hi < {threshold}) AS early FROM w),
e AS (SELECT total, early, lo, hi, CASE WHEN early THEN n ELSE total END AS checked, CASE WHEN early THEN good ELSE all_good END AS valid FROM d)
SELECT total AS n_rows, checked, valid, round(valid::DOUBLE / checked, 6) AS valid_rate,
  round(CASE WHEN early THEN lo ELSE valid::DOUBLE / checked END, 6) AS lower, round(CASE WHEN early THEN hi ELSE valid::DOUBLE / checked END, 6) AS upper,
  round_even(valid::DOUBLE / checked * total, 0)::BIGINT AS estimated, round_even(valid::DOUBLE / checked * total, 0) >= {required} AS enough,
  CASE WHEN early THEN 'sample' ELSE 'all' END AS decided_by, valid::DOUBLE / checked >= {threshold} AS keep_all FROM e"""


def _sampled(spark, d, valid, sample, threshold, required):
    rows = t.load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rounded(r.sampled_validity(rows, "o_orderkey", lambda x: x.withColumn("is_valid", valid), sample, threshold, required))


@query("a26_decided_by_sample", _sampled_sql("o_custkey % 50 <> 0", 400, 0.9, 1000))
def a26b(spark, d):
    return _sampled(spark, d, F.col("o_custkey") % 50 != 0, 400, 0.9, 1000)


@query("a26_decided_by_all", _sampled_sql("o_custkey % 10 <> 0", 300, 0.9, 10 ** 9))
def a26c(spark, d):
    """A share so near the threshold that the sample cannot tell."""
    return _sampled(spark, d, F.col("o_custkey") % 10 != 0, 300, 0.9, 10 ** 9)


GRID = """grid AS (
  SELECT event_type AS kernel, CAST(user_id % 4 AS INTEGER) AS depth,
         CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value / 500.0::DOUBLE END AS f1, value / 600.0::DOUBLE AS acc
  FROM events)"""


def _grid(spark, d):
    return t.load(spark, d, "events").select(
        F.col("event_type").alias("kernel"), (F.col("user_id") % 4).cast("int").alias("depth"),
        F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 500.0).alias("f1"),
        (F.col("value") / 600.0).alias("acc"))


def _grid_scores(spark, d):
    return r.grid_scores(_grid(spark, d), ["kernel", "depth"], {"mean_f1": "f1", "mean_acc": "acc"})


_SCORES = f"""WITH {GRID}, scores AS (
  SELECT kernel, depth, avg(CASE WHEN NOT isnan(f1) THEN f1 END) AS mean_f1, avg(acc) AS mean_acc
  FROM grid GROUP BY kernel, depth)
SELECT kernel, depth, round(mean_f1, 6) AS mean_f1, round(mean_acc, 6) AS mean_acc FROM scores"""


@query("a30_grid_scores", _SCORES)
def a30(spark, d):
    return rounded(_grid_scores(spark, d))


@query("k2_best_parameters", _SCORES + " WHERE mean_f1 IS NOT NULL ORDER BY scores.mean_f1 DESC, kernel, depth LIMIT 1")
def k2(spark, d):
    return rounded(r.best_parameters(_grid_scores(spark, d), ["kernel", "depth"]))


@query("k4_top_results", _SCORES + " ORDER BY scores.mean_f1 DESC NULLS LAST, kernel, depth LIMIT 10")
def k4(spark, d):
    return rounded(r.top_results(_grid_scores(spark, d), ["kernel", "depth"]))


@query("k1_best_metric", f"""WITH {LOG} SELECT * FROM log WHERE metric = 'purchase' AND phase = 'val'
ORDER BY value DESC, step LIMIT 1""")
def k1(spark, d):
    return r.best_metric(t.metrics_log(spark, d), "purchase", "val")


@query("k3_best_fold", f"""WITH {FOLDS}, s AS (
  SELECT model, fold, CASE WHEN val_f1 IS NULL OR isnan(val_f1) THEN -1.0::DOUBLE ELSE val_f1 END AS score FROM folds)
SELECT model, fold AS best_fold, round(score, 6) AS best_score FROM s
QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, fold) = 1""")
def k3(spark, d):
    return rounded(r.best_fold(t.folds(spark, d)))


@query("a33_complete_models", f"""WITH {FOLDS}
SELECT model, count(*) AS folds_done, count(*) >= 5 AS is_complete FROM folds GROUP BY model""")
def a33(spark, d):
    return r.complete_models(t.folds(spark, d), 5)


@query("j16_parameter_combinations", """WITH sizes AS (SELECT DISTINCT p_brand, p_size FROM part),
kinds AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT p_brand, p_size, p_type FROM sizes JOIN kinds USING (p_brand)""")
def j16(spark, d):
    grids = t.load(spark, d, "part").groupBy("p_brand").agg(
        F.collect_set("p_size").alias("sizes"), F.collect_set("p_type").alias("types"))
    return r.parameter_combinations(grids, {"p_size": "sizes", "p_type": "types"})


@query("j16_linear_grid", """WITH g AS (
  SELECT DISTINCT l_shipmode.penalty, s.solver, l_discount AS l1_ratio, l_returnflag
  FROM lineitem, (SELECT unnest(['l1', 'l2', 'elasticnet']) AS penalty) l_shipmode,
       (SELECT unnest(['liblinear', 'saga']) AS solver) s)
SELECT DISTINCT l_returnflag AS model, penalty, solver, CASE WHEN penalty = 'elasticnet' THEN l1_ratio END AS l1_ratio
FROM g WHERE penalty <> 'elasticnet' OR solver = 'saga'""")
def j16b(spark, d):
    models = t.load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")) \
        .agg(F.collect_set("l_discount").alias("_r")) \
        .withColumn("_p", F.array(F.lit("l1"), F.lit("l2"), F.lit("elasticnet"))) \
        .withColumn("_s", F.array(F.lit("liblinear"), F.lit("saga")))
    return r.clean_linear_grid(r.parameter_combinations(models, {"penalty": "_p", "solver": "_s", "l1_ratio": "_r"}))


@query("p5_metric_filter", f"WITH {LOG} SELECT * FROM log WHERE metric = 'click' AND phase = 'train'")
def p5(spark, d):
    return t.metrics_log(spark, d).where((F.col("metric") == "click") & (F.col("phase") == "train"))


@query("w6_last_values", f"""WITH {LOG} SELECT run_id, metric, value FROM log WHERE phase = 'val'
QUALIFY row_number() OVER (PARTITION BY run_id, metric ORDER BY step DESC) = 1""")
def w6(spark, d):
    from vidspark.operators.merging import last_values
    return last_values(t.metrics_log(spark, d).where(F.col("phase") == "val"), ["run_id", "metric"], "value", "step")


@query("y8_rows_from_metrics", """SELECT l_orderkey, l_partkey, 'tax' AS metric, l_tax AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, 'discount', l_discount FROM lineitem""")
def y8a(spark, d):
    li = t.load(spark, d, "lineitem").withColumn("metrics", F.create_map(
        F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount")))
    return r.metrics_to_rows(li, ["l_orderkey", "l_partkey"])


@query("y8_metrics_per_epoch", f"""WITH {LOG}, last AS (
  SELECT run_id, epoch, metric, value FROM log
  QUALIFY row_number() OVER (PARTITION BY run_id, epoch, metric ORDER BY step DESC) = 1)
SELECT run_id, epoch, max(CASE WHEN metric = 'click' THEN value END) AS click,
       max(CASE WHEN metric = 'purchase' THEN value END) AS purchase FROM last GROUP BY run_id, epoch""")
def y8b(spark, d):
    return r.metrics_to_columns(t.metrics_log(spark, d), ["run_id", "epoch"], ["click", "purchase"])


@query("s10_registered_table", f"""WITH {MANIFEST}
SELECT platform, count(*) AS n, CAST(sum(frame_count) AS BIGINT) AS frames FROM manifest WHERE label = 1 GROUP BY platform""")
def s10(spark, d):
    a = r.Analytics(spark)
    a.register_dataframe("clip_metadata", t.manifest(spark, d))
    return a.query("SELECT platform, count(*) AS n, sum(frame_count) AS frames FROM clip_metadata "
                   "WHERE label = 1 GROUP BY platform")


@query("s11_adhoc_sql", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus""")
def s11(spark, d):
    return r.Analytics(spark).query(
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {items} "
        "WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus", items=t.load(spark, d, "lineitem"))


@query("p13_checked_table", f"""WITH {STAGE2} SELECT seq, lines FROM stage2""")
def p13(spark, d):
    t.stage2_features(spark, d).createOrReplaceTempView(r.check_identifier("stage2_features"))
    return spark.table(r.check_identifier("stage2_features")).select("seq", "lines")
