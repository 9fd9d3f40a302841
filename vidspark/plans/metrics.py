"""Classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.functions import numeric as x
from vidspark.operators import metrics as m
from vidspark.plans.registry import query
from vidspark.plans.reports import rounded
from vidspark.plans.views import MANIFEST, SCORED


@query("a10_class_counts", f"WITH {MANIFEST} SELECT label, count(*) AS n FROM manifest GROUP BY label")
def a10(spark, d):
    return m.class_counts(t.manifest(spark, d))


@query("a11_class_weights", f"""WITH {MANIFEST}, c AS (
  SELECT label, count(*) AS n FROM manifest WHERE label IS NOT NULL GROUP BY label),
w AS (SELECT label, n, (SELECT sum(n) FROM c) / (n + 1e-6::DOUBLE) AS raw FROM c)
SELECT label, n, round(raw / (SELECT sum(raw) FROM w) * (SELECT count(*) FROM w), 6) AS weight FROM w""")
def a11(spark, d):
    return rounded(m.class_weights(t.manifest(spark, d)))


@query("a12_positive_weight", f"""WITH {MANIFEST}
SELECT round(count(*) FILTER (WHERE label = 0)::DOUBLE / count(*) FILTER (WHERE label = 1), 6) AS scale_pos_weight FROM manifest""")
def a12(spark, d):
    return rounded(m.positive_weight(t.manifest(spark, d)))


_CONF = """c AS (SELECT count(*) FILTER (WHERE y_pred = 1 AND y_true = 1) AS tp, count(*) FILTER (WHERE y_pred = 0 AND y_true = 0) AS tn,
  count(*) FILTER (WHERE y_pred = 1 AND y_true = 0) AS fp, count(*) FILTER (WHERE y_pred = 0 AND y_true = 1) AS fn FROM scored)"""
_PR = """pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p1,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r1,
  CASE WHEN tn + fn > 0 THEN tn::DOUBLE / (tn + fn) ELSE 0 END AS p0,
  CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS r0 FROM c)"""


@query("a13_basic_metrics", f"""WITH {SCORED}, {_CONF}, {_PR}
SELECT tp, tn, fp, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(p1, 6) AS precision,
       round(r1, 6) AS recall, round(2 * p1 * r1 / (p1 + r1), 6) AS f1 FROM pr""")
def a13(spark, d):
    return rounded(m.basic_metrics(t.scored(spark, d)))


@query("a14_confusion_matrix", f"""WITH {SCORED}
SELECT y_true, count(*) FILTER (WHERE y_pred = 0) AS pred_0, count(*) FILTER (WHERE y_pred = 1) AS pred_1 FROM scored GROUP BY y_true""")
def a14(spark, d):
    return m.confusion_matrix(t.scored(spark, d))


@query("a15_full_metrics", f"""WITH {SCORED}, {_CONF}, {_PR}
SELECT round((SELECT -avg(ln(CASE WHEN y_true = 1 THEN p1 ELSE 1.0::DOUBLE - p1 END + 1e-10::DOUBLE)) FROM scored), 6) AS val_loss,
       round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS val_acc, round(2 * p1 * r1 / (p1 + r1), 6) AS val_f1,
       round(p1, 6) AS val_precision, round(r1, 6) AS val_recall, round(2 * p0 * r0 / (p0 + r0), 6) AS val_f1_class0,
       round(p0, 6) AS val_precision_class0, round(r0, 6) AS val_recall_class0,
       round(2 * p1 * r1 / (p1 + r1), 6) AS val_f1_class1, round(p1, 6) AS val_precision_class1,
       round(r1, 6) AS val_recall_class1 FROM pr""")
def a15(spark, d):
    return rounded(m.full_metrics(t.scored(spark, d)))


_STEPS = """per AS (SELECT p1 AS threshold, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM scored GROUP BY p1),
steps AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg FROM per
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""
_AUC = "(SELECT sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(tpos)::DOUBLE * max(tneg)) FROM steps)"
_AP = "(SELECT sum(pos::DOUBLE / tpos * (tp::DOUBLE / (tp + fp))) FROM steps)"


@query("a16_roc_auc", f"WITH {SCORED}, {_STEPS} SELECT round({_AUC}, 6) AS roc_auc")
def a16(spark, d):
    return rounded(m.roc_auc(m.score_steps(t.scored(spark, d))))


@query("a17_average_precision", f"WITH {SCORED}, {_STEPS} SELECT round({_AP}, 6) AS average_precision")
def a17(spark, d):
    return rounded(m.average_precision(m.score_steps(t.scored(spark, d))))


@query("a18_roc_points", f"""WITH {SCORED}, {_STEPS}
SELECT threshold, round(fp::DOUBLE / tneg, 6) AS fpr, round(tp::DOUBLE / tpos, 6) AS tpr FROM steps""")
def a18(spark, d):
    return m.roc_points(m.score_steps(t.scored(spark, d))).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query("a18_pr_points", f"""WITH {SCORED}, {_STEPS}
SELECT threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / tpos, 6) AS recall FROM steps""")
def a18b(spark, d):
    return m.pr_points(m.score_steps(t.scored(spark, d))).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("w8_score_steps", """WITH per AS (
  SELECT l_extendedprice AS threshold, count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag <> 'R') AS neg
  FROM lineitem GROUP BY 1)
SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM per
WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def w8(spark, d):
    preds = t.load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                                                F.col("l_extendedprice").alias("p1"))
    return m.score_steps(preds).select("threshold", "tp", "fp")


@query("f16_evaluation", f"""WITH {SCORED}, {_CONF}, {_PR}, {_STEPS}
SELECT tp, tn, fp, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(p1, 6) AS precision,
       round(r1, 6) AS recall, round(2 * p1 * r1 / (p1 + r1), 6) AS f1, round({_AUC}, 6) AS roc_auc,
       round({_AP}, 6) AS average_precision FROM pr""")
def f16(spark, d):
    return rounded(m.evaluation(t.scored(spark, d)))


@query("a24_score_histogram", """WITH s AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y_true, l_extendedprice AS p FROM lineitem),
b AS (SELECT y_true, min(p) AS lo, max(p) AS hi FROM s GROUP BY y_true)
SELECT y_true, CAST(least(floor((p - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n
FROM s JOIN b USING (y_true) GROUP BY 1, 2""")
def a24(spark, d):
    preds = t.load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                                                F.col("l_extendedprice").alias("p1"))
    return m.score_histogram(preds)


@query("a24_score_box", f"""SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem GROUP BY 1""")
def a24b(spark, d):
    preds = t.load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                                                F.col("l_extendedprice").alias("p1"))
    return rounded(m.score_box(preds), 4)


_BASE = """base AS (SELECT user_id, event_type AS model, least(avg(value) / 100.0::DOUBLE, 1.0::DOUBLE) AS p1,
  CAST(user_id % 2 AS INTEGER) AS y_true FROM events GROUP BY user_id, event_type)"""


def base_predictions(spark, d):
    """One row per user and event type: each type stands for a model that scores the user."""
    return t.load(spark, d, "events").groupBy("user_id", F.col("event_type").alias("model")).agg(
        F.least(F.avg("value") / 100.0, F.lit(1.0)).alias("p1"), (F.max("user_id") % 2).cast("int").alias("y_true")) \
        .withColumn("p0", 1.0 - F.col("p1"))


@query("a25_ensemble_mean", f"""WITH {_BASE}, e AS (
  SELECT user_id, avg(1.0::DOUBLE - p1) AS p0, avg(p1) AS p1, max(y_true) AS y_true FROM base GROUP BY user_id)
SELECT user_id, round(p0, 6) AS p0, round(p1, 6) AS p1, y_true, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS y_pred FROM e""")
def a25(spark, d):
    return rounded(m.ensemble_mean(base_predictions(spark, d), "user_id"))


@query("a25_ensemble_accuracy", f"""WITH {_BASE}, e AS (
  SELECT user_id, avg(1.0::DOUBLE - p1) AS p0, avg(p1) AS p1, max(y_true) AS y_true FROM base GROUP BY user_id)
SELECT round(avg(CASE WHEN CASE WHEN p1 > p0 THEN 1 ELSE 0 END = y_true THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM e""")
def a25b(spark, d):
    return rounded(m.basic_metrics(m.ensemble_mean(base_predictions(spark, d), "user_id")).select("accuracy"))


@query("x16_scores", """SELECT l_orderkey, l_partkey, l_quantity,
       round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(l_discount * 10.0::DOUBLE - l_tax * 10.0::DOUBLE))), 6) AS sig,
       round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 6) AS soft_0,
       CASE WHEN l_tax >= l_discount THEN 0 ELSE 1 END AS best FROM lineitem""")
def x16(spark, d):
    li = t.load(spark, d, "lineitem")
    scores = [F.col("l_tax"), F.col("l_discount")]
    return li.select("l_orderkey", "l_partkey", "l_quantity",
                     F.round(x.sigmoid(F.col("l_discount") * 10.0 - F.col("l_tax") * 10.0), 6).alias("sig"),
                     F.round(x.softmax(scores)[0], 6).alias("soft_0"), x.argmax(scores).alias("best"))


@query("x17_thresholds", """SELECT l_quantity / 50.0::DOUBLE AS p, count(*) AS n, max(CAST(l_quantity / 50.0::DOUBLE > 0.5 AS INTEGER)) AS strict,
       max(CAST(l_quantity / 50.0::DOUBLE >= 0.5 AS INTEGER)) AS loose FROM lineitem GROUP BY 1""")
def x17(spark, d):
    p = F.col("l_quantity") / 50.0
    return t.load(spark, d, "lineitem").groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumns({"strict": x.above(F.col("p")), "loose": x.at_least(F.col("p"))})


@query("x18_finite_values", """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0.0::DOUBLE ELSE value END AS value
FROM events""")
def x18(spark, d):
    dirty = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))) \
        .otherwise(F.col("value"))
    return t.load(spark, d, "events").select("event_id", x.finite_or_zero(dirty).alias("value"))
