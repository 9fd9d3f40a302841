"""Classification metrics as one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.functions.numeric import ratio_or_zero
from vidspark.operators.ranking import exact_quantiles, running_totals

EPS = 1e-10


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse frequency, scaled so that the weights sum to the number of classes.

    The counts, one per class, are gathered in one row, so the rows are counted once.
    """
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    row = counts.agg(F.collect_list(F.struct(label, "n")).alias("_c"))
    inverse = F.aggregate("_c", F.lit(0.0), lambda a, c: a + F.lit(1.0) / (c["n"] + F.lit(1e-6)))
    return row.withColumns({"_inv": inverse, "_k": F.size("_c")}) \
        .select(F.explode("_c").alias("_c"), "_inv", "_k") \
        .select(f"_c.{label}", "_c.n", (F.lit(1.0) / (F.col("_c.n") + F.lit(1e-6)) / F.col("_inv") * F.col("_k")).alias("weight"))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive; 1 when there are no positives."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(F.when(pos > 0, neg / F.when(pos > 0, pos)).otherwise(1.0).alias("scale_pos_weight"))


def _f1(p: Column, r: Column) -> Column:
    return ratio_or_zero(F.lit(2.0) * p * r, p + r)


def confusion_counts(y: str, pred: str) -> list[Column]:
    t, p = F.col(y), F.col(pred)
    return [F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 0) & (t == 0)).alias("tn"),
            F.count_if((p == 1) & (t == 0)).alias("fp"), F.count_if((p == 0) & (t == 1)).alias("fn")]


def _scores(counts: DataFrame, keep: list[Column]) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    return counts.select(*keep, "tp", "tn", "fp", "fn", ratio_or_zero(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                         precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def basic_metrics(preds: DataFrame, y: str = "y_true", pred: str = "y_pred", groups: list[str] = ()) -> DataFrame:
    counts = preds.groupBy(*groups).agg(*confusion_counts(y, pred))
    return _scores(counts, [F.col(g) for g in groups])


def confusion_matrix(preds: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows are true classes, columns predicted ones."""
    return preds.groupBy(y).pivot(pred, [0, 1]).agg(F.count(F.lit(1))) \
        .select(y, F.coalesce("0", F.lit(0)).alias("pred_0"), F.coalesce("1", F.lit(0)).alias("pred_1"))


def full_metrics(preds: DataFrame, y: str = "y_true", pred: str = "y_pred", prob: str | None = "p1",
                 groups: list[str] = ()) -> DataFrame:
    """Loss, overall and per-class metrics in one pass; the loss is NaN without probabilities."""
    loss = F.lit(float("nan")) if prob is None else \
        -F.avg(F.ln(F.when(F.col(y) == 1, F.col(prob)).otherwise(F.lit(1.0) - F.col(prob)) + F.lit(EPS)))
    counts = preds.groupBy(*groups).agg(loss.alias("val_loss"), *confusion_counts(y, pred))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p1, r1 = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    p0, r0 = ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp)
    return counts.select(
        *groups, "val_loss", ratio_or_zero(tp + tn, tp + tn + fp + fn).alias("val_acc"), _f1(p1, r1).alias("val_f1"),
        p1.alias("val_precision"), r1.alias("val_recall"),
        _f1(p0, r0).alias("val_f1_class0"), p0.alias("val_precision_class0"), r0.alias("val_recall_class0"),
        _f1(p1, r1).alias("val_f1_class1"), p1.alias("val_precision_class1"), r1.alias("val_recall_class1"))


def score_steps(preds: DataFrame, y: str = "y_true", score: str = "p1") -> DataFrame:
    """One row per distinct score with running true and false positives from the highest score down.

    Rows are counted per score first; the running sums go over distinct scores only.
    """
    per_score = preds.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    return running_totals(per_score, {"tp": F.col("pos"), "fp": F.col("neg")}, "threshold", descending=True,
                          totals=True, sketch_from=preds.select(F.col(score).alias("threshold")))


def roc_auc(steps: DataFrame) -> DataFrame:
    """Share of positive-negative pairs in right order, ties counting half; NULL when a class is missing."""
    above = F.col("tp") - F.col("pos")
    pairs = F.sum(F.col("neg").cast("double") * (above.cast("double") + F.col("pos") / F.lit(2.0)))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return steps.agg(F.when((p > 0) & (n > 0), pairs / F.nullif(p * n, F.lit(0.0))).alias("roc_auc"))


def average_precision(steps: DataFrame) -> DataFrame:
    """Sum of recall gains times precision over falling thresholds."""
    gain = F.col("pos") / F.nullif(F.col("tp_total"), F.lit(0).cast("bigint"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.agg(F.coalesce(F.sum(gain * precision), F.lit(0.0)).alias("average_precision"))


def roc_points(steps: DataFrame) -> DataFrame:
    return steps.select("threshold", ratio_or_zero(F.col("fp"), F.col("fp_total")).alias("fpr"),
                        ratio_or_zero(F.col("tp"), F.col("tp_total")).alias("tpr"))


def pr_points(steps: DataFrame) -> DataFrame:
    return steps.select("threshold", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                        ratio_or_zero(F.col("tp"), F.col("tp_total")).alias("recall"))


def evaluation(preds: DataFrame, y: str = "y_true", score: str = "p1", threshold: float = 0.5) -> DataFrame:
    """F1, AUC, average precision and confusion counts in one row (F16), all from the counts per score."""
    steps = score_steps(preds, y, score)
    hit = F.col("threshold") > threshold
    sums = steps.agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
                     F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
                     F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
                     F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"))
    return _scores(sums, []).withColumn("roc_auc", roc_auc(steps).scalar()) \
        .withColumn("average_precision", average_precision(steps).scalar())


def score_histogram(preds: DataFrame, y: str = "y_true", score: str = "p1", bins: int = 50) -> DataFrame:
    """Rows per class and bin, bins of equal width between that class's lowest and highest score."""
    span = preds.groupBy(F.col(y).alias("_y")).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    spans = span.where(F.col("_y").isNotNull()) \
        .agg(F.map_from_entries(F.collect_list(F.struct("_y", F.struct("lo", "hi"))))).scalar()  # one entry per class
    per_score = preds.where(F.col(y).isNotNull()).groupBy(y, score).agg(F.count(F.lit(1)).alias("_n"))
    joined = per_score.withColumn("_s", F.try_element_at(spans, F.col(y)))
    low, width = F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo")
    raw = F.floor((F.col(score) - low) / F.nullif(width, F.lit(0.0)) * bins)
    # a single value lies in the middle of a span of width one
    number = F.when(width == 0, F.lit(bins // 2)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    return joined.groupBy(y, number.alias("bin")).agg(F.sum("_n").alias("n"))


def score_box(preds: DataFrame, y: str = "y_true", score: str = "p1") -> DataFrame:
    return exact_quantiles(preds, [y], score, {"q25": 0.25, "median": 0.5, "q75": 0.75})


def ensemble_mean(preds: DataFrame, key: str, p0: str = "p0", p1: str = "p1") -> DataFrame:
    """Mean probabilities over the models of each row, and the likelier class."""
    return preds.groupBy(key).agg(F.avg(p0).alias("p0"), F.avg(p1).alias("p1"), F.max("y_true").alias("y_true")) \
        .withColumn("y_pred", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0))
