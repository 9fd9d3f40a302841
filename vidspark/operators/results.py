"""Reports over manifests, folds and metric logs."""

from __future__ import annotations

import math
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidspark.functions.numeric import nan_to_null
from vidspark.operators.ranking import exact_quantiles, shuffled_sample


# Tasks get the t-distribution by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Analytics:
    """Canned statistics and free SQL over registered tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def register_dataframe(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(check_identifier(name))

    def register_parquet(self, name: str, path: str) -> None:
        self.register_dataframe(name, self.spark.read.parquet(path))

    def query(self, sql: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(sql, **tables)

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(check_identifier(name))

    def get_video_statistics(self, table: str = "metadata") -> DataFrame:
        return video_statistics(self._table(table))

    def get_augmentation_distribution(self, table: str = "metadata") -> DataFrame:
        return augmentation_distribution(self._table(table))

    def get_scaling_statistics(self, table: str = "scaled_metadata") -> DataFrame:
        return scaling_statistics(self._table(table))

    def get_feature_statistics(self, table: str = "features") -> DataFrame:
        return feature_statistics(self._table(table))

    def get_training_results_summary(self, table: str = "training_results") -> DataFrame:
        return training_summary(self._table(table))


def check_identifier(name: str) -> str:
    if not re.fullmatch(r"[^\W_]\w*|_+[^\W_]\w*", name):
        raise ValueError(f"invalid table name: {name}")
    return name


def video_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("video_count"), F.count_distinct("original_video").alias("unique_originals"),
        F.avg(F.when(F.col("is_original"), 1.0).otherwise(0.0)).alias("original_ratio"))


def augmentation_distribution(df: DataFrame) -> DataFrame:
    """Share of all rows: rows without a type count in the denominator only. One pass over the table."""
    counts = df.groupBy("augmentation_type").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.where(F.col("augmentation_type").isNotNull()) \
        .withColumn("percentage", F.col("count") * F.lit(100.0) / total).orderBy(F.col("count").desc(), "augmentation_type")


def scaling_statistics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_videos"),
        F.sum(F.when(F.col("is_upscaled").cast("boolean"), 1).otherwise(0)).alias("upscaled_count"),
        F.sum(F.when(F.col("is_downscaled").cast("boolean"), 1).otherwise(0)).alias("downscaled_count"),
        F.avg("scaled_width").alias("avg_width"), F.avg("scaled_height").alias("avg_height"),
        F.avg("original_width").alias("avg_original_width"), F.avg("original_height").alias("avg_original_height"))


def feature_statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_samples"), F.count_distinct("video_path").alias("unique_videos"),
                  F.count_distinct("label").alias("unique_labels"))


def training_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("model_type").agg(
        F.avg("val_acc").alias("avg_val_acc"), F.stddev_samp("val_acc").alias("std_val_acc"),
        F.avg("val_loss").alias("avg_val_loss"), F.stddev_samp("val_loss").alias("std_val_loss"),
        F.count(F.lit(1)).alias("fold_count")).orderBy(F.col("avg_val_acc").desc(), "model_type")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def dataset_profile(df: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    real, fake = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return df.agg(total.alias("total_videos"), real.alias("real_count"), fake.alias("fake_count"),
                  (real / total * 100).alias("real_pct"), (fake / total * 100).alias("fake_pct"),
                  F.avg("duration_sec").alias("avg_duration"), (F.sum("duration_sec") / 3600).alias("total_duration_hours"))


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled values per column, counted for all columns in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["_n"], columns, "column", "non_null") \
        .select("column", "non_null", (F.col("non_null") * 100.0 / F.nullif(F.col("_n"), F.lit(0))).alias("percent"))


def fold_averages(df: DataFrame, columns: list[str], groups: list[str] = ()) -> DataFrame:
    aggs = [F.avg(c).alias(f"avg_{c}") for c in columns] + [F.stddev_samp(c).alias(f"std_{c}") for c in columns]
    return df.groupBy(*groups).agg(*aggs)


def valid_fold_means(df: DataFrame, columns: list[str], model: str = "model") -> DataFrame:
    """Means over the folds that have a value: neither NULL nor NaN."""
    return df.groupBy(model).agg(*[F.avg(nan_to_null(F.col(c))).alias(f"avg_{c}") for c in columns])


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, population deviation, extremes and exact quartiles."""
    entries = F.array(*[F.struct(
        F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max")) for c in columns])
    moments = df.agg(entries.alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    quartiles = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(quartiles, "column", "left")


# ---- Student's t, for the few rows of a model table -----------------------------------------------------------

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def _beta_ratio(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Probability that |T| exceeds |t|."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    return 0.0 if math.isinf(t) else _beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by halving."""
    if df <= 0:
        return float("nan")
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2.0 > 1.0 - p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) / 2.0 > 1.0 - p else (low, mid)
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def _t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_975(df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(0.975, float(b)) for b in df], dtype="float64")


def confidence_summary(df: DataFrame, value: str = "val_acc", model: str = "model") -> DataFrame:
    """Per model mean, population deviation, extremes and 95 % t-interval.

    The t quantile depends on the number of folds only and is worked out per model row.
    """
    m = df.groupBy(model).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                              (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("_sem"),
                              F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("folds"))
    half = _t_975((F.col("folds") - 1).cast("double")) * F.col("_sem")
    return m.withColumn("_half", half).select(model, "mean", "std", (F.col("mean") - F.col("_half")).alias("ci_lower"),
                                              (F.col("mean") + F.col("_half")).alias("ci_upper"), "min", "max", "folds")


def pairwise_t_tests(df: DataFrame, value: str = "val_acc", model: str = "model", alpha: float = 0.05) -> DataFrame:
    """Pooled t-test for every pair of models (A23, J15), on one row of moments per model.

    Each model meets the later ones: the sorted list of model rows is as long as there are models.
    """
    m = df.where(F.col(value).isNotNull()).groupBy(model).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    all_models = m.agg(F.array_sort(F.collect_list(F.struct(model, "n", "mean", "var")))).scalar()
    pairs = m.withColumn("_o", all_models).select(F.struct(model, "n", "mean", "var").alias("a"), F.explode("_o").alias("b")) \
        .where(F.col(f"a.{model}") < F.col(f"b.{model}"))
    dof = F.col("a.n") + F.col("b.n") - 2
    pooled = ((F.col("a.n") - 1) * F.coalesce("a.var", F.lit(0.0)) + (F.col("b.n") - 1) * F.coalesce("b.var", F.lit(0.0))) \
        / F.nullif(dof, F.lit(0).cast("bigint"))
    t = (F.col("a.mean") - F.col("b.mean")) / F.nullif(
        F.sqrt(pooled * (F.lit(1.0) / F.col("a.n") + F.lit(1.0) / F.col("b.n"))), F.lit(0.0))
    rows = pairs.select(F.col(f"a.{model}").alias("model_1"), F.col(f"b.{model}").alias("model_2"),
                        t.alias("t_statistic"), dof.cast("double").alias("dof"))
    return rows.withColumn("p_value", _t_p_value("t_statistic", "dof")) \
        .withColumn("significant", F.when(F.col("p_value") < alpha, "Yes").otherwise("No"))


# ---- metric logs and searches ---------------------------------------------------------------------------------

def best_metric(log: DataFrame, metric: str, phase: str, maximize: bool = True) -> DataFrame:
    """The best row of one metric; the earliest wins among equals (K1)."""
    value = nan_to_null(F.col("value"))
    order = value.desc_nulls_last() if maximize else value.asc_nulls_last()
    return log.where((F.col("metric") == metric) & (F.col("phase") == phase)).orderBy(order, "step").limit(1)


def best_fold(df: DataFrame, score: str = "val_f1", model: str = "model", fold: str = "fold") -> DataFrame:
    """Fold with the best score per model; no value counts as -1, the first of equals wins (K3)."""
    clean = F.coalesce(nan_to_null(F.col(score)), F.lit(-1.0))
    best = F.max_by(F.struct(F.col(fold).alias("best_fold"), clean.alias("best_score")), F.struct(clean, -F.col(fold)))
    return df.groupBy(model).agg(best.alias("_b")).select(model, "_b.*")


def grid_scores(df: DataFrame, params: list[str], columns: dict[str, str]) -> DataFrame:
    """Mean score per parameter set, NaN left out."""
    return df.groupBy(*params).agg(*[F.avg(nan_to_null(F.col(c))).alias(n) for n, c in columns.items()])


def best_parameters(scores: DataFrame, order: list[str], score: str = "mean_f1") -> DataFrame:
    """The parameter set with the best score; sets without one are out, the first of equals wins (K2)."""
    return scores.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.col(score).desc(), *order).limit(1)


def top_results(scores: DataFrame, order: list[str], score: str = "mean_f1", k: int = 10) -> DataFrame:
    return scores.orderBy(F.col(score).desc_nulls_last(), *order).limit(k)


def complete_models(df: DataFrame, n_splits: int, model: str = "model") -> DataFrame:
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("folds_done")) \
        .withColumn("is_complete", F.col("folds_done") >= n_splits)


def parameter_combinations(df: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """Every combination of the listed values, one explode per parameter.

    ``parameters`` maps each parameter to the array column with its values.
    """
    out = df
    for name, column in parameters.items():
        out = out.withColumn(name, F.explode(column))
    return out.drop(*set(parameters.values()))


def clean_linear_grid(grid: DataFrame) -> DataFrame:
    """Elastic net needs saga; l1_ratio means something for elastic net only; what is then equal is one entry."""
    elastic = F.col("penalty") == "elasticnet"
    return grid.where(~elastic | (F.col("solver") == "saga")) \
        .withColumn("l1_ratio", F.when(elastic, F.col("l1_ratio"))).distinct()


def metrics_to_rows(df: DataFrame, keys: list[str], metrics: str = "metrics") -> DataFrame:
    """A map of metrics per row to one row per metric."""
    return df.select(*keys, F.explode(metrics).alias("metric", "value"))


def metrics_to_columns(log: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key with a column per metric; the last value in log order counts."""
    return log.groupBy(*keys).agg(*[F.max_by(F.when(F.col("metric") == m, F.col("value")),
                                             F.when(F.col("metric") == m, F.col("step"))).alias(m) for m in metrics])


def validity(verdicts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Share of valid rows and the decision taken on it."""
    n, ok = F.count(F.lit(1)), F.count_if("is_valid")
    bad = F.count_if(~F.col("is_valid") & F.lower(F.coalesce("error_reason", F.lit(""))).rlike("corrupt|moov atom"))
    share = F.when(n > 0, ok / F.nullif(n, F.lit(0))).otherwise(0.0)
    return verdicts.agg(n.alias("checked"), ok.alias("valid"), bad.alias("corrupted"), share.alias("valid_rate"),
                        (share >= threshold).alias("keep_all"))


def wilson_bounds(valid: int, n: int, z: float) -> tuple[float, float]:
    """Bounds on a share of which ``valid`` of ``n`` drawn rows are evidence; (0, 1) without any."""
    if not n:
        return 0.0, 1.0
    share, spread = valid / n, z * z / n
    middle = (share + spread / 2) / (1 + spread)
    half = z * math.sqrt(share * (1 - share) / n + spread / (4 * n)) / (1 + spread)
    return middle - half, middle + half


def sampled_validity(rows: DataFrame, key: str, validate, sample: int, threshold: float = 0.9, required: int = 0,
                     z: float = 1.96, seed: int = 42) -> DataFrame:
    """Whether to keep all rows, decided on a seeded sample where that is enough.

    The sample is exact and the same on any cluster (``shuffled_sample``). If the Wilson bounds of its valid share lie on
    one side of the threshold the decision is taken there, and the number of valid rows is estimated; only else all rows
    are validated. ``validate`` adds is_valid to rows. One row: n_rows, checked, valid, valid_rate, lower and upper bound,
    estimated number, whether it reaches ``required``, decided_by ('sample' or 'all') and keep_all. Counts alone reach the
    driver. An empty table is not kept.
    """
    total = rows.count()

    def counted(some: DataFrame) -> tuple[int, int]:
        r = validate(some).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid")).head()
        return r["n"], r["valid"]

    n, valid = counted(shuffled_sample(rows, key, sample, seed))
    low, high = wilson_bounds(valid, n, z)
    by = "sample" if n < total and (low >= threshold or high < threshold) else "all"
    if by == "all" and n < total:
        n, valid = counted(rows)
    if by == "all":
        low = high = valid / n if n else 0.0
    rate = valid / n if n else 0.0
    estimate = round(rate * total)
    row = (total, n, valid, rate, low, high, estimate, estimate >= required, by, bool(n) and rate >= threshold)
    return rows.sparkSession.createDataFrame([row], "n_rows bigint, checked bigint, valid bigint, valid_rate double, lower double, "
                                                    "upper double, estimated bigint, enough boolean, decided_by string, keep_all boolean")
