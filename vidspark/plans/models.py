"""Classifiers (F9-F18, F20). Fits are small here; what grows with the tables is the data they pass over."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.operators import features as fe
from vidspark.operators import metrics as m
from vidspark.operators import models as mo
from vidspark.operators import splits as sp
from vidspark.operators.stages import FeaturePreparer, FeatureSelector, feature_pipeline
from vidspark.plans.features import gappy
from vidspark.plans.metrics import base_predictions
from vidspark.plans.registry import query
from vidspark.plans.reports import rounded
from vidspark.session import materialize, scratch_path

COLUMNS = ["stage2_quantity", "stage2_price", "stage2_discount", "stage2_tax", "stage4_total"]


def feature_table(spark, d):
    """Combined features with a split and a fold, written once for all the passes of a fit. The label is noisy but learnable: dear orders are mostly positive."""
    rows = fe.combine_stages(t.feature_targets(spark, d), t.stage2_features(spark, d), t.stage4_features(spark, d))
    rows = rows.withColumn("label", ((F.col("stage4_total") + F.col("stage2_price") * 2 + F.col("id") % 5 * 40000) > 420000).cast("int"))
    rows = sp.two_cut_split(rows.select("id", "label", *COLUMNS), "id")
    return materialize(sp.stratified_folds(rows, "id", 3, platform=None, group=None), "features")


def _fit_and_score(kind, **params):
    def run(spark, d):
        rows = feature_table(spark, d)
        train = rows.where(F.col("split") == "train")
        fitted = mo.model_pipeline(kind, COLUMNS, train.count(), **params).fit(train)
        return rounded(m.full_metrics(mo.predictions(fitted, rows.where(F.col("split") == "test"), "id")), 4)
    return run


query("f9_logistic_regression")(_fit_and_score("logistic_regression", C=1.0))
query("f10_linear_svm")(_fit_and_score("svm", C=1.0))
query("f11_gradient_boosting")(_fit_and_score("gradient_boosting"))
query("f13_feature_mlp")(_fit_and_score("feature_mlp"))


def _fitted_margin(spark, d, kind):
    """(rows as x, an array with 1 in front; y; margin of the weights found), weights with the intercept first, penalty."""
    rows = feature_table(spark, d).where("split = 'train'")
    n = rows.count()
    model = mo.model_pipeline(kind, COLUMNS, n, C=1.0, max_iter=300).fit(rows)
    weights = [float(model.stages[-1].intercept), *map(float, model.stages[-1].coefficients)]
    x = model.transform(rows).select(F.concat(F.array(F.lit(1.0)), vector_to_array("features")).alias("x"), F.col("label").alias("y"))
    margin = sum((F.get("x", F.lit(j)) * F.lit(w) for j, w in enumerate(weights)), F.lit(0.0))
    return x.withColumn("margin", margin), weights, 1.0 / n


_WEIGHTS = ["intercept", *COLUMNS]


@query("f9_stationary_weights", f"SELECT unnest({_WEIGHTS!r}) AS weight, true AS stationary")
def f9b(spark, d):
    """The gradient of the penalised loss is zero at the weights that were found."""
    rows, weights, penalty = _fitted_margin(spark, d, "logistic_regression")
    off = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))) - F.col("y")
    slopes = [(F.avg(off * F.get("x", F.lit(j))) + F.lit(penalty * w * (j > 0))).alias(_WEIGHTS[j]) for j, w in enumerate(weights)]
    return rows.agg(*slopes).unpivot([], _WEIGHTS, "weight", "slope").select("weight", (F.abs("slope") < 1e-3).alias("stationary"))


@query("f10_least_loss", f"SELECT unnest({_WEIGHTS!r}) AS weight, true AS least")
def f10b(spark, d):
    """The hinge loss has no slope everywhere, so each weight is moved both ways: the penalised loss gets no smaller."""
    rows, weights, penalty = _fitted_margin(spark, d, "svm")
    sign = F.col("y") * 2 - 1

    def loss(j, step):
        moved = F.col("margin") + F.get("x", F.lit(j)) * F.lit(step)
        size = sum((w + step * (k == j)) ** 2 for k, w in enumerate(weights) if k)
        return F.avg(F.greatest(F.lit(0.0), F.lit(1.0) - sign * moved)) + F.lit(penalty * size / 2)

    worse = [(F.least(loss(j, 0.05), loss(j, -0.05)) > loss(j, 0.0) - 1e-3).alias(_WEIGHTS[j]) for j in range(len(weights))]
    return rows.agg(*worse).unpivot([], _WEIGHTS, "weight", "least")


def _scored_test_rows(spark, d, kind):
    rows = feature_table(spark, d)
    fitted = feature_pipeline(kind, COLUMNS).fit(rows.where(F.col("split") == "train"))
    preds = mo.predictions(fitted, rows.where(F.col("split") == "test"), "id")
    return preds.select("id", "y_true", F.col("p1").between(0, 1).alias("scored"), (F.col("y_pred") == (F.col("p1") > 0.5).cast("int")).alias("cut_at_half"))


def _boosted_embeddings(spark, d):
    """(rows with their split, predictions of the test rows): columns pruned on the training rows, trees stopped by the
    validation rows, and test rows that neither has seen."""
    wide = t.load(spark, d, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("label"),
                                                 *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])
    rows = materialize(sp.two_cut_split(wide, "vec_id"), "embeddings")
    train, seen = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "test")
    columns = [f"e{i}" for i in range(64)]
    prepared = Pipeline(stages=[FeatureSelector(inputCols=columns), FeaturePreparer(inputCols=columns, normalize=False)]).fit(train)
    weight = m.positive_weight(train).scalar()
    weighted = prepared.transform(seen).select("vec_id", "label", "features", (F.col("split") == "val").alias("held")) \
        .withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    gbt = mo.make_classifier("gradient_boosting", 0, 64, weight="weight", validation="held")
    fitted = gbt.fit(materialize(weighted, "weighted"))
    return rows, mo.predictions(fitted, prepared.transform(rows.where(F.col("split") == "test")), "vec_id")


@query("f12_embedding_boosting")
def f12(spark, d):
    return rounded(m.full_metrics(_boosted_embeddings(spark, d)[1]), 4)


@query("f12_scored_rows", """WITH e AS (SELECT vec_id AS id, CAST(label >= 5 AS INTEGER) AS label,
  row_number() OVER (PARTITION BY label >= 5 ORDER BY md5('42-' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label >= 5) AS n FROM embeddings),
c AS (SELECT *, round_even(n * (0.2::DOUBLE + 0.2::DOUBLE), 0) AS n_rest FROM e),
s AS (SELECT id, label, CASE WHEN rn <= n - n_rest THEN 'train' WHEN rn <= n - round_even(n_rest * 0.5::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM c)
SELECT id AS vec_id, label, split, CAST(split = 'test' AS BIGINT) AS times_scored FROM s""")
def f12b(spark, d):
    """Which rows fit, stop and test: only test rows are scored, each once."""
    rows, preds = _boosted_embeddings(spark, d)
    scored = preds.where(F.col("p1").between(0, 1)).groupBy("vec_id").agg(F.count(F.lit(1)).alias("times_scored"))
    return rows.select("vec_id", "label", "split").join(scored, "vec_id", "left").fillna(0, ["times_scored"])


@query("f14_cross_validation")
def f14(spark, d):
    preds = mo.cross_validate(feature_table(spark, d), "logistic_regression", COLUMNS, "id", k=3, stored=True, C=1.0)
    return rounded(mo.fold_metrics(preds), 4)


def searched_rows(spark, d):
    rows = feature_table(spark, d)
    sample = sp.stratified_sample(rows.where(F.col("split") != "test"), "id", fraction=0.2).select("id", "in_sample")
    return rows.join(sample, "id", "left").withColumn("in_sample", F.coalesce("in_sample", F.lit(False)))


@query("f15_search_and_test")
def f15(spark, d):
    grid = mo.parameter_grid("logistic_regression")
    _, _, _, preds, _ = mo.search_and_fit(searched_rows(spark, d), "logistic_regression", COLUMNS, "id", grid, k=3)
    return rounded(m.evaluation(preds), 4)


# The table of the fits in SQL: labels, the 60/20/20 split by label, three folds by label, and the sample of the search.
_FITTED = """li AS (SELECT l_orderkey AS id, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
base AS (SELECT id, CAST(o_totalprice + price * 2 + id % 5 * 40000 > 420000 AS INTEGER) AS label FROM li JOIN orders ON o_orderkey = id),
cut AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM base),
rest AS (SELECT *, round_even(n * (0.2::DOUBLE + 0.2::DOUBLE), 0) AS n_rest FROM cut),
parts AS (SELECT id, label, CASE WHEN rn <= n - n_rest THEN 'train' WHEN rn <= n - round_even(n_rest * 0.5::DOUBLE, 0) THEN 'val'
  ELSE 'test' END AS split FROM rest),
folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42-r:' || id), 'r:' || id) - 1) % 3 AS INTEGER) AS fold FROM parts),
known AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id), id)
  <= round_even(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE, 0) AS in_sample FROM folded WHERE split <> 'test')"""


@query("f14_held_out_rows", f"""WITH {_FITTED} SELECT id, label AS y_true, fold, 1::BIGINT AS times,
  (SELECT count(*) FROM folded f WHERE f.fold <> g.fold) AS n_train FROM folded g""")
def f14b(spark, d):
    """Every row is scored once, by the model of the fold that held it out; with the rows that model has seen."""
    rows = feature_table(spark, d)
    preds = mo.cross_validate(rows, "logistic_regression", COLUMNS, "id", k=3, stored=True, C=1.0)
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    scored = preds.where(F.col("p1").between(0, 1)).groupBy("id", "y_true", "fold").agg(F.count(F.lit(1)).alias("times"))
    return scored.join(sizes.select("fold", (sizes.agg(F.sum("n")).scalar() - F.col("n")).alias("n_train")), "fold")


_TEST_ROWS = f"WITH {_FITTED} SELECT id, label AS y_true, true AS scored, true AS cut_at_half FROM folded WHERE split = 'test'"


@query("f11_scored_rows", _TEST_ROWS)
def f11b(spark, d):
    """Every test row is scored once by trees that were fitted on training rows alone."""
    return _scored_test_rows(spark, d, "gradient_boosting")


@query("f13_scored_rows", _TEST_ROWS)
def f13b(spark, d):
    """The same by a small net, which has as many inputs as the pruning leaves."""
    return _scored_test_rows(spark, d, "feature_mlp")


@query("f15_search_entries", f"""WITH {_FITTED}, entry AS (SELECT CAST(row_number() OVER (ORDER BY c, i) - 1 AS INTEGER) AS entry, c, i
  FROM (SELECT unnest([0.1::DOUBLE, 1.0, 10.0]) AS c), (SELECT unnest([1000, 2000]) AS i))
SELECT entry, c AS "C", i AS max_iter, fold, count(*) AS n_rows, true AS mean_of_folds, 1::BIGINT AS n_best
FROM entry, known WHERE in_sample GROUP BY ALL""")
def f15b(spark, d):
    """All six entries over the sample: rows scored by fold, and whether each entry's mean F1 and the choice of the best
    follow from the pooled predictions."""
    rows = materialize(searched_rows(spark, d).where("in_sample"), "sample")
    grid = mo.parameter_grid("logistic_regression")
    best, scores, preds = mo.grid_search(rows, "logistic_regression", COLUMNS, "id", grid, k=3)
    by_fold = m.basic_metrics(preds, groups=["entry", "fold"])
    means = by_fold.groupBy("entry").agg(F.avg("f1").alias("again"))
    given = spark.createDataFrame([(i, float(g["C"]), g["max_iter"], scores[i], i == best) for i, g in enumerate(grid)],
                                  "entry int, C double, max_iter int, score double, is_best boolean")
    told = given.join(means, "entry")
    top = told.agg(F.max("again")).scalar()
    chosen = told.agg(F.count_if(F.col("is_best") & (F.col("again") >= top - 1e-9))).scalar()
    sizes = by_fold.select("entry", "fold", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_rows"))
    return told.join(sizes, "entry").select("entry", "C", "max_iter", "fold", "n_rows",
                                            (F.abs(F.col("again") - F.col("score")) < 1e-9).alias("mean_of_folds"),
                                            chosen.alias("n_best"))


@query("f17_stacked_models")
def f17(spark, d):
    preds = base_predictions(spark, d).select("user_id", "model", "y_true", "p1")
    models = ["click", "error", "purchase", "signup", "view"]
    _, out = mo.stacked(preds, "user_id", models, F.col("user_id") % 5 != 0)
    return rounded(m.basic_metrics(out), 4)


@query("f17_scored_rows", """SELECT user_id, CAST(user_id % 2 AS INTEGER) AS y_true, true AS scored, 1::BIGINT AS times
FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 = 0""")
def f17b(spark, d):
    """Users that the learner over the base models has not seen are scored once each."""
    preds = base_predictions(spark, d).select("user_id", "model", "y_true", "p1")
    _, out = mo.stacked(preds, "user_id", ["click", "error", "purchase", "signup", "view"], F.col("user_id") % 5 != 0)
    return out.groupBy("user_id", "y_true", F.col("p1").between(0, 1).alias("scored")).agg(F.count(F.lit(1)).alias("times"))


_ROWS = "rows_ AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"


@query("f18_scored_grid", f"""WITH {_ROWS}, grid AS (SELECT CAST(row_number() OVER (ORDER BY c, m) - 1 AS INTEGER) AS entry,
  '[(''C'', ' || c || '), (''max_iter'', ' || m || ')]' AS params
  FROM (SELECT unnest(['0.1', '1.0', '10.0']) AS c), (SELECT unnest(['1000', '2000']) AS m))
SELECT entry, params, CAST(id % 3 AS INTEGER) AS fold, count(*) AS n_rows FROM grid, rows_ GROUP BY ALL""")
def f18(spark, d):
    """Rows an entry of the grid would see per fold, folds by id."""
    grid = spark.createDataFrame([(i, str(sorted(p.items()))) for i, p in enumerate(mo.parameter_grid("logistic_regression_stage2"))],
                                 "entry int, params string")
    entries = grid.agg(F.array_sort(F.collect_list(F.struct("entry", "params")))).scalar()
    sizes = feature_table(spark, d).groupBy((F.col("id") % 3).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.withColumn("_g", F.explode(entries)).select("_g.*", "fold", "n_rows")


@query("f20_saved_model", f"WITH {_ROWS} SELECT count(*) AS n, count(*) AS same FROM rows_")
def f20(spark, d):
    """The whole pipeline, pruning and preparation included, written, read and applied to every row."""
    rows = feature_table(spark, d)
    fitted = feature_pipeline("logistic_regression", COLUMNS, max_iter=5).fit(rows)
    path = scratch_path(spark, "model")
    mo.save_model(fitted, path)
    again = mo.predictions(mo.load_model(path), rows, "id").withColumnsRenamed({"p1": "p1_loaded", "y_pred": "y_pred_loaded"})
    both = mo.predictions(fitted, rows, "id").join(again.select("id", "p1_loaded", "y_pred_loaded"), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") == F.col("p1_loaded")).alias("same"))


@query("f7_stored_stages", """WITH gappy AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 97 AS DOUBLE) END AS grp FROM orders),
filled AS (SELECT id, coalesce(price, -1.0::DOUBLE) AS price, coalesce(grp, -1.0::DOUBLE) AS grp FROM gappy),
s AS (SELECT id, (price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled) AS p,
         (grp - (SELECT avg(grp) FROM filled)) / (SELECT stddev_pop(grp) FROM filled) AS g FROM filled)
SELECT id, round(p / sqrt(p * p + g * g), 4) + 0.0::DOUBLE AS price, round(g / sqrt(p * p + g * g), 4) + 0.0::DOUBLE AS "group",
  2 AS n_features FROM s""")
def f7b(spark, d):
    """A pruner that drops a constant and a copy, and a preparer, fitted as a pipeline, stored, read and applied."""
    rows = gappy(spark, d).withColumns({"constant": F.lit(3.0), "group_twice": F.col("group") * 2})
    columns = ["price", "group_twice", "group", "constant"]
    # of two columns that say the same the one with less variance goes, so the doubled one is halved in SQL by scaling
    stages = Pipeline(stages=[FeatureSelector(inputCols=columns), FeaturePreparer(
        inputCols=columns, imputation="constant", constant=-2.0)])
    path = scratch_path(spark, "stages")
    stages.fit(rows.withColumn("price", F.col("price") * 2)).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(rows.withColumn("price", F.col("price") * 2))
    return rounded(out.select("id", "price", F.col("group_twice").alias("group")), 4) \
        .join(out.select("id", F.size(vector_to_array("features")).alias("n_features")), "id")
