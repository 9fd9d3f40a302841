"""Classifiers on feature tables, cross-validation, search, stacking."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions.numeric import sigmoid
from vidspark.operators.metrics import full_metrics
from vidspark.operators.ranking import order_index
from vidspark.operators.stages import feature_pipeline
from vidspark.session import materialize, scratch_path

# Parameter grids of the linear models.
GRIDS = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "max_iter": [1000, 2000]},
    "svm": {"C": [0.1, 1.0, 10.0]},  # Spark has the linear kernel only
    # ours: Spark's learners take other parameters
    "gradient_boosting": {"n_estimators": [20, 50], "max_depth": [3, 5], "learning_rate": [0.1]},
    "feature_mlp": {"hidden": [32, 64], "max_iter": [100]},
}
# The wider grid of the logistic regression script.
LINEAR_GRID = {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2", "elasticnet"], "solver": ["liblinear", "saga"],
               "max_iter": [1000], "l1_ratio": [0.1, 0.5, 0.9]}
#: Fits that run side by side; each is a job of its own over the same file.
PARALLEL_FITS = 4
L1_SHARE = {"l1": 1.0, "l2": 0.0}
PARAMETERS = {
    "logistic_regression": {"C", "max_iter", "penalty", "l1_ratio", "solver"},
    "svm": {"C", "max_iter"},
    "gradient_boosting": {"n_estimators", "max_depth", "learning_rate", "seed"},
    "feature_mlp": {"hidden", "max_iter", "seed"},
}


class _Stripped:
    """A learner whose model comes without the summary of its training. The summary holds the session, which can't be sent to
    tasks once a table has been observed in it, and would go along with every prediction. A stored model has none, so the
    model is written and read back."""

    def _fit(self, dataset: DataFrame):
        model, spark = super()._fit(dataset), dataset.sparkSession
        path = scratch_path(spark, "model")
        model.write().session(spark).save(path)
        return type(model).read().session(spark).load(path)


class _LogisticRegression(_Stripped, LogisticRegression):
    pass


class _LinearSVC(_Stripped, LinearSVC):
    pass


def parameter_grid(model: str) -> list[dict]:
    """Every combination of a model's grid."""
    base = model.removesuffix("_stage4").removesuffix("_stage2")
    if base not in GRIDS:
        raise ValueError(f"no grid for {model!r}")
    grid = GRIDS[base]
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def make_classifier(kind: str, n_rows: int, n_features: int, features: str = "features", label: str = "label",
                    weight: str | None = None, validation: str | None = None, **params):
    """The learner of a kind. C is the inverse strength of a penalty on the sum over rows, Spark's on their mean."""
    unknown = set(params) - PARAMETERS.get(kind, set(params))
    if unknown:
        raise ValueError(f"{kind} takes no {', '.join(sorted(unknown))}")
    if weight and kind == "feature_mlp" or validation and kind != "gradient_boosting":
        raise ValueError(f"{kind} takes no {'weights' if weight and kind == 'feature_mlp' else 'validation rows'}")
    common = {"featuresCol": features, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    penalty = 1.0 / (params.get("C", 1.0) * max(n_rows, 1))
    if kind == "logistic_regression":
        share = L1_SHARE.get(params.get("penalty", "l2"), params.get("l1_ratio", 0.5))
        return _LogisticRegression(regParam=penalty, elasticNetParam=share, standardization=False,
                                   maxIter=params.get("max_iter", 100), **common)
    if kind == "svm":
        return _LinearSVC(regParam=penalty, standardization=False, maxIter=params.get("max_iter", 100), **common)
    if kind == "gradient_boosting":
        extra = {"validationIndicatorCol": validation} if validation else {}
        return GBTClassifier(maxIter=params.get("n_estimators", 20), maxDepth=params.get("max_depth", 3),
                             stepSize=params.get("learning_rate", 0.1), seed=params.get("seed", 42), **extra, **common)
    if kind == "feature_mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, params.get("hidden", 32), 2],
                                              maxIter=params.get("max_iter", 50), seed=params.get("seed", 42), **common)
    raise ValueError(f"unknown classifier {kind!r}")


def model_pipeline(kind: str, columns: list[str], n_rows: int, label: str = "label", **params) -> Pipeline:
    """Assemble, scale and classify as one unit, so every fold fits its own scaler."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        make_classifier(kind, n_rows, len(columns), "features", label, **params)])


def predictions(model, df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, y_true, p1, y_pred); a margin becomes a pseudo-probability through the sigmoid."""
    out = model.transform(df)
    if "probability" in out.columns:
        p1 = F.get(vector_to_array("probability"), F.lit(1))
    else:
        p1 = sigmoid(F.get(vector_to_array("rawPrediction"), F.lit(1)))
    return out.select(key, F.col(label).cast("int").alias("y_true"), p1.alias("p1")) \
        .withColumn("y_pred", (F.col("p1") > 0.5).cast("int"))


def _scored_entries(df: DataFrame, kind: str, columns: list[str], grid: list[dict], label: str, k: int, fold: str,
                    parallelism: int):
    """A fitted CrossValidator over the entries, folds as the table says, its models of every fold kept."""
    sizes = {r[fold] for r in df.groupBy(fold).agg(F.count(F.lit(1))).collect()}  # k rows
    if sizes - set(range(k)):
        raise ValueError(f"folds must be 0 to {k - 1}, found {sorted(map(str, sizes - set(range(k))))}")
    pipeline = feature_pipeline(kind, columns, label)
    learner = pipeline.getStages()[-1]
    maps = []
    for entry in grid:
        unknown = set(entry) - PARAMETERS[kind]
        if unknown:
            raise ValueError(f"{kind} takes no {', '.join(sorted(unknown))}")
        maps.append({learner.getParam(name): learner.getParam(name).typeConverter(value) for name, value in entry.items()})
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, labelCol=label)
    tuner = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=f1, numFolds=k, foldCol=fold,
                           parallelism=parallelism, collectSubModels=True)
    return tuner.fit(df.withColumn(label, F.col(label).cast("double")))


def _pooled(df: DataFrame, models: list, key: str, label: str, fold: str) -> DataFrame:
    """Predictions of every row by the model of the fold that held it out."""
    parts = [predictions(m, df.where(F.col(fold) == i), key, label).withColumn(fold, F.lit(i)) for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, kind: str, columns: list[str], key: str, label: str = "label", k: int = 5,
                   fold: str = "fold", stored: bool = False, parallelism: int = PARALLEL_FITS, **params) -> DataFrame:
    """Pooled out-of-fold predictions (F14): pruning, preparation and learner are fitted for each fold on the rows outside
    it, several folds at a time. Fold metrics follow by grouping.

    Every fit makes several passes, so the needed columns are written once, unless ``stored`` says the table is a file.
    """
    df = df if stored else materialize(df.select(key, label, fold, *columns), "folds")
    fitted = _scored_entries(df, kind, columns, [params], label, k, fold, parallelism)
    return _pooled(df, [models[0] for models in fitted.subModels], key, label, fold)


def grid_search(df: DataFrame, kind: str, columns: list[str], key: str, grid: list[dict], label: str = "label", k: int = 5,
                fold: str = "fold", parallelism: int = PARALLEL_FITS) -> tuple[int, list[float], DataFrame]:
    """(number of the best entry, mean F1 of each over the folds, pooled predictions with their ``entry``) for a table that
    is a file. Of equal entries the first is the best; entries without a score never are."""
    fitted = _scored_entries(df, kind, columns, grid, label, k, fold, parallelism)
    scores = [float(m) for m in fitted.avgMetrics]
    best = max(range(len(grid)), key=lambda i: (-1.0 if scores[i] != scores[i] else scores[i], -i))
    parts = [_pooled(df, [models[i] for models in fitted.subModels], key, label, fold).withColumn("entry", F.lit(i))
             for i in range(len(grid))]
    return best, scores, reduce(DataFrame.unionByName, parts)


def fold_metrics(preds: DataFrame, fold: str = "fold") -> DataFrame:
    return full_metrics(preds, groups=[fold])


def search_and_fit(df: DataFrame, kind: str, columns: list[str], key: str, grid: list[dict], label: str = "label",
                   k: int = 5, sample: str = "in_sample", split: str = "split", fold: str = "fold",
                   parallelism: int = PARALLEL_FITS):
    """Search on the sample, cross-validate the best on all training rows, refit, score the test rows.

    Every fit reads the table several times, so the features are written once and read from there.
    Returns (model, best parameters, fold metrics, test predictions, mean F1 of each entry).
    """
    table = materialize(df, "features")
    rows = table.where(F.col(split) != "test")
    test = table.where(F.col(split) == "test")
    at, scores, _ = grid_search(rows.where(F.col(sample)), kind, columns, key, grid, label, k, fold, parallelism)
    best = grid[at]
    folds = fold_metrics(cross_validate(rows, kind, columns, key, label, k, fold, stored=True, parallelism=parallelism, **best))
    model = feature_pipeline(kind, columns, label, **best).fit(rows)
    return model, best, folds, predictions(model, test, key, label), scores


def stacked(preds: DataFrame, key: str, models: list[str], is_train, label: str = "y_true"):
    """A learner over the base models' probabilities: one column per model, then logistic regression.

    Returns (model, predictions for the rows outside ``is_train``).
    """
    wide = preds.groupBy(key, label).pivot("model", models).agg(F.avg("p1"))
    wide = materialize(wide.fillna(0.5, models), "stacked")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=models, outputCol="features"),
                            _LogisticRegression(featuresCol="features", labelCol=label, maxIter=50)])
    fitted = pipe.fit(wide.where(is_train))
    return fitted, predictions(fitted, wide.where(~is_train), key, label)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def label_index(df: DataFrame, label: str, name: str = "label_idx") -> DataFrame:
    """Position of each label among the sorted distinct labels (X21); NULL for no label.

    The distinct labels are written once and numbered by ranges of values, so a million of them need no single task.
    """
    labels = materialize(df.where(F.col(label).isNotNull()).select(label).distinct(), "labels")
    ranked = order_index(labels, label, name).withColumn(name, F.col(name).cast("int"))
    return df.drop(name).join(ranked, label, "left")
