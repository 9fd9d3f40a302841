"""Feature pruning, preparation and the learners as stages of a Spark ML pipeline.

An estimator learns on the rows it is given, a model is a projection of a few numbers a column. Both can be written and
read with the pipeline that holds them, and a cross-validation fits them anew for every fold, on its training rows alone.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.operators.features import FeaturePreprocessor, FeaturePruner


def _param(name: str, doc: str, kind=None) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class _Settings(Params):
    """Keyword arguments become parameters; those that are not given keep their defaults."""

    def _take(self, defaults: dict, given: dict) -> None:
        self._setDefault(**defaults)
        self._set(**{k: v for k, v in given.items() if v is not None})


class _Stored(Model, HasInputCols, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    pass


class FeatureSelector(Estimator, HasInputCols, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Learns which of the input columns to keep."""

    method = _param("method", "correlation, vif, both or none", TypeConverters.toString)
    correlationThreshold = _param("correlationThreshold", "pairs at least so related lose one", TypeConverters.toFloat)
    vifThreshold = _param("vifThreshold", "largest inflation that stays", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, method=None, correlationThreshold=None, vifThreshold=None):
        super().__init__()
        self._take({"method": "correlation", "correlationThreshold": 0.95, "vifThreshold": 10.0}, self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FeatureSelectorModel":
        pruner = FeaturePruner(self.getOrDefault("method"), self.getOrDefault("correlationThreshold"),
                               self.getOrDefault("vifThreshold")).fit(dataset, self.getInputCols())
        return FeatureSelectorModel(inputCols=self.getInputCols(), kept=pruner.kept)


class FeatureSelectorModel(_Stored):
    """Drops the input columns that are not kept."""

    kept = _param("kept", "columns that stay", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, kept=None):
        super().__init__()
        self._take({}, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*[c for c in self.getInputCols() if c not in self.getOrDefault("kept")])


class FeaturePreparer(Estimator, HasInputCols, HasOutputCol, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Learns to impute, scale and normalise those input columns that an earlier stage has left."""

    imputation = _param("imputation", "mean, median, most_frequent or constant", TypeConverters.toString)
    scaling = _param("scaling", "standard, robust or none", TypeConverters.toString)
    normalize = _param("normalize", "rows of unit length", TypeConverters.toBoolean)
    constant = _param("constant", "fill of the constant imputation", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, imputation=None, scaling=None, normalize=None, constant=None):
        super().__init__()
        self._take({"imputation": "mean", "scaling": "standard", "normalize": True, "constant": 0.0, "outputCol": "features"},
                   self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FeaturePreparerModel":
        columns = [c for c in self.getInputCols() if c in dataset.columns]
        scaling = self.getOrDefault("scaling")
        fitted = FeaturePreprocessor(self.getOrDefault("imputation"), None if scaling == "none" else scaling,
                                     self.getOrDefault("normalize"), self.getOrDefault("constant")).fit(dataset, columns)
        numbers = {name: [float(getattr(fitted, name)[c]) for c in columns] for name in ("fill", "center", "scale")}
        return FeaturePreparerModel(inputCols=columns, outputCol=self.getOutputCol(),
                                    normalize=self.getOrDefault("normalize"), **numbers)


class FeaturePreparerModel(_Stored, HasOutputCol):
    """Prepared columns in place, and as a vector in the output column."""

    normalize = _param("normalize", "rows of unit length", TypeConverters.toBoolean)
    fill = _param("fill", "one value an input column", TypeConverters.toListFloat)
    center = _param("center", "one value an input column", TypeConverters.toListFloat)
    scale = _param("scale", "one value an input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, normalize=None, fill=None, center=None, scale=None):
        super().__init__()
        self._take({}, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getInputCols()
        numbers = {name: dict(zip(columns, self.getOrDefault(name))) for name in ("fill", "center", "scale")}
        prepared = FeaturePreprocessor(normalize=self.getOrDefault("normalize"), **numbers).transform(dataset)
        return prepared.withColumn(self.getOutputCol(), array_to_vector(F.array(*columns)))


class FeatureClassifier(Estimator, HasLabelCol, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """A learner by its kind, sized by the rows and the vectors it is given: C weighs a penalty on the sum over rows, and a
    net has as many inputs as the stages before it have left. Fits to the learner's own Spark model."""

    kind = _param("kind", "logistic_regression, svm, gradient_boosting or feature_mlp", TypeConverters.toString)
    featuresCol = _param("featuresCol", "vector column", TypeConverters.toString)
    C = _param("C", "inverse strength of the penalty", TypeConverters.toFloat)
    max_iter = _param("max_iter", "iterations at most", TypeConverters.toInt)
    penalty = _param("penalty", "l1, l2 or elasticnet", TypeConverters.toString)
    l1_ratio = _param("l1_ratio", "share of l1", TypeConverters.toFloat)
    n_estimators = _param("n_estimators", "trees", TypeConverters.toInt)
    max_depth = _param("max_depth", "depth of a tree", TypeConverters.toInt)
    learning_rate = _param("learning_rate", "share of a tree that counts", TypeConverters.toFloat)
    hidden = _param("hidden", "hidden units", TypeConverters.toInt)
    seed = _param("seed", "of the learner's random choices", TypeConverters.toInt)
    solver = _param("solver", "taken for the sake of shared grids; Spark picks its own", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, kind=None, featuresCol=None, labelCol=None, C=None, max_iter=None, penalty=None, l1_ratio=None,
                 n_estimators=None, max_depth=None, learning_rate=None, hidden=None, seed=None, solver=None):
        super().__init__()
        self._take({"featuresCol": "features", "labelCol": "label"}, self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        from vidspark.operators.models import PARAMETERS, make_classifier

        kind = self.getOrDefault("kind")
        params = {p.name: self.getOrDefault(p) for p in self.params if p.name in PARAMETERS[kind] and self.isSet(p)}
        features = self.getOrDefault("featuresCol")
        size = dataset.select(features).first()
        if size is None:
            raise ValueError("no rows to fit on")
        return make_classifier(kind, dataset.count(), size[0].size, features, self.getLabelCol(), **params).fit(dataset)


def feature_pipeline(kind: str, columns: list[str], label: str = "label", method: str = "correlation",
                     imputation: str = "mean", scaling: str = "standard", normalize: bool = False, **params) -> Pipeline:
    """Prune, prepare and classify as one unit."""
    return Pipeline(stages=[FeatureSelector(inputCols=columns, method=method),
                            FeaturePreparer(inputCols=columns, imputation=imputation, scaling=scaling, normalize=normalize),
                            FeatureClassifier(kind=kind, labelCol=label, **params)])
