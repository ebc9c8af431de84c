"""Model fits, out-of-fold predictions and stacking on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def ridge(alpha: float, label: str = "label") -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=0.0)


def elastic_net(alpha: float, l1: float, label: str = "label") -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=l1, maxIter=50)


def logistic(alpha: float = 0.0, l1: float = 0.0, label: str = "label", iterations: int = 30) -> LogisticRegression:
    return LogisticRegression(labelCol=label, regParam=alpha, elasticNetParam=l1, maxIter=iterations)


def factorization_machine(label: str = "label", factors: int = 4, iterations: int = 20) -> FMRegressor:
    return FMRegressor(labelCol=label, factorSize=factors, maxIter=iterations, stepSize=0.05, seed=7)


def factorization_classifier(label: str = "label", factors: int = 4, iterations: int = 20) -> FMClassifier:
    return FMClassifier(labelCol=label, factorSize=factors, maxIter=iterations, stepSize=0.05, seed=7)


def boosted_classifier(label: str = "label", trees: int = 10, depth: int = 4) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=7)


def boosted_regressor(label: str = "label", trees: int = 10, depth: int = 4) -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=7)


def forest_regressor(label: str = "label", trees: int = 20, depth: int = 5, leaf: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=7)


def forest_classifier(label: str = "label", trees: int = 20, depth: int = 5, random_cuts: bool = False) -> RandomForestClassifier:
    """``random_cuts`` tries one feature per split on all rows, close to extremely random trees."""
    return RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, seed=7,
        featureSubsetStrategy="1" if random_cuts else "auto", bootstrap=not random_cuts,
    )


def naive_bayes(label: str = "label", smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(labelCol=label, smoothing=smoothing)


def perceptron(layers: Sequence[int], label: str = "label") -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol=label, layers=list(layers), maxIter=30, seed=7)


def positive_probability(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def scored(model: Model, df: DataFrame, out: str) -> DataFrame:
    """Apply a model and keep its probability of class 1, or its prediction, under ``out``."""
    raw = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in raw.columns else F.col("prediction")
    extra = [c for c in raw.columns if c not in df.columns]
    return raw.withColumn("__p", value).drop(*extra).withColumnRenamed("__p", out)


def per_label(df: DataFrame, labels: Sequence[str], make: Callable[[str], Estimator], key: str) -> DataFrame:
    """Fit one model per 0/1 label and return (key, p_label, ...)."""
    out = df.select(key)
    for label in labels:
        model = make(label).fit(df.withColumn(label, F.col(label).cast("double")))
        out = out.join(scored(model, df, f"p_{label}").select(key, f"p_{label}"), key)
    return out


def out_of_fold(df: DataFrame, make: Estimator, fold: str, k: int, out: str, test: DataFrame | None = None):
    """Predict each fold with a model of the others; test rows get the mean over the folds' models."""
    parts, tests = [], []
    for i in range(k):
        model = make.fit(df.where(F.col(fold) != i))
        parts.append(scored(model, df.where(F.col(fold) == i), out))
        if test is not None:
            tests.append(scored(model, test, f"{out}_{i}").select("id", f"{out}_{i}"))
    train = reduce(lambda a, b: a.unionByName(b), parts)
    if test is None:
        return train, None
    joined = reduce(lambda a, b: a.join(b, "id"), tests)
    mean = reduce(lambda a, b: a + b, [F.col(f"{out}_{i}") for i in range(k)]) / k
    return train, test.join(joined.select("id", mean.alias(out)), "id")


def stacked(train: DataFrame, test: DataFrame, features: Sequence[str], bases: Mapping[str, Estimator], second: Estimator,
            fold: str, k: int, out: str = "stacked") -> tuple[DataFrame, DataFrame]:
    """Two levels: base predictions out of fold, then a model of features and base predictions.

    Rows carry ``id``, ``label`` and the fold column (train only). Returns the
    second level's out-of-fold predictions and the test predictions.
    """
    train = cut_lineage(assembled(train, features))
    test = cut_lineage(assembled(test, features))
    level_train, level_test = train, test
    for name, base in bases.items():
        fitted, applied = out_of_fold(train, base, fold, k, name, test)
        level_train = level_train.join(fitted.select("id", name), "id")
        level_test = level_test.join(applied.select("id", name), "id")
    columns = [*features, *bases]
    level_train = cut_lineage(assembled(level_train.drop("features"), columns))
    level_test = cut_lineage(assembled(level_test.drop("features"), columns))
    return out_of_fold(level_train, second, fold, k, out, level_test)


def prepend_predictions(df: DataFrame, model: Model, out: str = "features_plus") -> DataFrame:
    """Features with the model's prediction in front."""
    return assembled(scored(model, df, "__first"), ["__first", "features"], out).drop("__first")


def log_target(regressor: Estimator, label: str) -> Pipeline:
    """Fit on log(1 + label); predictions come back as ``predicted`` on the raw scale."""
    regressor.setLabelCol("__log")
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, log1p({label}) AS __log FROM __THIS__"), regressor,
        SQLTransformer(statement="SELECT *, expm1(prediction) AS predicted FROM __THIS__"),
    ])


def grid_search(df: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], folds: int, metric: str = "r2") -> DataFrame:
    """Mean score of every parameter combination over k folds: one row per combination."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    evaluator = RegressionEvaluator(labelCol=estimator.getLabelCol(), metricName=metric)
    fitted = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=7, parallelism=2
    ).fit(df)
    rows = [tuple(float(m[estimator.getParam(n)]) for n in grid) + (float(s),) for m, s in zip(maps, fitted.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in [*grid, "score"]))


def importances(model: Model, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance), largest first."""
    values = model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
