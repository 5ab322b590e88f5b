"""Spark's own learners, with summary blocks; boosted trees are Spark's gradient-boosted ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import INTERCEPT, as_array, attribute_names, col, is_vector
from sparkloom.models.base import LOSS, SIGNIFICANCE, TREES, WEIGHTS, Model
from sparkloom.models.linear import LinearModel
from sparkloom.operators.pieces import partitions_for


class SparkModel(Model):
    """A fitted model of pyspark.ml, held by `native`; it is saved by Spark's own writer, in the folder `native`."""

    native: Any = None

    @staticmethod
    def of(native: Any, blocks: Mapping[str, DataFrame] | None = None, output: str = "prediction", features_col: str | None = None) -> SparkModel:
        """features_col: an array of numbers in it is made a vector before scoring."""
        m = SparkModel({"class": f"{type(native).__module__}.{type(native).__name__}", "output": output, "features_col": features_col}, blocks)
        m.native = native
        return m

    def copy(self, blocks=None, **params) -> SparkModel:
        m = super().copy(blocks, **params)
        m.native = self.native
        return m

    def transform(self, df: DataFrame) -> DataFrame:
        if self.native is None:
            import importlib

            module, _, name = self.params["class"].rpartition(".")
            self.native = getattr(importlib.import_module(module), name).load(self.params["path"])
        features = self.params.get("features_col")
        return self.native.transform(dense(df, features) if features and not is_vector(df.schema[features]) else df)

    def save(self, spark, path: str) -> None:
        self.native.write().overwrite().save(f"{path}/native")
        saved = self.copy(path=f"{path}/native")
        Model.save(saved, spark, path)


def dense(df: DataFrame, features_col: str) -> DataFrame:
    """`df` with its features as a dense ML vector, metadata kept."""
    return df.withColumn(features_col, array_to_vector(as_array(df, features_col))).withMetadata(features_col, df.schema[features_col].metadata or {})


def _named(df: DataFrame, features_col: str, n: int) -> list[str]:
    return (attribute_names(df.schema[features_col]) or []) + [f"{features_col}_{i}" for i in range(len(attribute_names(df.schema[features_col]) or []), n)]


def fit_spark(df: DataFrame, estimator: Any, summarise: Callable[[Any, DataFrame], Mapping[str, DataFrame]] | None = None, output: str = "prediction") -> SparkModel:
    """Any estimator of pyspark.ml, with blocks that `summarise` makes of the fitted model."""
    native = estimator.fit(df)
    return SparkModel.of(native, summarise(native, df) if summarise else None, output)


def fit_linear_regression(df: DataFrame, features_col: str = "features", label_col: str = "label", **params: Any) -> LinearModel:
    """Spark's linear regression; the weights block has p-values where the solver gives them, the intercept at -1."""
    from pyspark.ml.regression import LinearRegression

    ready = df if is_vector(df.schema[features_col]) else dense(df, features_col)
    native = LinearRegression(featuresCol=features_col, labelCol=label_col, **params).fit(ready)
    names = _named(df, features_col, len(native.coefficients))
    try:
        p = list(native.summary.pValues)
    except Exception:  # only the normal solver without L1 has them
        p = []
    rows = [(i, names[i], float(c), float(p[i]) if p else None) for i, c in enumerate(native.coefficients)]
    rows.append((-1, INTERCEPT, float(native.intercept), float(p[-1]) if len(p) > len(names) else None))
    block = df.sparkSession.createDataFrame(rows, "index int, name string, weight double, pValue double")
    history = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(native.summary.objectiveHistory)], "iteration int, loss double")
    return LinearModel.of(list(native.coefficients), native.intercept, "identity", features_col, native.getPredictionCol(), {WEIGHTS: block, LOSS: history})


def _importances(native: Any, df: DataFrame, features_col: str) -> DataFrame:
    values = native.featureImportances.toArray()
    names = _named(df, features_col, len(values))
    return df.sparkSession.createDataFrame([(i, names[i], float(v)) for i, v in enumerate(values)], "index int, name string, importance double")


def _trees(native: Any, df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, t.toDebugString) for i, t in enumerate(native.trees)], "treeIndex int, tree string")


def _small_partitions(df: DataFrame, used: list[str]) -> DataFrame:
    """The columns used, in partitions that don't grow with the frame: trees keep each as objects, many times the size of its file."""
    n = partitions_for(df)
    return df.select(*[col(c) for c in df.columns if c in used]).repartition(n) if n > df._jdf.rdd().getNumPartitions() else df


def fit_random_forest(df: DataFrame, features_col: str = "features", label_col: str = "label", regression: bool = False, **params: Any) -> SparkModel:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestRegressor if regression else RandomForestClassifier
    ready = dense(df, features_col)
    native = kind(featuresCol=features_col, labelCol=label_col, **params).fit(_small_partitions(ready, [features_col, label_col, *map(str, params.values())]))
    return SparkModel.of(native, {SIGNIFICANCE: _importances(native, df, features_col), TREES: _trees(native, df)}, features_col=features_col)


def fit_boosted_trees(df: DataFrame, features_col: str = "features", label_col: str = "label", regression: bool = False, **params: Any) -> SparkModel:
    """Blocks: lossHistory (by iteration, on the training rows), featuresSignificance, rawTrees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    kind = GBTRegressor if regression else GBTClassifier
    ready = dense(df, features_col)
    native = kind(featuresCol=features_col, labelCol=label_col, **params).fit(_small_partitions(ready, [features_col, label_col, *map(str, params.values())]))
    losses = native.evaluateEachIteration(ready, "squared") if regression else native.evaluateEachIteration(ready)
    history = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")
    return SparkModel.of(native, {LOSS: history, SIGNIFICANCE: _importances(native, df, features_col), TREES: _trees(native, df)}, features_col=features_col)


def fit_isotonic(df: DataFrame, score_col: str, label_col: str = "label", weight_col: str | None = None, isotonic: bool = True, output: str = "calibrated") -> SparkModel:
    """Isotonic regression of labels on a score; NaN scores count as 0, and rows of weight 0 or without a label go."""
    from pyspark.ml.regression import IsotonicRegression

    score = F.nanvl(F.col(score_col).cast("double"), F.lit(0.0))
    rows = df.select(score.alias(score_col), F.col(label_col).cast("double").alias(label_col), (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("__w"))
    rows = rows.where(F.col(label_col).isNotNull() & F.col(score_col).isNotNull() & (F.col("__w") > 0))
    native = IsotonicRegression(featuresCol=score_col, labelCol=label_col, weightCol="__w", isotonic=isotonic, predictionCol=output).fit(rows)
    points = zip(native.boundaries.toArray().tolist(), native.predictions.toArray().tolist())
    return SparkModel.of(native, {WEIGHTS: df.sparkSession.createDataFrame(list(points), "boundary double, prediction double")}, output)


def class_probability(df: DataFrame, probability_col: str = "probability", index: int = 1, output: str = "score") -> DataFrame:
    return df.withColumn(output, F.get(as_array(df, probability_col), F.lit(index)))


