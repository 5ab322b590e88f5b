"""Queries of the models: scoring with given weights, fitting, validation and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.metrics.binary import binary_metrics
from sparkloom.metrics.regression import regression_metrics
from sparkloom.models.combined import LinearCombinationModel, MultiClassModel, SelectingModel, fit_combination, fit_per_type
from sparkloom.models.linear import LinearModel, fit_descent, fit_lbfgs, fit_scaled, fit_svrg, fit_with_intercept
from sparkloom.models.wrapped import class_probability, fit_boosted_trees, fit_isotonic, fit_linear_regression, fit_random_forest
from sparkloom.operators.columns import assemble, with_metadata
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table
from sparkloom.train.search import DoubleRange, StopRule, grid, grid_search, stochastic_search
from sparkloom.train.validation import cross_validate, fit_with_selection, validate_in_folds

_W = [0.5, -0.2, 0.1, 0.05]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with four scaled features; the label is a linear function of them, `returned` a class."""
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    i = i.withColumn("label", 0.7 * F.col("q") - 0.3 * F.col("p") + 0.2 + 0.01 * (F.col("d") - F.col("t")))
    return assemble(i.withColumn("returned", (F.col("label") + 5 * F.col("d") > 0.75).cast("double")), ["q", "p", "d", "t"], as_ml_vector=False)


_SCORE = "0.5 * l_quantity / 50 - 0.2 * l_extendedprice / 100000 + 0.1 * l_discount + 0.05 * l_tax + 0.3"


@query(f"select l_orderkey, l_linenumber, round({_SCORE}, 9) as prediction from lineitem")
def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    return LinearModel.of(_W, 0.3).transform(_items(spark, sf)).select("l_orderkey", "l_linenumber", F.round("prediction", 9).alias("prediction"))


@query(f"select l_orderkey, l_linenumber, round(1 / (1 + exp(-({_SCORE}))), 9) as prediction from lineitem")
def logistic_score(spark: SparkSession, sf: str) -> DataFrame:
    return LinearModel.of(_W, 0.3, "logistic").transform(_items(spark, sf)).select("l_orderkey", "l_linenumber", F.round("prediction", 9).alias("prediction"))


@query(f"select l_orderkey, l_linenumber, round(case l_returnflag when 'A' then {_SCORE} when 'R' then l_quantity / 50 end, 9) as prediction from lineitem")
def per_type_score(spark: SparkSession, sf: str) -> DataFrame:
    m = SelectingModel.of({"A": LinearModel.of(_W, 0.3), "R": LinearModel.of([1, 0, 0, 0])}, "l_returnflag", blocks={})
    return m.transform(_items(spark, sf)).select("l_orderkey", "l_linenumber", F.round("prediction", 9).alias("prediction"))


@query(f"select l_orderkey, l_linenumber, round({_SCORE}, 9) as a, round(l_quantity / 50, 9) as b from lineitem")
def multi_class_score(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    m = MultiClassModel.of({"a": LinearModel.of(_W, 0.3), "b": LinearModel.of([1, 0, 0, 0])}, blocks={})
    v = vector_to_array("prediction")
    return m.transform(_items(spark, sf)).select("l_orderkey", "l_linenumber", F.round(v[0], 9).alias("a"), F.round(v[1], 9).alias("b"))


@query(f"select l_orderkey, l_linenumber, round(2 * ({_SCORE}) - 0.5 * l_quantity / 50, 9) as prediction from lineitem")
def weighted_combination(spark: SparkSession, sf: str) -> DataFrame:
    m = LinearCombinationModel.combine({"a": LinearModel.of(_W, 0.3), "b": LinearModel.of([1, 0, 0, 0])}, [{"a": 2.0, "b": -0.5}], blocks={})
    return m.transform(_items(spark, sf)).select("l_orderkey", "l_linenumber", F.round("prediction", 9).alias("prediction"))


def _weights(model) -> DataFrame:
    return model.blocks["weights"]


@query()
def fit_least_squares(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(fit_with_intercept(_items(spark, sf), lambda d: fit_lbfgs(d, keep_last=True)))


@query()
def fit_scaled_logistic(spark: SparkSession, sf: str) -> DataFrame:
    d = _items(spark, sf)
    return _weights(fit_scaled(d, lambda x: fit_with_intercept(x, lambda y: fit_lbfgs(y, label_col="returned", kind="logistic", l2=1e-4, keep_last=True, max_iter=30))))


@query()
def fit_many_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = _items(spark, sf)
    d = with_metadata(d.withColumn("labels", F.array("label", "returned")), "labels", ["linear", "returned"])
    return _weights(fit_lbfgs(d, label_col="labels", l1=0.05, max_iter=30))


@query()
def fit_variance_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(fit_with_intercept(_items(spark, sf), lambda d: fit_svrg(d, rate=0.3, max_iter=8)))


@query()
def fit_gradient_descent(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(fit_with_intercept(_items(spark, sf), lambda d: fit_descent(d, max_iter=15)))


@query()
def fit_ordinary(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(fit_linear_regression(_items(spark, sf), solver="normal"))


@query()
def fit_forest(spark: SparkSession, sf: str) -> DataFrame:
    return fit_random_forest(_items(spark, sf), label_col="returned", numTrees=5, maxDepth=4, seed=1).blocks["featuresSignificance"]


@query()
def fit_boosted(spark: SparkSession, sf: str) -> DataFrame:
    return fit_boosted_trees(_items(spark, sf), label_col="returned", maxIter=4, maxDepth=3, seed=1).blocks["lossHistory"]


@query()
def fit_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return fit_isotonic(_items(spark, sf).select("d", "returned"), "d", "returned").blocks["weights"]


@query()
def fit_types(spark: SparkSession, sf: str) -> DataFrame:
    return fit_per_type(_items(spark, sf), lambda d: fit_with_intercept(d, lambda x: fit_lbfgs(x, keep_last=True, max_iter=20)), "l_returnflag", threads=3).blocks["weights"]


@query()
def fit_classes(spark: SparkSession, sf: str) -> DataFrame:
    fit = lambda d: fit_with_intercept(d, lambda x: fit_lbfgs(x, kind="logistic", keep_last=True, max_iter=10))
    return fit_combination(_items(spark, sf), fit, "l_returnflag", [{"A": 0.5, "R": 0.5}], threads=3).blocks["weights"]


@query()
def cross_validated(spark: SparkSession, sf: str) -> DataFrame:
    fit = lambda d: fit_with_intercept(d, lambda x: fit_lbfgs(x, keep_last=True, max_iter=10))
    run = cross_validate(fit, lambda p: regression_metrics(p, keys=["isTest"]), folds=3, by=["l_orderkey"], threads=3)
    return run(_items(spark, sf)).blocks["metrics"]


@query()
def selected_features(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.operators.sampling import with_folds

    d = with_folds(_items(spark, sf), 3, ["l_orderkey"])
    fit = lambda x: fit_lbfgs(x, max_iter=10)
    return fit_with_selection(d, validate_in_folds(fit, 3, threads=3), fit, 5.0).blocks["featuresSignificance"]


def _searched(params):
    fit = lambda d: fit_lbfgs(d, label_col="returned", kind="logistic", l2=params["l2"], max_iter=int(params.get("max_iter", 5)))

    def run(d: DataFrame):
        m = fit(d)
        return m.with_block("metrics", binary_metrics(m.transform(d), "prediction", "returned", bins=0).where("metric = 'auc'"))

    return run


_AUC = "select value from __THIS__ where metric = 'auc'"


@query()
def grid_searched(spark: SparkSession, sf: str) -> DataFrame:
    return grid_search(_items(spark, sf), _searched, grid({"l2": [0.0, 0.1], "max_iter": [2, 5]}), _AUC, threads=4).blocks["configurations"]


@query()
def gaussian_searched(spark: SparkSession, sf: str) -> DataFrame:
    return stochastic_search(_items(spark, sf), _searched, {"l2": DoubleRange(0.0, 1.0)}, _AUC, stop=StopRule(4)).blocks["configurations"]


@query()
def forest_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    d = _items(spark, sf)
    scored = fit_random_forest(d, label_col="returned", numTrees=3, maxDepth=3, seed=1).transform(d)
    return binary_metrics(class_probability(scored), "score", "returned", bins=20)
