import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.metrics.binary import auc
from sparkloom.metrics.regression import regression_metrics
from sparkloom.models.base import Model, PipelineModel, extract_summary
from sparkloom.models.combined import LinearCombinationModel, MultiClassModel, SelectingModel, fit_multi_class, fit_per_type
from sparkloom.models.linear import LinearModel, fit_descent, fit_lbfgs, fit_scaled, fit_svrg, fit_with_intercept
from sparkloom.models.wrapped import fit_boosted_trees, fit_isotonic, fit_linear_regression, fit_random_forest
from sparkloom.operators.columns import with_metadata
from sparkloom.operators.sampling import sample_pairs
from sparkloom.train.forks import fit_forks
from sparkloom.train.gaussian import sobol
from sparkloom.train.search import Categories, DoubleRange, IntRange, RandomGuide, StopRule, grid, grid_search, grouped_search, stochastic_search
from sparkloom.train.stages import cached, evaluated, in_partitions, on_train_rows, pipeline, projected, sampled, through_parquet, with_collected_summary
from sparkloom.train.tracking import MlflowTracker, ParquetTracker, tracked
from sparkloom.train.validation import cross_validate, fit_with_selection, fold_forks, validate_in_folds


@pytest.fixture(scope="module")
def hidden(spark):
    """label = 0.5 x - 0.2 y + 0.2, and its class."""
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (1000, 2))
    y = x @ [0.5, -0.2]
    rows = [(i, v.tolist(), float(t), float(t + 0.2), float(t > 0), "Direct" if i % 2 else "Inverse", float(t if i % 2 else -t), "Positive" if t > 0 else "Negative") for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, features array<double>, label double, shifted double, returned double, type string, typed double, classes string")
    return with_metadata(df, "features", ["first", "second"]).cache()


def near(model, weights, intercept=0.0):
    return sum((a - b) ** 2 for a, b in zip(model.coefficients, weights)) + (model.params["intercept"] - intercept) ** 2 <= 0.001


def test_linear_learners_recover_the_model(hidden):
    assert near(fit_lbfgs(hidden), [0.5, -0.2])
    assert near(fit_with_intercept(hidden, lambda d: fit_lbfgs(d, label_col="shifted", keep_last=True)), [0.5, -0.2], 0.2)
    assert near(fit_scaled(hidden, lambda d: fit_with_intercept(d, lambda e: fit_lbfgs(e, label_col="shifted", keep_last=True))), [0.5, -0.2], 0.2)
    assert near(fit_svrg(hidden, rate=0.5, max_iter=30), [0.5, -0.2]) and near(fit_descent(hidden, max_iter=60, tol=1e-5), [0.5, -0.2])
    ordinary = fit_linear_regression(hidden, label_col="shifted", solver="normal")
    assert near(ordinary, [0.5, -0.2], 0.2) and ordinary.blocks["weights"].where("index = -1").count() == 1


def test_logistic_and_regularisation(hidden):
    m = fit_lbfgs(hidden, label_col="returned", kind="logistic", l2=1e-3)
    assert auc(m.transform(hidden), "prediction", "returned").first()["auc"] > 0.99
    assert m.coefficients[0] / m.coefficients[1] == pytest.approx(-2.5, rel=0.1)
    assert fit_lbfgs(hidden, l1=1.0).coefficients == pytest.approx([0, 0], abs=0.01) and fit_lbfgs(hidden, l1=0.8).coefficients[1] == 0
    v = fit_svrg(hidden, label_col="returned", kind="logistic", rate=1.0, max_iter=10)
    assert auc(v.transform(hidden), "prediction", "returned").first()["auc"] > 0.99


def test_many_labels_share_passes(hidden):
    df = with_metadata(hidden.withColumn("labels", F.array("label", "shifted")), "labels", ["a", "b"])
    m = fit_lbfgs(df, label_col="labels")
    assert near(m.nested["a"], [0.5, -0.2]) and m.nested["b"].coefficients == pytest.approx(fit_lbfgs(hidden, label_col="shifted").coefficients, abs=1e-4)
    assert m.blocks["weights"].count() == 4


def test_pair_samples_keep_the_order(hidden):
    df = hidden.withColumn("group", F.col("id") % 10)
    pairs = sample_pairs(df, ["group"], "features", "returned", item_rate=0.6, ranking_power=0.5)
    assert auc(fit_lbfgs(pairs, label_col="returned", kind="logistic", l2=1e-3).transform(hidden), "prediction", "returned").first()["auc"] >= 0.99


def test_combined_models_and_saving(spark, hidden, tmp_path):
    per_type = fit_per_type(hidden, lambda d: fit_lbfgs(d, label_col="typed"), "type", threads=2)
    out = per_type.transform(hidden)
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("typed")))).first()[0] < 1e-3
    assert per_type.transform(hidden.withColumn("type", F.lit("?"))).where("prediction is not null").count() == 0
    classes = fit_multi_class(hidden, lambda d: fit_lbfgs(d, kind="logistic", l2=1e-3), "classes", threads=2)
    assert classes.params["classes"] == ["Negative", "Positive"]
    combined = LinearCombinationModel.combine(classes.nested, [{"Positive": 1.0, "Negative": -1.0}], blocks={})
    assert auc(combined.transform(hidden), "prediction", "returned").first()["auc"] > 0.99
    for m in (per_type, classes, PipelineModel.of([LinearModel.of([1, 2])])):
        m.save(spark, f"file://{tmp_path}/{type(m).__name__}")
        back = Model.load(spark, f"file://{tmp_path}/{type(m).__name__}")
        assert [str(r) for r in back.transform(hidden).orderBy("id").collect()] == [str(r) for r in m.transform(hidden).orderBy("id").collect()]
        assert back.blocks.keys() == m.blocks.keys()
    assert isinstance(per_type, SelectingModel) and isinstance(classes, MultiClassModel)
    assert extract_summary([per_type, per_type])["weights"].count() == 8


def test_wrapped_learners(spark, hidden, tmp_path):
    forest = fit_random_forest(hidden, label_col="returned", numTrees=5, seed=1)
    assert [r["name"] for r in forest.blocks["featuresSignificance"].orderBy("index").collect()] == ["first", "second"]
    forest.save(spark, f"file://{tmp_path}/forest")
    assert Model.load(spark, f"file://{tmp_path}/forest").transform(hidden).count() == 1000
    boosted = fit_boosted_trees(hidden, regression=True, maxIter=5, seed=1)
    losses = [r["loss"] for r in boosted.blocks["lossHistory"].orderBy("iteration").collect()]
    assert losses == sorted(losses, reverse=True) and boosted.blocks["rawTrees"].count() == 5
    steps = fit_isotonic(hidden, "label", "returned").blocks["weights"]
    assert steps.agg(F.min("prediction"), F.max("prediction")).first() == (0, 1)


def test_train_only_stages(spark, hidden):
    seen = []

    def fit(d):
        seen.append((d.columns, d.count(), d.is_cached, d.rdd.getNumPartitions()))
        return fit_lbfgs(d)

    cached(projected(fit, keep=["features", "label"]), materialise=True)(hidden.select("*"))
    in_partitions(fit, 3)(hidden)
    on_train_rows(fit)(hidden.withColumn("isTest", F.col("id") < 400))
    sampled(fit, expected=200, key=["id"])(hidden)
    through_parquet(fit, partition_by=["type"])(hidden)
    assert seen[0][0] == ["features", "label"] and seen[1][3] == 3 and seen[2][1] == 600 and 120 < seen[3][1] < 280 and seen[4][1] == 1000
    m = with_collected_summary(evaluated(pipeline(lambda d: LinearModel.of([1, 0], output="one"), fit_lbfgs), regression_metrics))(hidden)
    assert m.blocks["metrics"].where("metric = 'r2'").first()["value"] > 0.99
    failing = through_parquet(lambda d: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failing(hidden)


def test_forks_restore_and_fail_fast(spark, hidden, tmp_path):
    path, calls = f"file://{tmp_path}/forks", []

    def fit(d):
        calls.append(1)
        return fit_lbfgs(d, max_iter=3)

    first = fit_forks([("a", hidden), ("b", hidden)], fit, threads=2, path=path)
    again = fit_forks([("a", hidden), ("b", hidden)], fit, threads=2, path=path)
    assert len(calls) == 2 and first["a"].coefficients == again["a"].coefficients
    with pytest.raises(ZeroDivisionError):
        fit_forks([("a", hidden), ("b", hidden)], lambda d: 1 / 0, threads=2)


def test_cross_validation(hidden):
    run = cross_validate(fit_lbfgs, lambda p: regression_metrics(p, keys=["isTest"]), folds=3, by=["id"], threads=3)
    m = run(hidden)
    folds = {r["foldNum"]: r["n"] for r in m.blocks["metrics"].groupBy("foldNum").agg(F.count("*").alias("n")).collect()}
    assert folds == {-1: 5, 0: 10, 1: 10, 2: 10} and near(m, [0.5, -0.2])
    timed = fold_forks(hidden.withColumn("foldNum", F.col("id") % 3), 0, test_expression="foldNum >= __FOLD__")
    assert [k for k, _ in timed] == ["0", "1", "2", "-1"] and timed[1][1].where("isTest").count() == 666


def test_feature_selection_drops_noise(spark, hidden):
    noise = hidden.withColumn("foldNum", F.col("id") % 5).withColumn("features", F.concat(F.array(F.rand(3) * 2 - 1), F.col("features")))
    noise = with_metadata(noise.withColumn("label", F.col("label") + (F.rand(9) - 0.5) * 0.3), "features", ["noise", "first", "second"]).cache()
    m = fit_with_selection(noise, validate_in_folds(lambda d: on_train_rows(fit_lbfgs)(d), 5, threads=4), fit_lbfgs, 8.0)
    assert m.coefficients[0] == 0 and m.coefficients[1] == pytest.approx(0.5, abs=0.03)
    assert m.blocks["featuresSignificance"].count() == 3


def _trial(params):
    def run(d):
        m = LinearModel.of([params["w"], params.get("v", -0.2)])
        return m.with_block("metrics", regression_metrics(m.transform(d)))

    return run


R2 = "select value from __THIS__ where metric = 'r2'"


def test_searches(spark, hidden):
    small = hidden.limit(100).cache()
    m = grid_search(small, _trial, grid({"w": [0.0, 0.5, 1.0], "v": [-0.2]}, lambda p: p["w"] < 1), R2, threads=2)
    assert m.coefficients[0] == 0.5 and m.blocks["configurations"].count() == 2
    bad = grid_search(small, lambda p: _trial(p) if p["w"] else (lambda d: 1 / 0), [{"w": 0.0}, {"w": 0.4}], R2)
    assert bad.blocks["configurations"].where("error like 'ZeroDivision%'").first()["configurationIndex"] == 2**31 - 1
    g = stochastic_search(small, _trial, {"w": DoubleRange(-1, 1), "v": DoubleRange(-1, 1)}, R2, stop=StopRule(9), priors=[({"w": 0.4, "v": 0.0}, 0.8)])
    assert g.blocks["configurations"].where("configurationIndex = 0").first()["resultingMetric"] > 0.8
    r = stochastic_search(small, _trial, {"w": DoubleRange(-1, 1)}, R2, guide=RandomGuide(1), stop=StopRule(6), threads=3)
    assert r.blocks["configurations"].count() == 6
    both = grouped_search(small, _trial, [("w", lambda fit, p: grid_search(small, fit, [{"w": 0.1}, {"w": 0.5}], R2)), ("v", lambda fit, p: grid_search(small, fit, [{"v": -0.2}, {"v": 0.9}], R2))])
    assert both.params["best_params"] == {"w": 0.5, "v": -0.2} and both.blocks["configurations"].count() == 4


def test_domains_and_sequence():
    assert IntRange(1, 3).value(0.99) == 3 and IntRange(1, 3).value(IntRange(1, 3).unit(2)) == 2
    assert Categories(("a", "b")).value(0.5) == "b" and DoubleRange(2, 4).unit(3) == 0.5
    points = sobol(256, 10, 0)
    assert all(len({int(v * 256) for v in points[:, d]}) == 256 for d in range(10))


def test_tracking(spark, hidden, tmp_path):
    t = ParquetTracker(spark, f"file://{tmp_path}/track")
    tracked(evaluated(fit_lbfgs, regression_metrics), t, {"l2": 0}, {"model": "a"})(hidden)
    assert spark.read.parquet(f"file://{tmp_path}/track/model=a/params").count() == 2
    assert spark.read.parquet(f"file://{tmp_path}/track/model=a/metrics").count() == 5

    class Client:
        calls = []

        def __getattr__(self, name):
            return lambda *a, **k: self.calls.append((name, a, k))

    tracked(evaluated(fit_lbfgs, regression_metrics), MlflowTracker(Client()), {"l2": 0})(hidden)
    names = [c[0] for c in Client.calls]
    assert names == ["start_run", "start_run", "log_params", "log_params", "log_metrics", "end_run"]


def test_streaming(spark, tmp_path):
    from sparkloom.streaming.events import ew_states, sessions

    folder = f"{tmp_path}/events"
    df = spark.createDataFrame([("a", 1, 0.2, "2024-01-01 00:00:00"), ("a", 2, 0.4, "2024-01-01 00:10:00"), ("b", 1, 0.1, "2024-01-01 05:00:00"), ("a", 3, 0.4, "2024-01-02 00:00:00")], "k string, day int, f double, t string")
    df.withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("k string, day int, f double, t timestamp").parquet(folder)
    for name, out in (("s", sessions(stream, ["k"], "t")), ("e", ew_states(stream, "k", "day", "f"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        q.stop()
    assert {(r["k"], r["n"]) for r in spark.table("s").collect()} >= {("a", 2), ("b", 1)}
    last = spark.table("e").where("key = 'a'").orderBy(F.desc("step")).first()
    assert spark.table("e").count() == 4 and last["ewma"] == pytest.approx(0.7 * (0.7 * 0.06 + 0.3 * 0.4) + 0.3 * 0.4)


def test_fits_by_moments_and_packed_rows(spark, monkeypatch):
    """Moments and packed rows give the losses and gradients of a pass over plain rows, with missing labels and NaN features; a linear fit needs no more passes for more iterations."""
    import numpy as np

    from sparkloom.models import linear

    rng = np.random.default_rng(5)
    data = [([float(v) for v in rng.normal(size=3)], [float(rng.normal()), float(rng.random() < 0.5)]) for _ in range(700)]
    data += [([float("nan"), 1.0, None], [0.5, 1.0]), ([1.0, 2.0, 3.0], [float("nan"), 0.0]), ([1.0, 2.0, 3.0], [1.0, None]), (None, [1.0, 1.0]), ([1.0, 1.0, 1.0], None)]
    rows = linear._training(spark.createDataFrame(data, "features array<double>, label array<double>").repartition(3), "features", "label")
    points = rng.normal(size=(2, 3))
    for kind in ("linear", "logistic"):
        want = linear.losses_and_gradients(rows, points, [0, 1], kind)
        packed = linear.losses_and_gradients(linear._Packed(linear.packed_rows(rows, 3, 2), 3, 2), points, [0, 1], kind)
        assert np.allclose(packed[0], want[0], rtol=1e-12) and np.allclose(packed[1], want[1], rtol=1e-10)
        if kind == "linear":
            moments = linear._from_moments(linear._moments(rows, 3, 2), points, [0, 1])
            assert np.allclose(moments[0], want[0], rtol=1e-12) and np.allclose(moments[1], want[1], rtol=1e-10)
    df = spark.createDataFrame([(v, y[0]) for v, y in data[:300]], "features array<double>, label double")
    by_moments = linear.fit_lbfgs(df, max_iter=20, l2=0.1, l1=0.1).coefficients
    passes = []
    plain = linear._summed
    monkeypatch.setattr(linear, "_summed", lambda parts: passes.append(1) or plain(parts))
    linear.fit_lbfgs(df, max_iter=20)
    assert len(passes) == 1
    monkeypatch.setattr(linear, "MOMENTS", 0)
    assert np.allclose(linear.fit_lbfgs(df, max_iter=20, l2=0.1, l1=0.1).coefficients, by_moments, atol=1e-7)


def test_scores_without_higher_order_functions(spark):
    from sparkloom.functions.vectors import dot, literal
    from sparkloom.models.linear import LinearModel

    m = LinearModel.of([0.5, -2.0, 0.1], 0.3)
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, None, 3.0],), ([1.0],), ([1.0, 2.0, 3.0, 4.0],), ([],), (None,), ([float("nan"), 1.0, 1.0],)], "features array<double>")
    out = m.transform(df).withColumn("w", dot(literal(m.coefficients), F.col("features")) + F.lit(0.3))
    assert all(repr(r["prediction"]) == repr(r["w"]) for r in out.collect())
    assert "lambda" not in out.drop("w")._jdf.queryExecution().optimizedPlan().toString()


def test_boosted_trees_read_small_partitions(spark, tmp_path):
    """A frame that is few partitions is cut for the trees by the size of its files; small ones stay as they are."""
    from sparkloom.models import wrapped

    spark.range(40_000).selectExpr("array(rand(1), rand(2), rand(3)) as features", "double(id % 2) as label", "uuid() as other").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = wrapped.dense(spark.read.parquet(str(tmp_path / "t")).coalesce(1), "features")
    assert wrapped._small_partitions(df.coalesce(1), ["features", "label"]).columns == df.columns or wrapped.partitions_for(df) > 1
    monkey = wrapped.partitions_for
    try:
        wrapped.partitions_for = lambda d: 5
        cut = wrapped._small_partitions(df, ["features", "label"])
        assert cut.columns == ["features", "label"] and cut.rdd.getNumPartitions() == 5 and cut.count() == 40_000
    finally:
        wrapped.partitions_for = monkey
    assert monkey(df, 1) >= 2 and monkey(df, 1000) == 1
