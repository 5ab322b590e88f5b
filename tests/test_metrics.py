from math import isnan, log2

import pytest
from pyspark.sql import functions as F

from sparkloom.metrics.binary import auc, binary_metrics
from sparkloom.metrics.ranking import CountIf, ranking_metrics
from sparkloom.metrics.regression import regression_metrics
from sparkloom.metrics.wrappers import empty_evaluation, train_test


@pytest.fixture(scope="module")
def ranked(spark):
    data = [(1, "Photo", 1, 0.9, 1.0), (1, "Post", 2, 0.8, 0.0), (1, "Post", 3, 0.7, 1.0), (1, "Post", 3, 0.0, 1.0), (2, "Photo", 1, 0.9, 1.0), (2, "Post", 2, 0.8, 1.0), (2, "Post", 3, 0.3, 0.0)]
    return spark.createDataFrame(data, "userId bigint, objectType string, ownerId bigint, score double, label double")


def test_ranking_family(ranked):
    names = {
        "ndcg": "ndcg", "ndcg2": "ndcg@2", "weak": "ndcgWeak", "weak2": "ndcgWeak@2", "auc": "auc", "precision": "precision", "recall": "recall", "precision2": "precision@2", "recall2": "recall@2", "f1": "f1", "f12": "f1@2",
        "pos": "numPositives", "neg": "numNegatives", "fpos": "foundPositives", "fneg": "foundNegatives", "photos": CountIf("objectType = 'Photo'"), "posts": CountIf("objectType = 'Post'"),
        "relevantPosts": CountIf("objectType = 'Post'", relevant=True), "relevantPost2": CountIf("objectType = 'Post'", 2, True), "owners": CountIf("true", distinct="ownerId"),
    }
    one, two = ranking_metrics(ranked, ["userId"], names).orderBy("userId").collect()
    assert one["ndcg"] == pytest.approx((1 + 1 / log2(4) + 1 / log2(5)) / (1 + 1 / log2(3) + 1 / log2(4))) and two["ndcg"] == pytest.approx(1)
    assert one["ndcg2"] == pytest.approx(1 / (1 + 1 / log2(3)))
    assert one["weak"] == pytest.approx((1 + 1 / log2(3) + 1 / log2(4)) / (2 + 1 / log2(3))) and one["weak2"] == pytest.approx(0.5)
    assert one["auc"] == pytest.approx(1 / 3) and two["auc"] == 1
    assert [one[c] for c in ("precision", "recall", "f1")] == pytest.approx([2 / 3] * 3) and [one[c] for c in ("precision2", "recall2", "f12")] == pytest.approx([0.5] * 3)
    assert [two[c] for c in ("precision", "recall", "f1", "precision2", "recall2", "f12")] == pytest.approx([1] * 6)
    assert [one[c] for c in ("pos", "neg", "fpos", "fneg", "photos", "posts", "relevantPosts", "relevantPost2", "owners")] == [3, 1, 2, 1, 1, 2, 1, 0, 3]
    assert [two[c] for c in ("pos", "neg", "fpos", "fneg", "photos", "posts", "relevantPosts", "relevantPost2")] == [2, 1, 2, 0, 1, 1, 1, 1]


def test_ranking_of_vectors_and_nan(ranked, spark):
    v = ranked.select("userId", F.array("score", "label").alias("s"), F.array("label", "score").alias("l"))
    out = {(r["userId"], r["score"], r["label"]): r for r in ranking_metrics(v, ["userId"], {"ndcg": "ndcg", "auc": "auc"}, "s", "l").collect()}
    assert len(out) == 8 and out[1, 0, 0]["auc"] == pytest.approx(1 / 3)
    swapped = out[1, 1, 1]
    top = (2**0.9 - 1) + (2**0.7 - 1) / log2(3) + (2**0.8 - 1) / log2(5)
    assert swapped["ndcg"] == pytest.approx(top / ((2**0.9 - 1) + (2**0.8 - 1) / log2(3) + (2**0.7 - 1) / log2(4)))
    lone = ranking_metrics(ranked.where("label = 1"), ["userId"], ["auc"]).collect()
    assert all(isnan(r["auc"]) for r in lone)


def test_binary_against_pairs(spark):
    data = [(0.1, 0.0), (0.4, 1.0), (0.4, 0.0), (0.8, 1.0), (0.9, 1.0), (0.95, 0.0), (None, 1.0)]
    df = spark.createDataFrame(data, "score double, label double")
    pos, neg = [s for s, y in data if s and y], [s for s, y in data if s and not y]
    expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / 9
    assert auc(df, "score", "label").first()["auc"] == pytest.approx(expected)
    out = binary_metrics(df, "score", "label", bins=0)
    assert out.where("metric = 'auc'").first()["value"] == pytest.approx(expected)
    from curves import area_under_pr

    assert out.where("metric = 'auc_pr'").first()["value"] == pytest.approx(area_under_pr([(s, y) for s, y in data if s]))
    assert binary_metrics(df.where("label = 1"), "score", "label").count() == 0


def test_binary_matches_spark(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(3000).select((F.round(F.rand(1), 3)).alias("score"), (F.rand(2) < F.rand(1)).cast("double").alias("label")).cache()
    ours = {r["metric"]: r["value"] for r in binary_metrics(df, "score", "label", bins=0).where("`x-metric` is null").collect()}
    for name, theirs in (("auc", "areaUnderROC"), ("auc_pr", "areaUnderPR")):
        e = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName=theirs, numBins=0)
        assert ours[name] == pytest.approx(e.evaluate(df), abs=1e-9)
    assert binary_metrics(df, "score", "label", bins=50).where("metric = 'recall'").count() <= 75


def test_regression(spark):
    from pyspark.ml.evaluation import RegressionEvaluator

    df = spark.createDataFrame([(1.0, 1.5, True), (2.0, 1.8, False), (4.0, 3.0, False), (None, 1.0, False)], "label double, prediction double, isTest boolean")
    ours = {r["metric"]: r["value"] for r in regression_metrics(df).collect()}
    clean = df.where("label is not null")
    for name, theirs in (("r2", "r2"), ("rmse", "rmse"), ("meanAbsoluteError", "mae"), ("meanSquaredError", "mse"), ("explainedVariance", "var")):
        assert ours[name] == pytest.approx(RegressionEvaluator(metricName=theirs).evaluate(clean))
    assert train_test(regression_metrics)(df).count() == 10
    assert regression_metrics(df.where("false")).count() == 0 and empty_evaluation(spark).first()["meaningless"] == 1


def test_ranking_spreads_large_tables(spark, tmp_path, monkeypatch):
    """Groups go to partitions by the size of the files once those are more than the session's number; the metrics stay."""
    from sparkloom.metrics import ranking
    from sparkloom.operators import pieces

    spark.range(30_000).selectExpr("id", "id % 700 as k", "rand(3) as score", "double(id % 3 = 0) as label").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = {r["k"]: (r["auc"], r["n"]) for r in ranking.ranking_metrics(df, ["k"], {"auc": "auc", "n": "ndcg@5"}, tiebreak=["id"]).collect()}
    monkeypatch.setattr(pieces, "partitions_for", lambda d, megabytes=4: 9)
    out = ranking.ranking_metrics(df, ["k"], {"auc": "auc", "n": "ndcg@5"}, tiebreak=["id"])
    assert "hashpartitioning(k" in out._jdf.queryExecution().executedPlan().toString() and "9), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: (r["auc"], r["n"]) for r in out.collect()} == plain and len(plain) == 700
