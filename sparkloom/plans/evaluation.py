"""Queries of the evaluators, the flagship among them: ranking metrics by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.metrics.binary import auc, binary_metrics
from sparkloom.metrics.ranking import CountIf, ranking_metrics
from sparkloom.metrics.regression import regression_metrics
from sparkloom.metrics.wrappers import empty_evaluation, train_test
from sparkloom.operators.pieces import spread
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by customer: score = discount * 10, label = returned or not."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return spread(items, [F.col("l_orderkey")]).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


_RANKED = """with i as (select o_custkey, l_orderkey, l_linenumber, l_returnflag, l_discount * 10 as score, case when l_returnflag = 'R' then 1.0 else 0.0 end as label, l_partkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey),
r as (select *, row_number() over (partition by o_custkey order by score desc, label desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rs, row_number() over (partition by o_custkey order by label desc, score desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rl,
label >= 0.5 as pos, score >= 0.5 as got, coalesce(sum(case when label >= 0.5 then 1 else 0 end) over (partition by o_custkey order by score desc, label desc, l_orderkey, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as before from i)
"""
_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(_RANKED + """select o_custkey, round(case when count(*) filter (where pos) > 0 and count(*) filter (where not pos) > 0 then sum(case when not pos then before else 0 end) / (count(*) filter (where pos) * count(*) filter (where not pos)) end, 6) as auc,
round(case when count(*) filter (where got and rs <= 3) > 0 then count(*) filter (where got and pos and rs <= 3) / count(*) filter (where got and rs <= 3) when count(*) filter (where pos) > 0 then 0 end, 6) as precision_3,
round(case when count(*) filter (where pos) > 0 then count(*) filter (where got and pos and rs <= 3) / count(*) filter (where pos and rl <= 3) end, 6) as recall_3,
round(case when sum(case when pos then 1 / log2(rl + 1) else 0 end) > 0 then sum((power(2, label) - 1) / log2(rs + 1)) / sum((power(2, label) - 1) / log2(rl + 1)) end, 6) as ndcg from r group by 1""")
def ranking_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking_metrics(_ranked(spark, sf), ["o_custkey"], {"auc": "auc", "precision_3": "precision@3", "recall_3": "recall@3", "ndcg": "ndcg"}, tiebreak=_TIES)
    return out.select("o_custkey", *[F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in ("auc", "precision_3", "recall_3", "ndcg")])


@query(_RANKED + """select o_custkey, count(*) filter (where pos) as positives, count(*) filter (where not pos) as negatives, count(*) filter (where got and pos) as found_positives, count(*) filter (where got and not pos) as found_negatives,
count(*) filter (where got and l_returnflag = 'A') as flag_a, count(*) filter (where got and rs <= 5 and l_returnflag = 'A') as flag_a_5, count(*) filter (where got and pos and rs <= 5 and l_linenumber = 1) as firsts_5,
count(distinct case when got then l_orderkey end) as orders, count(distinct case when got and pos and rs <= 5 then l_orderkey end) as relevant_orders_5 from r group by 1""")
def ranking_counts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {
        "positives": "numPositives", "negatives": "numNegatives", "found_positives": "foundPositives", "found_negatives": "foundNegatives", "flag_a": CountIf("l_returnflag = 'A'"), "flag_a_5": CountIf("l_returnflag = 'A'", 5),
        "firsts_5": CountIf("l_linenumber = 1", 5, True), "orders": CountIf("true", distinct="l_orderkey"), "relevant_orders_5": CountIf("true", 5, True, "l_orderkey"),
    }
    return ranking_metrics(_ranked(spark, sf), ["o_custkey"], wanted, tiebreak=_TIES)


@query(_RANKED + """select o_custkey, round(case when count(*) filter (where got) > 0 then count(*) filter (where got and pos) / count(*) filter (where got) when count(*) filter (where pos) > 0 then 0 end, 6) as precision,
round(case when count(*) filter (where pos) > 0 then count(*) filter (where got and pos) / count(*) filter (where pos) end, 6) as recall,
round(case when count(*) filter (where got) + count(*) filter (where pos) > 0 then 2 * count(*) filter (where got and pos) / (count(*) filter (where got) + count(*) filter (where pos)) end, 6) as f1,
round(case when count(*) filter (where got and rs <= 3) + count(*) filter (where pos and rl <= 3) > 0 then 2 * count(*) filter (where got and pos and rs <= 3) / (count(*) filter (where got and rs <= 3) + count(*) filter (where pos and rl <= 3)) end, 6) as f1_3,
round(case when sum(label) > 0 then sum(label / case when rs = 1 then 1 else log2(rs) end) / sum(label / case when rl = 1 then 1 else log2(rl) end) end, 6) as ndcg_weak,
round(case when sum(label) > 0 then sum(case when rs <= 5 then label / log2(rs + 1) else 0 end) / sum(case when rl <= 5 then label / log2(rl + 1) else 0 end) end, 6) as ndcg_5 from r group by 1""")
def ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking_metrics(_ranked(spark, sf), ["o_custkey"], {"precision": "precision", "recall": "recall", "f1": "f1", "f1_3": "f1@3", "ndcg_weak": "ndcgWeak", "ndcg_5": "ndcg@5"}, tiebreak=_TIES)
    return out.select("o_custkey", *[F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in out.columns[1:]])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """A score of a document's length and whether it is good."""
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_CURVE = """with s as (select least(n_chars, 5000) / 5000 as t, quality as y from documents join labels using (doc_id)),
c as (select t, count(*) filter (where y > 0.5) as p, count(*) filter (where y <= 0.5) as n from s group by 1),
m as (select t, p, n, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pp, sum(n) over () as nn from c window w as (order by t desc rows unbounded preceding))
"""


@query(_CURVE + "select round(sum(n * (tp - p / 2)) / any_value(pp * nn), 6) as auc from m")
def binary_auc(spark: SparkSession, sf: str) -> DataFrame:
    return auc(_scored(spark, sf), "score", "label").select(F.round("auc", 6).alias("auc"))


def _metric(spark: SparkSession, sf: str, metric: str, x: str) -> DataFrame:
    out = binary_metrics(_scored(spark, sf), "score", "label", f_betas={"f1": 1.0, "f2": 2.0}, bins=0)
    return out.where((F.col("metric") == metric) & (F.col("`x-metric`") == x)).select(F.round("`x-value`", 6).alias("x"), F.round("value", 6).alias("y"))


@query(_CURVE + "select round(t, 6) as x, round(tp / (tp + fp), 6) as y from m")
def precision_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, "precision", "threshold")


@query(_CURVE + "select round(tp / pp, 6) as x, round(tp / (tp + fp), 6) as y from m")
def precision_by_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, "precision", "recall")


@query(_CURVE + "select round(fp / nn, 6) as x, round(tp / pp, 6) as y from m union all select 0.0, 0.0")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, "tp_rate", "fp_rate")


@query(_CURVE + "select round(t, 6) as x, round(case when tp > 0 then 5 * (tp / (tp + fp)) * (tp / pp) / (4 * tp / (tp + fp) + tp / pp) else 0.0 end, 6) as y from m")
def f2_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, "f2", "threshold")


@query(_CURVE + """select 'auc' as metric, round(sum(n * (tp - p / 2)) / any_value(pp * nn), 6) as value from m
union all select 'auc_pr', round(sum(p / pp * (tp / (tp + fp) + case when tp + fp > p + n then (tp - p) / (tp + fp - p - n) else tp / (tp + fp) end) / 2), 6) from m""")
def binary_scalars(spark: SparkSession, sf: str) -> DataFrame:
    out = binary_metrics(_scored(spark, sf), "score", "label", bins=0)
    return out.where(F.col("`x-metric`").isNull()).select("metric", F.round("value", 6).alias("value"))


@query()
def binary_binned(spark: SparkSession, sf: str) -> DataFrame:
    return binary_metrics(_scored(spark, sf), "score", "label", bins=100)


@query(_CURVE.replace("select least(n_chars, 5000) / 5000 as t, quality as y", "select lang, least(n_chars, 5000) / 5000 as t, quality as y").replace("select t, count(*)", "select lang, t, count(*)").replace("from s group by 1", "from s group by 1, 2").replace("select t, p, n", "select lang, t, p, n").replace("sum(p) over ()", "sum(p) over (partition by lang)").replace("sum(n) over ()", "sum(n) over (partition by lang)").replace("w as (order by", "w as (partition by lang order by")
       + "select lang, round(sum(n * (tp - p / 2)) / any_value(pp * nn), 6) as auc from m where pp > 0 and nn > 0 group by 1")
def auc_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return auc(_scored(spark, sf), "score", "label", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


_REGRESSION = """m as (select {g} count(*) as n, avg((y - p) * (y - p)) as mse, avg(abs(y - p)) as mae, var_pop(y) as vy, var_pop(p) as vp, avg(y) as my, avg(p) as mp from d {by})
select {g} unnest(['r2', 'rmse', 'explainedVariance', 'meanAbsoluteError', 'meanSquaredError']) as metric,
unnest([round(1 - mse / vy, 6), round(sqrt(mse), 2), round(vp + (mp - my) * (mp - my), 0), round(mae, 2), round(mse, 0)]) as value from m"""


def _rounded(df: DataFrame) -> DataFrame:
    digits = F.when(F.col("metric") == "r2", F.round("value", 6)).when(F.col("metric").isin("explainedVariance", "meanSquaredError"), F.round("value", 0)).otherwise(F.round("value", 2))
    return df.withColumn("value", digits)


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_quantity") * 1500).alias("prediction"), F.col("l_extendedprice").alias("label"))


@query("with d as (select l_quantity * 1500 as p, l_extendedprice as y from lineitem), " + _REGRESSION.format(g="", by=""))
def regression_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(regression_metrics(_predicted(spark, sf)))


@query("""with d as (select ('0x' || substr(md5(cast(l_orderkey as varchar)), 1, 8))::bigint % 5 = 0 as "isTest", l_quantity * 1500 as p, l_extendedprice as y from lineitem), """ + _REGRESSION.format(g='"isTest",', by="group by 1"))
def train_test_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.functions.scalar import fold_of

    d = _predicted(spark, sf).withColumn("isTest", fold_of(F.col("l_orderkey"), 5) == 0)
    return _rounded(train_test(regression_metrics)(d))


@query("select 1 as meaningless")
def empty_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return empty_evaluation(spark)
