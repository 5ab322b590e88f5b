"""Ranking metrics by group, as plain relational aggregation.

Each group's rows are ranked by score (label, then tiebreak, deciding ties) and by label, on one hash partitioning;
every metric is then a conditional sum. A row is positive if its label reaches `label_threshold`, and returned if
its score reaches `model_threshold`. auc and the gains go over all rows, the other metrics over returned ones.

A metric is an entry of METRICS, or `name@k` of those that take a cut, or one of the counts below. Where a metric
isn't defined (no positives for recall, no ideal gain for ndcg) it is NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import as_array, col, is_numeric_array, is_vector
from sparkloom.operators.pieces import spread


@dataclass(frozen=True)
class CountIf:
    """Rows that are returned and meet a SQL condition; of the first k only, positive ones only, distinct values only."""

    condition: str
    k: int | None = None
    relevant: bool = False
    distinct: str | None = None


METRICS = ("auc", "numPositives", "numNegatives", "foundPositives", "foundNegatives", "precision", "recall", "f1", "ndcg", "ndcgWeak")


def _nan() -> Column:
    return F.lit(float("nan"))


def _ratio(top: Column, bottom: Column, otherwise: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / F.when(bottom > 0, bottom)).otherwise(otherwise)


def _metric(name: str) -> Column:
    base, _, cut = name.partition("@")
    k = int(cut) if cut else None
    pos, got = F.col("__pos"), F.col("__got")
    rs, rl = F.col("__rs"), F.col("__rl")
    n = lambda c: F.count(F.when(c, 1))
    first = got if k is None else got & (rs <= k)
    if base == "auc":
        # for each negative, the positives ranked before it
        pairs = F.sum(F.when(~pos, F.col("__before")).otherwise(0))
        return _ratio(pairs, n(pos) * n(~pos), _nan())
    if base in ("numPositives", "numNegatives"):
        return n(pos if base == "numPositives" else ~pos)
    if base in ("foundPositives", "foundNegatives"):
        return n(got & (pos if base == "foundPositives" else ~pos))
    if base == "precision":
        return _ratio(n(first & pos), n(first), F.when(n(pos) > 0, 0.0).otherwise(_nan()))
    if base == "recall":
        return _ratio(n(first & pos), n(pos if k is None else pos & (rl <= k)), _nan())
    if base == "f1":
        return _ratio(2 * n(first & pos), n(first) + n(pos if k is None else pos & (rl <= k)), _nan())
    if base in ("ndcg", "ndcgWeak"):
        label = F.col("__label")

        def gain(rank: Column) -> Column:
            if base == "ndcg":
                return (F.pow(F.lit(2.0), label) - 1) / F.log2(rank + 1)
            return label / F.when(rank == 1, 1.0).otherwise(F.log2(rank.cast("double")))

        inside = lambda rank: F.lit(True) if k is None else rank <= k
        real, ideal = F.sum(F.when(inside(rs), gain(rs)).otherwise(0.0)), F.sum(F.when(inside(rl), gain(rl)).otherwise(0.0))
        return F.when(ideal != 0, real / F.when(ideal != 0, ideal)).otherwise(_nan())
    raise ValueError(f"no metric {name}; there are {', '.join(METRICS)}")


def _count_if(c: CountIf) -> Column:
    condition = F.col("__got") & F.expr(c.condition)
    if c.k is not None:
        condition = condition & (F.col("__rs") <= c.k)
    if c.relevant:
        condition = condition & F.col("__pos")
    return F.count_distinct(F.when(condition, F.expr(c.distinct))) if c.distinct else F.count(F.when(condition, 1))


def ranking_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] | Mapping[str, str | CountIf], score: str = "score", label: str = "label", label_threshold: float = 0.5, model_threshold: float = 0.5, tiebreak: Sequence[str] = ()) -> DataFrame:
    """(keys, one column a metric), a row for each group; metrics: names, or column names and what they hold.

    Rows with a null or NaN score or label are left out. Of a vector of scores or labels, each pair of a score and a
    label is evaluated by itself, and the indices are further keys, `score` and `label`.
    """
    wanted = dict(metrics) if isinstance(metrics, Mapping) else {m: m for m in metrics}
    rows, keys = df.withColumn("__all", F.lit(1)), list(keys)
    extra = []
    for name, out in ((score, "score"), (label, "label")):
        f = df.schema[name]
        if is_vector(f) or is_numeric_array(f):
            rows = rows.select("*", F.posexplode(as_array(df, name)).alias(f"__i_{out}", f"__{out}"))
            extra.append((f"__i_{out}", out))
        else:
            rows = rows.withColumn(f"__{out}", col(name).cast("double"))
    rows = rows.where("__score is not null and __label is not null and not isnan(__score) and not isnan(__label)")
    parts = [col(k) for k in keys] + [F.col(i) for i, _ in extra]
    rows = spread(rows, parts)
    w = Window.partitionBy(*parts)
    ties = [col(c) for c in tiebreak]
    by_score = w.orderBy(F.desc("__score"), F.desc("__label"), *ties)
    ranked = rows.withColumns({"__rs": F.row_number().over(by_score), "__rl": F.row_number().over(w.orderBy(F.desc("__label"), F.desc("__score"), *ties)), "__pos": F.col("__label") >= label_threshold, "__got": F.col("__score") >= model_threshold})
    ranked = ranked.withColumn("__before", F.count(F.when(F.col("__pos"), 1)).over(by_score.rowsBetween(Window.unboundedPreceding, -1)))
    aggregates = [(_count_if(m) if isinstance(m, CountIf) else _metric(m)).alias(n) for n, m in wanted.items()]
    out = ranked.groupBy(*parts).agg(*aggregates)
    return out.select(*[col(k) for k in keys], *[F.col(i).alias(n) for i, n in extra], *[col(n) for n in wanted])
