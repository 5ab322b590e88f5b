"""Regression metrics as rows (metric, value), in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import col


def regression_metrics(df: DataFrame, prediction: str = "prediction", label: str = "label", keys: Sequence[str] = (), through_origin: bool = False) -> DataFrame:
    """(keys, metric, value): r2, rmse, explainedVariance, meanAbsoluteError, meanSquaredError.

    Rows with a null or NaN prediction or label are left out; a group without others has no rows. r2 is null for a
    constant label. through_origin: r2 against 0 instead of the labels' mean.
    """
    k = [col(c) for c in keys]
    rows = df.select(*k, col(prediction).cast("double").alias("__p"), col(label).cast("double").alias("__y")).where("__p is not null and __y is not null and not isnan(__p) and not isnan(__y)")
    e = F.col("__y") - F.col("__p")
    sums = rows.groupBy(*k).agg(F.count("*").alias("__n"), F.avg(e * e).alias("__mse"), F.avg(F.abs(e)).alias("__mae"), F.var_pop("__y").alias("__vy"), F.var_pop("__p").alias("__vp"), F.avg("__y").alias("__my"), F.avg("__p").alias("__mp"), F.avg(F.col("__y") * F.col("__y")).alias("__yy"))
    total = F.col("__yy") if through_origin else F.col("__vy")
    r2 = F.when(total > 0, 1 - F.col("__mse") / total)
    explained = F.col("__vp") + F.pow(F.col("__mp") - F.col("__my"), 2)
    values = {"r2": r2, "rmse": F.sqrt("__mse"), "explainedVariance": explained, "meanAbsoluteError": F.col("__mae"), "meanSquaredError": F.col("__mse")}
    return sums.where("__n > 0").select(*k, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()])))
