"""Scalar functions that are column arithmetic."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def wilson_lower(positive: Column, total: Column, confidence: float = 0.95, min_bound: float = 0.0) -> Column:
    """Lower bound of Wilson's interval of a share; bounds under `min_bound` are 0. Null for a null input.

    A total that isn't positive, a negative count, or a count above the total raises.
    """
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    n, p = total.cast("double"), positive.cast("double") / F.when(total > 0, total).cast("double")
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    value = F.when(bound < min_bound, 0.0).otherwise(bound)
    wrong = (total <= 0) | (positive < 0) | (positive > total)
    return F.when(wrong, F.raise_error(F.lit("wilson_lower: need 0 <= positive <= total and total > 0")).cast("double")).otherwise(value)


def register_wilson(spark: SparkSession, confidence: float = 0.95) -> str:
    """A temporary SQL function `wilson_lower_<percent>(positive, total)`; its name."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    name = f"wilson_lower_{round(confidence * 100)}"
    share = "positive / total"
    spark.sql(
        f"create or replace temporary function {name}(positive double, total double) returns double return "
        f"({share} + {z * z / 2}D / total - {z}D * sqrt(({share} * (1 - {share}) + {z * z / 4}D / total) / total)) / (1 + {z * z}D / total)"
    )
    return name


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


@lru_cache(maxsize=4096)
def student_quantile(p: float, freedom: int) -> float:
    """The quantile of Student's t with so many degrees of freedom."""
    if p < 0.5:
        return -student_quantile(1 - p, freedom)

    def cdf(t: float) -> float:
        return 1 - 0.5 * _incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


#: From here on the normal quantile with three correction terms is exact to 1e-9.
_T_TABLE = 200


def student_quantile_column(p: float, freedom: Column) -> Column:
    """`student_quantile` of a column: a table for up to 200 degrees, Cornish and Fisher's series beyond; null under 1."""
    table = F.array(*[F.lit(student_quantile(p, n)) for n in range(1, _T_TABLE + 1)])
    z, n = NormalDist().inv_cdf(p), freedom.cast("double")
    series = z + (z**3 + z) / 4 / n + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n * n) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (n * n * n)
    return F.when(freedom > _T_TABLE, series).when(freedom >= 1, F.get(table, freedom.cast("int") - 1))


def fold_of(key: Column, folds: int) -> Column:
    """A fold of 0 .. folds - 1 by the md5 of a key, alike in every SQL engine; all are in fold 0 for folds <= 0. Null keys hash as ''."""
    if folds <= 0:
        return F.lit(0).cast("bigint")
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") % folds
