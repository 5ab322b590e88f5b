"""Aggregates: lists and sets, vector statistics, means over NaN, significance of weights, sums for samplers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalar import student_quantile_column
from sparkloom.functions.vectors import as_array, attribute_names, col, is_vector


def list_of(c: Column) -> Column:
    """All values, nulls too, in no particular order."""
    return F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"])


def set_of(c: Column) -> Column:
    """The distinct values, sorted, without null."""
    return F.array_sort(F.collect_set(c))


def merged_sets(c: Column) -> Column:
    """The distinct entries of all arrays, sorted, without null; of no arrays the empty one."""
    own = F.filter(c, lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(own))))


def list_of_structs(*columns: str) -> Column:
    return F.collect_list(F.struct(*[col(c) for c in columns]))


def _long_form(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, __i, __x): every entry of every vector; NaN as null."""
    entries = df.select(*[col(k) for k in keys], F.posexplode(as_array(df, vector)).alias("__i", "__x"))
    return entries.withColumn("__x", F.nanvl("__x", F.lit(None).cast("double")))


def vector_stats(df: DataFrame, vector: str, keys: Sequence[str] = (), percentiles: Mapping[str, float] | None = None, exact: bool = True, compression: int = 150) -> DataFrame:
    """A row for each key, or one: <vector>_count, then arrays _mean, _var (sample), _min, _max, _nonZeros, _L1, _L2, _p10 ...

    NaN and null entries are left out of an entry's statistics. Percentiles are exact ones of rank n * p + 1/2, which
    sort all values; with `exact=False` they are approximate, of fixed memory however long a group is.
    """
    percentiles = {"p10": 0.1, "p50": 0.5, "p90": 0.9} if percentiles is None else dict(percentiles)
    long = _long_form(df, keys, vector)
    k = [col(c) for c in keys]
    stats = [
        F.avg("__x").alias("mean"), F.coalesce(F.var_samp("__x"), F.lit(0.0)).alias("var"), F.min("__x").alias("min"), F.max("__x").alias("max"),
        F.count(F.when(F.col("__x") != 0, 1)).alias("nonZeros"), F.sum(F.abs("__x")).alias("L1"), F.sqrt(F.sum(F.col("__x") * F.col("__x"))).alias("L2"),
    ]
    if exact and percentiles:
        w = Window.partitionBy(*k, "__i")
        long = long.withColumn("__rn", F.row_number().over(w.orderBy(F.col("__x").asc_nulls_last()))).withColumn("__n", F.count("__x").over(w))
        for name, p in percentiles.items():
            h = F.greatest(F.lit(1.0), F.least(F.col("__n").cast("double"), F.col("__n") * p + 0.5))
            stats.append(F.sum(F.col("__x") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("__rn") - h))).alias(name))
    else:
        for name, p in percentiles.items():
            stats.append(F.percentile_approx("__x", p, compression * 100).alias(name))
    of_entry = long.groupBy(*k, "__i").agg(F.count("__x").alias("count"), *stats)
    names = ["mean", "var", "min", "max", "nonZeros", "L1", "L2", *percentiles]
    gathered = of_entry.groupBy(*k).agg(F.max("count").alias(f"{vector}_count"), F.array_sort(F.collect_list(F.struct("__i", *names))).alias("__all"))
    return gathered.select(*k, f"{vector}_count", *[F.col("__all").getField(n).cast("array<double>").alias(f"{vector}_{n}") for n in names])


def nan_safe_means(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, means array<double>): mean of each entry without NaN and null; 0 where nothing else is there."""
    k = [col(c) for c in keys]
    means = _long_form(df, keys, vector).groupBy(*k, "__i").agg(F.coalesce(F.avg("__x"), F.lit(0.0)).alias("__m"))
    return means.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("means"))


def replace_nan_by_mean(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` with NaN and null entries of its vector replaced by the entry's mean in the row's group.

    Rows of a null key are a group. A null vector stays null.
    """
    means = nan_safe_means(df, vector, keys).select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("means").alias("__means"))
    a = as_array(df, vector)
    if keys:
        condition = F.lit(True)
        for i, k in enumerate(keys):
            condition = condition & df[k].eqNullSafe(F.col(f"__k{i}"))
        joined = df.join(means, condition, "left")
    else:
        joined = df.join(F.broadcast(means), how="left")  # one row
    filled = F.zip_with(a, F.col("__means"), lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x))
    out = array_to_vector(filled) if is_vector(df.schema[vector]) else filled
    return joined.select(*[(out.alias(vector, metadata=df.schema[vector].metadata or {}) if c == vector else col(c)) for c in df.columns])


def weight_significance(weights: DataFrame, discriminants: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """(index, name, discriminants, average, deviation, count, significance) of weights fitted on several folds.

    significance: |average| over the half width of its confidence interval by Student's t; 0 where that isn't
    above 0, as for a single fold.
    """
    keys = ["index", "name", *discriminants]
    found = weights.groupBy(*[col(k) for k in keys]).agg(F.avg("weight").alias("average"), F.stddev_samp("weight").alias("deviation"), F.count("weight").alias("count"))
    half = student_quantile_column(1 - (1 - confidence) / 2, F.col("count") - 1) * F.col("deviation") / F.sqrt(F.col("count"))
    return found.withColumn("significance", F.coalesce(F.when(half > 0, F.abs("average") / half), F.lit(0.0)))


def group_balance(df: DataFrame, keys: Sequence[str], label: str, threshold: float = 0.5) -> DataFrame:
    """One row (groups, positives, negatives), over the groups that have both classes."""
    of_group = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.when(col(label) >= threshold, 1)).alias("p"), F.count(F.when(col(label) < threshold, 1)).alias("n"))
    usable = of_group.where("p > 0 and n > 0")
    return usable.agg(F.count("*").alias("groups"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"))


def greatest_useful_l1(df: DataFrame, features: str, label: str) -> DataFrame:
    """One row, bound: the least L1 penalty that makes all weights 0: the greatest |sum of x (y - mean y)| / n."""
    entries = df.select(col(label).cast("double").alias("__y"), F.posexplode(as_array(df, features)).alias("__i", "__x"))
    # sum x (y - mean y) = sum xy - mean y * sum x, so one pass is enough
    sums = entries.groupBy("__i").agg(F.sum(F.col("__x") * F.col("__y")).alias("xy"), F.sum("__x").alias("x"), F.avg("__y").alias("m"), F.count("*").alias("n"))
    return sums.agg(F.max(F.abs(F.col("xy") - F.col("m") * F.col("x")) / F.col("n")).alias("bound"))


def document_frequency(df: DataFrame, tokens: str, min_documents: int = 1) -> DataFrame:
    """(term, n, documents): occurrences, and rows that hold the term, of terms in so many rows at least."""
    own = F.filter(col(tokens), lambda t: t.isNotNull())

    def marked(a: Column, n: int, d: int) -> Column:
        return F.transform(a, lambda t: F.struct(t.alias("term"), F.lit(n).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d")))

    rows = df.select(F.explode(F.concat(marked(own, 1, 0), marked(F.array_distinct(own), 0, 1))).alias("t")).select("t.*")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("documents")).where(F.col("documents") >= min_documents)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """(value): the distinct values of a column; of an array column those of its entries, null for none."""
    from pyspark.sql.types import ArrayType

    c = col(name)
    return df.select((F.explode_outer(c) if isinstance(df.schema[name].dataType, ArrayType) else c).alias("value")).distinct()


def salted_counts(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], merge: Mapping[str, Column], salts: int = 32) -> DataFrame:
    """Aggregates of very uneven groups in two levels: by key and salt, then by key. merge: over the first level's columns."""
    k = [col(c) for c in keys]
    first = df.groupBy(*k, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("__salt")).agg(*[v.alias(n) for n, v in aggregates.items()])
    return first.groupBy(*k).agg(*[v.alias(n) for n, v in merge.items()])


def vector_names(df: DataFrame, vector: str) -> list[str] | None:
    return attribute_names(df.schema[vector])
