"""Operators over ordered rows: top k, ordered cuts, gap sessions, time discount, exponentially weighted statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import as_array, col, is_vector


def top_k(df: DataFrame, keys: Sequence[str], order: str, k: int, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The k rows of each group with the greatest (or least) `order`, whole; ties by the tiebreak columns, nulls last.

    Spark cuts each partition to k rows of a group before it shuffles (WindowGroupLimit).
    """
    first = col(order).asc_nulls_last() if ascending else col(order).desc_nulls_last()
    w = Window.partitionBy(*[col(c) for c in keys]).orderBy(first, *[col(c) for c in tiebreak])
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= k).drop("__nth")


def top_rows(df: DataFrame, order: str, n: int, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The n rows with the greatest (or least) `order` of all."""
    return df.orderBy(col(order).asc_nulls_last() if ascending else col(order).desc_nulls_last(), *[col(c) for c in tiebreak]).limit(n)


def cut_bounds(df: DataFrame, keys: Sequence[str], order: str, expected: int, ascending: bool = True) -> DataFrame:
    """(keys, bound): the first value of `order` at which a group has `expected` rows, else its last one.

    Only the counts of (group, value) are sorted. Rows with a null `order` count for nothing.
    """
    counts = df.where(col(order).isNotNull()).groupBy(*[col(k) for k in keys], col(order)).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order).asc() if ascending else col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    used = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).where(F.col("__before") < expected)
    return used.groupBy(*[col(k) for k in keys]).agg((F.max if ascending else F.min)(col(order)).alias("bound"))


def ordered_cut(df: DataFrame, keys: Sequence[str], order: str, expected: int, ascending: bool = True) -> DataFrame:
    """The rows of each group up to its bound, all those at the bound included; rows of a null key or order go."""
    bounds = cut_bounds(df, keys, order, expected, ascending)
    return apply_cut(df, bounds, keys, order, ascending)


def apply_cut(df: DataFrame, bounds: DataFrame, keys: Sequence[str], order: str, ascending: bool = True) -> DataFrame:
    """The rows within bounds fitted elsewhere; groups without a bound go."""
    joined = df.join(bounds.withColumnRenamed("bound", "__bound"), list(keys))
    kept = joined.where(col(order) <= F.col("__bound")) if ascending else joined.where(col(order) >= F.col("__bound"))
    return kept.select(*[col(c) for c in df.columns])


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: Column | float, output: str = "session", tiebreak: Sequence[str] = ()) -> DataFrame:
    """`df` with a session number from 0: a row whose time is `gap` or more after the previous one's begins a session.

    time: a number, a date (gaps in days), or a timestamp (gaps in seconds). Rows with a null time come first, in session 0.
    """
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp"):
        t = F.unix_micros(col(time).cast("timestamp")) / 1e6
    else:
        t = F.unix_date(col(time)).cast("double") if kind == "date" else col(time).cast("double")
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(t.asc_nulls_first(), *[col(c) for c in tiebreak])
    new = F.coalesce((t - F.lag(t).over(w) >= gap).cast("bigint"), F.lit(0))
    marked = df.withColumn("__new", new)
    return marked.withColumn(output, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def discounted(df: DataFrame, keys: Sequence[str], time: str, vector: str, now: int, base: float = 0.7, scale: float = 2 * 86_400_000.0) -> DataFrame:
    """(keys, time, vector): the sum of each group's vectors, each discounted by base ^ (age / scale).

    Discounts multiply, so the step-by-step fold over sorted rows is one sum per entry, without a sort. time, and the
    time in the result (that of the group's last row), are in the units of `scale`. Rows with a null time or
    vector are left out; shorter vectors count as filled with zeros.
    """
    k = [col(c) for c in keys]
    entries = df.where(col(time).isNotNull()).select(*k, col(time).alias("__t"), F.posexplode(as_array(df, vector)).alias("__i", "__x"))
    factor = F.pow(F.lit(base), (F.lit(float(now)) - F.col("__t").cast("double")) / scale)
    sums = entries.groupBy(*k, "__i").agg(F.sum(F.col("__x") * factor).alias("__s"), F.max("__t").alias("__t"))
    ordered = sums.groupBy(*k).agg(F.max("__t").alias(time), F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda s: s["__s"]).alias("__v"))
    out = array_to_vector(F.col("__v")) if is_vector(df.schema[vector]) else F.col("__v")
    return ordered.select(*k, col(time), out.alias(vector))


def ew_update(freq: Column, ewma: Column, ewmvar: Column, alpha: float = 0.3, beta: float = 1e-7) -> Column:
    """struct(sig, ewma, ewmvar) after a new frequency; a null input counts as 0.

    sig: how many deviations the frequency lies above the old mean, 0 if below it.
    """
    f, m, v = (F.coalesce(c, F.lit(0.0)) for c in (freq, ewma, ewmvar))
    delta = f - m
    sig = F.greatest((f - F.greatest(m, F.lit(beta))) / (F.sqrt(v) + beta), F.lit(0.0))
    return F.struct(sig.alias("sig"), (m + alpha * delta).alias("ewma"), ((1 - alpha) * (v + alpha * delta * delta)).alias("ewmvar"))


def ew_stats(today: DataFrame, yesterday: DataFrame, term: str = "Term", freq: str = "Freq", state: str = "EWStruct", alpha: float = 0.3, beta: float = 1e-7) -> DataFrame:
    """(term, freq, state) of every term of today's frequencies and yesterday's states; what is missing counts as 0."""
    old = yesterday.select(col(term).alias("__term"), col(state).alias("__old"))
    both = today.join(old, col(term) == F.col("__term"), "full_outer")
    new = ew_update(col(freq), F.col("__old.ewma"), F.col("__old.ewmvar"), alpha, beta)
    return both.select(F.coalesce(col(term), F.col("__term")).alias(term), F.coalesce(col(freq), F.lit(0.0)).alias(freq), new.alias(state))


def ew_series(df: DataFrame, key: str, step: str, freq: str, alpha: float = 0.3, beta: float = 1e-7) -> DataFrame:
    """(key, sig, ewma, ewmvar): the state after all rows of a key, by `step`, beginning with zeros."""
    ordered = df.groupBy(col(key)).agg(F.array_sort(F.collect_list(F.struct(col(step).alias("s"), col(freq).cast("double").alias("f")))).alias("__all"))
    zero = F.struct(F.lit(0.0).alias("sig"), F.lit(0.0).alias("ewma"), F.lit(0.0).alias("ewmvar"))
    state = F.aggregate("__all", zero, lambda s, x: ew_update(x["f"], s["ewma"], s["ewmvar"], alpha, beta))
    return ordered.select(col(key), state.alias("__s")).select(col(key), "__s.*")
