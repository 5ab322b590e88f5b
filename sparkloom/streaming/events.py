"""Streaming counterparts of the ordered batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import col


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str = "30 minutes", late: str = "10 minutes", aggregates: Sequence[Column] = ()) -> DataFrame:
    """(keys, start, end, n, aggregates): sessions of events less than `gap` apart; later ones than `late` are dropped."""
    grouped = stream.withWatermark(time, late).groupBy(*[col(k) for k in keys], F.session_window(col(time), gap).alias("w"))
    found = grouped.agg(F.count("*").alias("n"), *aggregates)
    return found.select(*[col(k) for k in keys], F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in {*keys, "w"}])


def windowed(stream: DataFrame, keys: Sequence[str], time: str, length: str, slide: str | None = None, late: str = "10 minutes", aggregates: Sequence[Column] = ()) -> DataFrame:
    """(keys, start, end, n, aggregates) of time windows."""
    w = F.window(col(time), length, slide) if slide else F.window(col(time), length)
    found = stream.withWatermark(time, late).groupBy(*[col(k) for k in keys], w.alias("w")).agg(F.count("*").alias("n"), *aggregates)
    return found.select(*[col(k) for k in keys], F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in {*keys, "w"}])


def ew_states(stream: DataFrame, key: str, step: str, freq: str, alpha: float = 0.3, beta: float = 1e-7) -> DataFrame:
    """(key, step, sig, ewma, ewmvar) after each micro-batch's rows of a key, by `step`; the state lives in the store."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(stream.dtypes)
    rows = stream.select(col(key).alias("key"), col(step).alias("step"), col(freq).cast("double").alias("freq")).where("step is not null and freq is not null")

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, var = state.get if state.exists else (0.0, 0.0)
        own = pd.concat(list(frames)).sort_values("step", kind="stable")
        out = []
        for s, f in zip(own["step"], own["freq"]):
            delta = f - ewma
            sig = max((f - max(ewma, beta)) / (var**0.5 + beta), 0.0)
            ewma, var = ewma + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)
            out.append((name[0], s, sig, ewma, var))
        state.update((ewma, var))
        yield pd.DataFrame(out, columns=["key", "step", "sig", "ewma", "ewmvar"])

    schema = f"key {kinds[key]}, step {kinds[step]}, sig double, ewma double, ewmvar double"
    return rows.groupBy("key").applyInPandasWithState(update, schema, "ewma double, ewmvar double", "append", GroupStateTimeout.NoTimeout)
