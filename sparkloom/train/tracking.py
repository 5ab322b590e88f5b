"""Experiment tracking: nested runs whose parameters and metrics go to Parquet, or to MLflow where it is installed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.models.base import METRICS, Model


class Tracker(Protocol):
    def log_params(self, params: Mapping[str, Any]) -> None: ...
    def log_metrics(self, metrics: DataFrame) -> None: ...
    def dive(self, tags: Mapping[str, Any]) -> Tracker: ...
    def come_up(self) -> None: ...


class ParquetTracker:
    """Appends to `<path>/<tag=value>/.../params` and `/metrics`."""

    def __init__(self, spark: SparkSession, path: str, tags: Mapping[str, Any] | None = None):
        self.spark, self.path, self.tags = spark, path.rstrip("/"), dict(tags or {})

    @property
    def place(self) -> str:
        return "/".join([self.path, *[f"{k}={v}" for k, v in self.tags.items()]])

    def log_params(self, params: Mapping[str, Any]) -> None:
        if params:
            self.spark.createDataFrame([(str(k), str(v)) for k, v in params.items()], "param string, value string").coalesce(1).write.mode("append").parquet(f"{self.place}/params")

    def log_metrics(self, metrics: DataFrame) -> None:
        metrics.coalesce(1).write.mode("append").parquet(f"{self.place}/metrics")

    def dive(self, tags: Mapping[str, Any]) -> ParquetTracker:
        return ParquetTracker(self.spark, self.path, {**self.tags, **tags})

    def come_up(self) -> None:
        pass


class MlflowTracker:
    """Nested MLflow runs; `client` is the mlflow module, or what stands for it. Metrics are rows (metric, value)."""

    def __init__(self, client: Any = None, tags: Mapping[str, Any] | None = None):
        if client is None:
            import mlflow as client  # optional
        self.client = client
        self.run = client.start_run(nested=True, tags={k: str(v) for k, v in (tags or {}).items()})

    def log_params(self, params: Mapping[str, Any]) -> None:
        self.client.log_params({k: str(v)[:250] for k, v in params.items()})

    def log_metrics(self, metrics: DataFrame) -> None:
        rows = metrics.where("value is not null").select("metric", F.col("value").cast("double").alias("value"), *([F.col("x-value").alias("x")] if "x-value" in metrics.columns else []))
        scalars = rows.where("x is null") if "x" in rows.columns else rows
        self.client.log_metrics({r["metric"]: r["value"] for r in scalars.collect()})

    def dive(self, tags: Mapping[str, Any]) -> MlflowTracker:
        return MlflowTracker(self.client, tags)

    def come_up(self) -> None:
        self.client.end_run()


@contextmanager
def inside(tracker: Tracker, tags: Mapping[str, Any]) -> Iterator[Tracker]:
    deeper = tracker.dive(tags)
    try:
        yield deeper
    finally:
        deeper.come_up()


def tracked(fit: Callable[[DataFrame], Model], tracker: Tracker, params: Mapping[str, Any] | None = None, tags: Mapping[str, Any] | None = None, metrics: Callable[[Model], DataFrame | None] | None = None) -> Callable[[DataFrame], Model]:
    """`fit`, whose parameters, seconds and metrics are logged in a run of its own."""

    def run(df: DataFrame) -> Model:
        with inside(tracker, tags or {}) as t:
            t.log_params(params or {})
            began = time.time()
            model = fit(df)
            t.log_params({"fit_seconds": round(time.time() - began, 3)})
            found = metrics(model) if metrics else model.blocks.get(METRICS)
            if found is not None:
                t.log_metrics(found)
            return model

    return run


def sql_metrics(statement: str, block: str = METRICS) -> Callable[[Model], DataFrame | None]:
    """Metrics by a SQL statement over a block, which it names __THIS__."""
    from sparkloom.operators.columns import sql_transform

    return lambda m: sql_transform(m.blocks[block], statement) if block in m.blocks else None
