"""Train-only stages: what a frame goes through before a fit, and the model doesn't.

A fit is any function frame -> Model. Each wrapper here gives another such function; whatever it holds on to while
the inner one runs (a cache, a temporary table) is released when that ends, also when it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from sparkloom.models.base import METRICS, Model, PipelineModel, collected
from sparkloom.operators.columns import project, train_rows
from sparkloom.operators.sampling import downsample, dynamically_repartitioned, repartitioned, sample
from sparkloom.sources.tables import persisted_to_temp, single_file

Fit = Callable[[DataFrame], Model]
Change = Callable[[DataFrame], DataFrame]


def train_only(fit: Fit, change: Change, undo: Callable[[Model], Model] | None = None, release: Callable[[DataFrame], None] | None = None) -> Fit:
    """`fit` on a changed frame. undo: makes the model fit the unchanged one. release: runs in any case at the end."""

    def run(df: DataFrame) -> Model:
        changed = change(df)
        try:
            model = fit(changed)
            return undo(model) if undo else model
        finally:
            if release:
                release(changed)

    return run


def model_only(change: Callable[[Model], Model], fit: Fit) -> Fit:
    """`fit`, whose model is then changed."""
    return lambda df: change(fit(df))


def with_training(fit: Fit, fit_change: Callable[[DataFrame], Model]) -> Fit:
    """`fit` on a frame changed by a model fitted on it, which the result doesn't have."""
    return lambda df: fit(fit_change(df).transform(df))


def cached(fit: Fit, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER, materialise: bool = False) -> Fit:
    def change(df: DataFrame) -> DataFrame:
        kept = df.persist(level)
        if materialise:
            kept.count()
        return kept

    return train_only(fit, change, release=lambda df: df.unpersist() and None)


def uncached(fit: Fit) -> Fit:
    """`fit` on a frame whose cache is dropped first."""
    return train_only(fit, lambda df: df.unpersist())


def through_parquet(fit: Fit, path: str | None = None, partition_by: Sequence[str] = (), uncache_input: bool = False) -> Fit:
    """`fit` on a frame written to Parquet and read again; the table is deleted at the end."""

    def run(df: DataFrame) -> Model:
        with persisted_to_temp(df, path, partition_by) as back:
            if uncache_input:
                df.unpersist()
            return fit(back)

    return run


def in_partitions(fit: Fit, partitions: int | None = None, by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> Fit:
    return train_only(fit, lambda df: repartitioned(df, partitions, by, sort_by))


def in_dynamic_partitions(fit: Fit, rows_per_partition: int, **how) -> Fit:
    return train_only(fit, lambda df: dynamically_repartitioned(df, rows_per_partition, **how))


def projected(fit: Fit, keep: Sequence[str] | None = None, remove: Sequence[str] | None = None) -> Fit:
    return train_only(fit, lambda df: project(df, keep, remove))


def sampled(fit: Fit, share: float | None = None, expected: int | None = None, **how) -> Fit:
    return train_only(fit, lambda df: downsample(df, expected, **how) if share is None else sample(df, share, **how))


def on_train_rows(fit: Fit, test_col: str = "isTest") -> Fit:
    return train_only(fit, lambda df: train_rows(df, test_col))


def with_collected_summary(fit: Fit) -> Fit:
    """Blocks become rows on the driver, independent of the training frame."""
    return model_only(lambda m: m.copy({n: collected(b) for n, b in m.blocks.items()}), fit)


def with_saved_summary(fit: Fit, path: str) -> Fit:
    """Blocks become single Parquet files at `path`/block=<name>."""
    return model_only(lambda m: m.copy({n: single_file(b, f"{path}/block={n}") for n, b in m.blocks.items()}), fit)


def evaluated(fit: Fit, evaluate: Callable[[DataFrame], DataFrame], block: str = METRICS) -> Fit:
    """`fit`, with a block of metrics of the model's predictions for the whole frame."""

    def run(df: DataFrame) -> Model:
        model = fit(df)
        return model.with_block(block, evaluate(model.transform(df)))

    return run


def pipeline(*fits: Fit) -> Fit:
    """Fits one after another, each on what the models before it give."""

    def run(df: DataFrame) -> Model:
        models = []
        for fit in fits:
            models.append(fit(df))
            df = models[-1].transform(df)
        return PipelineModel.of(models)

    return run
