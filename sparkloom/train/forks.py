"""Fitting many models at once, from forks of one frame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from sparkloom.models.base import Model, exists

Fit = Callable[[DataFrame], Model]


def fit_forks(forks: Iterable[tuple[str, DataFrame]], fit: Fit, threads: int = 1, path: str | None = None) -> dict[str, Model]:
    """A model for each (key, frame), `threads` fits at a time; Spark runs their jobs side by side.

    The first failure ends it: fits that have not begun are left out, and the exception is raised. path: models are
    saved there as they are done, and those that are there already are read instead of fitted again.
    """

    def one(key: str, df: DataFrame) -> Model:
        spark = df.sparkSession
        place = f"{path.rstrip('/')}/{quote(key, safe='')}" if path else None
        if place and exists(spark, f"{place}/model.json"):
            return Model.load(spark, place)
        model = fit(df)
        if place:
            model.save(spark, place)
        return model

    every = list(forks)
    if threads <= 1:
        return {key: one(key, df) for key, df in every}
    with ThreadPoolExecutor(threads) as pool:
        running = {key: pool.submit(inheritable_thread_target(df.sparkSession)(one), key, df) for key, df in every}
        _, rest = wait(running.values(), return_when=FIRST_EXCEPTION)
        for f in rest:
            f.cancel()
        for f in running.values():
            if f.done() and not f.cancelled() and f.exception():
                raise f.exception()
        return {key: f.result() for key, f in running.items()}


def fit_in_application(df: DataFrame, module: str, function: str, path: str, submit: list[str] | None = None, timeout: float | None = None) -> Model:
    """`function(frame) -> Model` of a module, run by a Spark application of its own.

    The frame is written to `path`/data, the application started by spark-submit (or the command given), and the model
    that it writes to `path`/model read. `path` must be on a file system that both applications see.
    """
    import os
    import subprocess
    import sys

    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    command = submit or [sys.executable]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([p for p in sys.path if p])}
    done = subprocess.run([*command, "-m", "sparkloom.train.application", module, function, path], capture_output=True, text=True, timeout=timeout, env=env)
    if done.returncode:
        raise RuntimeError(f"the application ended with {done.returncode}: {done.stderr[-2000:]}")
    return Model.load(spark, f"{path}/model")
