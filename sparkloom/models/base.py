"""Models: parameters, summary blocks (named frames) and nested models, saved as JSON and Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the blocks that the learners here attach.
WEIGHTS, METRICS, SIGNIFICANCE, LOSS, CONFIGURATIONS, TREES = "weights", "metrics", "featuresSignificance", "lossHistory", "configurations", "rawTrees"

_kinds: dict[str, type[Model]] = {}


class Model:
    """What `fit` returns: `transform` scores a frame, `blocks` are the frames that sum the fit up."""

    def __init__(self, params: Mapping[str, Any] | None = None, blocks: Mapping[str, DataFrame] | None = None, nested: Mapping[str, Model] | None = None):
        self.params, self.blocks, self.nested = dict(params or {}), dict(blocks or {}), dict(nested or {})

    def __init_subclass__(cls, **how):
        super().__init_subclass__(**how)
        _kinds[cls.__name__] = cls

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def copy(self, blocks: Mapping[str, DataFrame] | None = None, **params: Any) -> Model:
        return type(self)(self.params | params, self.blocks if blocks is None else blocks, self.nested)

    def map_blocks(self, changes: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Model:
        """The model with some blocks changed, others as they are."""
        return self.copy({n: changes[n](b) if n in changes else b for n, b in self.blocks.items()})

    def with_block(self, name: str, block: DataFrame) -> Model:
        return self.copy({**self.blocks, name: block})

    def save(self, spark: SparkSession, path: str) -> None:
        """`path`/model.json, a Parquet folder for each block, and a folder for each nested model."""
        header = {"kind": type(self).__name__, "params": self.params, "blocks": sorted(self.blocks), "nested": sorted(self.nested)}
        write_text(spark, f"{path}/model.json", json.dumps(header))
        for name, block in self.blocks.items():
            block.write.mode("overwrite").parquet(f"{path}/block={name}")
        for name, model in self.nested.items():
            model.save(spark, f"{path}/model={name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        header = json.loads(read_text(spark, f"{path}/model.json"))
        blocks = {n: spark.read.parquet(f"{path}/block={n}") for n in header["blocks"]}
        nested = {n: Model.load(spark, f"{path}/model={n}") for n in header["nested"]}
        return _kinds[header["kind"]](header["params"], blocks, nested)


_kinds["Model"] = Model


class PipelineModel(Model):
    """Models applied one after another."""

    @staticmethod
    def of(models: Iterable[Model]) -> PipelineModel:
        return PipelineModel(nested={f"{i:03d}": m for i, m in enumerate(models)})

    @property
    def stages(self) -> list[Model]:
        return [self.nested[k] for k in sorted(self.nested)]

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self.stages:
            df = m.transform(df)
        return df


def extract_summary(models: Iterable[Model], column: str = "stageId") -> dict[str, DataFrame]:
    """The blocks of several models, those of a name united by name, with the model's number."""
    return union_blocks(((str(i), m) for i, m in enumerate(models)), column)


def union_blocks(models: Iterable[tuple[Any, Model]], column: str) -> dict[str, DataFrame]:
    """The blocks of keyed models, those of a name united by name, with the key."""
    out: dict[str, DataFrame] = {}
    for key, m in models:
        for name, block in m.blocks.items():
            own = block.withColumn(column, F.lit(key))
            out[name] = out[name].unionByName(own, allowMissingColumns=True) if name in out else own
    return out


def collected(df: DataFrame) -> DataFrame:
    """A summary frame as rows on the driver, in one partition; it no longer depends on its sources."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)
