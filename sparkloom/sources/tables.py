"""Reading and writing tables: Parquet first, other formats by Spark's own readers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.models.base import delete

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str | Sequence[str], kind: str = "parquet", schema: str | None = None, base_path: str | None = None, **options: Any) -> DataFrame:
    """A table of any of Spark's formats. base_path: folders below it are partition columns, also for chosen folders."""
    reader = spark.read.format(kind).options(**options)
    if base_path:
        reader = reader.option("basePath", base_path)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path if isinstance(path, str) else list(path))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: Any) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def single_file(df: DataFrame, path: str) -> DataFrame:
    """A small (summary) frame as one Parquet file, read again."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that setting is unset, one process may use a temporary folder, as in tests; a cluster may not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


@contextmanager
def persisted_to_temp(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """`df` as a Parquet table while the block runs; the table is deleted after it, whatever happens."""
    spark = df.sparkSession
    place = f"{path.rstrip('/')}/{uuid.uuid4().hex}" if path else shared_folder(spark)
    try:
        write(df, place, partition_by=partition_by)
        yield spark.read.parquet(place)
    finally:
        delete(spark, place)


def prior_configurations(spark: SparkSession, path: str, condition: str | None = None, most: int = 20, seed: int = 42) -> DataFrame:
    """At most so many rows, drawn at random, of the configurations that earlier searches have left."""
    df = spark.read.parquet(path)
    df = df.where(condition) if condition else df
    return df.orderBy(F.rand(seed)).limit(most)
