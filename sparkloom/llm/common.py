"""What the operators of this subpackage share: row packing, text hashes and written intermediates."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

_written: dict[str, SparkSession] = {}
_paths: dict[int, str] = {}


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """Every row as one struct `row`, beside the given keys; no column of `df` can clash with a later one."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def text_hash(text: Column) -> list[Column]:
    """128 bits of a text, as two bigint columns h1 and h2."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7919), text, F.length(text)).alias("h2")]


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id bigint, text) of the rows that have both, and (name, id) if the ids of `df` aren't integers.

    Those are numbered in their order.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).alias("text")).where("id is not null and text is not null")
    if isinstance(rows.schema["id"].dataType, IntegralType):
        return rows.withColumn("id", F.col("id").cast("bigint")), None
    ordered = rows.select(F.col("id").alias("name")).distinct().sort("name")
    names = written(ordered.select("name", F.monotonically_increasing_id().alias("id")))
    return rows.withColumnRenamed("id", "name").join(names, "name").select("id", "text"), names


def named(out: DataFrame, names: DataFrame | None) -> DataFrame:
    """`out` (id, class_id, ...) with the names that `keyed` numbered."""
    if names is None:
        return out
    classes = names.select(F.col("name").alias("class_name"), F.col("id").alias("class_id"))
    full = out.join(names, "id").join(classes, "class_id")
    return full.select(F.col("name").alias("id"), F.col("class_name").alias("class_id"), *[c for c in out.columns if c not in ("id", "class_id")])


def _remove() -> None:
    for path, spark in _written.items():
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder then stays for the cluster's own cleaning
            pass
    _written.clear()


atexit.register(_remove)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the one that all executors share.

    Where that setting is unset, one process may use a temporary folder, as in tests; a cluster may not.
    It is deleted when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"on {master}, set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        _written[root] = spark
    path = f"{root.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[id(back)] = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete what `written` wrote, when nothing will read it any more."""
    path = _paths.pop(id(df), None)
    spark = _written.pop(path, None)
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)
