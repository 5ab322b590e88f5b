"""The application that `fit_in_application` starts: MODULE FUNCTION PATH."""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import SparkSession


def main(module: str, function: str, path: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    try:
        model = getattr(importlib.import_module(module), function)(spark.read.parquet(f"{path}/data"))
        model.save(spark, f"{path}/model")
    finally:
        spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:4])
