"""Locality-sensitive hashes and de-duplication within their buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import as_array, col, projection_hash, projection_matrix
from sparkloom.operators.pieces import group_pieces, piece_of, task_count, with_pieces


def with_projection_hash(df: DataFrame, vector: str, dimension: int, bits: int = 18, density: float = 0.5, seed: int = 42, output: str = "hash") -> DataFrame:
    """`df` with a bigint of sign bits of random projections. Short vectors stay in the JVM, long ones go by Arrow batches."""
    matrix = projection_matrix(dimension, bits, density, seed)
    if dimension * bits <= 4096:
        return df.withColumn(output, projection_hash(as_array(df, vector), matrix))
    rows = np.array(matrix, dtype=np.float64)

    @F.pandas_udf("bigint")
    def run(vectors: pd.Series) -> pd.Series:
        sides = [None if v is None else int(((rows[:, : len(v)] @ np.nan_to_num(np.asarray(v, dtype=float)) > 0) * (1 << np.arange(bits))).sum()) for v in vectors]
        return pd.Series(sides, dtype="Int64")

    return df.withColumn(output, run(as_array(df, vector)))


#: Vectors of a bucket that a task compares with as many others, and rows of its products at a time.
BLOCK, SLAB = 8192, 256


def similar_pairs(df: DataFrame, id_col: str, vector: str, bucket: str, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity), a < b: pairs of one bucket whose cosine similarity reaches the threshold.

    All pairs of a bucket are compared, by products of blocks of vectors: a bucket is cut into pieces of about `block`
    rows, and two pieces are one task's, which holds them and a slab of their products. The pieces are counted first.
    """
    rows = df.select(col(bucket).alias("__h"), col(id_col).alias("__id"), as_array(df, vector).alias("__v")).where("__h is not null and __id is not null and __v is not null")
    large, _, pairs = group_pieces(rows.select("__h"), ["__h"], block)
    rows = with_pieces(rows, large, ["__h"]).withColumn("__q", piece_of([F.col("__id")], F.col("__pieces")))
    other = rows.withColumn("__r", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
    tasks = other.select("__h", F.least("__q", "__r").alias("__i"), F.greatest("__q", "__r").alias("__j"), "__q", "__id", "__v")
    tasks = tasks.repartition(task_count(df, pairs), "__h", "__i", "__j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        first = np.flatnonzero(table["__q"].to_numpy() == table["__i"][0].as_py())
        second = np.flatnonzero(table["__q"].to_numpy() == table["__j"][0].as_py())
        x, there = _matrix(table["__v"].combine_chunks())
        ids, alone = table["__id"].combine_chunks(), table["__i"][0].as_py() == table["__j"][0].as_py()
        for lo in range(0, len(first), SLAB):
            own = first[lo : lo + SLAB]
            with np.errstate(all="ignore"):
                at, to, similarity = _close(x, there, own, second, threshold)
            if alone:
                later = lo + at < to
                at, to, similarity = at[later], to[later], similarity[later]
            if len(at):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[at])), ids.take(pa.array(second[to])), pa.array(similarity)], ["x", "y", "similarity"])

    kind = rows.schema["__id"].dataType.simpleString()
    found = tasks.groupBy("__h", "__i", "__j").applyInArrow(compare, f"x {kind}, y {kind}, similarity double")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of a matrix, and where its entries are numbers, if some aren't: nulls, and what shorter rows lack, are 0."""
    ends = np.asarray(vectors.offsets.to_numpy(), dtype=np.int64)
    sizes = np.diff(ends)
    values = vectors.values.slice(ends[0], ends[-1] - ends[0])
    width = int(sizes.max(initial=0))
    if not values.null_count and (sizes == width).all():
        return values.to_numpy().reshape(len(sizes), width), None
    x, there = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), dtype=bool)
    inside = np.arange(width) < sizes[:, None]
    there[inside] = values.is_valid().to_numpy(zero_copy_only=False)
    x[inside] = np.where(there[inside], values.fill_null(0.0).to_numpy(), 0.0)
    return x, there


def _close(x: np.ndarray, there: np.ndarray | None, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in `first`, places in `second`, cosines) that reach the threshold; as in Spark's order, NaN does.

    Cosines next to the threshold are summed again entry by entry, as `cosine` does it.
    """
    a, b = x[first], x[second]
    products = a @ b.T
    if there is not None and not np.isfinite(x).all():  # a number that isn't finite times a missing one is missing
        for i in np.flatnonzero(~np.isfinite(a).all(axis=1)):
            products[i] = np.where(there[first[i]] & there[second], a[i] * b, 0.0).sum(axis=1)
        for j in np.flatnonzero(~np.isfinite(b).all(axis=1)):
            products[:, j] = np.where(there[first] & there[second[j]], a * b[j], 0.0).sum(axis=1)
    norms = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
    cosines = products / norms
    at, to = np.nonzero(~(norms <= 0) & ~(cosines < threshold - 1e-9))
    found = cosines[at, to]
    for n in np.flatnonzero(np.abs(found - threshold) <= 1e-9):
        u, v = a[at[n]], b[to[n]]
        found[n] = np.add.accumulate(u * v)[-1] / (np.sqrt(np.add.accumulate(u * u)[-1]) * np.sqrt(np.add.accumulate(v * v)[-1]))
    keep = ~(found < threshold)
    return at[keep], to[keep], found[keep]


def greedy_dedup(df: DataFrame, order: str | Column, vector: str, bucket: str, threshold: float = 0.9) -> DataFrame:
    """The rows of each bucket, by `order`, whose cosine similarity to every row kept before is under the threshold.

    A zero vector is similar to nothing; rows with a null vector are kept, those of a null bucket are one bucket.
    A bucket is one task's; widen the hash where buckets are large.
    """
    row = F.struct(*[col(c) for c in df.columns])
    rows = df.select(row.alias("row"), col(bucket).alias("__h"), (col(order) if isinstance(order, str) else order).alias("__o"), as_array(df, vector).alias("__v"))

    def keep(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("__o", "ascending")]))
        kept, matrix, size = [], None, 0
        for i, v in enumerate(table["__v"].to_pylist()):
            if v is None:
                kept.append(i)
                continue
            x = np.array([np.nan if e is None else e for e in v], dtype=float)
            n = np.linalg.norm(x)
            x = x / n if n > 0 else x * 0
            if matrix is None:
                matrix = np.zeros((16, len(x)))
            if size and (matrix[:size] @ x >= threshold).any():
                continue
            if size == len(matrix):
                matrix = np.concatenate((matrix, np.zeros_like(matrix)))
            matrix[size] = x
            size += 1
            kept.append(i)
        return table.select(["row"]).take(pa.array(kept, pa.int64()))

    return rows.groupBy("__h").applyInArrow(keep, rows.select("row").schema).select("row.*")
