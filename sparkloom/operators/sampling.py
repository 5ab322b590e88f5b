"""Partitioning, samples and folds; everything random takes a seed and depends on the rows alone where a key is given."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.scalar import fold_of
from sparkloom.functions.vectors import as_array, col, is_vector
from sparkloom.operators.aggregates import group_balance


def repartitioned(df: DataFrame, partitions: int | None = None, by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> DataFrame:
    """`df` in so many partitions and/or by columns, each sorted by others."""
    args = ([partitions] if partitions else []) + [col(c) for c in by]
    out = df.repartition(*args) if args else df
    return out.sortWithinPartitions(*[col(c) for c in sort_by]) if sort_by else out


def partitions_for(df: DataFrame, rows_per_partition: int, least: int = 1, most: int = 100_000) -> int:
    return max(least, min(most, -(-df.count() // rows_per_partition)))


def dynamically_repartitioned(df: DataFrame, rows_per_partition: int, least: int = 1, most: int = 100_000, by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> DataFrame:
    return repartitioned(df, partitions_for(df, rows_per_partition, least, most), by, sort_by)


def _unit(seed: int, key: Sequence[str]) -> Column:
    """A uniform number of [0, 1), by a hash of the key columns, or random without any."""
    if not key:
        return F.rand(seed)
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[col(c) for c in key]), 11).cast("double") / float(1 << 53)


def sample(df: DataFrame, share: float, seed: int = 42, replacement: bool = False, keep_positive: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Each row with probability `share`; all rows from a share of 1 on, unless drawn with replacement.

    keep_positive: rows whose label in that column is 1 all stay. key: the decision depends on these columns alone.
    """
    if replacement:
        return df.sample(True, share, seed)
    if share >= 1:
        return df
    drawn = _unit(seed, key) < share
    return df.where((col(keep_positive) == 1) | drawn) if keep_positive else df.where(drawn)


def downsample(df: DataFrame, expected: int, **how) -> DataFrame:
    """A sample of about so many rows."""
    return sample(df, min(1.0, expected / (df.count() + 1)), **how)


def take_sample(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows, or all if there are fewer."""
    return df.orderBy(_unit(seed, key), *[col(c) for c in key]).limit(n)


def with_folds(df: DataFrame, folds: int, by: Sequence[str] = (), output: str = "foldNum") -> DataFrame:
    """`df` with a fold of 0 .. folds - 1 by a hash of the columns, or of the whole row; with folds <= 0 all are 0."""
    names = list(by) or df.columns
    key = col(names[0]).cast("string") if len(names) == 1 else F.to_json(F.struct(*[col(c) for c in names]))
    return df.withColumn(output, fold_of(key, folds))


def fold_count(df: DataFrame, fold_col: str = "foldNum") -> int:
    """How many folds a frame that has them holds: the greatest and one, as they count from 0."""
    last = df.agg(F.max(col(fold_col)).alias("m")).first()["m"]
    return 0 if last is None else int(last) + 1


def sample_pairs(df: DataFrame, keys: Sequence[str], features: str, label: str, group_rate: float = 1.0, item_rate: float = 1.0, ranking_power: float = 0.0, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """A sample for combined regression and ranking: (keys, features, label).

    Groups stay with probability `group_rate`, their rows with `item_rate`. A row that stays is, with probability
    `ranking_power`, replaced by the difference of its features and those of a random row of the other class in its
    group, its label kept (1 or 0). Groups without both classes go. A group is one worker's at a time.
    """
    import zlib

    import numpy as np
    import pyarrow as pa

    rows = df.select(*[col(k) for k in keys], as_array(df, features).alias("__x"), col(label).cast("double").alias("__y")).where("__x is not null and __y is not null")
    rows = rows.where(_unit(seed, keys) < group_rate) if group_rate < 1 else rows
    schema = StructType([*rows.select(*[col(k) for k in keys]).schema.fields, *StructType.fromDDL("__x array<double>, __y double").fields])

    def draw(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.array([zlib.crc32(np.array(x).tobytes()) for x in table["__x"].to_pylist()]), table["__y"].to_numpy()))
        table = table.take(pa.array(order))
        y = table["__y"].to_numpy() >= threshold
        mixed = y.any() and not y.all()
        x = np.array(table["__x"].to_pylist(), dtype=float)
        rng = np.random.default_rng([seed, len(y), int(y.sum()), zlib.crc32(x.tobytes())])
        kept = np.flatnonzero((rng.random(len(y)) < item_rate) & mixed)
        paired = rng.random(len(kept)) < ranking_power
        out = x[kept]
        for i in np.flatnonzero(paired):
            others = np.flatnonzero(y != y[kept[i]])
            out[i] -= x[others[rng.integers(len(others))]]
        picked = table.take(pa.array(kept))
        return picked.set_column(picked.column_names.index("__x"), "__x", pa.array(out.tolist(), pa.list_(pa.float64())))

    sampled = rows.groupBy(*[col(k) for k in keys]).applyInArrow(draw, schema)
    from pyspark.ml.functions import array_to_vector

    x = array_to_vector(F.col("__x")) if is_vector(df.schema[features]) else F.col("__x")
    return sampled.select(*[col(k) for k in keys], x.alias(features), F.col("__y").alias(label))


def item_rate_for(df: DataFrame, keys: Sequence[str], label: str, expected: int, group_rate: float = 1.0) -> float:
    """The share of rows of groups with both classes that gives about so many."""
    b = group_balance(df, keys, label).first()
    usable = b["positives"] + b["negatives"]
    return min(1.0, expected / (usable * group_rate)) if usable else 1.0


def sorted_groups(df: DataFrame, keys: Sequence[str], sort_by: Sequence[str], function, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """function(key values, pandas rows in order) -> rows, for each run of a key in partitions sorted by key."""
    import pandas as pd

    ready = repartitioned(df, partitions, keys, [*keys, *sort_by])
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            same = frame[names].eq(frame[names].iloc[-1]) | (frame[names].isna() & frame[names].iloc[-1].isna())
            rest = frame[same.all(axis=1)]
            done = frame[~same.all(axis=1)]
            for key, own in done.groupby(names, sort=False, dropna=False):
                yield function(key, own.reset_index(drop=True))
        if rest is not None and len(rest):
            yield function(tuple(rest[names].iloc[0]), rest.reset_index(drop=True))

    return ready.mapInPandas(run, schema)


