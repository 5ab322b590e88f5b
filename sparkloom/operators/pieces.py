"""Large groups of equal keys in pieces, so that the work on one group is many tasks'."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TASKS = 20_000


def group_pieces(df: DataFrame, keys: Sequence[str], rows: int) -> tuple[DataFrame, int, int]:
    """((keys, __pieces) of the groups of more than so many rows; how many pieces, and pairs of pieces, all groups have).

    Runs one count. The frame has a row for so many rows of `df` at most. Null keys are no group.
    """
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    counts = known.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("__pieces"))
    n = F.col("__pieces").cast("bigint")
    found = counts.agg(F.sum(n), F.sum(n * (n + 1) / 2)).first()
    return counts.where("__pieces > 1"), int(found[0] or 0), int(found[1] or 0)


def with_pieces(df: DataFrame, large: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with __pieces, the number of pieces of each row's group."""
    return df.join(F.broadcast(large), list(keys), "left").withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))


def piece_of(row: Sequence[Column], pieces: Column | int) -> Column:
    """A piece by the hash of a row, so that a task that runs again gives each row the same one."""
    return F.pmod(F.xxhash64(*row), F.lit(pieces) if isinstance(pieces, int) else pieces).cast("int")


def task_count(df: DataFrame, units: int) -> int:
    """Partitions for so many units of work: a few units of chance in each, and not fewer than the session has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * units, MOST_TASKS))


def partitions_for(df: DataFrame, megabytes: int = 4) -> int:
    """So many partitions that each has about so many MB of the files that `df` reads, by Spark's own sizes of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(MOST_TASKS, -(-size // (megabytes << 20)))


def spread(df: DataFrame, keys: Sequence[Column], megabytes: int = 4) -> DataFrame:
    """`df` on a hash of the keys in partitions that don't grow with it; as it is where the session's number does for that."""
    n = partitions_for(df, megabytes)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
