"""Joins: by any condition, and with keys that must be unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import col
from sparkloom.operators.pieces import MOST_TASKS, group_pieces, piece_of, task_count, with_pieces

KINDS = ("inner", "outer", "left_outer", "right_outer", "leftsemi")


def join(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of two frames by a condition of any kind (Column or SQL text) or by columns of one name.

    Null keys of an equality match nothing. Of the kinds, outer ones fill the missing side with nulls.
    """
    if how not in KINDS:
        raise ValueError(f"how: one of {', '.join(KINDS)}")
    if isinstance(on, str) and on not in left.columns:
        on = F.expr(on)
    return left.join(right, on, how)


#: Rows of one key that a task joins with all rows of that key on the other side.
PIECE = 1000


def join_large_groups(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], condition: str = "true", how: str = "inner", left_where: str = "true", right_where: str = "true", piece: int = PIECE) -> DataFrame:
    """`join` on equal keys (left, right) and a condition in SQL, where few keys have many rows on both sides.

    The rows of a key on one side are cut into pieces of about so many rows, and the other side's rows of large keys
    are copied to each piece; pieces are counted first. That is the side whose rows without a partner are kept, else the
    left one. left_where, right_where: conditions of one side alone; rows that don't meet them match nothing. No name
    may be on both sides.
    """
    if how not in KINDS:
        raise ValueError(f"how: one of {', '.join(KINDS)}")
    if set(left.columns) & set(right.columns):
        raise ValueError(f"names on both sides: {sorted(set(left.columns) & set(right.columns))}")
    names = [*left.columns, *right.columns]
    back = [(b, a) for a, b in keys]
    if how == "right_outer":
        return _in_pieces(right, left, back, condition, "left_outer", right_where, left_where, piece).select(*map(col, names))
    matched = _in_pieces(left, right, keys, condition, "left_outer" if how == "outer" else how, left_where, right_where, piece)
    if how != "outer":
        return matched
    alone = _in_pieces(right, left, back, condition, "leftanti", right_where, left_where, piece)
    kinds = left.schema
    return matched.unionByName(alone.select(*[F.lit(None).cast(kinds[c].dataType).alias(c) for c in left.columns], *map(col, right.columns)))


def _in_pieces(cut: DataFrame, copied: DataFrame, keys: Sequence[tuple[str, str]], condition: str, how: str, cut_where: str, copied_where: str, piece: int) -> DataFrame:
    own, other = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(keys))]
    rows = cut.withColumns({k: F.when(F.expr(cut_where), col(a)) for k, (a, _) in zip(own, keys)})
    large, pieces, _ = group_pieces(rows.select(*own), own, piece)
    keyless = F.lit(False)
    for k in own:
        keyless = keyless | F.col(k).isNull()
    whole = [col(c) for c in cut.columns]
    rows = with_pieces(rows, large, own).withColumn("__p", F.when(keyless, piece_of(whole, MOST_TASKS)).otherwise(piece_of(whole, F.col("__pieces"))))
    copies = copied.where(copied_where).withColumns({k: col(b) for k, (_, b) in zip(own, keys)}).where(" and ".join(f"{k} is not null" for k in own))
    copies = with_pieces(copies, large, own).withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
    copies = copies.select(*[F.col(k).alias(o) for k, o in zip(own, other)], "__q", *map(col, copied.columns))
    n = task_count(cut, pieces)
    on = (F.col("__p") == F.col("__q")) & F.expr(condition)
    for k, o in zip(own, other):
        on = on & (F.col(k) == F.col(o))
    joined = rows.repartition(n, *own, "__p").join(copies.repartition(n, *other, "__q"), on, how)
    return joined.select(*whole, *(map(col, copied.columns) if how in ("inner", "left_outer") else ()))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, which raises when run if a key repeats. Null keys count as one key.

    The check is an aggregation on the keys; a join on them reuses its partitioning.
    """
    row = F.struct(*[col(c) for c in df.columns])
    once = df.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.first(row).alias("__row"), F.count("*").alias("__n"))
    repeated = F.raise_error(F.concat(F.lit("a key repeats: "), F.to_json(F.struct(*[F.col(f"__k{i}") for i in range(len(keys))])))).cast(df.select(row.alias("r")).schema["r"].dataType)
    return once.select(F.when(F.col("__n") == 1, F.col("__row")).otherwise(repeated).alias("__row")).select("__row.*")


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; a key that repeats on either side raises, even one without a partner."""
    return _unique(left, right, keys, "inner")


def left_join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join; a key that repeats on either side raises. Keys of the right side alone have no row."""
    return _unique(left, right, keys, "left_outer")


def _unique(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), list(keys), how)


def distribute(data: DataFrame, mapping: DataFrame, key: str, destination: str) -> DataFrame:
    """(destination, the columns of data) for every distinct pair of a key and a destination.

    A key with several rows in `data` raises. Keys without a destination, and destinations of unknown keys, have no row.
    """
    pairs = mapping.select(col(key), col(destination)).distinct()
    return assert_unique(data, [key]).join(pairs, key).select(col(destination), *[col(c) for c in data.columns])


def union_all(*frames: DataFrame, by_name: bool = False) -> DataFrame:
    """All rows of all frames: by position, or by name with nulls for columns that a frame lacks."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True) if by_name else out.union(df)
    return out
