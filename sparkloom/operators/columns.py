"""Projections, filters, defaults and vector assembly: frames in, frames out, all of them column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType

from sparkloom.functions.vectors import INTERCEPT, as_array, attribute_metadata, attribute_names, col, is_vector, vector_size


def chosen_columns(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> list[str]:
    """All columns, the included ones, or all but the excluded ones; naming both raises."""
    if include and exclude:
        raise ValueError("give either columns to include or columns to exclude")
    if include:
        return [c for c in df.columns if c in set(include)]
    return [c for c in df.columns if c not in set(exclude or ())]


def extract(df: DataFrame, *names: str, expressions: Mapping[str, str] | None = None, metadata: Mapping[str, dict] | None = None, keep_inputs: bool = False) -> DataFrame:
    """Named columns and SQL expressions, in the order given.

    With `keep_inputs`, the input columns come first, without those that are defined anew. An expression that
    is just an input column keeps that column's metadata unless others are given.
    """
    wanted = {n: "`" + n.replace("`", "``") + "`" for n in names} | dict(expressions or {})
    fields, out = {f.name: f for f in df.schema.fields}, []
    if keep_inputs:
        out = [col(c) for c in df.columns if c not in wanted]
    for name, text in wanted.items():
        meta = (metadata or {}).get(name)
        source = fields.get(text.strip("`")) if meta is None else None
        if source is not None:
            meta = source.metadata
        out.append(F.expr(text).alias(name, metadata=meta) if meta else F.expr(text).alias(name))
    return df.select(*out)


def where(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a SQL condition is true; false and null ones go."""
    return df.where(condition)


def project(df: DataFrame, keep: Sequence[str] | None = None, remove: Sequence[str] | None = None) -> DataFrame:
    """Only the columns to keep, in the frame's order, else all but those to remove; `keep` wins over `remove`."""
    if keep:
        return df.select(*[col(c) for c in df.columns if c in set(keep)])
    return df.select(*[col(c) for c in df.columns if c not in set(remove or ())])


def train_rows(df: DataFrame, test_col: str = "isTest") -> DataFrame:
    """Rows whose test flag is false; null flags go."""
    return df.where(~col(test_col))


def with_metadata(df: DataFrame, name: str, names: Sequence[str]) -> DataFrame:
    """`df` with attribute names on a vector column."""
    return df.withMetadata(name, {**(df.schema[name].metadata or {}), **attribute_metadata(names)})


def null_to_default(df: DataFrame, defaults: Mapping[str, object] | None = None, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """Nulls of boolean and numeric columns become false and 0, or the given default cast to the column's type.

    Null vectors become zeros of the column's size. Columns that cannot be null, and other types, stay as they are.
    """
    chosen, given, out = set(chosen_columns(df, include, exclude)), dict(defaults or {}), []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in chosen and f.nullable:
            if isinstance(f.dataType, BooleanType | NumericType):
                default = given.get(f.name, "false" if isinstance(f.dataType, BooleanType) else "0")
                c = F.coalesce(c, F.lit(str(default)).cast(f.dataType)).alias(f.name, metadata=f.metadata or {})
            elif is_vector(f):
                zeros = array_to_vector(F.array_repeat(F.lit(0.0), vector_size(df, f.name)))
                c = F.coalesce(c, zeros).alias(f.name, metadata=f.metadata or {})
        out.append(c)
    return df.select(*out)


def assemble_array(df: DataFrame, columns: Sequence[str]) -> tuple[Column, list[str]]:
    """(array<double>, attribute names) of numeric, boolean and vector columns; nulls are NaN."""
    parts, names = [], []
    for name in columns:
        f = df.schema[name]
        if isinstance(f.dataType, NumericType | BooleanType):
            parts.append(F.array(F.coalesce(col(name).cast("double"), F.lit(float("nan")))))
            names.append(name)
        elif is_vector(f) or (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType)):
            own = attribute_names(f)
            size = len(own) if own is not None else vector_size(df, name)
            nan = F.lit(float("nan"))
            values = F.coalesce(F.transform(as_array(df, name), lambda x: F.coalesce(x, nan)), F.array_repeat(nan, size))
            wrong = F.raise_error(F.concat(F.lit(f"{name}: a vector of another size than {size}: "), F.size(values).cast("string"))).cast("array<double>")
            parts.append(F.when(F.size(values) == size, values).otherwise(wrong))
            names += [f"{name}_{a}" for a in (own if own is not None else range(size))]
        else:
            raise TypeError(f"{name}: {f.dataType.simpleString()} can't be assembled")
    return (F.concat(*parts) if parts else F.array().cast("array<double>")), names


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features", as_ml_vector: bool = True) -> DataFrame:
    """`df` with a vector of the columns, its attribute names in the metadata; nulls become NaN."""
    values, names = assemble_array(df, columns)
    return df.withColumn(output, array_to_vector(values) if as_ml_vector else values).withMetadata(output, attribute_metadata(names))


def names_of_indices(df: DataFrame, index_col: str, names: Sequence[str], output: str) -> DataFrame:
    """`df` with the attribute name of an index; an index out of range gives its number, null gives null."""
    i = col(index_col).cast("int")
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return df.withColumn(output, F.when(i.isNotNull(), F.coalesce(F.get(known, i), i.cast("string"))))


def explode_vectors(df: DataFrame, value_col: str = "value", columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each attribute of a row's vectors: the other columns, the attribute's name, and each vector's entry.

    Only entries that a vector holds count (of sparse ones those stored); an absent, null or NaN entry is null, and
    a name that no vector of the row holds has no row. Vectors share a name where their metadata do; nameless
    attributes are `<column>_<index>`.
    """
    vectors = list(columns or [f.name for f in df.schema.fields if is_vector(f)])
    named = {v: attribute_names(df.schema[v]) for v in vectors}
    named = {v: n if n is not None else [f"{v}_{i}" for i in range(vector_size(df, v))] for v, n in named.items()}
    every = list(dict.fromkeys(n for names in named.values() for n in names))
    others = [c for c in df.columns if c not in vectors]
    if not every:
        return df.where("false").select(*[col(c) for c in others], F.lit("").alias(value_col), *[F.lit(0.0).alias(v) for v in vectors])

    def held(v: str) -> Column:
        if not is_vector(df.schema[v]):
            a = as_array(df, v)
            return F.when(F.size(a) > 0, F.map_from_arrays(F.sequence(F.lit(0), F.size(a) - 1), a))
        raw = F.unwrap_udt(col(v))
        dense = F.when(F.size(raw["values"]) > 0, F.map_from_arrays(F.sequence(F.lit(0), F.size(raw["values"]) - 1), raw["values"]))
        return F.when(raw["type"] == 0, F.map_from_arrays(raw["indices"], raw["values"])).otherwise(dense)

    # the maps are columns of their own, so that each is built once for a row
    maps = df.select(*[col(c) for c in others], *[held(v).alias(f"__held_{i}") for i, v in enumerate(vectors)])
    labels = F.array(*[F.lit(n) for n in every])
    at = {v: F.array(*[F.lit(named[v].index(n) if n in named[v] else -1) for n in every]) for v in vectors}

    def entry(i: Column) -> Column:
        values = [F.nanvl(F.try_element_at(F.col(f"__held_{n}"), F.get(at[v], i)), F.lit(None).cast("double")).alias(f"__v_{n}") for n, v in enumerate(vectors)]
        return F.struct(F.get(labels, i).alias("__name"), *values)

    rows = maps.select(*[col(c) for c in others], F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(every) - 1)), entry)).alias("__e"))
    some = F.coalesce(*[F.col(f"__e.__v_{n}") for n in range(len(vectors))]).isNotNull()
    # a held NaN is a row with null, an entry that isn't held is none
    kept = rows if len(vectors) == 0 else rows.where(some)
    return kept.select(*[col(c) for c in others], F.col("__e.__name").alias(value_col), *[F.col(f"__e.__v_{n}").alias(v) for n, v in enumerate(vectors)])


def append_intercept(df: DataFrame, features_col: str = "features") -> DataFrame:
    """`df` with a last entry of 1.0 on its vector, named `#intercept`."""
    field = df.schema[features_col]
    longer = F.array_append(as_array(df, features_col), F.lit(1.0))
    out = df.withColumn(features_col, array_to_vector(longer) if is_vector(field) else longer)
    names = attribute_names(field)
    return out if names is None else out.withMetadata(features_col, attribute_metadata([*names, INTERCEPT]))


def select_features(df: DataFrame, features_col: str, indices: Sequence[int]) -> DataFrame:
    """`df` with only those entries of its vector, and their names."""
    field = df.schema[features_col]
    kept = F.transform(F.array(*[F.lit(i) for i in indices]) if len(indices) else F.array().cast("array<int>"), lambda i: F.get(as_array(df, features_col), i))
    out = df.withColumn(features_col, array_to_vector(kept) if is_vector(field) else kept)
    names = attribute_names(field)
    return out if names is None else out.withMetadata(features_col, attribute_metadata([names[i] for i in indices]))


def sql_transform(df: DataFrame, statement: str) -> DataFrame:
    """A SQL statement over the frame, which it names __THIS__."""
    from pyspark.ml.feature import SQLTransformer

    return SQLTransformer(statement=statement).transform(df)


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)


def nominal_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that hold a string or an array of strings."""
    kinds = {c: df.schema[c].dataType for c in columns}
    return [c for c, t in kinds.items() if isinstance(t, StringType) or (isinstance(t, ArrayType) and isinstance(t.elementType, StringType))]
