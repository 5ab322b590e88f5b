"""Vectors as columns: attribute names in metadata, and arithmetic on `array<double>` inside Catalyst.

A vector column is either an `array<double>` or an ML vector; `as_array` gives the former for both. Attribute
names are kept where Spark's own feature stages keep them, in the `ml_attr` entry of the column's metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructField

INTERCEPT = "#intercept"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_vector(field: StructField) -> bool:
    return isinstance(field.dataType, VectorUDT)


def is_numeric_array(field: StructField) -> bool:
    return isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, NumericType)


def as_array(df: DataFrame, name: str) -> Column:
    """`array<double>` of a vector or numeric array column; null stays null."""
    field = df.schema[name]
    return vector_to_array(col(name)) if is_vector(field) else col(name).cast("array<double>")


def as_vector(array: Column) -> Column:
    return array_to_vector(array)


def attribute_metadata(names: Sequence[str]) -> dict:
    return {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}}


def attribute_names(field: StructField) -> list[str] | None:
    """The names in a column's metadata, None where there are none; nameless attributes are `<column>_<index>`."""
    meta = (field.metadata or {}).get("ml_attr")
    if not meta:
        return None
    size = int(meta.get("num_attrs", 0))
    found = [a for group in (meta.get("attrs") or {}).values() for a in group]
    size = max([size, *(int(a["idx"]) + 1 for a in found)])
    names = [f"{field.name}_{i}" for i in range(size)]
    for a in found:
        if a.get("name"):
            names[int(a["idx"])] = a["name"]
    return names


def vector_size(df: DataFrame, name: str) -> int:
    """The size of a vector column: by metadata, else that of its first value; 0 if it has none."""
    names = attribute_names(df.schema[name])
    if names is not None:
        return len(names)
    first = df.where(col(name).isNotNull()).select(F.size(as_array(df, name)).alias("n")).first()
    return first["n"] if first else 0


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null entries (also those of the shorter array) count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def axpy(scale: Column | float, x: Column, y: Column) -> Column:
    """scale * x + y, entry by entry."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(x, y, lambda a, b: s * a + b)


def scal(scale: Column | float, x: Column) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.transform(x, lambda a: s * a)


def gemv(matrix: Sequence[Sequence[float]], x: Column) -> Column:
    """A literal matrix times a vector."""
    return F.array(*[dot(literal(row), x) for row in matrix])


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def projection_hash(a: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """The sign bits of a literal matrix times a vector, as a bigint: bit i is set where row i gives more than 0."""
    out = F.lit(0).cast("bigint")
    for i, row in enumerate(matrix):
        out = out + F.when(dot(literal(row), a) > 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return out


def projection_matrix(dimension: int, bits: int = 18, density: float = 0.5, seed: int = 42) -> list[list[float]]:
    """Seeded Gaussian rows of which about `density` entries aren't 0."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return (rng.normal(size=(bits, dimension)) * (rng.random((bits, dimension)) < density)).tolist()
