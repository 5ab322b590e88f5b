"""Encoders: nominal values to binary vectors, everything to one feature vector, numbers to quantile buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sparkloom.functions.vectors import attribute_metadata, col
from sparkloom.operators.columns import assemble_array, chosen_columns, nominal_columns


def _values(df: DataFrame, name: str) -> Column:
    """The distinct values of a row, as an array: of a string one, of an array several, of null none."""
    c = col(name)
    many = isinstance(df.schema[name].dataType, ArrayType)
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull())) if many else F.when(c.isNotNull(), F.array(c))


def nominal_counts(df: DataFrame, name: str, ignore: Sequence[str] = (), replacements: Mapping[str, str] | None = None) -> DataFrame:
    """(value, n): rows with each value, after replacements, without the ignored ones."""
    values = df.select(F.explode(_values(df, name)).alias("value"))
    for old, new in (replacements or {}).items():
        values = values.withColumn("value", F.when(F.col("value") == old, F.lit(new)).otherwise(F.col("value")))
    if ignore:
        values = values.where(~F.col("value").isin(*ignore))
    return values.groupBy("value").agg(F.count("*").alias("n"))


def _replaced(old: str, new: str):
    return lambda v: F.when(v == old, F.lit(new)).otherwise(v)


@dataclass
class NominalEncoder:
    """A string or array of strings as a binary vector; null and unknown values give zeros."""

    column: str
    values: list[str]
    replacements: dict[str, str] = field(default_factory=dict)

    def array(self, df: DataFrame) -> Column:
        own = F.coalesce(_values(df, self.column), F.array().cast("array<string>"))
        for old, new in self.replacements.items():
            own = F.transform(own, _replaced(old, new))
        known = F.array(*[F.lit(v) for v in self.values]) if self.values else F.array().cast("array<string>")
        return F.transform(known, lambda v: F.array_contains(own, v).cast("double"))

    def transform(self, df: DataFrame, output: str | None = None, as_ml_vector: bool = True) -> DataFrame:
        values = self.array(df)
        name = output or f"{self.column}_vector"
        return df.withColumn(name, array_to_vector(values) if as_ml_vector else values).withMetadata(name, attribute_metadata(self.values))


def fit_nominal(df: DataFrame, column: str, ignore: Sequence[str] = (), replacements: Mapping[str, str] | None = None) -> NominalEncoder:
    """An encoder of the column's values, the most frequent first; of equally frequent ones, the least."""
    found = nominal_counts(df, column, ignore, replacements).orderBy(F.desc("n"), "value").collect()
    return NominalEncoder(column, [r["value"] for r in found], dict(replacements or {}))


@dataclass
class AutoAssembler:
    """Nominal columns as binary vectors (values in alphabetical order), then all columns as one vector."""

    columns: list[str]
    encoders: dict[str, NominalEncoder]

    def transform(self, df: DataFrame, output: str = "features", as_ml_vector: bool = True) -> DataFrame:
        parts, names = [], []
        for c in self.columns:
            if c in self.encoders:
                parts.append(self.encoders[c].array(df))
                names += [f"{c}_{v}" for v in self.encoders[c].values]
            else:
                values, own = assemble_array(df, [c])
                parts.append(values)
                names += own
        values = F.concat(*parts) if parts else F.array().cast("array<double>")
        return df.withColumn(output, array_to_vector(values) if as_ml_vector else values).withMetadata(output, attribute_metadata(names))


def fit_auto_assembler(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> AutoAssembler:
    """All nominal columns are fitted in one pass."""
    columns = chosen_columns(df, include, exclude)
    nominal = nominal_columns(df, columns)
    encoders = {}
    if nominal:
        sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(_values(df, c), F.array().cast("array<string>")))))).alias(f"c{i}") for i, c in enumerate(nominal)]
        found = df.agg(*sets).first()
        encoders = {c: NominalEncoder(c, list(found[f"c{i}"])) for i, c in enumerate(nominal)}
    return AutoAssembler(columns, encoders)


@dataclass
class QuantileBuckets:
    """Split points by column, from -inf to inf; value x is in bucket i (from 1) where splits[i-1] <= x < splits[i]."""

    splits: dict[str, list[float]]
    handle_invalid: str = "keep"

    def bucket(self, name: str) -> Column:
        c, inner = col(name).cast("double"), self.splits[name][1:-1]
        n = F.lit(0)
        for s in inner:
            n = n + (c >= F.lit(s)).cast("int")
        value = F.when(~F.isnan(c), n.cast("double"))
        if self.handle_invalid == "error":
            return F.when(F.isnan(c), F.raise_error(F.lit(f"{name}: NaN")).cast("double")).otherwise(value)
        return F.when(F.isnan(c), float(len(inner) + 1)).otherwise(value) if self.handle_invalid == "keep" else value

    def transform(self, df: DataFrame, suffix: str = "_bucket") -> DataFrame:
        """`df` with a bucket for each column; that of null is null.

        NaN goes to a bucket of its own behind all others ("keep"), raises ("error"), or is null; "skip" drops rows
        whose bucket is null.
        """
        out = df.withColumns({c + suffix: self.bucket(c) for c in self.splits})
        if self.handle_invalid == "skip":
            for c in self.splits:
                out = out.where(F.col("`" + c + suffix + "`").isNotNull())
        return out


def fit_quantile_buckets(df: DataFrame, buckets: Mapping[str, int], relative_error: float = 0.001, handle_invalid: str = "keep") -> QuantileBuckets:
    """Distinct approximate quantiles of each column as splits, the outermost widened by -inf and inf.

    A column with one distinct quantile s is split at it; one with no value has the splits -inf, 0, inf.
    """
    splits = {}
    for name, n in buckets.items():
        probabilities = [i / n for i in range(n + 1)]
        clean = df.select(F.nanvl(col(name).cast("double"), F.lit(None).cast("double")).alias("x")).where("x is not null")
        found = sorted(set(clean.approxQuantile("x", probabilities, relative_error)))
        splits[name] = [float("-inf"), *(found or [0.0]), float("inf")]
    return QuantileBuckets(splits, handle_invalid)


def exact_quantile_splits(df: DataFrame, name: str, n: int) -> list[float]:
    """Distinct exact quantiles, by linear interpolation, with -inf and inf around them."""
    found = df.agg(F.percentile(col(name).cast("double"), F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("q")).first()["q"]
    return [float("-inf"), *(sorted(set(found)) if found else [0.0]), float("inf")]


def hazen(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """(keys, one column a probability): quantiles at rank n * p + 1/2, between neighbours linearly; nulls and NaN are left out."""
    w = Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    rows = df.select(*[col(k) for k in keys], F.nanvl(col(value).cast("double"), F.lit(None).cast("double")).alias("__x")).where("__x is not null")
    rows = rows.withColumn("__rn", F.row_number().over(w.orderBy("__x"))).withColumn("__n", F.count("*").over(w))

    def quantile(p: float) -> Column:
        h = F.greatest(F.lit(1.0), F.least(F.col("__n").cast("double"), F.col("__n") * p + 0.5))
        return F.sum(F.col("__x") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("__rn") - h)))

    return rows.groupBy(*[col(k) for k in keys]).agg(*[quantile(p).alias(name) for name, p in probabilities.items()])
