"""Mixing sources: temperature weights met by bisection, realised as budgeted block permutations.

The weight of a source is its share of all tokens raised to an exponent between 0 (all sources alike) and
1 (as they are), then normalised. The exponent is bisected: the least that keeps every source within
`max_repetition` passes, raised no further than `target_entropy` (in nats) needs, if that is given.
The token budget is the least at which every source is used whole, unless one is given.

A source's quota, weight x budget, is filled by whole passes over its documents, then by the part of one
further pass that fits. Each pass is a permutation of its own, by the md5 of seed, pass and id. Positions in
the passes, as shares of the quota, put every source into each block of the stream at its weight; in a
block, documents are permuted again.

Tokens are runs of non-blanks, unless the column `token_col` gives a count. Texts without a token, null ones
included, cannot be drawn. A null source is a source of its own. Rows of one id tie, and go in or stay out
of the last pass together. What comes to the driver is a row for each source; no other list or sort takes
more than 1/4096 of a pass or one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import col, packed, written


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def entropy(counts: np.ndarray, exponent: float) -> float:
    p = weights(counts, exponent)
    return float(-(p * np.log(p)).sum())


def weights(counts: np.ndarray, exponent: float) -> np.ndarray:
    x = np.exp(exponent * (np.log(counts) - np.log(counts.max())))
    return x / x.sum()


def repetition(counts: np.ndarray, exponent: float, budget: float | None) -> float:
    passes = weights(counts, exponent) / counts
    return float(passes.max() / passes.min() if budget is None else passes.max() * budget)


def find_exponent(counts: np.ndarray, max_repetition: float | None, target_entropy: float | None, budget: float | None = None) -> float:
    """The least exponent within the repetition limit whose entropy isn't above the target; 1 if none is."""

    def least(ok) -> float:
        if ok(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    wanted = [least(lambda e: repetition(counts, e, budget) <= max_repetition)] if max_repetition is not None else []
    if target_entropy is not None:
        wanted.append(least(lambda e: entropy(counts, e) <= target_entropy))
    return max(wanted, default=1.0)


@dataclass
class Mix:
    sources: list[str | None]
    tokens: np.ndarray
    exponent: float
    weight: np.ndarray
    budget: float

    def plan(self, spark) -> DataFrame:
        """(source, total, quota, passes, rest): whole passes, and tokens of the last one."""
        rows = []
        for s, n, w in zip(self.sources, self.tokens.tolist(), self.weight.tolist()):
            quota = w * self.budget
            passes = math.floor(quota / n + 1e-9)
            rows.append((s, int(n), quota, passes, max(quota - passes * n, 0.0)))
        return spark.createDataFrame(rows, "p_source string, total bigint, quota double, passes int, rest double")


def fit_mix(rows: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: float | None) -> Mix | None:
    """rows: (source, tokens)."""
    found = rows.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("n")).orderBy("source").collect()
    if not found:
        return None
    counts = np.array([r["n"] for r in found], dtype=float)
    exponent = find_exponent(counts, max_repetition, target_entropy, budget)
    w = weights(counts, exponent)
    return Mix([r["source"] for r in found], counts, exponent, w, float((counts / w).max()) if budget is None else float(budget))


def _drawn_key(seed: int, copy: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), copy, F.coalesce(F.col("id").cast("string"), F.lit("null"))))


def _before_bucket(rows: DataFrame) -> DataFrame:
    """(source, copy, bucket, before): tokens in the buckets before it; buckets are 1/4096 of a pass."""
    sums = rows.groupBy("source", "copy", "bucket").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("source", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("source", "copy", "bucket", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"), "t")


def _meta(docs: DataFrame, id_col: str, text_col: str, source_col: str, token_col: str | None) -> DataFrame:
    return docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), _tokens_of(docs, text_col, token_col).alias("tokens"))


def _with_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    plan = mix.plan(rows.sparkSession)
    return rows.where("tokens > 0").join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")


def _placed(rows: DataFrame, mix: Mix, block_tokens: int, seed: int) -> DataFrame:
    """(block, id, source, copy, tokens) of every draw."""
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    drawn = _with_plan(rows, mix).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    drawn = drawn.where("copy < passes or rest > 0").withColumn("u", _drawn_key(seed, F.col("copy"))).withColumn("bucket", F.substring("u", 1, 3))
    before = _before_bucket(drawn).withColumnsRenamed({"source": "b_source", "copy": "b_copy", "bucket": "b_bucket"})
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("copy") == F.col("b_copy")) & (F.col("bucket") == F.col("b_bucket"))
    at = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "copy", "bucket").orderBy("u"))
    placed = drawn.join(before.drop("t"), same).withColumn("at", at).where("copy < passes or at <= rest")
    block = F.least(F.lit(blocks), F.greatest(F.lit(1), F.ceil((F.col("copy") * F.col("total") + F.col("at")) / F.col("quota") * blocks - 1e-9))) - 1
    return placed.select(block.cast("bigint").alias("block"), "id", "source", "copy", "tokens")


def mixed_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", token_col: str | None = None, max_repetition: float | None = 1.5, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = 65_536, seed: int = 11) -> DataFrame:
    """(block, slot, doc_id, source, copy, tokens): every draw, with its place in the stream."""
    rows = written(_meta(docs, id_col, text_col, source_col, token_col))  # tokens are counted once
    mix = fit_mix(rows, max_repetition, target_entropy, budget)
    if mix is None:
        return rows.select(F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("slot"), F.col("id").alias("doc_id"), "source", F.lit(0).alias("copy"), "tokens").where("false")
    placed = _placed(rows, mix, block_tokens, seed)
    key = _block_key(seed)
    slot = F.row_number().over(Window.partitionBy("block").orderBy(key, "source", "tokens")) - 1
    return placed.select("block", slot.alias("slot"), F.col("id").alias("doc_id"), "source", "copy", "tokens")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", token_col: str | None = None, max_repetition: float | None = 1.5, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = 65_536, seed: int = 11, blocks_per_part: int = 256) -> DataFrame:
    """`docs`, all columns, each row as often as the mix draws it, in the order of block and slot.

    A partition holds about `blocks_per_part` blocks that follow one another, sorted; partitions are in order.
    """
    rows = written(_meta(docs, id_col, text_col, source_col, token_col))
    mix = fit_mix(rows, max_repetition, target_entropy, budget)
    if mix is None:
        return docs.where("false")
    # rows of one id and source tie, so they share the block of each copy
    places = _placed(rows, mix, block_tokens, seed).select("id", "source", "copy", "block").distinct()
    places = places.groupBy("id", "source").agg(F.collect_list(F.struct("copy", "block")).alias("draws")).withColumnsRenamed({"id": "p_id", "source": "p_source"})
    full = packed(docs, id=col(id_col), source=col(source_col).cast("string"), has=F.coalesce(col(text_col).rlike(r"\S"), F.lit(False)) if token_col is None else _tokens_of(docs, text_col, token_col) > 0)
    full = full.where("has").drop("has").join(places, F.col("id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")))
    drawn = full.select("row", "id", "source", F.explode("draws").alias("draw")).select("row", "id", "source", "draw.*")
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    parts = min(blocks, max(math.ceil(blocks / blocks_per_part), 2 * docs.sparkSession.sparkContext.defaultParallelism))
    drawn = drawn.repartitionById(parts, F.floor(F.col("block") * parts / blocks).cast("int"))
    return drawn.withColumn("key", _block_key(seed)).sortWithinPartitions("block", "key", "source").select("row.*")


def _block_key(seed: int) -> Column:
    """By which the draws of a block are permuted."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), F.col("block"), F.col("copy"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))


def _tokens_of(docs: DataFrame, text_col: str, token_col: str | None) -> Column:
    return count_tokens(col(text_col)) if token_col is None else F.coalesce(col(token_col).cast("bigint"), F.lit(0))
