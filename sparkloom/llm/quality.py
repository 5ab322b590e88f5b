"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each text (lengths, character classes, repetition) are standardised and mapped to cosines
whose products approximate a Gaussian kernel (Rahimi and Recht, 2007). Workers sum the normal equations of
their partitions; their sum is solved with a ridge penalty. A held-out part of the labelled rows calibrates
the scores to probabilities by isotonic regression (pool adjacent violators).

The fit uses a bounded sample of labelled rows (`max_labelled`, those of the least hashes of their ids);
scoring covers every row. Labelled rows with a null id or label are left out; a repeated label row counts
again. Without labels of both classes every text gets probability 1, as there is nothing to reject it by.
A null text, or one without a word, gets probability 0 and is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col, extended, packed
from sparkloom.llm.textkernel import Words, buffers, slices

_CLASSES = np.zeros((256, 9), dtype=bool)
for _i, _chars in enumerate((range(65, 91), range(48, 58), b".,;:", b"!", b"|", b"#$%&*@^~=<>\\/_", b"?\"'()[]{}-", b"\n", b" \t")):
    _CLASSES[list(_chars), _i] = True
_CLASS_OF = np.where(_CLASSES.any(1), _CLASSES.argmax(1), 9).astype(np.uint8)
N_STATISTICS = 9 + 8


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, N_STATISTICS) of a slice of texts."""
    n = len(off) - 1
    words = Words(raw, off)
    size = np.diff(off)
    row_of_byte = np.repeat(np.arange(n), size)
    by_class = np.bincount(row_of_byte * 10 + _CLASS_OF[raw], minlength=10 * n).reshape(n, 10)[:, :9]
    count = np.maximum(words.count, 1)
    length = words.ends - words.starts
    mean = np.bincount(words.row, length, n) / count
    square = np.bincount(words.row, length.astype(float) ** 2, n) / count
    keys = (words.row.astype(np.uint64) << np.uint64(44)) | (words.hashes() >> np.uint64(20))
    keys.sort()
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    distinct = np.bincount((keys[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)
    capital = _CLASS_OF[raw[words.starts]] == 0
    shout = capital & (_CLASS_OF[raw[words.ends - 1]] == 0) & (length > 1)
    dense = np.minimum(size, 1) / np.maximum(size, 1)
    return np.column_stack([
        by_class * dense[:, None], np.log1p(size), np.log1p(words.count), mean, np.sqrt(np.maximum(square - mean**2, 0)),
        distinct / count, np.bincount(words.row, capital, n) / count, np.bincount(words.row, shout, n) / count, by_class[:, 2] / count,
    ])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the steps of the non-decreasing least-squares fit; tied scores are one point."""
    at, where = np.unique(scores, return_inverse=True)
    weight = np.bincount(where).astype(float)
    value = np.bincount(where, labels) / weight
    blocks: list[list[float]] = []
    for x, v, w in zip(at, value, weight):
        blocks.append([v, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = np.array([b[i] for b in blocks for i in (2, 3)])
    return xs, np.repeat([b[0] for b in blocks], 2)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (statistics, features)
    phase: np.ndarray
    beta: np.ndarray  # features and an intercept
    steps: np.ndarray
    probabilities: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones(len(z))])

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.lift(stats) @ self.beta, self.steps, self.probabilities)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, most: int) -> DataFrame:
    # ids of one type stay as they are; of two types, such as bigint and string, both are compared as strings
    same = docs.schema[id_col].dataType == labels.schema[label_id].dataType
    known_id, own_id = (x if same else x.cast("string") for x in (col(label_id), col(id_col)))
    known = labels.select(known_id.alias("id"), col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    texts = docs.select(own_id.alias("id"), col(text_col).alias("text"))
    return texts.join(F.broadcast(known), "id").select("id", "y", "text")  # at most `most` rows of 16 bytes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000, features: int = 256, width: float = 3.0, ridge: float = 1e-3, seed: int = 5) -> QualityModel | None:
    """The model, or None without labels of both classes. label: above 0.5 is good. A fifth of the sample calibrates."""

    def stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(2))
            parts = [statistics(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * N_STATISTICS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "y", "stats"])

    sample = _labelled(docs, labels, id_col, text_col, label_id, label_col, max_labelled)
    held = sample.mapInArrow(stats_of, extended(sample.select("id").schema, "y double, stats array<double>")).withColumn("held", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0)
    held = held.persist()  # at most max_labelled rows of numbers
    try:
        span = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        summary = held.where("not held").agg(F.min(F.col("y") > 0.5).alias("lo"), F.max(F.col("y") > 0.5).alias("hi"), *span).first()
        if summary["lo"] is None or summary["lo"] == summary["hi"]:
            return None
        rng = np.random.default_rng(seed)
        mean = np.array([summary[f"m{i}"] for i in range(N_STATISTICS)])
        scale = np.array([summary[f"s{i}"] or 1.0 for i in range(N_STATISTICS)])
        model = QualityModel(mean, scale, rng.normal(size=(N_STATISTICS, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))
        d = features + 1

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, d + 1))
            for batch in batches:
                z = model.lift(batch.column(0).flatten().to_numpy().reshape(-1, N_STATISTICS))
                y = (batch.column(1).to_numpy() > 0.5).astype(float)
                total += z.T @ np.column_stack([z, y])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

        # one matrix a partition, of which the bounded sample has few
        sums = held.where("not held").select("stats", "y").coalesce(16).mapInArrow(normal, "sums array<double>").toArrow()["sums"].combine_chunks()
        total = sums.flatten().to_numpy().reshape(-1, d, d + 1).sum(axis=0)
        penalty = ridge * total[-1, -2] * np.eye(d)
        penalty[-1, -1] = 0
        model.beta = np.linalg.solve(total[:, :d] + penalty, total[:, d])
        rest = held.where("held").select("stats", "y").toArrow()
        if not rest.num_rows:
            rest = held.select("stats", "y").toArrow()
        stats = rest["stats"].combine_chunks().flatten().to_numpy().reshape(-1, N_STATISTICS)
        model.steps, model.probabilities = isotonic(model.lift(stats) @ model.beta, (rest["y"].to_numpy() > 0.5).astype(float))
        return model
    finally:
        held.unpersist()


def _scored(rows: DataFrame, model: QualityModel | None, threshold: float, passed: bool) -> DataFrame:
    """`rows` of (something, text): with all of the first, and probability, or only those that pass."""
    first = rows.columns[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            parts = []
            for lo, hi in slices(off):
                stats = statistics(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                p = model.probability(stats) if model else np.ones(len(stats))
                parts.append(np.where(stats[:, 10] > 0, p, 0.0))
            p = np.concatenate(parts) if parts else np.zeros(0)
            if passed:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(p >= threshold))], [first])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], [first, "probability"])

    schema = rows.select(first).schema
    return rows.mapInArrow(score, schema if passed else schema.add("probability", "double"))


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, probability, keep), a row for each row of `docs`."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return _scored(rows, model, threshold, False).select("doc_id", F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose probability reaches the threshold."""
    return _scored(packed(docs, text=col(text_col)), model, threshold, True).select("row.*")
