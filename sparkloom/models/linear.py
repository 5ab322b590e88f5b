"""Linear and logistic models: scoring as column expressions, fitting by partition sums of gradients."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import INTERCEPT, as_array, attribute_names, col, dot, is_numeric_array, is_vector, literal, logistic
from sparkloom.models.base import LOSS, WEIGHTS, Model
from sparkloom.models.optimise import Search, descent, drive, lbfgs

_X, _Y = "__x", "__y"


class LinearModel(Model):
    """link(coefficients . features + intercept); params: coefficients, intercept, link, features_col, output."""

    @staticmethod
    def of(coefficients: Sequence[float], intercept: float = 0.0, link: str = "identity", features_col: str = "features", output: str = "prediction", blocks: Mapping[str, DataFrame] | None = None) -> LinearModel:
        return LinearModel({"coefficients": [float(c) for c in coefficients], "intercept": float(intercept), "link": link, "features_col": features_col, "output": output}, blocks)

    @property
    def coefficients(self) -> list[float]:
        return self.params["coefficients"]

    def score(self, features: Column) -> Column:
        """The prediction for an array<double>."""
        raw = _weighted(features, self.coefficients) + F.lit(self.params["intercept"])
        return logistic(raw) if self.params["link"] == "logistic" else raw

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.params["output"], self.score(as_array(df, self.params["features_col"])))


def _weighted(features: Column, coefficients: Sequence[float]) -> Column:
    """`dot` with literals; of few entries it is written out, which Spark compiles, as it does not higher-order functions."""
    if not 0 < len(coefficients) <= 64:
        return dot(literal(coefficients), features)
    total = F.lit(0.0)
    for i, c in enumerate(coefficients):
        total = total + F.coalesce(F.lit(float(c)) * F.get(features, F.lit(i)), F.lit(0.0))
    return F.when(features.isNotNull(), total)


def weights_block(df: DataFrame, features_col: str, coefficients: Sequence[float], intercept: float | None = None) -> DataFrame:
    """(index, name, weight); the intercept, if given, has the index -1."""
    names = attribute_names(df.schema[features_col]) or [f"{features_col}_{i}" for i in range(len(coefficients))]
    rows = [(i, names[i] if i < len(names) else str(i), float(c)) for i, c in enumerate(coefficients)]
    if intercept is not None:
        rows.append((-1, INTERCEPT, float(intercept)))
    return df.sparkSession.createDataFrame(rows, "index int, name string, weight double")


def _training(df: DataFrame, features_col: str, label_col: str) -> DataFrame:
    """(__x array, __y array) of rows without a null, as many labels as the label column has."""
    f = df.schema[label_col]
    y = as_array(df, label_col) if is_vector(f) or is_numeric_array(f) else F.when(col(label_col).isNotNull(), F.array(col(label_col).cast("double")))
    return df.select(as_array(df, features_col).alias(_X), y.alias(_Y)).where(f"{_X} is not null and {_Y} is not null")


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) and (rows, labels); null entries are NaN, and NaN features count as 0."""
    x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (0, 1))
    return np.nan_to_num(x, nan=0.0), y


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of a column of equally long arrays: by groups of partitions first, as there may be very many."""

    def add(table: pa.Table) -> pa.Table:
        rows = table["sums"].combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
        return pa.table({"sums": pa.array([total], pa.list_(pa.float64()))})

    grouped = parts.groupBy((F.spark_partition_id() % 32).alias("g")).applyInArrow(add, "sums array<double>")
    found = grouped.toArrow()["sums"].combine_chunks()
    return found.flatten().to_numpy().reshape(len(found), -1).sum(axis=0) if len(found) else np.zeros(0)


def losses_and_gradients(rows: DataFrame | _Packed, points: np.ndarray, labels: Sequence[int], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss and gradient at each point (labels x features), of squared error / 2 or logistic loss, in one pass."""
    m, f = points.shape
    which = np.array(labels)
    read, rows = ((lambda b, f=rows.f, k=rows.k: _unpacked(b, f, k)), rows.rows) if isinstance(rows, _Packed) else (_blocks, rows)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, n = np.zeros(m), np.zeros((m, f)), np.zeros(m)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = read(batch)
            y = y[:, which]
            ok = ~np.isnan(y)
            y = np.where(ok, y, 0.0)
            raw = x @ points.T
            if kind == "logistic":
                p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
                loss += ((np.logaddexp(0, raw) - y * raw) * ok).sum(axis=0)
                error = (p - y) * ok
            else:
                error = (raw - y) * ok
                loss += (error**2).sum(axis=0) / 2
            grad += error.T @ x
            n += ok.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((loss, grad.ravel(), n))], pa.list_(pa.float64()))], ["sums"])

    total = _summed(rows.mapInArrow(part, "sums array<double>"))
    if not len(total):
        return np.zeros(m), np.zeros((m, f))
    n = np.maximum(total[m + m * f :], 1)
    return total[:m] / n, total[m : m + m * f].reshape(m, f) / n[:, None]


#: Rows of a packed block, entries of X'X that a partition may send, and bytes of a block at most.
PACK, MOMENTS, PACK_BYTES = 256, 1 << 16, 1 << 15


def packed_rows(rows: DataFrame, f: int, k: int) -> DataFrame:
    """The rows of `_training` as blocks of float64 in one binary column, for many passes over them.

    A block is features and labels, row by row. An Arrow batch of blocks is read as one matrix, without a copy for each row.
    """
    width = 8 * (f + k)
    size = max(1, min(PACK, PACK_BYTES // max(width, 1)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _blocks(batch)
            data = np.ascontiguousarray(np.concatenate((x, y), axis=1), dtype=np.float64)
            ends = np.append(np.arange(0, len(data), size), len(data)) * width
            blocks = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([blocks], ["block"])

    return rows.mapInArrow(part, "block binary")


def _unpacked(batch: pa.RecordBatch, f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    blocks = batch.column(0)
    kind = np.int64 if pa.types.is_large_binary(blocks.type) else np.int32
    ends = np.frombuffer(blocks.buffers()[1], dtype=kind, count=len(blocks) + 1, offset=blocks.offset * np.dtype(kind).itemsize)
    data = np.frombuffer(blocks.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(-1, f + k)
    return data[:, :f], data[:, f:]


class _Packed:
    """Packed rows with their shape, as `losses_and_gradients` takes them in place of plain ones."""

    def __init__(self, rows: DataFrame, f: int, k: int):
        self.rows, self.f, self.k = rows, f, k


def _moments(rows: DataFrame, f: int, k: int) -> np.ndarray:
    """For each label the matrix Z'Z of the rows that have it, Z being (features, label, 1): (k, f + 2, f + 2), in one pass."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, f + 2, f + 2))
        for batch in batches:
            if batch.num_rows:
                x, y = _blocks(batch)
                for i in range(k):
                    ok = ~np.isnan(y[:, i])
                    z = np.concatenate((x, y[:, i : i + 1], np.ones((len(x), 1))), axis=1)
                    z = z if ok.all() else z[ok]
                    total[i] += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    total = _summed(rows.mapInArrow(part, "sums array<double>"))
    return total.reshape(k, f + 2, f + 2) if len(total) else np.zeros((k, f + 2, f + 2))


def _from_moments(moments: np.ndarray, points: np.ndarray, labels: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses and gradients of squared error / 2, as `losses_and_gradients` gives them, without another pass."""
    losses, gradients = np.zeros(len(points)), np.zeros(points.shape)
    f = points.shape[1]
    for at, i in enumerate(labels):
        m = moments[i]
        n = max(m[-1, -1], 1)
        error = np.append(points[at], -1.0)  # (features, label) . error is the residual
        seen = m[: f + 1, : f + 1] @ error
        losses[at], gradients[at] = max(float(error @ seen), 0.0) / 2 / n, seen[:f] / n
    return losses, gradients


def _shape(rows: DataFrame) -> tuple[int, int]:
    found = rows.select(F.size(_X).alias("f"), F.size(_Y).alias("k")).first()
    if found is None:
        raise ValueError("no rows to fit on")
    return found["f"], found["k"]


def _fit(df: DataFrame, features_col: str, label_col: str, kind: str, l2: float, l1: float, keep_last: bool, search) -> list[tuple[np.ndarray, list[float]]]:
    """Squared error of not too many features is searched on its moments, which take one pass; other fits pass over packed rows for each point."""
    rows = _training(df, features_col, label_col)
    f, k = _shape(rows)
    by_moments = kind != "logistic" and k * (f + 2) ** 2 <= MOMENTS
    packed = None if by_moments else packed_rows(rows, f, k).persist()
    try:
        ridge = np.full(f, l2)
        lasso = np.zeros((k, f))
        if keep_last:
            ridge[-1] = 0
        if l1 > 0:
            lasso[:] = l1 * greatest_useful(rows, k, f)[:, None]
            if keep_last:
                lasso[:, -1] = 0
        starts = np.zeros((k, f))
        if keep_last and kind == "logistic":
            rate = np.array(rows.select(*[F.avg(F.get(_Y, F.lit(i))).alias(f"m{i}") for i in range(k)]).first(), dtype=float)
            starts[:, -1] = np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6)))
        searches: list[Search] = [search(starts[i], lasso[i] if l1 > 0 else None) for i in range(k)]
        moments = _moments(rows, f, k) if by_moments else None

        def evaluate(points: np.ndarray, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
            loss, grad = losses_and_gradients(_Packed(packed, f, k), points, which, kind) if moments is None else _from_moments(moments, points, which)
            return loss + (points**2 * ridge).sum(axis=1) / 2, grad + points * ridge

        return drive(searches, evaluate)
    finally:
        if packed is not None:
            packed.unpersist()


def greatest_useful(rows: DataFrame, k: int, f: int) -> np.ndarray:
    """For each label the least L1 penalty that makes every weight 0: max over features of |sum x (y - mean y)| / n."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy, sx, sy, n = np.zeros((k, f)), np.zeros(f), np.zeros(k), 0
        for batch in batches:
            if batch.num_rows:
                x, y = _blocks(batch)
                xy, sx, sy, n = xy + np.nan_to_num(y).T @ x, sx + x.sum(axis=0), sy + np.nan_to_num(y).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((xy.ravel(), sx, sy, [n]))], pa.list_(pa.float64()))], ["sums"])

    total = _summed(rows.mapInArrow(part, "sums array<double>"))
    n = max(total[-1], 1)
    xy, sx, sy = total[: k * f].reshape(k, f), total[k * f : k * f + f], total[k * f + f : -1]
    return np.abs(xy - np.outer(sy / n, sx)).max(axis=1) / n


def _models(df: DataFrame, features_col: str, label_col: str, kind: str, found: list[tuple[np.ndarray, list[float]]], output: str) -> Model:
    link = "logistic" if kind == "logistic" else "identity"
    made = []
    for w, losses in found:
        history = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")
        made.append(LinearModel.of(w, 0.0, link, features_col, output, {WEIGHTS: weights_block(df, features_col, w), LOSS: history}))
    f = df.schema[label_col]
    if not (is_vector(f) or is_numeric_array(f)):
        return made[0]
    from sparkloom.models.combined import MultiClassModel

    names = attribute_names(f) or [str(i) for i in range(len(made))]
    return MultiClassModel.of(dict(zip(names, made)), output)


def fit_lbfgs(df: DataFrame, features_col: str = "features", label_col: str = "label", kind: str = "linear", l2: float = 0.0, l1: float = 0.0, keep_last: bool = False, max_iter: int = 100, tol: float = 1e-9, memory: int = 10, output: str = "prediction") -> Model:
    """Least squares ("linear") or "logistic" by L-BFGS, with L1 by OWL-QN; several labels of a vector share each pass.

    l1: a share of the greatest useful penalty of each label. keep_last: the last feature is an intercept, which isn't
    penalised and, for logistic models, begins at the log odds of the labels. Rows with a null vector or label are left
    out; NaN features count as 0, and a NaN label leaves its row out of that label's fit.
    """
    found = _fit(df, features_col, label_col, kind, l2, l1, keep_last, lambda start, lasso: lbfgs(start, lasso, max_iter, tol, memory))
    return _models(df, features_col, label_col, kind, found, output)


def fit_descent(df: DataFrame, features_col: str = "features", label_col: str = "label", step: float = 1.0, max_iter: int = 100, tol: float = 1e-3, l2: float = 0.0, output: str = "prediction") -> Model:
    """Least squares by gradient descent."""
    found = _fit(df, features_col, label_col, "linear", l2, 0.0, False, lambda start, lasso: descent(start, step, max_iter, tol))
    return _models(df, features_col, label_col, "linear", found, output)


def fit_svrg(df: DataFrame, features_col: str = "features", label_col: str = "label", kind: str = "linear", l2: float = 0.0, l1: float = 0.0, keep_last: bool = False, batch: int = 50, rate: float = 0.1, max_iter: int = 50, tol: float = 1e-6, converge: str = "any", seed: int = 1, output: str = "prediction") -> Model:
    """Distributed variance-reduced gradient descent: each partition walks from the common weights over its own
    mini-batches, corrected by the full gradient; the weights are averaged by rows.

    A label's rate is halved when its loss rises, and grows slowly when it falls. L1 shrinks weights after each
    mini-batch. converge: by "weights", "loss", "both" or "any" of them. The last, smaller mini-batch counts too.
    """
    rows = _training(df, features_col, label_col).persist()
    try:
        f, k = _shape(rows)
        ridge, shrink = np.full(f, l2), np.full(f, l1)
        if keep_last:
            ridge[-1] = shrink[-1] = 0
        w, rates, losses = np.zeros((k, f)), np.full(k, rate), []
        best, last_loss = w.copy(), np.full(k, np.inf)
        for epoch in range(max_iter):
            loss, grad = losses_and_gradients(rows, w, range(k), kind)
            loss = loss + (w**2 * ridge).sum(axis=1) / 2 + (np.abs(w) * shrink).sum(axis=1)
            grad = grad + w * ridge
            losses.append(loss)
            worse = ~(loss <= last_loss)
            w_from = np.where(worse[:, None], best, w)
            moved = np.linalg.norm(w - best, axis=1) / np.maximum(np.linalg.norm(w, axis=1), 1e-12)
            fell = np.abs(last_loss - loss) / np.maximum(np.abs(loss), 1e-12)
            if epoch:
                by = {"weights": moved < tol, "loss": fell < tol, "both": (moved < tol) & (fell < tol), "any": (moved < tol) | (fell < tol)}[converge]
                if (by | (rates < 1e-9)).all():
                    break
            if worse.any() and epoch:
                rates = np.where(worse, rates / 2, rates)
                w = w_from
                loss2, grad2 = losses_and_gradients(rows, w, range(k), kind)
                grad = grad2 + w * ridge
                loss = loss2 + (w**2 * ridge).sum(axis=1) / 2 + (np.abs(w) * shrink).sum(axis=1)
            rates = np.where(worse, rates, rates * 1.05)
            best, last_loss = w.copy(), loss
            w = _walk(rows, w, grad, rates, kind, ridge, shrink, batch, seed + epoch)
        found = [(best[i], [float(x[i]) for x in losses]) for i in range(k)]
        return _models(df, features_col, label_col, kind, found, output)
    finally:
        rows.unpersist()


def _walk(rows: DataFrame, start: np.ndarray, full: np.ndarray, rates: np.ndarray, kind: str, ridge: np.ndarray, shrink: np.ndarray, size: int, seed: int) -> np.ndarray:
    k, f = start.shape

    def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        raw = x @ w.T
        p = 1 / (1 + np.exp(-np.clip(raw, -500, 500))) if kind == "logistic" else raw
        ok = ~np.isnan(y)
        return (np.where(ok, p - np.where(ok, y, 0.0), 0.0)).T @ x / len(x) + w * ridge

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, rng = start.copy(), 0, np.random.default_rng(seed)
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _blocks(b)
            order = rng.permutation(len(x))
            for lo in range(0, len(x), size):
                own = order[lo : lo + size]
                step = gradient(x[own], y[own], w) - gradient(x[own], y[own], start) + full
                w = w - rates[:, None] * step
                limit = rates[:, None] * shrink
                w = np.sign(w) * np.maximum(np.abs(w) - limit, 0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((w.ravel() * n, [n]))], pa.list_(pa.float64()))], ["sums"])

    total = _summed(rows.mapInArrow(part, "sums array<double>"))
    return total[:-1].reshape(k, f) / max(total[-1], 1)


# --- scaling and intercepts, folded into the weights -----------------------------------------------------------------


def standard_deviations(df: DataFrame, features_col: str) -> tuple[list[float], list[float]]:
    """(means, sample deviations) of each entry; a constant one has deviation 0."""
    entries = df.select(F.posexplode(as_array(df, features_col)).alias("i", "x")).where("not isnan(x)")
    found = entries.groupBy("i").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s")).orderBy("i").collect()
    return [r["m"] for r in found], [r["s"] for r in found]


def fit_scaled(df: DataFrame, fit, features_col: str = "features", with_mean: bool = True, with_deviation: bool = True) -> Model:
    """`fit` on standardised features; the model it gives is changed to score features as they are."""
    means, deviations = standard_deviations(df, features_col)
    m = F.array(*[F.lit(x if with_mean else 0.0) for x in means])
    s = F.array(*[F.lit(1 / x if with_deviation and x > 0 else 1.0) for x in deviations])
    scaled = F.zip_with(F.zip_with(as_array(df, features_col), m, lambda x, y: x - y), s, lambda x, y: x * y)
    field = df.schema[features_col]
    ready = df.withColumn(features_col, array_to_vector(scaled) if is_vector(field) else scaled).withMetadata(features_col, field.metadata or {})
    used = [x if with_mean else 0.0 for x in means]
    return unscaled(fit(ready), used, [x if with_deviation and x > 0 else 1.0 for x in deviations], df)


def unscaled(model: Model, means: Sequence[float], deviations: Sequence[float], df: DataFrame) -> Model:
    """Weights w / s and intercept b - sum(w / s * m); the weights block keeps both kinds, with means and deviations."""
    if not isinstance(model, LinearModel):
        return type(model)(model.params, model.blocks, {n: unscaled(m, means, deviations, df) for n, m in model.nested.items()})
    w = [c / s for c, s in zip(model.coefficients, deviations)]
    intercept = model.params["intercept"] - sum(c * m for c, m in zip(w, means))
    block = model.blocks.get(WEIGHTS)
    if block is not None:
        stats = df.sparkSession.createDataFrame([(i, float(w[i]), float(means[i]), float(deviations[i])) for i in range(len(w))], "index int, unscaled_weight double, value_mean double, value_std double")
        block = block.join(F.broadcast(stats), "index", "left")  # a row a feature
    return model.copy({**model.blocks, WEIGHTS: block} if block is not None else None, coefficients=w, intercept=intercept)


def fit_with_intercept(df: DataFrame, fit, features_col: str = "features") -> Model:
    """`fit` on features with a last entry of 1; the weight of that becomes the model's intercept."""
    from sparkloom.operators.columns import append_intercept

    return extracted_intercept(fit(append_intercept(df, features_col)))


def extracted_intercept(model: Model) -> Model:
    if not isinstance(model, LinearModel):
        return type(model)(model.params, model.blocks, {n: extracted_intercept(m) for n, m in model.nested.items()})
    *w, b = model.coefficients
    blocks = dict(model.blocks)
    if WEIGHTS in blocks:
        last = len(w)
        blocks[WEIGHTS] = blocks[WEIGHTS].withColumns({"name": F.when(F.col("index") == last, INTERCEPT).otherwise(F.col("name")), "index": F.when(F.col("index") == last, -1).otherwise(F.col("index"))})
    return model.copy(blocks, coefficients=w, intercept=model.params["intercept"] + b)

