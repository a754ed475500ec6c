"""A small convolutional classifier: two convolutions with pooling, two dense layers, softmax.

The model is a plain object of NumPy arrays, about 140 KB, so it travels with each task.
Whole batches go through matrix products. Training sums gradients per partition on
the executors; the driver adds up one gradient per partition, by a tree, and takes the step.
All layers get gradients, the first convolution too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CLASSES = 10
NAMES = ("conv1_w", "conv1_b", "conv2_w", "conv2_b", "fc1_w", "fc1_b", "fc2_w", "fc2_b")


@dataclass
class Model:
    """``side``: of the square input image, 28 by default; 8 suits the driver's vectors with kernels of 2."""

    side: int = 28
    kernel: int = 5
    maps: tuple[int, int] = (6, 16)
    hidden: int = 120
    seed: int = 1
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng, k, (a, b) = np.random.default_rng(self.seed), self.kernel, self.maps
            shapes = {"conv1": (a, 1, k, k), "conv2": (b, a, k, k), "fc1": (self.hidden, self.flat), "fc2": (CLASSES, self.hidden)}
            for name, shape in shapes.items():
                bound = np.sqrt(2.0 / np.prod(shape[1:]))
                self.weights[f"{name}_w"] = rng.uniform(-bound, bound, shape).astype(np.float32)
                self.weights[f"{name}_b"] = np.zeros(shape[0], np.float32)

    @property
    def flat(self) -> int:
        first = (self.side - self.kernel + 1) // 2
        return self.maps[1] * ((first - self.kernel + 1) // 2) ** 2

    def copy(self) -> Model:
        return Model(self.side, self.kernel, self.maps, self.hidden, self.seed, {k: v.copy() for k, v in self.weights.items()})

    def size(self) -> int:
        return sum(v.size for v in self.weights.values())


@dataclass(frozen=True)
class Optimizer:
    """Settings of a training run. Of these the rate alone acts in ``step``; the others are kept with the results."""

    rate: float = 0.01
    momentum: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Valid cross-correlation with ReLU of a batch (n, channels, h, w); and the unrolled windows."""
    k = w.shape[-1]
    view = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(2, 3))
    n, _, h, v = view.shape[:4]
    cols = view.transpose(0, 2, 3, 1, 4, 5).reshape(n, h * v, -1)
    out = cols @ w.reshape(len(w), -1).T + b
    return np.maximum(out, 0).transpose(0, 2, 1).reshape(n, len(w), h, v), cols


def pool(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """2 x 2 maxima, and which of the four it was (the first of equals)."""
    n, c, h, w = x.shape
    four = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
    which = four.argmax(axis=-1)
    return np.take_along_axis(four, which[..., None], -1)[..., 0], which


def unpool(g: np.ndarray, which: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    n, c, h, w = g.shape
    four = np.zeros((*g.shape, 4), g.dtype)
    np.put_along_axis(four, which[..., None], g[..., None], -1)
    out = np.zeros(shape, g.dtype)
    out[:, :, : 2 * h, : 2 * w] = four.reshape(n, c, h, w, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, 2 * h, 2 * w)
    return out


def conv_gradients(g: np.ndarray, out: np.ndarray, cols: np.ndarray, w: np.ndarray, shape: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of weights, biases and, if the input's shape is given, of the input."""
    n, f, h, v = g.shape
    g = np.where(out > 0, g, 0).reshape(n, f, h * v)
    gw = np.einsum("nfp,npc->fc", g, cols, optimize=True).reshape(w.shape)
    if shape is None:
        return gw, g.sum(axis=(0, 2)), None
    k = w.shape[-1]
    back = (g.transpose(0, 2, 1) @ w.reshape(f, -1)).reshape(n, h, v, shape[1], k, k)
    gx = np.zeros(shape, g.dtype)
    for i in range(k):
        for j in range(k):
            gx[:, :, i : i + h, j : j + v] += back[..., i, j].transpose(0, 3, 1, 2)
    return gw, g.sum(axis=(0, 2)), gx


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(m: Model, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Probabilities of a batch (n, side * side), and what the backward pass needs."""
    w, x = m.weights, x.reshape(-1, 1, m.side, m.side).astype(np.float32)
    c1, cols1 = conv(x, w["conv1_w"], w["conv1_b"])
    p1, at1 = pool(c1)
    c2, cols2 = conv(p1, w["conv2_w"], w["conv2_b"])
    p2, at2 = pool(c2)
    flat = p2.reshape(len(x), -1)
    h = np.maximum(flat @ w["fc1_w"].T + w["fc1_b"], 0)
    return softmax(h @ w["fc2_w"].T + w["fc2_b"]), (c1, cols1, p1, at1, c2, cols2, p2, at2, flat, h)


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Sums over a batch of the gradients and of the loss."""
    w = m.weights
    p, (c1, cols1, p1, at1, c2, cols2, p2, at2, flat, h) = forward(m, x)
    loss = float(-np.log(p[np.arange(len(y)), y] + 1e-7).sum())
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    out = {"fc2_w": g.T @ h, "fc2_b": g.sum(0)}
    g = np.where(h > 0, g @ w["fc2_w"], 0)
    out |= {"fc1_w": g.T @ flat, "fc1_b": g.sum(0)}
    g = unpool((g @ w["fc1_w"]).reshape(p2.shape), at2, c2.shape)
    out["conv2_w"], out["conv2_b"], g = conv_gradients(g, c2, cols2, w["conv2_w"], p1.shape)
    out["conv1_w"], out["conv1_b"], _ = conv_gradients(unpool(g, at1, c1.shape), c1, cols1, w["conv1_w"], None)
    return out, loss


def step(m: Model, grads: dict[str, np.ndarray], rate: float | Optimizer) -> None:
    """Weights less the rate times the gradient."""
    rate = rate.rate if isinstance(rate, Optimizer) else rate
    for k in NAMES:
        m.weights[k] -= (rate * grads[k]).astype(np.float32)


def train_local(m: Model, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 50, batch: int = 32, rate: float = 0.01, patience: int = 5, min_delta: float = 0.001, seed: int = 1) -> tuple[Model, list[float]]:
    """Mini-batches on one machine: shuffled anew each epoch, a short last batch, the best weights kept, early stop. Accuracies by epoch."""
    rng, best, history, stale = np.random.default_rng(seed), m.copy(), [], 0
    top = -1.0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            grads, _ = gradients(m, x[at], y[at])
            step(m, grads, rate / len(at))
        history.append(float((forward(m, xv)[0].argmax(1) == yv).mean()))
        if history[-1] > top + min_delta:
            top, best, stale = history[-1], m.copy(), 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best, history


def _pixels(batch: pa.RecordBatch, at: int, size: int) -> np.ndarray:
    column = batch.column(at)
    return np.array(column.to_pylist(), np.float32).reshape(-1, size) if len(column) else np.zeros((0, size), np.float32)


def predict(df: DataFrame, m: Model, pixels: str = "pixels", rows: int = 1024) -> DataFrame:
    """All columns, probabilities (10) and predicted, the first of equals; null pixels give nulls."""
    schema = T.StructType([*df.schema, T.StructField("probabilities", T.ArrayType(T.FloatType())), T.StructField("predicted", T.IntegerType())])
    at, size = df.columns.index(pixels), m.side**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                good = np.flatnonzero(np.asarray(batch.column(at).is_valid()))
                p = forward(m, _pixels(batch.take(pa.array(good)), at, size))[0] if len(good) else np.zeros((0, CLASSES), np.float32)
                probabilities: list = [None] * batch.num_rows
                top: list = [None] * batch.num_rows
                for k, row in zip(good, p, strict=True):
                    probabilities[k], top[k] = row, int(row.argmax())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probabilities, pa.list_(pa.float32())), pa.array(top, pa.int32())], names=schema.names)

    return df.mapInArrow(run, schema)


def batch_gradients(df: DataFrame, m: Model, pixels: str = "pixels", label: str = "label", rows: int = 256) -> tuple[dict[str, np.ndarray], float, int]:
    """Gradient, loss and rows summed over a DataFrame: one row of numbers per partition, added up in a tree."""
    made = T.StructType([T.StructField("g", T.BinaryType()), T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())])
    size = m.side**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = None, 0.0, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                g, part = gradients(m, _pixels(batch, 0, size), np.asarray(batch.column(1)).astype(int))
                flat = np.concatenate([g[k].ravel() for k in NAMES]).astype(np.float64)
                total = flat if total is None else total + flat
                loss, n = loss + part, n + batch.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([n], pa.int64())], names=made.names)

    def both(a, b):
        return (np.frombuffer(a[0]) + np.frombuffer(b[0])).tobytes(), a[1] + b[1], a[2] + b[2]

    sums = df.select(pixels, F.col(label).cast("int")).mapInArrow(run, made).rdd.map(tuple)
    zero = (np.zeros(m.size()).tobytes(), 0.0, 0)
    flat, loss, n = sums.treeAggregate(zero, both, both)
    out, at, flat = {}, 0, np.frombuffer(flat)
    for k in NAMES:
        out[k] = flat[at : at + m.weights[k].size].reshape(m.weights[k].shape)
        at += m.weights[k].size
    return out, loss, n


def train(df: DataFrame, validate: DataFrame, m: Model, key: str, epochs: int = 20, batches: int = 4, rate: float = 0.1, patience: int = 5, min_delta: float = 0.001, seed: int = 1) -> tuple[Model, list[float]]:
    """Gradient descent over a cluster: every epoch deals the rows anew into ``batches`` by a seeded hash of the key; a step per batch. The best weights on ``validate`` are kept."""
    best, history, top, stale = m.copy(), [], -1.0, 0
    for epoch in range(epochs):
        dealt = df.withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed * 1000 + epoch), F.col(key)), F.lit(batches)))
        for k in range(batches):
            grads, _, n = batch_gradients(dealt.where(F.col("_batch") == k), m)
            if n:
                step(m, grads, rate / n)
        history.append(evaluate(validate, m))
        if history[-1] > top + min_delta:
            top, best, stale = history[-1], m.copy(), 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best, history


def evaluate(df: DataFrame, m: Model, label: str = "label") -> float:
    """Share of rows that are predicted right; 0 of none."""
    return predict(df, m).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] or 0.0


def grid_search(df: DataFrame, configs: DataFrame, m: Model, share: float = 0.7) -> DataFrame:
    """One training per configuration, each in a task of its own: config_id, accuracy, macro_f1, and the confusion counts.

    ``df`` (pixels, label) is sent to every task, so it must be small; rows are cut into training
    and test by their order. configs: config_id, epochs, batch_size, learning_rate.
    """
    if df.count() * m.side**2 * 4 > 256 << 20:
        raise ValueError("too many samples to send to every task")
    rows = df.select("pixels", F.col("label").cast("int").alias("label")).toPandas()
    x, y = np.stack(rows["pixels"].to_list()).astype(np.float32), rows["label"].to_numpy()
    n = int(len(x) * share)
    made = "config_id int, accuracy double, macro_f1 double, confusion array<long>"

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for c in batch.itertuples():
                best, _ = train_local(m.copy(), x[:n], y[:n], x[n:], y[n:], int(c.epochs), int(c.batch_size), float(c.learning_rate))
                guess = forward(best, x[n:])[0].argmax(1)
                cells = np.zeros((CLASSES, CLASSES), int)
                np.add.at(cells, (y[n:], guess), 1)
                tp, seen, said = np.diag(cells), cells.sum(1), cells.sum(0)
                f1 = np.divide(2 * tp, seen + said, out=np.zeros(CLASSES), where=seen + said > 0)
                out.append((c.config_id, float((guess == y[n:]).mean()), float(f1.mean()), cells.ravel().tolist()))
            yield pd.DataFrame(out, columns=["config_id", "accuracy", "macro_f1", "confusion"])

    return configs.repartition(configs.count(), "config_id").mapInPandas(run, made)
