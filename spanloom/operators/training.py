"""Fitting the type head: linear, ReLU, linear, by synchronous mini-batch gradients.

Rows are packed once into blocks of numbers, dealt to the steps of an epoch.  A step is one
job over its own blocks: every task sums loss and gradient of its rows, the sums meet in a
tree of tasks, and the driver moves the weights (Adam).  What travels has the size of the
model, never of the data; a lost executor costs the tasks of one step."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import argmax, top_probability
from ..session import shared_path
from .vectors import score_spans

# the batch functions travel with the plan
register_pickle_by_value(sys.modules[__name__])

Layer = tuple[np.ndarray, np.ndarray]


@dataclass
class Head:
    """The two layers, the epoch they are of, its F1 on the validation rows, and per epoch the
    training loss, validation loss and F1."""

    hidden: Layer
    out: Layer
    epoch: int = 0
    f1: float = 0.0
    history: list[tuple[float, float, float]] = field(default_factory=list)


def align_weights(types: Sequence[str], type_weights: dict[str, float] | None) -> np.ndarray:
    """One weight a type: 1 without weights, with them 0 for a type that has none."""
    if type_weights is None:
        return np.ones(len(types))
    if unknown := set(type_weights) - set(types):
        raise ValueError(f"weights for unknown types: {sorted(unknown)}")
    return np.array([float(type_weights.get(t, 0.0)) for t in types])


def _packed(df: DataFrame, features: str, label: str, steps: int) -> DataFrame:
    """Blocks (step, x, y) of the rows that have features and a label, in a folder per step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(0)
        for b in batches:
            if not b.num_rows:
                continue
            y = np.asarray(b.column(1), np.int32)
            x = np.asarray(b.column(0).flatten(), np.float64).reshape(len(y), -1)
            step = rng.permutation(len(y)) % steps
            rows = [(k, x[step == k], y[step == k]) for k in range(min(steps, len(y)))]
            columns = [[k for k, _, _ in rows], [v.tobytes() for _, v, _ in rows], [v.tobytes() for _, _, v in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["step", "x", "y"])

    whole = F.col(features).isNotNull() & ~F.exists(F.col(features), lambda v: v.isNull() | F.isnan(v))
    rows = df.filter(whole & F.col(label).isNotNull()).select(F.col(features).cast("array<double>"), F.col(label).cast("int"))
    path = shared_path(df.sparkSession, "blocks")
    rows.mapInArrow(run, "step int, x binary, y binary").write.partitionBy("step").parquet(path)
    return df.sparkSession.read.schema("x binary, y binary, step int").parquet(path)


def _forward(x: np.ndarray, layers: tuple[Layer, Layer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden activations, logits, log-probabilities."""
    (w1, b1), (w2, b2) = layers
    hidden = np.maximum(x @ w1.T + b1, 0.0)
    logits = hidden @ w2.T + b2
    shifted = logits - logits.max(axis=1, keepdims=True)
    return hidden, logits, shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def loss_and_gradient(x: np.ndarray, y: np.ndarray, layers: tuple[Layer, Layer], weights: np.ndarray) -> np.ndarray:
    """[weighted loss, sum of weights, gradients of w1, b1, w2, b2], summed over the rows."""
    hidden, _, logp = _forward(x, layers)
    at, w = np.arange(len(y)), weights[y]
    off = np.exp(logp)
    off[at, y] -= 1.0
    off *= w[:, None]
    back = (off @ layers[1][0]) * (hidden > 0)
    parts = (back.T @ x, back.sum(axis=0), off.T @ hidden, off.sum(axis=0))
    return np.concatenate([[-(w * logp[at, y]).sum(), w.sum()], *(p.ravel() for p in parts)])


def _verdicts(x: np.ndarray, y: np.ndarray, layers: tuple[Layer, Layer], weights: np.ndarray, outside: int) -> np.ndarray:
    """[weighted loss, TP, FP, FN] of spans: a wrong type is both a false and a missed one."""
    _, logits, logp = _forward(x, layers)
    pred = logits.argmax(axis=1)
    loss = -(weights[y] * logp[np.arange(len(y)), y]).sum()
    return np.array([loss, *(float(v.sum()) for v in ((pred == y) & (y != outside), (pred != y) & (pred != outside), (pred != y) & (y != outside)))])


def _summed(blocks: DataFrame, size: int, width: int, part) -> np.ndarray:
    """The sum of ``part(x, y)`` over all blocks, added up in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                total += part(np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width), np.frombuffer(y.as_buffer(), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["p"])

    sums = blocks.select("x", "y").mapInArrow(run, "p binary").rdd.map(lambda r: np.frombuffer(r[0]))
    return sums.treeReduce(lambda a, b: a + b) if sums.getNumPartitions() else np.zeros(size)


class Adam:
    """Moments of the gradient; ``step`` gives the change of the weights."""

    def __init__(self, size: int, rate: float, decay=(0.9, 0.999), tiny=1e-8):
        self.rate, self.decay, self.tiny, self.t = rate, decay, tiny, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        a, b = self.decay
        self.mean = a * self.mean + (1 - a) * g
        self.square = b * self.square + (1 - b) * g * g
        return -self.rate * (self.mean / (1 - a**self.t)) / (np.sqrt(self.square / (1 - b**self.t)) + self.tiny)


def _layers(flat: np.ndarray, width: int, hidden: int, n_types: int) -> tuple[Layer, Layer]:
    cuts = np.cumsum([hidden * width, hidden, n_types * hidden])
    w1, b1, w2, b2 = np.split(flat, cuts)
    return (w1.reshape(hidden, width), b1), (w2.reshape(n_types, hidden), b2)


def fit_span_classifier(
    train: DataFrame, validation: DataFrame, types: Sequence[str], features="features", label="label", hidden=128,
    rate=1e-3, epochs=300, patience=5, steps=8, type_weights: dict[str, float] | None = None, outside=0, seed=42,
) -> Head:
    """Fit the head on ``train`` (features, label code) and keep the weights of the epoch with
    the best F1 on ``validation``, of equal ones the one with the smallest loss there.

    An epoch takes ``steps`` mini-batches, one job each.  It ends after ``epochs`` or when
    ``patience`` epochs bring nothing better.  ``type_weights`` (by name, 0 for a missing one)
    weigh the cross-entropy.  Rows with a null, or a null or NaN entry, are left out; without
    any training row it is an error, without validation rows F1 is 0 and the last epoch counts."""
    weights = align_weights(types, type_weights)
    blocks = _packed(train, features, label, steps)
    held = _packed(validation, features, label, 1)
    first = blocks.select(F.length("x").alias("x"), F.length("y").alias("y")).filter("y > 0").first()
    if first is None:
        raise ValueError("no training rows")
    width = first["x"] // 8 // (first["y"] // 4)
    rng = np.random.default_rng(seed)
    bound = lambda n, *shape: rng.uniform(-1 / np.sqrt(n), 1 / np.sqrt(n), shape).ravel()
    flat = np.concatenate([bound(width, hidden, width), bound(width, hidden), bound(hidden, len(types), hidden), bound(hidden, len(types))])
    adam, best = Adam(len(flat), rate), None
    history: list[tuple[float, float, float]] = []
    for epoch in range(epochs):
        lost = seen = 0.0
        for k in range(steps):
            layers = _layers(flat, width, hidden, len(types))
            total = _summed(blocks.filter(F.col("step") == k), len(flat) + 2, width, lambda x, y: loss_and_gradient(x, y, layers, weights))
            lost, seen = lost + total[0], seen + total[1]
            if total[1] > 0:
                flat = flat + adam.step(total[2:] / total[1])
        layers = _layers(flat, width, hidden, len(types))
        loss, tp, fp, fn = _summed(held, 4, width, lambda x, y: _verdicts(x, y, layers, weights, outside))
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        history.append((lost / seen if seen else 0.0, float(loss), float(f1)))
        if best is None or (f1, -loss) >= (best.f1, -history[best.epoch][1]):
            best = Head(*layers, epoch, float(f1))
        elif epoch - best.epoch >= patience:
            break
    best.history = history
    return best


def predict_types(head: Head, df: DataFrame, features="features") -> DataFrame:
    """Add ``predicted``, the code of the type with the highest logit, and its probability."""
    scored = score_spans(df, head.hidden, head.out, features)
    return scored.select(
        *df.columns, argmax(F.col("logits")).alias("predicted"), top_probability(F.col("logits")).alias("confidence")
    )
