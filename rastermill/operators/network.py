"""Penalised networks trained by mini-batches whose gradients are summed by partition.

Rows are dealt once to the batches of an epoch and written by batch, so a step
reads one batch's files only.  Each task sums the gradient over its rows, Spark
adds the tasks' sums, and the driver keeps what is as large as the network: its
parameters and the solver's moments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.store import Scratch


@dataclass(frozen=True)
class Training:
    """alpha penalises half the sum of squared weights, by row; solver is adam, or sgd with momentum; batches is the number of steps of an epoch."""

    hidden: tuple[int, ...] = (20, 20, 20, 20, 20)
    alpha: float = 1e-4
    solver: str = "adam"
    learning_rate: float = 1e-3
    momentum: float = 0.9
    batches: int = 8
    epochs: int = 200
    tolerance: float = 1e-4
    patience: int = 10
    seed: int = 1

    def __post_init__(self):
        if self.solver not in ("adam", "sgd"):
            raise ValueError(f"unknown solver: {self.solver}")


def _layers(sizes: tuple[int, ...], parameters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's weights and offsets."""
    out, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((parameters[at : at + n * m].reshape(n, m), parameters[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def is_weight(sizes: tuple[int, ...]) -> np.ndarray:
    """Which parameters are weights; offsets aren't penalised."""
    return np.concatenate([np.concatenate([np.ones(n * m, bool), np.zeros(m, bool)]) for n, m in zip(sizes[:-1], sizes[1:], strict=True)])


def first_parameters(sizes: tuple[int, ...], seed: int) -> np.ndarray:
    """Uniform draws whose width falls with the ends a layer joins (after Glorot and Bengio)."""
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.uniform(-1, 1, n * m + m) * np.sqrt(6 / (n + m)) for n, m in zip(sizes[:-1], sizes[1:], strict=True)])


def log_odds(sizes: tuple[int, ...], parameters: np.ndarray, x: np.ndarray) -> np.ndarray:
    layers = _layers(sizes, parameters)
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x[:, 0]


def loss_and_gradient(sizes: tuple[int, ...], parameters: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows of the log-loss and of its gradient; y is 0 or 1."""
    layers, seen = _layers(sizes, parameters), [x]
    for k, (w, b) in enumerate(layers):
        z = seen[-1] @ w + b
        seen.append(np.maximum(z, 0.0) if k < len(layers) - 1 else z)
    odds = seen[-1][:, 0]
    loss = np.logaddexp(0.0, odds) - y * odds
    back = (1 / (1 + np.exp(-np.clip(odds, -700, 700))) - y)[:, None]
    parts = []
    for (w, _), value in zip(reversed(layers), reversed(seen[:-1]), strict=True):
        parts += [back.sum(0), (value.T @ back).ravel()]
        back = (back @ w.T) * (value > 0)
    return float(loss.sum()), np.concatenate(parts[::-1])


@dataclass(frozen=True)
class NetworkModel:
    """A trained network on standardised values, and the mean loss of each epoch."""

    sizes: tuple[int, ...]
    parameters: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    losses: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(log_odds(self.sizes, self.parameters, (x - self.mean) / self.scale), -700, 700)))


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _summed(rows: DataFrame, sums) -> np.ndarray:
    """A vector that `sums` makes of each batch of rows (x, y), added up within tasks and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                found = sums(_values(batch), batch.column(1).to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "value"])

    found = rows.select("x", "y").mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("k").to_numpy()] = found.column("value").to_numpy()
    return out


class Moments:
    """The solver's memory: adam's running means of gradients and their squares, or sgd's velocity."""

    def __init__(self, training: Training, n: int):
        self.training, self.turn, self.first, self.second = training, 0, np.zeros(n), np.zeros(n)

    def step(self, gradient: np.ndarray) -> np.ndarray:
        """What to add to the parameters."""
        t = self.training
        if t.solver == "sgd":  # looks ahead along the velocity (Nesterov)
            self.first = t.momentum * self.first - t.learning_rate * gradient
            return t.momentum * self.first - t.learning_rate * gradient
        self.turn += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        return -t.learning_rate * (self.first / (1 - 0.9**self.turn)) / (np.sqrt(self.second / (1 - 0.999**self.turn)) + 1e-8)


def train_network(rows: DataFrame, training: Training = Training(), values: str = "features", label: str = "label", scratch: Scratch | None = None) -> NetworkModel:
    """A network that tells label 1 from the rest in an array column of numbers.

    A row's batch hangs on its values and label, the order of batches on the
    seed; so reruns agree up to the order of sums.  Training ends after
    `epochs`, or once the mean loss has not fallen by `tolerance` for `patience`
    epochs.  Rows with null values or a null label are left out; no rows are an
    error.  Batches without rows are passed over.
    """
    scratch = scratch or Scratch(rows.sparkSession, "network")
    data = rows.where(F.col(values).isNotNull() & F.col(label).isNotNull()).select(F.col(values).cast("array<double>").alias("x"), (F.col(label) == 1).cast("double").alias("y"))
    data = data.withColumn("batch", F.pmod(F.xxhash64("x", "y"), F.lit(training.batches)).cast("int"))
    path = f"{scratch.path}/batches"
    data.repartition(F.col("batch"), F.pmod(F.xxhash64("y", "x"), F.lit(64))).write.partitionBy("batch").parquet(path)
    data = rows.sparkSession.read.schema(data.schema).parquet(path)
    moments = _summed(data, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        raise ValueError("no rows to train on")
    count, (total, squares) = moments[0], moments[1:].reshape(2, -1)
    mean = total / count
    scale = np.sqrt(np.maximum(squares / count - mean**2, 0.0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    sizes = (len(mean), *training.hidden, 1)
    parameters, penalised = first_parameters(sizes, training.seed), is_weight(sizes)
    memory, order = Moments(training, len(parameters)), np.random.default_rng(training.seed)
    losses, least, since = [], np.inf, 0
    for _ in range(training.epochs):
        loss = 0.0
        for k in order.permutation(training.batches).tolist():
            now = parameters

            def sums(x, y, now=now):
                value, gradient = loss_and_gradient(sizes, now, (x - mean) / scale, y)
                return np.concatenate([[len(x), value], gradient])

            found = _summed(data.where(F.col("batch") == k), sums)
            if len(found):
                loss += found[1] + training.alpha / 2 * (parameters[penalised] ** 2).sum()
                parameters = parameters + memory.step((found[2:] + training.alpha * parameters * penalised) / found[0])
        losses.append(loss / count)
        since = 0 if losses[-1] < least - training.tolerance else since + 1
        least = min(least, losses[-1])
        if since >= training.patience:
            break
    return NetworkModel(sizes, parameters, mean, scale, tuple(losses))


def with_probability(rows: DataFrame, model: NetworkModel, values: str = "features", output: str = "score") -> DataFrame:
    """Rows with the model's probability of label 1; null where there are no values."""
    spread = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(values))
            mask = ~column.is_valid().to_numpy(zero_copy_only=False)
            found = np.full(len(batch), np.nan)
            if not mask.all():
                x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape((~mask).sum(), -1)
                found[~mask] = spread.value.probability(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=mask)], names=[*batch.schema.names, output])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(output, DoubleType())]))
