"""A small feed-forward network trained by full-batch gradients summed over Spark tasks.

The training rows stay with the executors as numpy blocks, dealt evenly to as many partitions as run at once.
Each epoch is a job of one stage: every task adds up the gradient of its blocks, the driver, which holds nothing but the
weights and the optimiser's moments, adds the tasks up in order and takes the step. A lost executor costs the blocks it
held, which are read again. (A barrier stage over many epochs was tried: an exchange between its tasks takes
a whole second, as they look for each other's messages once a second, against a tenth for the pass itself.)
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelink.models.scaler import Scaler

# Layer sizes and training settings.
HIDDEN = (32, 16)
LEARNING_RATE = 1e-3
MAX_EPOCHS = 300
PATIENCE = 20
MIN_IMPROVEMENT = 1e-6
SEED = 0

#: Rows whose layers are computed at once, which then stay in a core's cache.
SLICE = 1000

#: Sums of no more tasks (8 KB each) are added up by the driver, of more in a tree of tasks first.
FLAT_SUMS = 256

_log = logging.getLogger(__name__)


@dataclass
class Network:
    """Weights of the layers, first to last, each as (matrix, offset)."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    history: list[tuple[float, float]] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0.0)
        return x[:, 0]

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in self.layers for part in layer])

    def with_flat(self, values: np.ndarray) -> Network:
        layers, at = [], 0
        for w, b in self.layers:
            nw = values[at : at + w.size].reshape(w.shape)
            at += w.size
            nb = values[at : at + b.size].reshape(b.shape)
            at += b.size
            layers.append((nw, nb))
        return Network(layers)

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squared errors and its gradient over the rows given."""
        loss, total = 0.0, np.zeros(sum(w.size + b.size for w, b in self.layers))
        for at in range(0, len(y), SLICE):
            part, gradient = self._slice_gradient(x[at : at + SLICE], y[at : at + SLICE])
            loss += part
            total += gradient
        return loss, total

    def _slice_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        inputs, out = [], x
        for i, (w, b) in enumerate(self.layers):
            inputs.append(out)
            out = out @ w
            out += b
            if i < len(self.layers) - 1:
                np.maximum(out, 0.0, out=out)
        error = out[:, 0] - y
        back = 2.0 * error[:, None]
        ones = np.ones(len(y))
        parts: list[np.ndarray] = []
        for i in reversed(range(len(self.layers))):
            parts[:0] = [(inputs[i].T @ back).ravel(), ones @ back]
            if i:
                back = back @ self.layers[i][0].T
                back *= inputs[i] > 0
        return float(error @ error), np.concatenate(parts)

    def squared_error(self, x: np.ndarray, y: np.ndarray) -> float:
        """Sum of squared errors over the rows given."""
        loss = 0.0
        for at in range(0, len(y), SLICE):
            error = self.forward(x[at : at + SLICE]) - y[at : at + SLICE]
            loss += float(error @ error)
        return loss


def new_network(n_inputs: int, hidden: Sequence[int] = HIDDEN, seed: int = SEED) -> Network:
    """Uniform start in +-1/sqrt(inputs of the layer)."""
    rng = np.random.default_rng(seed)
    sizes = [n_inputs, *hidden, 1]
    layers = []
    for a, b in zip(sizes, sizes[1:]):
        reach = 1.0 / np.sqrt(a)
        layers.append((rng.uniform(-reach, reach, (a, b)), rng.uniform(-reach, reach, b)))
    return Network(layers)


def _blocks(rows: DataFrame, columns: Sequence[str], target: str, is_val: Column, tasks: int = 0):
    """Persisted RDD of (is_val, inputs, targets) blocks, one per Arrow batch and side, dealt to ``tasks`` partitions (0: as they come)."""
    width = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, y, val = np.column_stack(cols[:width]), cols[width], cols[width + 1].astype(bool)
            known = np.isfinite(x).all(axis=1) & np.isfinite(y)
            for side in (False, True):
                chosen = known & (val == side)
                if chosen.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([side]), pa.array([x[chosen].tobytes()]), pa.array([y[chosen].tobytes()])],
                        names=["val", "x", "y"],
                    )

    narrow = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("_y"), is_val.alias("_v"))
    packed = narrow.mapInArrow(pack, "val boolean, x binary, y binary")
    if tasks:
        packed = packed.repartition(tasks)
    return packed.rdd.map(
        lambda r: (r.val, np.frombuffer(bytes(r.x)).reshape(-1, width), np.frombuffer(bytes(r.y)))
    ).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(part: Iterator, network: Network) -> np.ndarray:
    """Gradient sum, train loss sum, train rows, validation loss sum and validation rows of some blocks."""
    size = network.flat().size
    total = np.zeros(size + 4)
    for val, x, y in part:
        if val:
            total[-2] += network.squared_error(x, y)
            total[-1] += len(y)
        else:
            loss, gradient = network.loss_gradient(x, y)
            total[:size] += gradient
            total[-4] += loss
            total[-3] += len(y)
    return total


def _one_pass(blocks, network: Network) -> np.ndarray:
    sums = blocks.mapPartitions(lambda part: [_sums(part, network)])
    if blocks.getNumPartitions() > FLAT_SUMS:
        return sums.treeReduce(np.add, depth=3)
    return np.sum(sums.collect(), axis=0)


@dataclass
class Descent:
    """Adam on the train loss with an early stop on the validation loss. ``take`` is one pass's sums further."""

    weights: np.ndarray
    learning_rate: float
    max_epochs: int
    patience: int
    step: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0
    loss: float = 0.0
    best: np.ndarray | None = None
    best_loss: float = float("inf")
    waited: int = 0
    done: bool = False
    history: list[tuple[float, float]] = field(default_factory=list)

    def take(self, total: np.ndarray) -> None:
        """Judge the last step by the sums at the weights it led to, then take the next one."""
        gradient, (loss, n_train, val_sum, n_val) = total[:-4], total[-4:]
        if self.step:
            val_loss = float(val_sum / n_val)
            self.history.append((self.loss, val_loss))
            if val_loss < self.best_loss - MIN_IMPROVEMENT:
                self.best, self.best_loss, self.waited = self.weights, val_loss, 0
            else:
                self.waited += 1
            if self.waited >= self.patience or self.step >= self.max_epochs:
                self.done = True
                return
        self.loss = float(loss / n_train)
        self.step += 1
        g = gradient / n_train
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        rate = self.learning_rate / (1 - 0.9**self.step)
        self.weights = self.weights - rate * self.first / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)


def mean_gradient(rows: DataFrame, columns: Sequence[str], target: str, network: Network) -> DataFrame:
    """Gradient of the mean squared error over ``rows`` at the given weights: i, value."""
    blocks = _blocks(rows, columns, target, F.lit(False))
    total = _one_pass(blocks, network)
    blocks.unpersist()
    return rows.sparkSession.createDataFrame([(i, float(g / total[-3])) for i, g in enumerate(total[:-4])], "i int, value double")


def train_network(
    rows: DataFrame,
    columns: Sequence[str],
    target: str,
    partition_col: str = "partition",
    hidden: Sequence[int] = HIDDEN,
    learning_rate: float = LEARNING_RATE,
    max_epochs: int = MAX_EPOCHS,
    patience: int = PATIENCE,
    seed: int = SEED,
    tasks: int | None = None,
) -> Network:
    """Fit on the 'train' rows, stop early on the 'val' rows, return the best weights met.

    Each pass gives both the gradient at the current weights and the validation loss of
    the step that led to them. ``tasks`` is the number of partitions of a pass, by default what the cluster runs
    at once. The history does not depend on it but for rounding.
    """
    chosen = rows.where(F.col(partition_col).isin("train", "val"))
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(chosen, columns, target, F.col(partition_col) == "val", tasks)
    network = new_network(len(columns), hidden, seed)
    descent = Descent(network.flat(), learning_rate, max_epochs, patience)
    try:
        total = _one_pass(blocks, network)
        if total[-3] == 0 or total[-1] == 0:
            raise ValueError("training needs rows in both 'train' and 'val'")
        began = time.time()
        descent.take(total)
        while not descent.done:
            descent.take(_one_pass(blocks, network.with_flat(descent.weights)))
        _log.info("%d epochs in %.1f s", len(descent.history), time.time() - began)
    finally:
        blocks.unpersist()
    fitted = network.with_flat(descent.weights if descent.best is None else descent.best)
    fitted.history = descent.history
    return fitted


def correction(network: Network, scaler: Scaler) -> Column:
    """Predicted residual as a vectorised column over unscaled inputs.

    Stateless, so it serves batch and streaming tables alike.
    """
    means, stds = np.array(scaler.means), np.array(scaler.stds)

    @F.pandas_udf("double")
    def residual(inputs: pd.DataFrame) -> pd.Series:
        x = inputs.to_numpy(dtype="float64", na_value=np.nan)
        y = network.forward((x - means) / stds)
        return pd.Series(y).where(np.isfinite(y))

    return residual(F.struct(*[F.col(c).cast("double").alias(c) for c in scaler.columns]))


def score(df: DataFrame, network: Network, scaler: Scaler, observed: str = "sat_sss", out: str = "pred_ffann") -> DataFrame:
    """Add the corrected value: the observation plus the predicted residual."""
    return df.withColumn(out, F.col(observed) + correction(network, scaler))


def network_frame(spark: SparkSession, network: Network, scaler: Scaler) -> DataFrame:
    """Weights and scaler as one row, ready to be written."""
    sizes = [network.layers[0][0].shape[0], *[w.shape[1] for w, _ in network.layers]]
    row = (list(scaler.columns), list(map(float, scaler.means)), list(map(float, scaler.stds)), sizes, network.flat().tolist())
    return spark.createDataFrame(
        [row],
        "columns array<string>, means array<double>, stds array<double>, layer_sizes array<int>, weights array<double>",
    )


def load_network(saved: DataFrame) -> tuple[Network, Scaler]:
    row = saved.first()
    shape = new_network(row.layer_sizes[0], row.layer_sizes[1:-1])
    return shape.with_flat(np.array(row.weights)), Scaler(tuple(row.columns), tuple(row.means), tuple(row.stds))
