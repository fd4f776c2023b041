"""Constant and linear corrections fitted from one pass of sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_constant(train: DataFrame, observed: str = "sat_sss", truth: str = "argo_salinity") -> float:
    """Mean offset of the observation on the training rows."""
    return float(train.agg(F.avg(F.col(observed) - F.col(truth))).first()[0])


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of products of every pair of columns: (i, j, value) with i <= j, plus an intercept.

    Index ``len(columns)`` is the constant 1.  Each task multiplies its batches and emits
    one small matrix; Spark adds the matrices up.  Rows with a missing value are left out.
    """
    columns = list(columns)
    k = len(columns) + 1
    upper = np.triu_indices(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns] + [np.ones(batch.num_rows)])
            x = x[np.isfinite(x).all(axis=1)]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype("int32")), pa.array(upper[1].astype("int32")), pa.array(total[upper])],
            names=["i", "j", "value"],
        )

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return (
        rows.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    )


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        """The prediction as an expression over the model's columns."""
        out = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            out = out + F.col(c) * F.lit(w)
        return out


def r_factor(df: DataFrame, columns: Sequence[str], fan_in: int = 64) -> np.ndarray:
    """The R of a QR decomposition of (1, columns) over all rows without a missing value.

    A tall matrix is factored block by block: what a block adds to the product is its own small R, so tasks hand on one R each and
    stacks of ``fan_in`` of them are factored again, until few are left for the driver. Nothing is squared on the way.
    """
    columns = list(columns)
    k = len(columns) + 1

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows)] + [c.to_numpy(zero_copy_only=False) for c in batch.columns])
            r = np.linalg.qr(np.vstack([r, x[np.isfinite(x).all(axis=1)]]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["r"])

    def of_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for batch in batches:
            for part in batch.column(0).to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(part).reshape(-1, k)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["r"])

    factors = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(of_rows, "r binary")
    tasks = df.sparkSession.sparkContext.defaultParallelism
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        factors = factors.repartition(tasks).mapInArrow(of_factors, "r binary")
    return np.linalg.qr(np.vstack([np.zeros((0, k)), *[np.frombuffer(bytes(row.r)).reshape(-1, k) for row in factors.collect()]]), mode="r")


def fit_linear(train: DataFrame, columns: Sequence[str], target: str) -> LinearModel:
    """Least squares with intercept; of several exact solutions the one of least norm.

    The constant is the first column, so what is left of R without its first row and column is the factor of the
    centred table, and the solution comes from it without the squares of the inputs. Columns are brought to
    one length first; only R (a few hundred numbers) reaches the driver.
    """
    columns = list(columns)
    k = len(columns)
    r = r_factor(train, [*columns, target])
    if not len(r) or r[0, 0] == 0:
        raise ValueError("a fit needs rows")
    means = r[0, 1:] / r[0, 0]
    rest = r[1:, 1:]
    size = np.linalg.norm(rest[:, :k], axis=0)
    noise = np.finfo(float).eps * max(r[0, 0] ** 2, k)
    used = size > noise * np.abs(r[0, 1 : k + 1])  # a constant column has nothing left
    weights = np.zeros(k)
    left, right = rest[:, :k][:, used], rest[:, k]
    # what is dependent is told at equal lengths; the least norm is that of the columns as given
    _, values, _ = np.linalg.svd(left / size[used], full_matrices=False)
    if used.any() and values[-1] > values[0] * noise:
        weights[used] = np.linalg.lstsq(left / size[used], right, rcond=noise)[0] / size[used]
    elif used.any():
        weights[used] = np.linalg.lstsq(left, right, rcond=noise)[0]
    return LinearModel(tuple(columns), tuple(map(float, weights)), float(means[k] - weights @ means[:k]))


def daily_sums(df: DataFrame, columns: Sequence[str], date_col: str = "cycle_date") -> tuple[np.ndarray, np.ndarray]:
    """Days, and for each the sums of products of (columns, 1) over its rows without a missing value.

    One scan; a task hands on one matrix per day it has met, and what reaches the driver grows with the calendar only.
    """
    columns = list(columns)
    k = len(columns) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            day = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]] + [np.ones(batch.num_rows)])
            known = np.isfinite(x).all(axis=1)
            for d in np.unique(day[known]):
                rows = x[known & (day == d)]
                total[d] = total.get(d, 0) + rows.T @ rows
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([m.ravel().tolist()])], names=["day", "sums"])

    day = F.unix_date(F.col(date_col).cast("date")).alias("day")
    rows = df.where(F.col(date_col).isNotNull()).select(day, *[F.col(c).cast("double").alias(c) for c in columns])
    sums = rows.mapInArrow(products, "day int, sums array<double>").select("day", F.posexplode("sums").alias("i", "v"))
    sums = sums.groupBy("day", "i").agg(F.sum("v").alias("v")).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    found = sorted(sums.select("day", "x.v").collect())
    return np.array([r.day for r in found]), np.array([r.v for r in found]).reshape(len(found), k, k)
