"""Fitting the four corrections and comparing them on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.models.linear import LinearModel, fit_constant, fit_linear
from brinelink.models.network import MAX_EPOCHS, Network, score, train_network
from brinelink.models.scaler import Scaler, fit_scaler
from brinelink.operators.features import FEATURE_COLUMNS, TARGET, add_features, add_residual

_SCALED = "_scaled"

# Names of the compared methods and of their prediction columns.
METHODS = {
    "raw": "pred_raw",
    "constant_bias": "pred_constant",
    "linear_regression": "pred_linreg",
    "ffann": "pred_ffann",
}
PREDICTION_COLUMNS = ["sat_lat", "sat_lon", "sat_sss", "sat_oceanBasin", TARGET, *METHODS.values()]


@dataclass(frozen=True)
class Corrections:
    """The fitted corrections; a few hundred numbers altogether."""

    scaler: Scaler
    offset: float
    linear: LinearModel
    network: Network | None


def fit_corrections(split: DataFrame, with_network: bool = True, max_epochs: int = MAX_EPOCHS) -> Corrections:
    """Fit everything on the train rows of a table with a ``partition`` column."""
    rows = add_residual(add_features(split))
    train = rows.where(F.col("partition") == "train")
    scaler = fit_scaler(train, FEATURE_COLUMNS)
    scaled = scaler.transform(rows, _SCALED)
    names = [f"{c}{_SCALED}" for c in FEATURE_COLUMNS]
    linear = fit_linear(scaled.where(F.col("partition") == "train"), names, TARGET)
    network = train_network(scaled, names, "residual", max_epochs=max_epochs) if with_network else None
    return Corrections(scaler, fit_constant(train), linear, network)


def apply_corrections(rows: DataFrame, fitted: Corrections) -> DataFrame:
    """Add the prediction column of every fitted method."""
    scaled = fitted.scaler.transform(add_features(rows), _SCALED)
    out = (
        scaled.withColumn("pred_raw", F.col("sat_sss"))
        .withColumn("pred_constant", F.col("sat_sss") - F.lit(fitted.offset))
        .withColumn("pred_linreg", fitted.linear.predict())
    )
    if fitted.network is not None:
        out = score(out, fitted.network, fitted.scaler)
    return out.drop(*[f"{c}{_SCALED}" for c in FEATURE_COLUMNS])


def available_methods(df: DataFrame) -> dict[str, str]:
    return {name: col for name, col in METHODS.items() if col in df.columns}
