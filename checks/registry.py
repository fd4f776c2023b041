"""Collects the checked queries: a Spark callable and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelink.functions.scalars import micros
from checks import sqlparts as sp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WINDOWS = {
    name: (date.fromisoformat(lo), date.fromisoformat(hi))
    for name, (lo, hi) in {"train": sp.TRAIN, "val": sp.VAL, "test": sp.TEST}.items()
}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(value: Column | str, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + 2e-10, digits)


def secs(time: Column | str) -> Column:
    time = F.col(time) if isinstance(time, str) else time
    return F.floor(micros(time) / 1000000)


def text(col: str) -> Column:
    return F.col(col).cast("string").alias(col)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rnd(c) for c in cols})


def matchup_out(df: DataFrame) -> DataFrame:
    return df.select(
        "argo_lat",
        "argo_lon",
        secs("argo_datetime").alias("argo_t"),
        "argo_oceanBasin",
        rnd("argo_salinity").alias("argo_salinity"),
        rnd("argo_depth").alias("argo_depth"),
        "sat_sss",
        "sat_lat",
        "sat_lon",
        secs("sat_datetime").alias("sat_t"),
        "sat_oceanBasin",
        rnd("dist_km").alias("dist_km"),
        "time_delta_s",
        text("cycle_date"),
        "cycle_hour",
    )


def metrics_out(df: DataFrame) -> DataFrame:
    return rounded(df, "rmse", "bias", "corr")


def describe_out(df: DataFrame) -> DataFrame:
    return rounded(df, "mean", "std", "min", "max", "p25", "p50", "p75")
