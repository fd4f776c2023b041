"""Train / validation / test splits by date and by instrument."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.operators.enrich import PROFILE_ID
from brinelink.operators.groups import spread_unknown

Windows = Mapping[str, tuple[date, date]]

# Default split windows, both ends inclusive; the gaps between them are embargo.
DEFAULT_WINDOWS: Windows = {
    "train": (date(2021, 1, 1), date(2022, 12, 31)),
    "val": (date(2023, 1, 15), date(2023, 6, 30)),
    "test": (date(2023, 7, 15), date(2023, 12, 31)),
}


def date_partition(day: Column, windows: Windows = DEFAULT_WINDOWS) -> Column:
    """Name of the window holding a day, NULL in an embargo gap or outside."""
    name = F.lit(None).cast("string")
    for part, (lo, hi) in windows.items():
        name = F.when(day.cast("date").between(F.lit(lo), F.lit(hi)), F.lit(part)).otherwise(name)
    return name


def split_by_date(df: DataFrame, windows: Windows = DEFAULT_WINDOWS, date_col: str = "cycle_date") -> DataFrame:
    """Add ``partition``; rows outside every window are dropped."""
    return df.withColumn("partition", date_partition(F.col(date_col), windows)).where(F.col("partition").isNotNull())


def owner_partition(df: DataFrame, windows: Windows = DEFAULT_WINDOWS, date_col: str = "cycle_date") -> DataFrame:
    """Per instrument: the window of its earliest in-window row (wmo, owner)."""
    names = F.array(*[F.lit(name) for name in windows])
    place = F.array_position(names, date_partition(F.col(date_col), windows))
    return (
        df.select(F.col("wmo").cast("long").alias("wmo"), place.alias("place"))
        .where(F.col("wmo").isNotNull() & F.col("place").isNotNull())
        .groupBy("wmo")
        .agg(F.min("place").alias("place"))
        .select("wmo", F.element_at(names, F.col("place").cast("int")).alias("owner"))
    )


def split_by_float(
    df: DataFrame,
    windows: Windows = DEFAULT_WINDOWS,
    date_col: str = "cycle_date",
    outside: str = "drop",
) -> DataFrame:
    """Date split in which all rows of an instrument follow its owner window.

    Rows of unknown instrument keep their date window.  ``outside`` says what happens to
    rows of an owned instrument that lie in no window: ``drop`` leaves them out,
    ``follow`` lets them join the owner's window.
    """
    if outside not in ("drop", "follow"):
        raise ValueError("outside must be 'drop' or 'follow'")
    if "wmo" not in df.columns:
        return split_by_date(df, windows, date_col)
    owners = owner_partition(df, windows, date_col).withColumnRenamed("wmo", "_k")
    key = spread_unknown(F.col("wmo"), *[c for c in PROFILE_ID if c in df.columns])
    naive = date_partition(F.col(date_col), windows)
    joined = df.withColumn("_naive", naive).withColumn("_k", key)
    if outside == "drop":
        joined = joined.where(F.col("_naive").isNotNull())
    return (
        joined.join(owners, "_k", "left")
        .withColumn("partition", F.coalesce("owner", "_naive"))
        .where(F.col("partition").isNotNull())
        .drop("_naive", "_k", "owner")
    )


def expanding_folds(
    start: date, first_train_days: int, val_days: int, embargo_days: int, folds: int
) -> list[tuple[int, date, date, date, date]]:
    """(fold, train_lo, train_hi, val_lo, val_hi) of an expanding-window cross-validation."""
    out = []
    for k in range(folds):
        train_hi = start + timedelta(days=first_train_days + k * val_days - 1)
        val_lo = train_hi + timedelta(days=embargo_days + 1)
        out.append((k, start, train_hi, val_lo, val_lo + timedelta(days=val_days - 1)))
    return out


def assign_folds(df: DataFrame, folds: list[tuple[int, date, date, date, date]], date_col: str = "cycle_date") -> DataFrame:
    """One row per (row, fold) the row takes part in, with ``fold`` and ``partition``.

    The folds are a handful of literals, so no join is needed.
    """
    day = F.col(date_col).cast("date")
    options = F.array(
        *[
            F.struct(
                F.lit(k).alias("fold"),
                F.when(day.between(F.lit(t0), F.lit(t1)), "train").when(day.between(F.lit(v0), F.lit(v1)), "val").alias("partition"),
            )
            for k, t0, t1, v0, v1 in folds
        ]
    )
    return (
        df.withColumn("_f", F.explode(options))
        .where(F.col("_f.partition").isNotNull())
        .select(*df.columns, "_f.fold", "_f.partition")
    )
