"""Labels and joins on the instrument identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.functions.quality import MAX_DEPTH, near_surface
from brinelink.functions.scalars import prefer_adjusted
from brinelink.operators.enrich import PROFILE_ID


def spread_unknown(wmo: Column, *row: str) -> Column:
    """Join key that scatters rows of unknown instrument instead of sending all to one task.

    Such rows get negative keys, which no instrument has.
    """
    scatter = -1 - F.pmod(F.xxhash64(*row), F.lit(1 << 20).cast("long"))
    return F.coalesce(wmo.cast("long"), scatter)


def label_membership(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Add ``float_group``: seen (instrument has rows in train), unseen, or unknown."""
    in_train = train.select(F.col("wmo").cast("long").alias("_k")).dropna().distinct().withColumn("_in", F.lit(True))
    key = spread_unknown(F.col("wmo"), *[c for c in PROFILE_ID if c in rows.columns])
    joined = rows.withColumn("_k", key).join(in_train, "_k", "left")
    label = (
        F.when(F.col("wmo").isNull(), "unknown").when(F.col("_in").isNotNull(), "seen").otherwise("unseen")
    )
    return joined.withColumn("float_group", label).drop("_k", "_in")


def group_counts(rows: DataFrame) -> DataFrame:
    """Rows per ``float_group``."""
    return rows.groupBy("float_group").agg(F.count(F.lit(1)).alias("n"))


def files_to_fetch(lookup: DataFrame) -> DataFrame:
    """The profile files that a lookup or index names, each once."""
    return lookup.select("file").where(F.col("file").isNotNull()).distinct()


def known_with_file(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows of known instrument with the profile file of the lookup; rows without one are dropped."""
    files = lookup.select(*PROFILE_ID, "file").where(F.col("file").isNotNull())
    return rows.where(F.col("float_group") != "unknown").join(files, PROFILE_ID)


def delayed_near_surface(levels: DataFrame, max_depth: float = MAX_DEPTH) -> DataFrame:
    """Mean near-surface salinity per profile file, adjusted values preferred level by level.

    Files without a usable shallow value do not appear.
    """
    usable = levels.where(near_surface(F.col("pres"), max_depth)).withColumn(
        "value", prefer_adjusted(F.col("psal_adjusted"), F.col("psal"))
    )
    return (
        usable.groupBy("file")
        .agg(F.avg("value").alias("delayed_salinity"), F.min("data_mode").alias("data_mode"))
        .where(F.col("delayed_salinity").isNotNull())
    )


def attach_delayed(rows: DataFrame, delayed: DataFrame) -> DataFrame:
    """Add the delayed-mode value per file and the discrepancy; rows without one are dropped."""
    gap = F.col("argo_salinity") - F.col("delayed_salinity")
    return (
        rows.join(delayed, "file")
        .withColumn("discrepancy", gap)
        .withColumn("abs_discrepancy", F.abs(gap))
    )


def cross_tabulate(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with one column per value."""
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def tag_sensors(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack the tables of several sensors with a ``sensor`` column."""
    out = None
    for sensor, table in tables.items():
        tagged = table.withColumn("sensor", F.lit(sensor))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
