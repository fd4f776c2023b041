"""The list of six-hourly cycles and their running number."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinelink.functions.scalars import parse_cycle_path

# The hours a day is cut into.
CYCLE_HOURS = ("00", "06", "12", "18")


def cycle_slot(cycle_date: str = "cycle_date", cycle_hour: str = "cycle_hour") -> Column:
    """Six-hour slots since the epoch; orders cycles and joins as one number."""
    return F.unix_date(cycle_date).cast("long") * 4 + F.floor(F.col(cycle_hour).cast("int") / 6)


def list_cycles(*tables: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Cycles present in any of the tables: cycle_date, cycle_hour, slot, cycle_idx.

    Both ends are inclusive; hours other than the four are skipped.  ``cycle_idx`` is the
    position among the cycles that exist, so a gap in the archive does not count.  The
    ranked list holds one row per cycle of the archive (four a day), whatever the data size.
    """
    seen = None
    for table in tables:
        cycles = table.select("cycle_date", "cycle_hour").distinct()
        seen = cycles if seen is None else seen.unionByName(cycles)
    seen = seen.where(F.col("cycle_hour").isin(*CYCLE_HOURS)).distinct()
    if start is not None:
        seen = seen.where(F.col("cycle_date") >= F.lit(start))
    if end is not None:
        seen = seen.where(F.col("cycle_date") <= F.lit(end))
    slots = seen.withColumn("slot", cycle_slot())
    return slots.withColumn("cycle_idx", F.row_number().over(Window.orderBy("slot")).cast("long"))


def cycles_from_paths(paths: DataFrame, path_col: str = "path", start: date | None = None, end: date | None = None) -> DataFrame:
    """Cycle list out of a table of folder or file paths; malformed names are skipped."""
    day, hour = parse_cycle_path(F.col(path_col))
    parsed = paths.select(day.alias("cycle_date"), hour.alias("cycle_hour")).dropna()
    return list_cycles(parsed, start=start, end=end)


def cycles_from_folder(spark: SparkSession, root: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Cycle list of an archive tree ``<root>/<prefix>.YYYYMMDD/HH/...`` by its file names only."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    return cycles_from_paths(files, start=start, end=end)


def cycles_from_partitions(spark: SparkSession, *roots: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Cycle list of tables partitioned by ``cycle_date`` and ``cycle_hour``, by their file names only: no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    path = F.col("path")
    day = F.try_to_date(F.regexp_extract(path, r"/cycle_date=(\d{4}-\d{2}-\d{2})/", 1))
    hour = F.regexp_extract(path, r"/cycle_hour=(\d{2})/", 1)
    found = reader.load(list(roots)).select(day.alias("cycle_date"), hour.alias("cycle_hour"))
    return list_cycles(found.dropna(), start=start, end=end)


def with_cycle_idx(df: DataFrame, cycles: DataFrame) -> DataFrame:
    """Attach ``cycle_idx``; the cycle list is small by construction and is broadcast."""
    numbers = cycles.select("slot", "cycle_idx")
    return df.withColumn("slot", cycle_slot()).join(F.broadcast(numbers), "slot").drop("slot")
