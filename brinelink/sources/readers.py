"""Readers for the observation tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelink.functions.quality import nan_to_null
from brinelink.sources.writers import path_exists

SAT_SCHEMA = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("oceanBasin", T.IntegerType()),
        T.StructField("sss", T.DoubleType()),
        T.StructField("preqc", T.IntegerType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("cycle_date", T.DateType()),
        T.StructField("cycle_hour", T.StringType()),
    ]
)
ARGO_SCHEMA = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("oceanBasin", T.IntegerType()),
        T.StructField("original_datetime", T.LongType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("depth", T.DoubleType()),
        T.StructField("salinity", T.DoubleType()),
        T.StructField("cycle_date", T.DateType()),
        T.StructField("cycle_hour", T.StringType()),
    ]
)
INDEX_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("wmo", T.LongType()),
        T.StructField("cyc", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("dac", T.StringType()),
    ]
)

def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    skip_bad_files: bool = False,
) -> DataFrame:
    """Parquet scan of named columns only, NaN turned into NULL.

    With ``skip_bad_files`` an unreadable or vanished file contributes no rows instead
    of failing the job.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if skip_bad_files:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    return nan_to_null(df)


def _cycles_between(df: DataFrame, start: date | None, end: date | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("cycle_date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("cycle_date") <= F.lit(end))
    return df


def read_sat_obs(
    spark: SparkSession,
    path: str,
    sensor: str,
    start: date | None = None,
    end: date | None = None,
    where: Column | None = None,
    skip_bad_files: bool = False,
) -> DataFrame:
    """Satellite observations of one sensor; sensor and dates prune partitions (both ends inclusive).

    ``where`` is applied to the columns as stored, so that plain comparisons such as those of
    ``profiles.usable_condition`` reach the Parquet scan.
    """
    here = F.col("sensor") == sensor
    df = read_partitioned(spark, path, SAT_SCHEMA, here if where is None else here & where, skip_bad_files)
    return _cycles_between(df, start, end)


def read_argo_obs(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    where: Column | None = None,
    skip_bad_files: bool = False,
) -> DataFrame:
    """In-situ observations, one row per depth level; ``where`` as in ``read_sat_obs``."""
    return _cycles_between(read_partitioned(spark, path, ARGO_SCHEMA, where, skip_bad_files), start, end)


def read_partitioned(
    spark: SparkSession, path: str, schema: T.StructType, where: Column | None = None, skip_bad_files: bool = False
) -> DataFrame:
    """Hive-partitioned tree; an absent tree gives no rows.

    Absent or unreadable files fail the job unless ``skip_bad_files`` says that they are to be
    left out; ``files_without_rows`` tells which those are.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    skip = str(skip_bad_files).lower()
    df = spark.read.schema(schema).option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip).parquet(path)
    return nan_to_null(df if where is None else df.where(where))


def files_without_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files under ``path`` that a read with ``skip_bad_files`` gets nothing from: path, length.

    They are damaged or empty. Only file names and row groups are read, no columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), "length")
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    gave = reader.parquet(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    return files.join(gave, "path", "left_anti")


def read_profile_index(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return index_in_range(read_table(spark, path, schema=INDEX_SCHEMA), start, end)


def index_in_range(index: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The seven index columns inside a date box, rows without a position dropped."""
    date_col = F.col("date")
    if start is not None:
        index = index.where(date_col >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        index = index.where(date_col <= F.lit(end).cast("timestamp_ntz"))
    return index.select("date", "latitude", "longitude", "wmo", "cyc", "file", "dac").dropna(
        subset=["latitude", "longitude"]
    )
