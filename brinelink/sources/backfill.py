"""Resumable loading of raw profiles in chunks of whole months."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelink.operators.mergeable import merged_counts, part_counts, read_counts
from brinelink.session import cut_lineage
from brinelink.sources.writers import path_exists


def month_chunks(spark: SparkSession, start: date, end: date, months: int) -> DataFrame:
    """Half-open chunks (chunk_start, chunk_end) covering start's month up to and with ``end``."""
    first = F.trunc(F.lit(start), "month")
    starts = spark.range(1).select(
        F.explode(F.sequence(first, F.lit(end), F.make_ym_interval(F.lit(0), F.lit(months)))).alias("chunk_start")
    )
    chunk_end = F.least(F.add_months("chunk_start", months), F.date_add(F.lit(end), 1))
    return starts.select("chunk_start", chunk_end.alias("chunk_end"))


def chunk_of(time: Column, start: date, months: int) -> Column:
    """First day of the chunk holding a time, by month arithmetic instead of a range join."""
    first = start.replace(day=1)
    since = (F.year(time) - first.year) * 12 + F.month(time) - first.month
    return F.add_months(F.lit(first), (F.floor(since / months) * months).cast("int"))


def pending_rows(
    rows: DataFrame,
    start: date,
    end: date,
    months: int,
    done: DataFrame | None = None,
    time_col: str = "TIME",
    depth_col: str = "PRES",
    max_depth: float = 10.0,
) -> DataFrame:
    """Rows of the period and depth with their ``chunk_start``, those of finished chunks left out.

    ``done`` holds one row per finished chunk, so the anti join stays small.
    """
    day = F.col(time_col).cast("date")
    first = start.replace(day=1)
    inside = rows.where((day >= F.lit(first)) & (day <= F.lit(end)) & (F.col(depth_col) <= max_depth))
    chunked = inside.withColumn("chunk_start", chunk_of(F.col(time_col), start, months))
    return chunked if done is None else chunked.join(done.select("chunk_start"), "chunk_start", "left_anti")


def chunk_report(chunked: DataFrame, platform_col: str = "PLATFORM_NUMBER") -> DataFrame:
    """Rows and distinct instruments per chunk."""
    return chunked.groupBy("chunk_start").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(platform_col).alias("n_floats")
    )


def manifest(path: str) -> str:
    """Table of finished chunks beside the data: chunk_start, chunk_end, months."""
    return f"{path.rstrip('/')}_chunks"


def finished_chunks(spark: SparkSession, path: str, start: date, end: date, months: int) -> DataFrame | None:
    """Wanted chunks that an earlier run finished, up to the wanted end of each.

    A chunk that was written when the period ended earlier is not finished.
    """
    if not path_exists(spark, manifest(path)):
        return None
    done = spark.read.parquet(manifest(path))
    other = done.where(F.col("months") != months).select("months").first()
    if other is not None:
        raise ValueError(f"{path} holds chunks of {other.months} months, not of {months}")
    reached = done.groupBy("chunk_start").agg(F.max("chunk_end").alias("reached"))
    wanted = month_chunks(spark, start, end, months)
    return wanted.join(reached, "chunk_start").where("reached >= chunk_end").select("chunk_start", "chunk_end")


def counts_table(path: str) -> str:
    """Table of the counts of each chunk beside the data: chunk_start and ``mergeable.part_counts`` of its rows."""
    return f"{path.rstrip('/')}_counts"


def backfill(rows: DataFrame, path: str, start: date, end: date, months: int = 3, counted: Sequence[str] = (), **columns) -> None:
    """Write the chunks not yet finished under ``path``; each is replaced whole, the others stay.

    The chunks are recorded after their rows are in place, empty ones too, so a run that ends
    in between, or in the middle of a chunk's months, is made good by the next. Of the ``counted`` columns every chunk keeps
    mergeable counts, made from these columns of the files just written, for ``chunk_totals``.
    """
    spark = rows.sparkSession
    done = finished_chunks(spark, path, start, end, months)
    todo = pending_rows(rows, start, end, months, done, **columns)
    pending = month_chunks(spark, start, end, months)
    if done is not None:
        pending = pending.join(done.select("chunk_start"), "chunk_start", "left_anti")
    pending = cut_lineage(pending.withColumn("months", F.lit(months)))
    starts = [row.chunk_start for row in pending.select("chunk_start").collect()]  # a calendar of months
    if not starts:
        return
    (
        todo.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("chunk_start")
        .parquet(path)
    )
    if counted:
        written = spark.read.schema(todo.schema).parquet(path).where(F.col("chunk_start").isin(starts))
        (
            part_counts(written, ["chunk_start"], counted)
            .repartition("chunk_start")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("chunk_start")
            .parquet(counts_table(path))
        )
    pending.coalesce(1).write.mode("append").parquet(manifest(path))


def chunk_totals(
    spark: SparkSession, path: str, counted: Sequence[str], first: date | None = None, last: date | None = None
) -> DataFrame:
    """Totals over the chunks that start between ``first`` and ``last``: n_rows and, per column, known_<c>, n_<c> (distinct, within
    ``mergeable.RELATIVE_ERROR``) and known_pct_<c>. Only the counts of the chunks are read, never their rows."""
    parts = spark.read.parquet(counts_table(path))
    if first is not None:
        parts = parts.where(F.col("chunk_start") >= F.lit(first))
    if last is not None:
        parts = parts.where(F.col("chunk_start") <= F.lit(last))
    return read_counts(merged_counts(parts, [], counted), counted)
