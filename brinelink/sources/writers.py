"""Writing results, and replacing a table that is being read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, replacing what is there; parent folders are made."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """The long metrics table (one row per method and group) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def observed(df: DataFrame, measures: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that are taken in passing by the first job that reads all of it."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in measures.items()]), seen


def replace_table(df: DataFrame, path: str, accept: Callable[[], None] | None = None) -> None:
    """Overwrite ``path`` with a DataFrame that may read from it.

    The result is written beside the table, then the two folders change places, so a
    failed job leaves the table as it was. ``accept`` is called in between and may raise, which leaves the table as it was too.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    tag = uuid.uuid4().hex[:8]
    base = path.rstrip("/")
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (base, f"{base}.new-{tag}", f"{base}.old-{tag}"))
    df.write.parquet(fresh.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if accept is not None:
        try:
            accept()
        except BaseException:
            fs.delete(fresh, True)
            raise
    existed = fs.exists(target)
    if existed and not fs.rename(target, old):
        raise OSError(f"could not set aside {path}")
    if not fs.rename(fresh, target):
        if existed:
            fs.rename(old, target)
        raise OSError(f"could not put the new table in place of {path}")
    if existed:
        fs.delete(old, True)


def path_exists(spark, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
