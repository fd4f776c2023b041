"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brinelink")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Put an existing session in the state the operators expect.

    Observation times carry no zone, so zone arithmetic is pinned to UTC.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every machine can reach.

    The cluster names it in spark.checkpoint.dir; on a single machine a folder of our own is
    taken where it does not, and removed at the end of the program.
    """
    global _own_folder
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that every machine can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="brinelink-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


_own_folder: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, used between the rounds of an
    iterative job. Later reads take the columns they need. The files go when the program ends, those
    exchanged on the way soon after the table is written."""
    return cut_in_parts(df)


def cut_in_parts(df: DataFrame, *by: str) -> DataFrame:
    """The same in a folder for each value of the columns ``by``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brinelink-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    # Spark deletes the shuffle files of a job on all machines once the driver has collected its plan
    spark._jvm.System.gc()
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(kept: DataFrame, part: str = "") -> None:
    """Removes a table that was kept so, or a ``part`` (column=value) of it, that nothing reads any more."""
    spark = kept.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{kept.stored_at}/{part}".rstrip("/"))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_written: list[tuple[SparkSession, str]] = []
