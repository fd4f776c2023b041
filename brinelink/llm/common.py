"""What the operators share: reading tables, tables kept between jobs, and connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelink.session import shared_folder

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder, in a folder for each value of the columns ``by``, and read again.

    It cuts the lineage, survives lost executors and fixes what is not the same on each
    evaluation (row numbers, partition numbers). The files go when the program ends, those
    exchanged on the way soon after the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brinelink-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    # Spark deletes the shuffle files of a job on all machines once the driver has collected its plan
    spark._jvm.System.gc()
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a stored table that nothing reads any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if x[1] != df.stored_at]


def _clear() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None:
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the held-out fold: crc32 of its id as text. No id: not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Node and smallest node reachable, for every node of ``edges`` (a, b).

    Alternates two steps that both keep connectivity: each node hands its larger neighbours
    to its smallest one, then its smaller neighbours. Edges turn into stars around the
    smallest node after about log(n) rounds. Every step is an aggregate and a join on the
    node, so a node with very many edges is combined before the shuffle and split by the
    skew join.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return small.union(low.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        return row[0], row[1]

    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        last, edges = edges, stored(stars(edges), "edges")
        dropped(last)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
