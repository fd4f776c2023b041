"""Counts merged from parts against one pass over the whole, and chunk totals that never open the rows."""

import shutil
from datetime import date

from pyspark.sql import functions as F

from brinelink.operators.mergeable import RELATIVE_ERROR, merged_counts, part_counts, read_counts
from brinelink.sources.backfill import backfill, chunk_totals


def test_parts_and_whole_agree_within_the_stated_error(spark):
    # every value stands in several parts, one part holds a third of all rows
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("part"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 90_000).alias("v"),
    )
    parts = part_counts(rows, ["part"], ["v"])
    exact = rows.agg(F.count_distinct("v")).first()[0]
    once = read_counts(merged_counts(parts, [], ["v"]), ["v"]).first()
    twice = read_counts(merged_counts(merged_counts(parts.withColumn("half", F.col("part") < 3), ["half"], ["v"]), [], ["v"]), ["v"]).first()
    whole = read_counts(part_counts(rows, [], ["v"]), ["v"]).first()
    for got in (once, twice, whole):
        assert got.n_rows == 300_000 and got.known_v == rows.where("v is not null").count()
        assert abs(got.n_v - exact) <= RELATIVE_ERROR * exact
    assert abs(once.n_v - sum(r.n_v for r in read_counts(parts, ["v"]).collect())) > RELATIVE_ERROR * exact  # they do not add up


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (None, "b")], "part int, v string")
    got = {r.part: (r.n_rows, r.known_v, r.n_v) for r in read_counts(part_counts(rows, ["part"], ["v"]), ["v"]).collect()}
    assert got == {1: (2, 0, 0), 2: (2, 2, 1), None: (1, 1, 1)}
    none = read_counts(merged_counts(part_counts(rows.limit(0), ["part"], ["v"]), [], ["v"]), ["v"]).first()
    assert (none.n_rows, none.known_v, none.n_v, none.known_pct_v) == (0, 0, 0, None)


def test_chunk_totals_after_the_rows_are_gone(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"2024-0{m}-0{d}", f"f{(m * d) % 5}" if d < 9 else None, 1.0) for m in range(1, 6) for d in range(1, 10)],
        "TIME string, PLATFORM_NUMBER string, PRES double",
    ).withColumn("TIME", F.to_timestamp("TIME"))
    path = str(tmp_path / "raw")
    for end in (date(2024, 2, 4), date(2024, 5, 31), date(2024, 5, 31)):
        backfill(rows, path, date(2024, 1, 1), end, months=2, counted=["PLATFORM_NUMBER"])
    shutil.rmtree(path)
    total = chunk_totals(spark, path, ["PLATFORM_NUMBER"]).first()
    assert (total.n_rows, total.known_PLATFORM_NUMBER, total.n_PLATFORM_NUMBER) == (45, 40, 5)
    early = chunk_totals(spark, path, ["PLATFORM_NUMBER"], last=date(2024, 2, 1)).first()
    assert (early.n_rows, early.known_PLATFORM_NUMBER) == (18, 16)
