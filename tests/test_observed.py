"""Counts taken in passing by the job that writes, and tables that stay as they were if a check fails."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brinelink.plans import index_match
from brinelink.sources.writers import observed, replace_table, write_table

T = datetime(2024, 1, 1)
KEY = "argo_lat double, argo_lon double, argo_datetime timestamp_ntz"


def _tables(spark, tmp_path, lookup_rows):
    path = str(tmp_path / "matchups")
    rows = [(float(i % 4), 0.0, T, i) for i in range(40)]
    write_table(spark.createDataFrame(rows, f"{KEY}, id int"), path)
    return path, spark.createDataFrame(lookup_rows, f"{KEY}, wmo long, matched boolean")


def test_counts_come_from_the_write(spark, tmp_path):
    lookup = [(0.0, 0.0, T, 7, True), (1.0, 0.0, T, 8, True), (2.0, 0.0, T, 9, False)]
    path, table = _tables(spark, tmp_path, lookup)
    assert index_match.attach_in_place(spark, path, table) == {"n_rows": 40, "n_known": 20, "n_floats": 2}
    # repeated, the step gives the same
    assert index_match.attach_in_place(spark, path, table) == {"n_rows": 40, "n_known": 20, "n_floats": 2}
    assert spark.read.parquet(path).where("wmo = 8").count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["matchups"]


def test_a_key_of_two_rows_leaves_the_table(spark, tmp_path):
    path, table = _tables(spark, tmp_path, [(0.0, 0.0, T, 7, True), (0.0, 0.0, T, 8, True)])
    with pytest.raises(Exception, match="not unique"):
        index_match.attach_in_place(spark, path, table)
    assert spark.read.parquet(path).columns == ["argo_lat", "argo_lon", "argo_datetime", "id"]


def test_a_refused_result_leaves_the_table(spark, tmp_path):
    path, _ = _tables(spark, tmp_path, [])
    half, seen = observed(spark.read.parquet(path).where("id < 20"), {"n": F.count(F.lit(1))})

    def refuse():
        raise ValueError(f"only {seen.get['n']}")

    with pytest.raises(ValueError, match="only 20"):
        replace_table(half, path, refuse)
    assert spark.read.parquet(path).count() == 40
    assert [p.name for p in tmp_path.iterdir()] == ["matchups"]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "matchups")
    write_table(spark.createDataFrame([], f"{KEY}, id int"), path)
    lookup = spark.createDataFrame([], f"{KEY}, wmo long, matched boolean")
    assert index_match.attach_in_place(spark, path, lookup) == {"n_rows": 0, "n_known": 0, "n_floats": 0}
