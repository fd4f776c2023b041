"""The kept index: the same answers as a search from scratch, and its side of the join stays where it is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelink.operators.nearest import _cells_of_queries, _measure, keep_points, nearest_kept
from tests.test_nearest import EDGES, km


def points_of(rng, n):
    spots = [*EDGES, (12.5, 7.5), (12.5, 7.5)]
    rows = []
    for i in range(n):
        lat, lon = spots[i % len(spots)]
        rows.append((float(np.clip(lat + rng.normal(0, 0.05), -90, 90)), float((lon + rng.normal(0, 0.05) + 180) % 360 - 180)))
    return sorted(set(rows))


@pytest.mark.parametrize("hot_cell", [4, 1000])
def test_nearest_kept_against_brute_force(spark, hot_cell):
    rng = np.random.default_rng(2)
    points = [(a, b, f"e{i}") for i, (a, b) in enumerate(points_of(rng, 400))]
    queries = points_of(rng, 90)
    kept = keep_points(spark.createDataFrame(points, "lat double, lon double, entry string"), ["entry"], 0.25, hot_cell)
    assert kept.any_crowded == (hot_cell == 4)
    asked = spark.createDataFrame(queries, "lat double, lon double").withColumn("radius_km", F.lit(10.0))
    got = {(r.lat, r.lon): tuple(r.hit) for r in nearest_kept(asked, kept, hot_cell).collect()}
    want = {}
    for a, b in queries:
        near = [(int(np.floor(km(a, b, p, q) * 1e6 + 0.5)), p, q, e) for p, q, e in points if km(a, b, p, q) <= 10.0]
        if near:
            want[a, b] = min(near)
    assert got == want


def test_the_index_is_not_exchanged(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(a, b, 1) for a, b in points_of(rng, 200)], "lat double, lon double, entry int")
    kept = keep_points(points, ["entry"], 0.25, buckets=4)
    asked = points.select(F.lit(0).cast("long").alias("part"), "lat", "lon", F.lit(5.0).alias("radius_km"), F.monotonically_increasing_id().alias("qid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _measure(_cells_of_queries(asked, F.lit(0.25)), kept.table, ["cell"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept_side = plan[plan.index("SortMergeJoin"):]
    above_scan = kept_side[: kept_side.index("Bucketed: true")].rsplit("+- Exchange", 1)[-1] if "Bucketed: true" in kept_side else None
    assert above_scan is not None and plan.count("Exchange hashpartitioning") == 1  # the queries'
