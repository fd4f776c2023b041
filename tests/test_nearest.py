"""The cell join against brute force, on spread, crowded and awkward positions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelink.operators.enrich import nearest_position
from brinelink.operators.nearest import nearest

R = 6371.0


def km(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(1, a)))


EDGES = [(90.0, 0.0), (-90.0, 10.0), (89.9, 179.9), (89.9, 0.0), (-89.95, -90.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.99), (10.0, -179.99), (0.3, 0.0)]


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def brute(queries, points, radius):
    out = {}
    for q, part, lat, lon in queries:
        best = None
        for p, plat, plon, tag in points:
            d = km(lat, lon, plat, plon)
            if p == part and d <= radius:
                key = (int(np.floor(d * 1e6 + 0.5)), tag, plat, plon)
                best = key if best is None or key < best else best
        if best is not None:
            out[q] = best
    return out


def spark_nearest(spark, queries, points, radius, **kw):
    q = frame(spark, queries, "q long, part long, lat double, lon double").withColumn("radius_km", F.lit(float(radius)))
    p = frame(spark, points, "part long, lat double, lon double, tag long")
    return {r.q: tuple(r.hit) for r in nearest(q, p, ["tag"], **kw).collect()}


def spread_case(seed, n=150, m=400):
    rng = np.random.default_rng(seed)
    spots = EDGES + [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 30), rng.uniform(-180, 180, 30))]

    def near(k):
        lat, lon = spots[k % len(spots)]
        lat = float(np.clip(lat + rng.normal(0, 0.2), -90, 90))
        return lat, float((lon + rng.normal(0, 0.4) + 180) % 360 - 180)

    queries = [(i, int(i % 2), *near(i)) for i in range(n)] + [(n + i, 0, *e) for i, e in enumerate(EDGES)]
    points = [(int(i % 2), *near(i), i) for i in range(m)] + [(0, *e, m + i) for i, e in enumerate(EDGES)]
    return queries, points


@pytest.mark.parametrize("radius", [5.0, 50.0, 400.0])
def test_spread_positions(spark, radius):
    queries, points = spread_case(1)
    assert spark_nearest(spark, queries, points, radius) == brute(queries, points, radius)


def test_untouched_cells_are_left_out(spark):
    queries, points = spread_case(2)
    assert spark_nearest(spark, queries, points, 50.0) == brute(queries, points, 50.0)


@pytest.mark.parametrize("hot_cell", [1, 3, 20])
def test_crowded_cells_walk_down_the_grid(spark, hot_cell):
    rng = np.random.default_rng(hot_cell)
    points = [(0, 10 + float(a), 20 + float(b), i) for i, (a, b) in enumerate(rng.normal(0, 0.05, (300, 2)))]
    points += [(0, 10.2, 20.2, 1000 + i) for i in range(100)]  # copies of one position
    points += [(1, 89.99, float(b), 2000 + i) for i, b in enumerate(rng.uniform(-180, 180, 60))]
    points += [(1, -10.0, 180.0, 3000), (1, -10.0, -180.0, 3001)]
    queries = [(i, 0, 10 + float(a), 20 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.2, (60, 2)))]
    queries += [(100 + i, 1, 89.9, float(b)) for i, b in enumerate(rng.uniform(-180, 180, 20))]
    queries += [(200, 1, -10.0, 179.9), (201, 1, 90.0, 0.0), (202, 0, 10.2, 20.2)]
    found = spark_nearest(spark, queries, points, 50.0, hot_cell=hot_cell)
    assert found == brute(queries, points, 50.0)


def test_equal_distance_goes_to_smaller_payload(spark):
    points = [(0, 0.0, 0.1, 7), (0, 0.0, -0.1, 3), (0, 0.1, 0.0, 5)]
    found = spark_nearest(spark, [(1, 0, 0.0, 0.0)], points, 50.0)
    assert found[1][1] == 3


def test_exactly_on_the_radius(spark):
    lat = float(np.degrees(50.0 / R))
    assert 1 in spark_nearest(spark, [(1, 0, 0.0, 0.0)], [(0, lat - 1e-12, 0.0, 1)], 50.0)
    assert 1 not in spark_nearest(spark, [(1, 0, 0.0, 0.0)], [(0, lat + 1e-6, 0.0, 1)], 50.0)


@pytest.mark.parametrize("hot_cell", [2, 64])
def test_nearest_at_any_distance(spark, hot_cell):
    rng = np.random.default_rng(5)
    pos = [(float(a), float(b)) for a, b in zip(rng.uniform(-60, -20, 80), rng.uniform(100, 180, 80))]
    pos += [(-40.0 + float(a), 150.0 + float(b)) for a, b in rng.normal(0, 0.01, (60, 2))]
    ask = EDGES + [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))]
    ask += [pos[0], (pos[1][0] + 0.001, pos[1][1]), (-40.0, 150.0)]
    got = nearest_position(frame(spark, ask, "lat double, lon double"), frame(spark, pos, "lat double, lon double"), hot_cell)
    found = {(r.lat, r.lon): (r.near_lat, r.near_lon) for r in got.collect()}
    assert len(found) == len(set(ask))
    for a in ask:
        d = min(km(a[0], a[1], *p) for p in pos)
        assert abs(km(a[0], a[1], *found[a]) - d) < 1e-6


def test_what_a_join_meets_is_neither_kept_nor_sorted(spark, monkeypatch):
    """Points are kept once per position, and the smallest distance is combined in passing."""
    import brinelink.operators.nearest as nn

    kept = []

    def record(df, cut=nn.cut_lineage):
        out = cut(df)
        kept.append((df._jdf.queryExecution().executedPlan().toString(), out))
        return out

    monkeypatch.setattr(nn, "cut_lineage", record)
    queries = [(i, 0, 10.0 + i * 1e-3, 20.0) for i in range(40)]
    points = [(0, 10.2, 20.0 + (i % 3) * 0.01, i) for i in range(600)]
    assert spark_nearest(spark, queries, points, 50.0) == brute(queries, points, 50.0)
    located = [df for _, df in kept if "point" in df.columns]
    assert [df.count() for df in located] == [3]
    (least,) = [plan for plan, df in kept if df.columns == ["qid", "mm"]]
    assert "SortAggregate" not in least


def test_crowded_cells_are_walked_without_windows(spark, monkeypatch):
    import brinelink.operators.nearest as nn

    plans = []

    def record(df, cut=nn.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(nn, "cut_lineage", record)
    queries, points = [(i, 0, 10.0, 20.0 + i * 1e-3) for i in range(20)], [(0, 10.0 + i * 1e-3, 20.0, i) for i in range(30)]
    assert spark_nearest(spark, queries, points, 50.0, hot_cell=4) == brute(queries, points, 50.0)
    assert not any("Window" in p for p in plans)


def test_the_first_join_moves_no_place_in_double_precision(spark):
    """What is exchanged for the bound: keys, the query's number and limit, and two unit vectors of floats."""
    import brinelink.operators.nearest as nn

    queries = frame(spark, [(i, 0, 10.0 + i * 1e-3, 20.0) for i in range(40)], "qid long, part long, lat double, lon double").withColumn("radius_km", F.lit(50.0))
    points = frame(spark, [(0, 10.2, 20.0 + i * 0.01, i) for i in range(60)], "part long, lat double, lon double, tag long")
    h = F.lit(1.0)
    located = nn._locate_points(points, h, ["tag"])
    assert located.columns == ["part", "point", "cell"]  # the place in the grid follows from the point
    met = nn._chords(nn._cells_of_queries(queries, h), located)
    assert met.columns == ["qid", "chord"]
    measured = {r.qid: r.mm for r in nn._measure(nn._cells_of_queries(queries, h), located).groupBy("qid").agg(F.min("hit.mm").alias("mm")).collect()}
    bound = {r.qid: r.c for r in met.groupBy("qid").agg(F.min("chord").alias("c")).collect()}
    assert bound.keys() == measured.keys()
    for q, mm in measured.items():
        assert abs(2 * R * np.arcsin(np.sqrt(bound[q]) / 2) * 1e6 - mm) <= 2 * R * 1e6 * nn._SLACK_CHORD


def test_places_closer_than_single_precision(spark):
    """Points that single precision cannot tell apart, some at one distance and some just beyond the radius."""
    rng = np.random.default_rng(11)
    queries = [(i, 0, 40.0 + float(a), 140.0 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 1e-6, (30, 2)))]
    points = [(0, 40.0 + float(a), 140.0 + float(b), i) for i, (a, b) in enumerate(rng.normal(0, 2e-6, (120, 2)))]
    for radius, hot_cell in ((2e-4, 1000), (50.0, 8)):
        assert spark_nearest(spark, queries, points, radius, hot_cell=hot_cell) == brute(queries, points, radius)
