"""Branch and bound over place, time and value against brute force, and how much of a crowded cell is met."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelink.operators import nearest_valid as nv
from brinelink.operators.nearest_valid import nearest_valid
from tests.test_nearest import EDGES, km

ALLOWED = {"t": 100, "v": 2.0}


def brute(queries, points, radius):
    out = {}
    for q, lat, lon, t, v in queries:
        best = None
        for plat, plon, pt, pv, tag in points:
            if pv is None or abs(pt - t) > ALLOWED["t"] or abs(pv - v) > ALLOWED["v"]:
                continue
            d = km(lat, lon, plat, plon)
            if d <= radius:
                key = (int(np.floor(d * 1e6 + 0.5)), pt, pv, tag, plat, plon)
                best = key if best is None or key < best else best
        if best is not None:
            out[q] = best
    return out


def found(spark, queries, points, radius, **kw):
    q = spark.createDataFrame(queries, "qid long, lat double, lon double, mid_t long, mid_v double")
    q = q.withColumns({"radius_km": F.lit(float(radius)), "part": F.lit(0).cast("long")})
    p = spark.createDataFrame(points, "lat double, lon double, t long, v double, tag long").withColumn("part", F.lit(0).cast("long"))
    return {r.qid: tuple(r.hit) for r in nearest_valid(q, p, ["t", "v", "tag"], ALLOWED, **kw).collect()}


def case(seed, n, m):
    rng = np.random.default_rng(seed)
    spots = EDGES + [(12.5, 7.5)] * 10

    def near(k, wide):
        lat, lon = spots[k % len(spots)]
        return float(np.clip(lat + rng.normal(0, wide), -90, 90)), float((lon + rng.normal(0, wide) + 180) % 360 - 180)

    time, value = lambda: int(rng.integers(0, 1000)), lambda: float(np.round(rng.uniform(30, 40), 1))
    queries = [(i, *near(i, 0.2), time(), value()) for i in range(n)]
    points = [(*near(i, 0.1), time(), value(), i) for i in range(m)]
    points += [(12.5, 7.5, time(), value(), m + i) for i in range(200)]  # one position
    points += [(12.5, 7.5, 500, 35.0, 10_000 + i) for i in range(50)]  # rows alike but for the tag
    points += [(12.5, 7.5, 500, None, 1)]
    return queries + [(n + 1, 12.5, 7.5, 500, 35.0), (n + 2, 0.0, 60.0, 500, 35.0)], points


@pytest.mark.parametrize("hot_cell", [1, 8, 10_000])
def test_same_as_brute_force(spark, hot_cell):
    queries, points = case(5, 80, 500)
    assert found(spark, queries, points, 40.0, hot_cell=hot_cell) == brute(queries, points, 40.0)


def test_limits_are_inclusive_and_ties_are_ordered(spark):
    points = [(10.0, 10.0, 400, 37.0, 3), (10.0, 10.0, 400, 37.0, 2), (10.0, 10.0, 600, 33.0, 1), (10.0, 10.0, 601, 35.0, 0), (10.0, 10.0, 500, 37.1, 0)]
    for hot_cell in (1, 100):
        assert found(spark, [(1, 10.0, 10.0, 500, 35.0)], points, 1.0, hot_cell=hot_cell) == {1: (0, 400, 37.0, 2, 10.0, 10.0)}


def test_a_crowded_cell_is_met_in_summaries(spark, monkeypatch):
    """All points in one cell: each query meets a few rows per round, however many points there are."""
    met = []
    cut = nv.cut_lineage

    def counted(df):
        out = cut(df)
        if "settled" in out.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(nv, "cut_lineage", counted)
    rng = np.random.default_rng(1)
    queries = [(i, 12.5 + 0.01 * i, 7.5, 100 * i, 30.0 + i) for i in range(10)]
    most = []
    for m in (2_000, 16_000):
        met.clear()
        spread = zip(rng.uniform(12, 13, m), rng.uniform(7, 8, m), rng.integers(0, 1000, m), rng.uniform(30, 40, m))
        points = [(float(a), float(b), int(t), float(v), i) for i, (a, b, t, v) in enumerate(spread)]
        assert found(spark, queries, points, 40.0, hot_cell=16) == brute(queries, points, 40.0)
        most.append(max(met))
    assert most[1] <= 2 * most[0] and most[1] <= 250 * len(queries)


def test_points_are_kept_once_and_rounds_leave_nothing(spark, monkeypatch):
    """Each point stays with one small cell, whatever the number of rounds, and the summaries of a round go with it."""
    met, kept = [], []
    measure, cut = nv._measure, nv.cut_lineage

    def counted(asked, located, *rest):
        met.append(located.count())
        return measure(asked, located, *rest)

    def noted(df):
        kept.append((cut(df), df.columns))
        return kept[-1][0]

    monkeypatch.setattr(nv, "_measure", counted)
    monkeypatch.setattr(nv, "cut_lineage", noted)
    rng = np.random.default_rng(2)
    m = 3_000
    queries = [(i, 12.5 + 0.01 * i, 7.5, 100 * i, 30.0 + i) for i in range(10)]
    spread = zip(rng.uniform(12, 13, m), rng.uniform(7, 8, m), rng.integers(0, 1000, m), rng.uniform(30, 40, m))
    points = [(float(a), float(b), int(t), float(v), i) for i, (a, b, t, v) in enumerate(spread)]
    assert found(spark, queries, points, 40.0, hot_cell=16) == brute(queries, points, 40.0)
    assert len(met) >= 6 and sum(met) <= 2 * m  # once for the bound, once for the hits
    rounds = [out.inputFiles() for out, columns in kept if "disc" in columns or "settled" in columns]
    assert len(rounds) >= 4 and not any(os.path.exists(f.removeprefix("file:")) for files in rounds for f in files)
