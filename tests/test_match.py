from datetime import date, datetime, timedelta

import pytest

from brinelink.operators.enrich import attach_wmo, match_to_index
from brinelink.operators.match import build_matchups, first_match_per_profile, match_windowed
from brinelink.operators.profiles import argo_profiles, usable_sat
from brinelink.sources.cycles import list_cycles

T0 = datetime(2024, 1, 1)
SAT = "lat double, lon double, datetime timestamp_ntz, oceanBasin int, sss double, preqc int, cycle_date date, cycle_hour string"
ARGO = "lat double, lon double, oceanBasin int, original_datetime bigint, depth double, salinity double, cycle_date date, cycle_hour string"


def epoch(t):
    return int((t - datetime(1970, 1, 1)).total_seconds())


def cycle(k):
    t = T0 + timedelta(hours=6 * k)
    return t.date(), f"{t.hour:02d}"


def sat_row(lat, lon, hours, sss, k, preqc=0):
    return (lat, lon, T0 + timedelta(hours=hours), 1, sss, preqc, *cycle(k))


def argo_row(lat, lon, hours, salinity, k, depth=2.0, basin=1):
    return (lat, lon, basin, epoch(T0 + timedelta(hours=hours)), depth, salinity, *cycle(k))


def tables(spark, argo, sat):
    return spark.createDataFrame(argo, ARGO), spark.createDataFrame(sat, SAT)


def run(spark, argo, sat, **kw):
    return build_matchups(*tables(spark, argo, sat), "smap", **kw).collect()


def test_nearer_at_wrong_time_hides_within_a_cycle(spark):
    sat = [sat_row(0.0, 0.05, 17.0, 35.0, 2), sat_row(0.0, 0.2, 12.0, 35.1, 2)]
    assert run(spark, [argo_row(0.0, 0.0, 12.0, 35.0, 2)], sat) == []


def test_best_valid_hides_nothing(spark):
    sat = [sat_row(0.0, 0.05, 17.0, 35.0, 2), sat_row(0.0, 0.1, 12.0, 60.0, 2), sat_row(0.0, 0.2, 12.0, 35.1, 2), sat_row(0.0, 0.2, 12.5, 35.1, 1)]
    argo, sat = tables(spark, [argo_row(0.0, 0.0, 12.0, 35.0, 2), argo_row(0.0, 0.0, 12.0, 35.0, 9)], sat)
    cycles = list_cycles(argo, sat)
    rows = match_windowed(argo_profiles(argo), sat, cycles, mode="best_valid", window=1).collect()
    assert [(m.sat_sss, m.sat_datetime, m.cycle_hour) for m in rows if m.cycle_hour == cycle(2)[1]] == [(35.1, T0 + timedelta(hours=12.5), cycle(2)[1])]
    with pytest.raises(ValueError):
        match_windowed(argo_profiles(argo), sat, cycles, mode="other")


def test_levels_of_a_profile_in_many_files(spark):
    """Means must be the same numbers wherever they are used, whatever the order of the levels."""
    levels = [argo_row(0.0, 0.01 * p, 12.0, 35.0 + i / 7, 2, depth=0.1 + i / 3) for p in range(20) for i in range(13)]
    argo, sat = tables(spark, levels, [sat_row(0.0, 0.1, 12.0, 36.0, 2)])
    rows = match_windowed(argo_profiles(argo.repartition(17)), sat, list_cycles(argo, sat)).collect()
    assert len(rows) == 20


def test_other_cycle_is_not_hidden(spark):
    sat = [sat_row(0.0, 0.05, 17.0, 35.0, 2), sat_row(0.0, 0.2, 10.0, 35.1, 1)]
    (m,) = run(spark, [argo_row(0.0, 0.0, 12.0, 35.0, 2)], sat)
    assert m.sat_sss == 35.1 and (m.cycle_date, m.cycle_hour) == cycle(2)


def test_limits_are_inclusive(spark):
    argo = [argo_row(0.0, 0.0, 12.0, 30.0, 2)]
    assert len(run(spark, argo, [sat_row(0.0, 0.1, 15.0, 40.0, 2)])) == 1
    assert run(spark, argo, [sat_row(0.0, 0.1, 15.001, 40.0, 2)]) == []
    assert run(spark, argo, [sat_row(0.0, 0.1, 15.0, 40.1, 2)]) == []


def test_earliest_copy_is_kept_even_if_a_later_one_is_nearer(spark):
    argo = [argo_row(0.0, 0.0, 12.0, 35.0, k) for k in (1, 3, 6)]
    sat = [sat_row(0.0, 0.3, 11.0, 34.0, 2), sat_row(0.0, 0.1, 13.0, 36.0, 4)]
    (m,) = run(spark, argo, sat, window=1)
    assert (m.cycle_date, m.cycle_hour) == cycle(1) and m.sat_sss == 34.0
    every = match_every(spark, argo, sat, window=1)
    assert len(every) == 3  # cycle 5 does not exist, so cycle 6 still reaches cycle 4


def match_every(spark, argo, sat, **kw):
    a, s = tables(spark, argo, sat)
    return match_windowed(argo_profiles(a), usable_sat(s, "smap"), list_cycles(a, s), **kw).collect()


def test_window_counts_existing_cycles_only(spark):
    argo = [argo_row(0.0, 0.0, 12.0, 35.0, 2)]
    sat = [sat_row(0.0, 0.1, 12.0, 35.0, 30)]
    assert len(run(spark, argo, sat, window=1)) == 1
    assert run(spark, argo, sat, window=0) == []


def test_smaller_distance_wins_and_earlier_cycle_on_a_tie(spark):
    argo = [argo_row(0.0, 0.0, 12.0, 35.0, 2)]
    sat = [sat_row(0.0, 0.2, 12.0, 34.0, 1), sat_row(0.0, -0.2, 12.0, 36.0, 3), sat_row(0.0, 0.4, 12.0, 35.0, 2)]
    (m,) = run(spark, argo, sat)
    assert m.sat_sss == 34.0


def test_quality_range_and_missing_values(spark):
    argo = [argo_row(0.0, 0.0, 12.0, s, 2, depth=d) for s, d in ((35.0, 1.0), (35.4, 3.0), (float("nan"), 2.0), (0.1, 4.0), (39.0, 6.0))]
    sat = [sat_row(0.0, 0.01, 12.0, 35.0, 2, preqc=4), sat_row(0.0, 0.02, 12.0, 50.0, 2), sat_row(0.0, 0.2, 12.0, 35.0, 2)]
    from brinelink.functions.quality import nan_to_null

    a, s = tables(spark, argo, sat)
    (m,) = build_matchups(nan_to_null(a), s, "smap").collect()
    assert m.argo_salinity == pytest.approx(35.2) and m.argo_depth == pytest.approx(2.0) and m.sat_lon == 0.2


def test_dedup_prefers_smaller_basin_within_a_cycle(spark):
    argo = [argo_row(0.0, 0.0, 12.0, 35.0, 2, basin=b) for b in (4, 2)]
    a, s = tables(spark, argo, [sat_row(0.0, 0.1, 12.0, 35.0, 2)])
    every = match_windowed(argo_profiles(a), usable_sat(s, "smap"), list_cycles(a, s))
    assert every.count() == 2
    assert [m.argo_oceanBasin for m in first_match_per_profile(every).collect()] == [2]
    assert [m.argo_oceanBasin for m in build_matchups(a, s, "smap").collect()] == [2]


def test_crowded_satellite_cell_gives_the_same_matches(spark):
    argo = [argo_row(0.01 * i, 0.0, 12.0, 35.0, k) for i in range(20) for k in (1, 2)]
    sat = [sat_row(0.013 * (i % 17), 0.01 * (i % 13), 11.0 + 0.01 * i, 35.0 + 0.001 * i, 2) for i in range(200)]
    a, s = tables(spark, argo, sat)
    plain = sorted(map(str, build_matchups(a, s, "smap").collect()))
    assert plain and plain == sorted(map(str, build_matchups(a, s, "smap", hot_cell=4).collect()))


LOOKUP = "argo_lat double, argo_lon double, argo_datetime timestamp_ntz, wmo bigint, matched boolean"


def test_attach_keeps_rows_and_can_be_repeated(spark):
    m = spark.createDataFrame([(1.0, 2.0, T0, 35.0), (3.0, 4.0, T0, 36.0)], "argo_lat double, argo_lon double, argo_datetime timestamp_ntz, sat_sss double")
    lookup = spark.createDataFrame([(1.0, 2.0, T0, 77, True), (3.0, 4.0, T0, 88, False)], LOOKUP)
    once = attach_wmo(m, lookup)
    assert {(r.argo_lat, r.wmo) for r in attach_wmo(once, lookup).collect()} == {(1.0, 77), (3.0, None)}


def test_attach_refuses_an_ambiguous_key(spark):
    m = spark.createDataFrame([(1.0, 2.0, T0)], "argo_lat double, argo_lon double, argo_datetime timestamp_ntz")
    lookup = spark.createDataFrame([(1.0, 2.0, T0, 77, True), (1.0, 2.0, T0, 78, True)], LOOKUP)
    with pytest.raises(Exception, match="not unique"):
        attach_wmo(m, lookup).collect()


def test_index_match_keeps_every_profile(spark):
    profiles = spark.createDataFrame(
        [(0.0, 0.0, T0), (0.0, 0.0, T0 + timedelta(hours=1)), (50.0, 60.0, T0)],
        "argo_lat double, argo_lon double, argo_datetime timestamp_ntz",
    )
    index = spark.createDataFrame(
        [(T0 + timedelta(minutes=5), 0.0, 0.001, 1, 1, "a", "x"), (T0, 0.0, 5.0, 2, 1, "b", "x")],
        "date timestamp_ntz, latitude double, longitude double, wmo bigint, cyc bigint, file string, dac string",
    )
    rows = match_to_index(profiles, index).collect()
    got = {(r.argo_lat, r.argo_datetime): (r.wmo, r.matched) for r in rows}
    assert got == {(0.0, T0): (1, True), (0.0, T0 + timedelta(hours=1)): (1, False), (50.0, T0): (2, False)}


def test_cycle_listing_is_inclusive_and_ordered(spark):
    a, s = tables(spark, [argo_row(0.0, 0.0, 0.0, 35.0, k) for k in (0, 5, 9)], [sat_row(0.0, 0.0, 0.0, 35.0, 5)])
    rows = list_cycles(a, s, start=date(2024, 1, 1), end=date(2024, 1, 2)).orderBy("cycle_idx").collect()
    assert [(r.cycle_date, r.cycle_hour, r.cycle_idx) for r in rows] == [(*cycle(0), 1), (*cycle(5), 2)]


def test_copies_of_a_profile_are_searched_once(spark, monkeypatch):
    """Limits on the pair are searched per profile and searched cycle; copies then choose among the hits."""
    from brinelink.operators import match

    asked = []

    def record(queries, *args, search=match.nearest_valid, **kw):
        asked.append(queries.count())
        return search(queries, *args, **kw)

    monkeypatch.setattr(match, "nearest_valid", record)
    files = range(5, 14)
    sat = [sat_row(0.0, 0.3, 54.0, 35.0, 9), sat_row(0.0, 0.1, 53.0, 35.0, 8)]
    argo, sat = tables(spark, [argo_row(0.0, 0.0, 54.0, 35.0, k) for k in files], sat)
    profiles, cycles = argo_profiles(argo), list_cycles(argo, sat)
    got = match.match_windowed(profiles.unionByName(profiles), sat, cycles, mode="best_valid", window=4).collect()
    assert asked == [2]
    near = {cycle(k): 0.1 if abs(k - 8) <= 4 else 0.3 for k in files}
    assert sorted(((r.cycle_date, r.cycle_hour), r.sat_lon) for r in got) == sorted([*near.items()] * 2)
