"""Joins, profile aggregates, windows and the instrument lookup."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.operators import enrich, match, profiles, summaries
from brinelink.operators.groups import (
    attach_delayed,
    delayed_near_surface,
    files_to_fetch,
    known_with_file,
    label_membership,
)
from brinelink.operators.split import owner_partition, split_by_date
from brinelink.plans import index_match
from brinelink.plans.coverage import coverage_scan
from brinelink.plans.quality_report import quality_report
from brinelink.session import cut_lineage, shared_folder
from brinelink.sources.cycles import list_cycles
from brinelink.sources.writers import write_table
from checks import fixtures as fx
from checks import sqlparts as sp
from checks.registry import WINDOWS, check, describe_out, matchup_out, rnd, rounded, secs, text
from checks.sqlparts import CYCLES, LEVELS, PROFILES, cdate, chour, km, part, query, r


def _matchups(spark, sf, sensor="smap", window=4) -> DataFrame:
    return match.build_matchups(
        fx.argo_obs(spark, sf), fx.sat_obs(spark, sf, sensor), sensor, max_abs_diff=3.0, window=window
    )


def _inputs(spark, sf, sensor):
    argo, sat = fx.argo_obs(spark, sf), fx.sat_obs(spark, sf, sensor)
    cycles = cut_lineage(list_cycles(argo, sat))
    return profiles.argo_profiles(argo), profiles.usable_sat(sat, sensor), cycles


@check("J1_windowed_nearest", query(["sat", "argo"], sp.matched_parts("smap"), sp.matchup_select("best")))
def _(spark, sf):
    return matchup_out(match.match_windowed(*_inputs(spark, sf, "smap"), max_abs_diff=3.0))


@check("J1_windowed_nearest_window_0", query(["sat", "argo"], sp.matched_parts("smos", window=0), sp.matchup_select("best")))
def _(spark, sf):
    return matchup_out(match.match_windowed(*_inputs(spark, sf, "smos"), max_abs_diff=3.0, window=0))


@check("J1_windowed_nearest_best_valid", query(["sat", "argo"], sp.best_valid_parts("smap"), sp.matchup_select("best")))
def _(spark, sf):
    return matchup_out(match.match_windowed(*_inputs(spark, sf, "smap"), max_abs_diff=3.0, mode="best_valid"))


@check("J1_windowed_nearest_best_valid_crowded", query(["sat", "argo"], sp.best_valid_parts("smap"), sp.matchup_select("best")))
def _(spark, sf):
    """The same with every cell of two observations or more searched by bounds on place, time, value and cycle."""
    return matchup_out(match.match_windowed(*_inputs(spark, sf, "smap"), max_abs_diff=3.0, mode="best_valid", hot_cell=1))


@check("J1_windowed_nearest_crowded_cells", query(["sat", "argo"], sp.matched_parts("smap"), sp.matchup_select("best")))
def _(spark, sf):
    """The same with cells that count as crowded from two observations on, so that most queries walk down the grid."""
    return matchup_out(match.match_windowed(*_inputs(spark, sf, "smap"), max_abs_diff=3.0, hot_cell=1))


for _sensor in ("smap", "smos"):

    @check(f"J2_build_matchups_{_sensor}", query(["sat", "argo"], sp.matchup_parts(_sensor), sp.matchup_select("matchups")))
    def _(spark, sf, sensor=_sensor):
        return matchup_out(_matchups(spark, sf, sensor))

    _near = sp.nearest_parts(_sensor, 0, None)

    @check(
        f"J3_same_cycle_diagnostics_{_sensor}",
        query(
            ["sat", "argo"],
            _near,
            f"select {cdate()} as cycle_date, {chour()} as cycle_hour, cast(count(*) as bigint) as n_candidates, "
            "cast(count(*) filter (where abs(sss - salinity) > 3) as bigint) as n_gross_fail from hits h join cycles c on h.j = c.ci group by cyc",
        ),
    )
    def _(spark, sf, sensor=_sensor):
        pairs = match.same_cycle_nearest(*_inputs(spark, sf, sensor))
        return match.match_diagnostics(pairs, 3.0).select(text("cycle_date"), "cycle_hour", "n_candidates", "n_gross_fail")


@check("W1_first_match_per_profile", query(["sat", "argo"], sp.matchup_parts("smap"), sp.matchup_select("matchups")))
def _(spark, sf):
    every = match.match_windowed(*_inputs(spark, sf, "smap"), max_abs_diff=3.0)
    return matchup_out(match.first_match_per_profile(every))


_INDEX_OK = ("ix", "select * from idx where latitude is not null and longitude is not null")
_LOOKUP = [
    _INDEX_OK,
    ("asked", "select distinct argo_lat, argo_lon, argo_t from pairs"),
    ("ap", "select distinct argo_lat, argo_lon from asked"),
    ("ip", "select latitude, longitude, min({'t': t, 'wmo': wmo, 'cyc': prof_cyc, 'file': file, 'dac': dac}) as e from ix group by latitude, longitude"),
    (
        "np",
        "select argo_lat, argo_lon, min({'mm': cast(floor(d*1e6 + 0.5e0) as bigint), 'lat': latitude, 'lon': longitude, 'd': d}) as b from ("
        f"select *, {km('argo_lat', 'argo_lon', 'latitude', 'longitude')} as d from ap cross join ip) z group by argo_lat, argo_lon",
    ),
    (
        "lookup",
        "select *, dist_km <= 1 and time_delta_s <= 600 as matched from (select a.argo_lat, a.argo_lon, a.argo_t, e.wmo as wmo, e.cyc as cyc, e.file as file, e.dac as dac, e.t as index_t, "
        "b.d as dist_km, cast(abs(a.argo_t - e.t) as double) as time_delta_s "
        "from asked a join np using (argo_lat, argo_lon) join ip on b.lat = ip.latitude and b.lon = ip.longitude) z",
    ),
]


def _profiles(spark, sf):
    return enrich.unique_profiles(*[fx.pairs(spark, sf, s) for s in ("smap", "smos")])


def _lookup(spark, sf):
    return index_match.build_lookup(
        [fx.pairs(spark, sf, s) for s in ("smap", "smos")], fx.kept_index(spark, sf)
    )


@check(
    "J4_nearest_in_index",
    query(["pairs", "idx"], _LOOKUP, f"select argo_lat, argo_lon, argo_t, wmo, cyc, file, dac, index_t, {r('dist_km')} as dist_km, time_delta_s, matched from lookup"),
)
def _(spark, sf):
    found = enrich.match_to_index(_profiles(spark, sf), fx.kept_index(spark, sf))
    return found.select(
        "argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "wmo", "cyc", "file", "dac",
        secs("index_date").alias("index_t"), rnd("dist_km").alias("dist_km"), "time_delta_s", "matched",
    )


_ATTACHED = (
    "attached",
    "select p.sensor, p.argo_lat, p.argo_lon, p.argo_t, p.sat_sss, l.wmo from pairs p left join (select * from lookup where matched) l using (argo_lat, argo_lon, argo_t)",
)


@check("J5_attach_wmo", query(["pairs", "idx"], [*_LOOKUP, _ATTACHED], "select * from attached"))
def _(spark, sf):
    out = enrich.attach_wmo(fx.pairs_all(spark, sf), _lookup(spark, sf))
    return out.select("sensor", "argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "sat_sss", "wmo")


@check(
    "J5_attach_in_place",
    query(["pairs", "idx"], [*_LOOKUP, _ATTACHED], "select sensor, cast(count(*) as bigint) as n_rows, cast(count(wmo) as bigint) as n_known, cast(count(*) as bigint) as reported_rows, cast(count(wmo) as bigint) as reported_known from attached group by sensor"),
)
def _(spark, sf):
    """Each sensor's table rewritten with its instruments; the counts reported by the writing job beside those of the table."""
    lookup = _lookup(spark, sf)
    out = []
    for sensor in ("smap", "smos"):
        path = f"{shared_folder(spark)}/attached-{uuid.uuid4().hex}"
        write_table(fx.pairs(spark, sf, sensor), path)
        told = index_match.attach_in_place(spark, path, lookup)
        counted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.count("wmo").alias("n_known"))
        out.append(counted.select(F.lit(sensor).alias("sensor"), "*", F.lit(told["n_rows"]).cast("long").alias("reported_rows"), F.lit(told["n_known"]).cast("long").alias("reported_known")))
    return out[0].unionByName(out[1])


_SPLIT = ("sp", f"select *, {part()} as part from pairs")
_GROUP = (
    "grp",
    "select *, case when wmo is null then 'unknown' when exists (select 1 from sp t where t.sensor = sp.sensor and t.part = 'train' and t.wmo = sp.wmo) "
    "then 'seen' else 'unseen' end as float_group from sp where part = 'test'",
)


def labelled(spark, sf, sensor="smap"):
    split = split_by_date(fx.pairs(spark, sf, sensor), WINDOWS)
    return label_membership(split.where(F.col("partition") == "test"), split.where(F.col("partition") == "train"))


@check(
    "J6_membership_label",
    query(["pairs"], [_SPLIT, _GROUP], "select argo_lat, argo_lon, argo_t, cast(wmo as bigint) as wmo, float_group from grp where sensor = 'smap'"),
)
def _(spark, sf):
    return labelled(spark, sf).select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "wmo", "float_group")


_KNOWN = (
    "known",
    "select g.*, l.file from grp g join (select argo_lat, argo_lon, argo_t, file from lookup where file is not null) l using (argo_lat, argo_lon, argo_t) where float_group <> 'unknown'",
)


@check(
    "J7_known_floats_with_file",
    query(["pairs", "idx"], [*_LOOKUP, _SPLIT, _GROUP, _KNOWN], "select argo_lat, argo_lon, argo_t, cast(wmo as bigint) as wmo, float_group, file from known where sensor = 'smap'"),
)
def _(spark, sf):
    out = known_with_file(labelled(spark, sf), _lookup(spark, sf))
    return out.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "wmo", "float_group", "file")


DELAYED = (
    "delayed",
    "select * from (select file, avg(coalesce(psal_adjusted, psal)) as delayed_salinity, min(data_mode) as data_mode from del where pres <= 5 group by file) z where delayed_salinity is not null",
)


@check(
    "J8_attach_delayed_mode",
    query(
        ["pairs", "idx", "del"],
        [*_LOOKUP, _SPLIT, _GROUP, _KNOWN, DELAYED],
        f"select argo_lat, argo_lon, argo_t, file, data_mode, {r('delayed_salinity')} as delayed_salinity, {r('argo_salinity - delayed_salinity')} as discrepancy, "
        f"{r('abs(argo_salinity - delayed_salinity)')} as abs_discrepancy from known join delayed using (file) where sensor = 'smap'",
    ),
)
def _(spark, sf):
    rows = known_with_file(labelled(spark, sf), _lookup(spark, sf))
    out = attach_delayed(rows, delayed_near_surface(fx.delayed_profiles(spark, sf)))
    out = out.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "file", "data_mode", "delayed_salinity", "discrepancy", "abs_discrepancy")
    return rounded(out, "delayed_salinity", "discrepancy", "abs_discrepancy")


@check(
    "A1_profile_means",
    query(["argo"], [LEVELS, PROFILES], f"select {cdate()} as cycle_date, {chour()} as cycle_hour, lat, lon, t, oceanBasin, {r('salinity')} as salinity, {r('depth')} as depth from aprof"),
)
def _(spark, sf):
    out = profiles.argo_profiles(fx.argo_obs(spark, sf))
    out = out.select(text("cycle_date"), "cycle_hour", "lat", "lon", secs("datetime").alias("t"), "oceanBasin", "salinity", "depth")
    return rounded(out, "salinity", "depth")


@check(
    "A1b_profile_means_without_basin",
    query(
        ["argo"],
        [],
        f"select {cdate()} as cycle_date, {chour()} as cycle_hour, lat, lon, t, {r('avg(salinity)')} as salinity, {r('avg(depth)')} as depth "
        "from argo where salinity is not null and depth <= 5 group by cyc, lat, lon, t",
    ),
)
def _(spark, sf):
    from brinelink.functions.quality import near_surface

    lev = profiles.with_true_time(fx.argo_obs(spark, sf)).where(near_surface(F.col("depth")) & F.col("salinity").isNotNull())
    out = profiles.profile_means(lev, ["lat", "lon", "datetime"])
    out = out.select(text("cycle_date"), "cycle_hour", "lat", "lon", secs("datetime").alias("t"), "salinity", "depth")
    return rounded(out, "salinity", "depth")


@check(
    "A2_sat_cycle_summary",
    query(
        ["sat"],
        [],
        f"select {cdate()} as cycle_date, {chour()} as cycle_hour, min(sss) as sss_min, max(sss) as sss_max, {r('avg(sss)')} as sss_mean, "
        f"{r('stddev_pop(sss)')} as sss_std, cast(count(*) as bigint) as n, {r('median(sss)')} as sss_median from sat where sss is not null group by cyc",
    ),
)
def _(spark, sf):
    out = summaries.sat_cycle_summary(fx.sat_obs(spark, sf))
    return rounded(out, "sss_mean", "sss_std", "sss_median").withColumn("cycle_date", text("cycle_date"))


@check(
    "A3_argo_cycle_summary",
    query(
        ["argo"],
        [
            ("tot", "select cyc, cast(count(*) as bigint) as n_obs, cast(count(*) filter (where depth <= 5) as bigint) as n_near from argo group by cyc"),
            ("m", "select cyc, avg(salinity) as s, avg(depth) as d from argo where depth <= 5 and salinity is not null group by cyc, lat, lon, t"),
        ],
        f"select {cdate()} as cycle_date, {chour()} as cycle_hour, n_obs, n_near, {r('n_near*100e0/n_obs')} as pct_near, n_profiles, sal_min, sal_max, sal_mean, sal_std, "
        "depth_min, depth_max, depth_mean, sal_median from tot left join (select cyc, cast(count(*) as bigint) as n_profiles, "
        f"{r('min(s)')} as sal_min, {r('max(s)')} as sal_max, {r('avg(s)')} as sal_mean, {r('stddev_pop(s)')} as sal_std, "
        f"{r('min(d)')} as depth_min, {r('max(d)')} as depth_max, {r('avg(d)')} as depth_mean, {r('median(s)')} as sal_median from m group by cyc) z using (cyc)",
    ),
)
def _(spark, sf):
    out = summaries.argo_cycle_summary(fx.argo_obs(spark, sf))
    cols = ["pct_near", "sal_min", "sal_max", "sal_mean", "sal_std", "depth_min", "depth_max", "depth_mean", "sal_median"]
    return rounded(out, *cols).withColumn("cycle_date", text("cycle_date"))


def _sat_counts(sensor):
    ok = "preqc_smap = 0" if sensor == "smap" else "preqc_smos < 600"
    return (
        "cast(count(*) filter (where sss is not null) as bigint) as sat_raw, "
        f"cast(count(*) filter (where sss is not null and not ({ok})) as bigint) as sat_quality_fail, "
        f"cast(count(*) filter (where sss is not null and {ok} and sss not between 20 and 42) as bigint) as sat_range_fail, "
        f"cast(count(*) filter (where sss is not null and {ok} and sss between 20 and 42) as bigint) as sat_pass"
    )


_NEAR = "salinity is not null and depth <= 5 and t between 946684800 and 1893456000"
_ARGO_COUNTS = (
    f"cast(count(*) filter (where {_NEAR}) as bigint) as argo_raw, "
    f"cast(count(*) filter (where {_NEAR} and salinity not between 20 and 42) as bigint) as argo_range_fail, "
    f"cast(count(*) filter (where {_NEAR} and salinity between 20 and 42) as bigint) as argo_pass, "
    f"cast(count(distinct case when {_NEAR} and salinity between 20 and 42 then {{'c': cyc, 'a': lat, 'b': lon, 't': t, 'o': oceanBasin}} end) as bigint) as argo_profiles"
)

for _sensor in ("smap", "smos"):

    @check(f"A4_sat_funnel_{_sensor}", query(["sat"], [], f"select {cdate()} as cycle_date, {chour()} as cycle_hour, {_sat_counts(_sensor)} from sat group by cyc"))
    def _(spark, sf, sensor=_sensor):
        return summaries.sat_funnel(fx.sat_obs(spark, sf, sensor), sensor).withColumn("cycle_date", text("cycle_date"))


@check("A5_argo_funnel", query(["argo"], [], f"select {cdate()} as cycle_date, {chour()} as cycle_hour, {_ARGO_COUNTS} from argo group by cyc"))
def _(spark, sf):
    return summaries.argo_funnel(fx.argo_obs(spark, sf)).withColumn("cycle_date", text("cycle_date"))


def _totals_sql(sensor, gross):
    rates = {
        "sat_quality_fail_pct": "sat_quality_fail*100e0/sat_raw",
        "sat_range_fail_pct_of_raw": "sat_range_fail*100e0/sat_raw",
        "sat_range_fail_pct_of_good": "sat_range_fail*100e0/(sat_raw - sat_quality_fail)",
        "sat_pass_pct": "sat_pass*100e0/sat_raw",
        "sat_suspicious_pct": "(sat_quality_fail + sat_range_fail)*100e0/sat_raw",
        "argo_range_fail_pct": "argo_range_fail*100e0/argo_raw",
        "argo_pass_pct": "argo_pass*100e0/argo_raw",
        "gross_fail_pct": "gross_fail*100e0/candidates",
    }
    return query(
        ["sat", "argo"],
        [
            *sp.nearest_parts(sensor, 0, None),
            ("ts", f"select {_sat_counts(sensor)} from sat"),
            ("ta", f"select {_ARGO_COUNTS} from argo"),
            ("tp", f"select cast(count(*) as bigint) as candidates, cast(count(*) filter (where abs(sss - salinity) > {gross}) as bigint) as gross_fail from hits"),
        ],
        "select *, " + ", ".join(f"{r(e)} as {n}" for n, e in rates.items()) + ", candidates - gross_fail as final_pairs from ts cross join ta cross join tp",
    )


_RATES = [
    "sat_quality_fail_pct", "sat_range_fail_pct_of_raw", "sat_range_fail_pct_of_good", "sat_pass_pct",
    "sat_suspicious_pct", "argo_range_fail_pct", "argo_pass_pct", "gross_fail_pct",
]


@check("A6_funnel_totals", _totals_sql("smap", 3))
def _(spark, sf):
    argo, sat = fx.argo_obs(spark, sf), fx.sat_obs(spark, sf)
    pairs = match.same_cycle_nearest(*_inputs(spark, sf, "smap"))
    totals = summaries.funnel_totals(
        summaries.sat_funnel(sat, "smap"), summaries.argo_funnel(argo), match.match_diagnostics(pairs, 3.0)
    )
    return rounded(totals, *_RATES)


@check("D1_quality_report_smos", _totals_sql("smos", 3))
def _(spark, sf):
    report = quality_report(fx.argo_obs(spark, sf), fx.sat_obs(spark, sf, "smos"), "smos", max_abs_diff=3.0)
    return rounded(report, *_RATES)


_LOG = (
    "log",
    "select c.cyc, coalesce(np, 0) as n_profiles, coalesce(ns, 0) as n_sat, coalesce(nm, 0) as n_matches from cycles c "
    "left join (select cyc, cast(count(*) as bigint) as np from aprof group by cyc) using (cyc) "
    "left join (select cyc, cast(count(*) as bigint) as ns from satq group by cyc) using (cyc) "
    "left join (select cyc, cast(count(*) as bigint) as nm from best group by cyc) using (cyc)",
)


@check("A7_match_log", query(["sat", "argo"], [*sp.matched_parts("smap"), _LOG], f"select {cdate()} as cycle_date, {chour()} as cycle_hour, n_profiles, n_sat, n_matches from log"))
def _(spark, sf):
    rows, sat, cycles = _inputs(spark, sf, "smap")
    log = summaries.match_log(cycles, rows, sat, match.match_windowed(rows, sat, cycles, max_abs_diff=3.0))
    return log.withColumn("cycle_date", text("cycle_date"))


@check(
    "A7_match_totals",
    query(
        ["sat", "argo"],
        [*sp.matchup_parts("smap"), _LOG],
        "select cast(sum(n_profiles) as bigint) as n_profiles, cast(sum(n_sat) as bigint) as n_sat, cast(sum(n_matches) as bigint) as n_before_dedup, "
        "(select cast(count(*) as bigint) from matchups) as n_after_dedup from log",
    ),
)
def _(spark, sf):
    rows, sat, cycles = _inputs(spark, sf, "smap")
    every = cut_lineage(match.match_windowed(rows, sat, cycles, max_abs_diff=3.0))
    return summaries.match_totals(summaries.match_log(cycles, rows, sat, every), match.first_match_per_profile(every))


@check("A14_describe_distance", query(["sat", "argo"], sp.matchup_parts("smap"), f"select 'dist_km' as what, {sp.describe('d')} from matchups union all select 'time_delta_s' as what, {sp.describe('cast(abs(t - st) as double)')} from matchups"))
def _(spark, sf):
    m = cut_lineage(_matchups(spark, sf).select("dist_km", "time_delta_s"))
    parts = [summaries.describe(m, c).withColumn("what", F.lit(c)) for c in ("dist_km", "time_delta_s")]
    return describe_out(reduce(DataFrame.unionByName, parts))


@check(
    "D5_index_match_report",
    query(
        ["pairs", "idx"],
        _LOOKUP,
        f"select matched, {sp.describe('dist_km')}, (select cast(count(*) as bigint) from lookup) as n_profiles, {r('count(*)*100e0/(select count(*) from lookup)')} as pct from lookup group by matched",
    ),
)
def _(spark, sf):
    return rounded(describe_out(index_match.lookup_report(cut_lineage(_lookup(spark, sf)))), "pct")


@check("W2_distinct_profiles", query(["pairs"], [], "select distinct argo_lat, argo_lon, argo_t from pairs"))
def _(spark, sf):
    return _profiles(spark, sf).select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"))


_COVERAGE = "select distinct round_even(lat, 4) as lat, round_even(lon, 4) as lon, cast(t as double) as original_datetime_epoch from argo where depth <= 5 and lat is not null and lon is not null"
for _name in ("W3_distinct_rounded_profiles", "D4_coverage_scan"):

    @check(_name, query(["argo"], [], _COVERAGE))
    def _(spark, sf):
        return coverage_scan(fx.argo_obs(spark, sf))


@check(
    "W4_owner_partition",
    query(
        ["pairs"],
        [_SPLIT],
        "select wmo, owner from (select cast(wmo as bigint) as wmo, part as owner, row_number() over (partition by wmo order by case part when 'train' then 0 when 'val' then 1 else 2 end, cyc) as rn "
        "from sp where wmo is not null and part is not null and sensor = 'smap') z where rn = 1",
    ),
)
def _(spark, sf):
    return owner_partition(fx.pairs(spark, sf), WINDOWS)


@check("W5_distinct_files", query(["idx"], [], "select distinct file from idx"))
def _(spark, sf):
    return files_to_fetch(fx.profile_index(spark, sf))


@check("W6_cycle_order", query(["sat"], [], "select cyc as slot, row_number() over (order by cyc) as cycle_idx from (select distinct cyc from sat) z"))
def _(spark, sf):
    return list_cycles(fx.sat_all(spark, sf)).select("slot", "cycle_idx")
