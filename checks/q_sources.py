"""Scans, sources, sinks, filters and scalar functions."""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import functions as F

from brinelink.functions import geo
from brinelink.functions import quality as q
from brinelink.functions import scalars as sc
from brinelink.operators.groups import tag_sensors
from brinelink.operators.mergeable import RELATIVE_ERROR
from brinelink.operators.profiles import near_surface_levels, usable_sat, with_true_time
from brinelink.operators.summaries import distinct_and_rate
from brinelink.session import shared_folder
from brinelink.sources import backfill as bf
from brinelink.sources import readers as rd
from brinelink.sources import writers as wr
from brinelink.sources.cycles import cycles_from_folder, cycles_from_partitions, cycles_from_paths, list_cycles
from checks import fixtures as fx
from checks.registry import check, metrics_out, rnd, secs, text
from checks.sqlparts import CYCLES, LEVELS, SATQ, cdate, chour, metrics, query, r

SAT_COLS = "lat, lon, t, oceanBasin, sss"


def _sat_out(df):
    return df.select("lat", "lon", secs("datetime").alias("t"), "oceanBasin", "sss")


@check(
    "S1_cycle_listing",
    query(
        ["sat", "argo"],
        [CYCLES],
        f"select * from (select {cdate()} as cycle_date, {chour()} as cycle_hour, cyc as slot, row_number() over (order by cyc) as cycle_idx "
        f"from cycles where {cdate()} between '2024-01-05' and '2024-01-20') z",
    ),
)
def _(spark, sf):
    cycles = list_cycles(
        fx.sat_all(spark, sf), fx.argo_obs(spark, sf), start=date(2024, 1, 5), end=date(2024, 1, 20)
    )
    return cycles.select(text("cycle_date"), "cycle_hour", "slot", "cycle_idx")


def _temp(name: str, spark) -> str:
    return f"{shared_folder(spark)}/{name}-{os.getpid()}-{next(_serial)}"


_serial = iter(range(10**9))


@check(
    "S1_cycles_from_file_names",
    query(["sat"], [], f"select {cdate()} as cycle_date, {chour()} as cycle_hour, cyc as slot, row_number() over (order by cyc) as cycle_idx from (select distinct cyc from sat) z where {cdate()} <= '2024-01-20'"),
)
def _(spark, sf):
    """The archive as a tree of files; none of them is opened."""
    path = _temp("tree", spark)
    wr.write_table(fx.sat_all(spark, sf).repartition("cycle_date"), path, ["cycle_date", "cycle_hour"])
    cycles = cycles_from_partitions(spark, path, end=date(2024, 1, 20))
    return cycles.select(text("cycle_date"), "cycle_hour", "slot", "cycle_idx")


@check(
    "S4_damaged_file",
    query(["sat"], [], f"select {SAT_COLS}, preqc_smos as preqc from sat where {cdate()} between '2024-01-05' and '2024-01-09' and not ({cdate()} = '2024-01-07' and {chour()} = '06')"),
)
def _(spark, sf):
    """A cycle whose file is no Parquet gives no rows, all others are read."""
    path = _temp("damaged", spark)
    sat = fx.sat_obs(spark, sf, "smos").withColumn("sensor", F.lit("smos"))
    wr.write_table(sat.repartition("cycle_date"), path, ["sensor", "cycle_date", "cycle_hour"])
    sat.limit(1).select(F.lit("cut off").alias("value")).write.mode("overwrite").text(f"{path}/sensor=smos/cycle_date=2024-01-07/cycle_hour=06")
    back = rd.read_sat_obs(spark, path, "smos", date(2024, 1, 5), date(2024, 1, 9), skip_bad_files=True)
    return back.select("lat", "lon", secs("datetime").alias("t"), "oceanBasin", "sss", "preqc")


@check(
    "S2_sat_scan",
    query(["sat"], [], f"select {SAT_COLS}, preqc_smap as preqc from sat where {cdate()} between '2024-01-05' and '2024-01-20'"),
)
def _(spark, sf):
    path = _temp("sat_obs", spark)
    sat = fx.sat_obs(spark, sf).withColumn("sensor", F.lit("smap"))
    wr.write_table(sat.repartition("cycle_date"), path, ["sensor", "cycle_date", "cycle_hour"])
    back = rd.read_sat_obs(spark, path, "smap", date(2024, 1, 5), date(2024, 1, 20))
    return back.select("lat", "lon", secs("datetime").alias("t"), "oceanBasin", "sss", "preqc")


@check(
    "S3_argo_scan",
    query(["argo"], [], f"select lat, lon, t, oceanBasin, depth, salinity from argo where {cdate()} between '2024-01-10' and '2024-01-12'"),
)
def _(spark, sf):
    path = _temp("argo_obs", spark)
    wr.write_table(fx.argo_obs(spark, sf).repartition("cycle_date"), path, ["cycle_date", "cycle_hour"])
    back = rd.read_argo_obs(spark, path, date(2024, 1, 10), date(2024, 1, 12))
    return back.select("lat", "lon", F.col("original_datetime").alias("t"), "oceanBasin", "depth", "salinity")


@check(
    "S4_missing_tree_gives_no_rows",
    query(["sat"], [], "select cast(count(*) as bigint) as n_present, cast(0 as bigint) as n_absent from sat"),
)
def _(spark, sf):
    path = _temp("present", spark)
    wr.write_table(fx.sat_obs(spark, sf).withColumn("sensor", F.lit("smap")), path)
    present = rd.read_partitioned(spark, path, rd.SAT_SCHEMA).withColumn("there", F.lit(1))
    absent = rd.read_partitioned(spark, f"{path}-absent", rd.SAT_SCHEMA).withColumn("there", F.lit(0))
    return present.unionByName(absent).agg(
        F.count_if(F.col("there") == 1).alias("n_present"), F.count_if(F.col("there") == 0).alias("n_absent")
    )


@check("S5_column_projection", "select l_orderkey, l_quantity from lineitem")
def _(spark, sf):
    return rd.read_table(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_quantity"])


@check("S6_write_and_read_back", query(["pairs"], [], "select sensor, argo_lat, argo_lon, argo_t, sat_sss from pairs"))
def _(spark, sf):
    path = _temp("matchups", spark)
    wr.write_table(fx.pairs_all(spark, sf), path)
    return spark.read.parquet(path).select("sensor", "argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "sat_sss")


@check(
    "S7_replace_table_in_place",
    query(["pairs"], [], "select argo_lat, argo_lon, argo_t, sat_sss, cast(wmo as bigint) as wmo from pairs where sensor = 'smap'"),
)
def _(spark, sf):
    path = _temp("replace", spark)
    rows = fx.pairs(spark, sf)
    wr.write_table(rows.drop("wmo"), path)
    there = spark.read.parquet(path)
    known = rows.select("argo_lat", "argo_lon", "argo_datetime", "wmo")
    wr.replace_table(there.join(known, ["argo_lat", "argo_lon", "argo_datetime"], "left"), path)
    back = spark.read.parquet(path)
    return back.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "sat_sss", "wmo")


@check(
    "S8_metrics_json",
    query(["pairs"], [], f"select sensor, {metrics('sat_sss', 'argo_salinity')} from pairs group by sensor"),
)
def _(spark, sf):
    from brinelink.operators.metrics import error_metrics

    path = _temp("metrics", spark)
    wr.write_metrics_json(error_metrics(fx.pairs_all(spark, sf), "sat_sss", "argo_salinity", ["sensor"]), path)
    back = spark.read.schema("sensor string, n bigint, rmse double, bias double, corr double").json(path)
    return metrics_out(back)


@check(
    "S9_profile_index",
    query(
        ["idx"],
        [],
        "select t, latitude, longitude, wmo, prof_cyc as cyc, file, dac from idx where t between 1704412800 and 1705622400 and latitude is not null",
    ),
)
def _(spark, sf):
    index = rd.index_in_range(fx.profile_index(spark, sf), "2024-01-05", "2024-01-19")
    return index.select(secs("date").alias("t"), "latitude", "longitude", "wmo", "cyc", "file", "dac")


@check(
    "S10_month_chunks",
    """select cast(c as varchar) as chunk_start, cast(least(cast(c + interval 2 month as date), date '2024-02-01') as varchar) as chunk_end,
 cast((select count(*) from events where cast(ts as date) >= c and cast(ts as date) < least(cast(c + interval 2 month as date), date '2024-02-01')) as bigint) as n_rows
from (select cast(unnest(generate_series(timestamp '2023-05-01', timestamp '2024-01-31', interval 2 month)) as date) as c) z""",
)
def _(spark, sf):
    start, end = date(2023, 5, 17), date(2024, 1, 31)
    chunks = bf.month_chunks(spark, start, end, 2)
    raw = _raw(spark, sf)
    counts = bf.chunk_report(bf.pending_rows(raw, start, end, 2, max_depth=2.0))
    out = chunks.join(counts, "chunk_start", "left").na.fill(0, ["n_rows"])
    return out.select(text("chunk_start"), text("chunk_end"), "n_rows")


def _raw(spark, sf):
    """Raw profile levels: one shallow and one deep level per event."""
    events = fx.table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("PLATFORM_NUMBER"), F.col("ts").alias("TIME"),
        F.explode(F.array(F.lit(1.0), F.lit(9.0))).alias("PRES"),
    )


@check(
    "S10_backfill_resumed",
    """select chunk_start, cast(sum(n) as bigint) as n_rows, cast(count(*) as bigint) as n_floats from (
 select cast(date_trunc('month', ts) as date)::varchar as chunk_start, user_id, 2*count(*) as n from events
 where cast(ts as date) between date '2024-01-01' and date '2024-02-29' group by 1, 2) z group by 1""",
)
def _(spark, sf):
    path = _temp("raw", spark)
    raw = _raw(spark, sf)
    # the first run ends in the middle of a chunk, and the last is a repetition
    for end in (date(2024, 1, 10), date(2024, 1, 31), date(2024, 2, 29), date(2024, 2, 29)):
        bf.backfill(raw, path, date(2024, 1, 1), end, months=1)
    return bf.chunk_report(spark.read.parquet(path)).select(text("chunk_start"), "n_rows", "n_floats")


@check(
    "S10_totals_over_chunks",
    """with year as (select user_id, ts + to_months(cast(event_id % 12 as int)) as ts from events)
select 'half' as period, cast(2*count(*) as bigint) as n_rows, cast(2*count(user_id) as bigint) as n_known, true as distinct_as_stated from year where ts >= timestamp '2024-01-01' and ts < timestamp '2024-07-01'
union all select 'all', cast(2*count(*) as bigint), cast(2*count(user_id) as bigint), true from year where ts >= timestamp '2024-01-01' and ts < timestamp '2025-01-01'""",
)
def _(spark, sf):
    """Events spread over a year and loaded in two runs, the first ending within a chunk. The totals come from the counts kept by chunk; a
    distinct count of the rows tells whether they hold."""
    path, column = _temp("counted", spark), "PLATFORM_NUMBER"
    month = (F.col("event_id") % 12).cast("int")
    raw = fx.table(spark, sf, "events").select(
        F.col("user_id").alias(column), (F.col("ts") + F.make_ym_interval(F.lit(0), month)).alias("TIME"),
        F.explode(F.array(F.lit(1.0), F.lit(9.0))).alias("PRES"),
    )
    for end in (date(2024, 5, 10), date(2024, 12, 31)):
        bf.backfill(raw, path, date(2024, 1, 1), end, months=3, counted=[column])
    whole = spark.read.parquet(path)
    out = []
    for period, last, rows in (("half", date(2024, 6, 30), whole.where("month(chunk_start) < 7")), ("all", None, whole)):
        exact = rows.agg(F.count_distinct(column).alias("exact"))
        kept = bf.chunk_totals(spark, path, [column], last=last).join(exact, F.lit(True))
        close = F.abs(F.col(f"n_{column}") - F.col("exact")) <= F.col("exact") * RELATIVE_ERROR
        out.append(kept.select(F.lit(period).alias("period"), "n_rows", F.col(f"known_{column}").alias("n_known"), close.alias("distinct_as_stated")))
    return out[0].unionByName(out[1])


@check("F1_missing_salinity", query(["sat"], [], f"select {SAT_COLS} from sat where sss is not null"))
def _(spark, sf):
    return _sat_out(fx.sat_obs(spark, sf).where(F.col("sss").isNotNull()))


for _sensor in ("smap", "smos"):
    _rule = "preqc_smap = 0" if _sensor == "smap" else "preqc_smos < 600"

    @check(f"F2_quality_{_sensor}", query(["sat"], [], f"select {SAT_COLS}, preqc_{_sensor} as preqc from sat where {_rule}"))
    def _(spark, sf, sensor=_sensor):
        ok = fx.sat_obs(spark, sf, sensor).where(q.quality_pass(sensor, F.col("preqc")))
        return ok.select("lat", "lon", secs("datetime").alias("t"), "oceanBasin", "sss", "preqc")

    @check(f"F1_F2_F3_usable_{_sensor}", query(["sat"], [SATQ[_sensor]], f"select {SAT_COLS} from satq"))
    def _(spark, sf, sensor=_sensor):
        return _sat_out(usable_sat(fx.sat_obs(spark, sf, sensor), sensor))


@check("F3_valid_range", query(["sat"], [], f"select {SAT_COLS} from sat where sss between 31 and 34"))
def _(spark, sf):
    return _sat_out(fx.sat_obs(spark, sf).where(q.in_range(F.col("sss"), 31.0, 34.0)))


@check("F4_near_surface", query(["argo"], [], "select cyc as slot, depth, cast(count(*) as bigint) as n from argo where depth <= 5 group by cyc, depth"))
def _(spark, sf):
    from brinelink.sources.cycles import cycle_slot

    near = fx.argo_obs(spark, sf).where(q.near_surface(F.col("depth")))
    return near.groupBy(cycle_slot().alias("slot"), "depth").agg(F.count(F.lit(1)).alias("n"))


@check("F5_plausible_time", query(["prof"], [], "select lat, lon, t from prof where t between 1704844800 and 1705708800"))
def _(spark, sf):
    from datetime import datetime

    time = q.epoch_to_time(F.col("t"))
    return fx.prof(spark, sf).where(q.plausible_time(time, datetime(2024, 1, 10), datetime(2024, 1, 20))).select("lat", "lon", "t")


@check("F6_epoch_to_time", "select cast(o_orderkey as bigint) as k, strftime(make_timestamp((1704067200 + o_orderkey)*1000000), '%Y-%m-%d %H:%M:%S') as at from orders")
def _(spark, sf):
    orders = fx.table(spark, sf, "orders")
    time = q.epoch_to_time(fx.EPOCH_2024 + F.col("o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("k"), F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("at"))


@check("F7_gross_error", query(["pairs"], [], "select sensor, argo_lat, argo_lon, argo_t, sat_sss, argo_salinity from pairs where abs(sat_sss - argo_salinity) <= 1.55"))
def _(spark, sf):
    from brinelink.operators.match import gross_mismatch

    kept = fx.pairs_all(spark, sf).where(~gross_mismatch(1.55))
    return kept.select("sensor", "argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "sat_sss", "argo_salinity")


@check("F8_without_coordinates", query(["idx"], [], "select file, latitude, longitude from idx where latitude is not null and longitude is not null"))
def _(spark, sf):
    return rd.index_in_range(fx.profile_index(spark, sf)).select("file", "latitude", "longitude")


@check(
    "F9_matchup_schema",
    query(["pairs"], [], "select argo_lat, argo_lon, argo_t, argo_oceanBasin, sat_sss, sat_lat, sat_lon, sat_t from pairs where sensor = 'smos'"),
)
def _(spark, sf):
    p = fx.pairs(spark, sf, "smos")
    return p.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "argo_oceanBasin", "sat_sss", "sat_lat", "sat_lon", secs("sat_datetime").alias("sat_t"))


@check("F10_sensor_tag", query(["pairs"], [], "select sensor, argo_lat, argo_lon, sat_sss from pairs"))
def _(spark, sf):
    tagged = tag_sensors({s: fx.pairs(spark, sf, s) for s in ("smap", "smos")})
    return tagged.select("sensor", "argo_lat", "argo_lon", "sat_sss")


@check("F_all_near_surface_levels", query(["argo"], [LEVELS], "select cyc as slot, cast(count(*) as bigint) as n, " + r("sum(salinity)") + " as total from lev group by cyc"))
def _(spark, sf):
    from brinelink.sources.cycles import cycle_slot

    lev = near_surface_levels(fx.argo_obs(spark, sf))
    return lev.groupBy(cycle_slot().alias("slot")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("salinity")).alias("total"))


@check("U1_cycles_concatenated", query(["argo"], [], f"select {cdate()} as cycle_date, {chour()} as cycle_hour, cast(count(*) as bigint) as n from argo group by cyc"))
def _(spark, sf):
    return fx.argo_obs(spark, sf).groupBy("cycle_date", "cycle_hour").agg(F.count(F.lit(1)).alias("n")).select(text("cycle_date"), "cycle_hour", "n")


@check("U2_sensors_concatenated", query(["pairs"], [], "select sensor, cast(count(*) as bigint) as n, cast(count(wmo) as bigint) as n_wmo from pairs group by sensor"))
def _(spark, sf):
    both = tag_sensors({"smap": fx.pairs(spark, sf, "smap"), "smos": fx.pairs(spark, sf, "smos")})
    return both.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count("wmo").alias("n_wmo"))


@check("X1_radians", query(["sat"], [], f"select lat, {r('radians(lat)')} as rad from sat"))
def _(spark, sf):
    return fx.sat_obs(spark, sf).select("lat", rnd(F.radians("lat")).alias("rad"))


@check(
    "X2_haversine",
    query(["pairs"], [], f"select sensor, argo_lat, argo_lon, sat_lat, sat_lon, {r('2e0*6371e0*asin(sqrt(least(1e0, pow(sin(radians(sat_lat-argo_lat)/2e0),2) + cos(radians(argo_lat))*cos(radians(sat_lat))*pow(sin(radians(sat_lon-argo_lon)/2e0),2))))')} as km from pairs"),
)
def _(spark, sf):
    km = geo.haversine_km(F.col("argo_lat"), F.col("argo_lon"), F.col("sat_lat"), F.col("sat_lon"))
    return fx.pairs_all(spark, sf).select("sensor", "argo_lat", "argo_lon", "sat_lat", "sat_lon", rnd(km).alias("km"))


@check("X3_time_gap", query(["pairs"], [], "select sensor, argo_t, sat_t, cast(abs(argo_t - sat_t) as double) as gap_s from pairs"))
def _(spark, sf):
    p = fx.pairs_all(spark, sf)
    gap = sc.time_gap_s(F.col("argo_datetime"), F.col("sat_datetime"))
    return p.select("sensor", secs("argo_datetime").alias("argo_t"), secs("sat_datetime").alias("sat_t"), gap.alias("gap_s"))


_DOY = "2e0*pi()*dayofyear(make_timestamp(sat_t*1000000))/365.25e0"


@check("X4_yearly_cycle", query(["pairs"], [], f"select sat_t, {r(f'sin({_DOY})')} as doy_sin, {r(f'cos({_DOY})')} as doy_cos from pairs"))
def _(spark, sf):
    s, c = sc.yearly_cycle(F.col("sat_datetime"))
    return fx.pairs_all(spark, sf).select(secs("sat_datetime").alias("sat_t"), rnd(s).alias("doy_sin"), rnd(c).alias("doy_cos"))


@check("X5_longitude_cycle", query(["sat"], [], f"select lon, {r('sin(radians(lon))')} as lon_sin, {r('cos(radians(lon))')} as lon_cos from sat"))
def _(spark, sf):
    s, c = sc.longitude_cycle(F.col("lon"))
    return fx.sat_obs(spark, sf).select("lon", rnd(s).alias("lon_sin"), rnd(c).alias("lon_cos"))


@check(
    "X6_basin_one_hot",
    query(["pairs"], [], "select sat_oceanBasin, " + ", ".join(f"case when sat_oceanBasin = {i} then 1e0 else 0e0 end as basin_{i}" for i in range(6)) + " from pairs"),
)
def _(spark, sf):
    return fx.pairs_all(spark, sf).select("sat_oceanBasin", *[sc.one_hot(F.col("sat_oceanBasin"), i).alias(f"basin_{i}") for i in range(6)])


@check("X7_residual", query(["pairs"], [], f"select sensor, {r('argo_salinity - sat_sss')} as residual, {r('argo_salinity')} as restored from pairs"))
def _(spark, sf):
    res = sc.residual(F.col("argo_salinity"), F.col("sat_sss"))
    return fx.pairs_all(spark, sf).select("sensor", rnd(res).alias("residual"), rnd(sc.apply_residual(F.col("sat_sss"), res)).alias("restored"))


@check("X8_prefer_adjusted", query(["del"], [], "select file, pres, coalesce(psal_adjusted, psal) as value from del"))
def _(spark, sf):
    return fx.delayed_profiles(spark, sf).select("file", "pres", sc.prefer_adjusted(F.col("psal_adjusted"), F.col("psal")).alias("value"))


@check("X9_round_half_even", "select c_acctbal, round_even(floor(c_acctbal)/8e0, 2) as half from customer")
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_acctbal", sc.round_half_even(F.floor("c_acctbal") / 8, 2).alias("half"))


@check("X10_log10_count", f"select l_suppkey, cast(count(*) as bigint) - 590 as n, case when count(*) > 590 then {r('log10(count(*) - 590)')} end as log10_n from lineitem group by l_suppkey")
def _(spark, sf):
    counts = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) - 590).alias("n"))
    return counts.select("l_suppkey", "n", rnd(sc.log10_count(F.col("n"))).alias("log10_n"))


@check("X11_discrepancy", query(["pairs"], [], f"select sensor, {r('sat_sss - argo_salinity')} as d, {r('abs(sat_sss - argo_salinity)')} as abs_d from pairs"))
def _(spark, sf):
    d = F.col("sat_sss") - F.col("argo_salinity")
    return fx.pairs_all(spark, sf).select("sensor", rnd(d).alias("d"), rnd(F.abs(d)).alias("abs_d"))


@check(
    "X12_date_from_folder",
    """select distinct cast(cast(o_orderdate as date) as varchar) as cycle_date, lpad(cast((o_orderkey % 4)*6 as varchar), 2, '0') as cycle_hour from orders
 where o_orderpriority <> '1-URGENT'""",
)
def _(spark, sf):
    """An urgent order writes a malformed folder name, which must not become a cycle."""
    orders = fx.table(spark, sf, "orders")
    hour = F.lpad(((F.col("o_orderkey") % 4) * 6).cast("string"), 2, "0")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    bad = F.concat(F.lit("/archive/obs.2024x"), F.substring(day, 1, 3), F.lit("/"), hour, F.lit("/ocean/x.nc"))
    good = F.concat(F.lit("/archive/obs."), day, F.lit("/"), hour, F.lit("/ocean/x.nc"))
    paths = orders.select(F.when(F.col("o_orderpriority") == "1-URGENT", bad).otherwise(good).alias("path"))
    return cycles_from_paths(paths).select(text("cycle_date"), "cycle_hour")


@check("A13_float_counts", query(["pairs"], [], f"select cast(count(*) as bigint) as n_rows, cast(count(wmo) as bigint) as n_known, cast(count(distinct wmo) as bigint) as n_distinct, {r('avg(case when wmo is null then 0e0 else 100e0 end)')} as known_pct from pairs"))
def _(spark, sf):
    out = distinct_and_rate(fx.pairs_all(spark, sf), "wmo")
    return out.withColumn("known_pct", rnd("known_pct"))
