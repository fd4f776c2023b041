"""Observation tables derived from the given tables, for checks and benchmarks.

Each table exists twice: as a DataFrame for the library and as SQL text for an
independent engine.  Coordinates are whole numbers divided once by a double, so both
give the same bits.  Every row of the source table yields rows here.

The DataFrames are written once per session to the shared folder and read from there, so
that queries scan columns, as they would an archive, instead of carrying the formulas of
the fixture into every filter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelink.functions.quality import in_range
from brinelink.operators.enrich import keep_index
from brinelink.operators.nearest import KeptPoints
from brinelink.session import prepare, shared_folder
from brinelink.sources.readers import index_in_range, read_table
from brinelink.sources.writers import path_exists, write_table

EPOCH_2024 = 1704067200

SQL = {
    "sat": """select cast(lat_c as double)/100e0 as lat,
  cast(case when lon_c < -18000 then lon_c+36000 when lon_c >= 18000 then lon_c-36000 else lon_c end as double)/100e0 as lon,
  t, cast(floor((t+10800)/21600e0) as bigint) as cyc, cast(site % 6 as int) as oceanBasin,
  case when ln=6 and ok % 11 = 0 then null when ok % 97 = 0 then 1.5e0 else cast(3000+q*10 as double)/100e0 end as sss,
  case when ln=7 then 4 else 0 end as preqc_smap, cast(case when ok % 5 = 0 then 999 else pk % 900 end as int) as preqc_smos
from (select l_partkey % 150 as site, l_orderkey as ok, l_partkey as pk, l_linenumber as ln, cast(l_quantity as bigint) as q,
  -7800 + ((l_partkey % 150)*370) % 15600 + ((l_orderkey % 9)-4)*5 as lat_c,
  -18000 + ((l_partkey % 150)*830) % 36000 + ((l_suppkey % 9)-4)*5 as lon_c,
  1704067200 + (l_orderkey*7919 + l_partkey*104729 + l_linenumber*31) % 2592000 as t from lineitem) x""",
    "prof": """select event_id as eid, 5900000+user_id as wmo, t, cast(floor((t+10800)/21600e0) as bigint) as hc, cast(site % 6 as int) as oceanBasin,
  cast((-7800 + (site*370) % 15600)*100 + event_id % 97 as double)/10000e0 as lat,
  cast((-18000 + (site*830) % 36000)*100 + event_id % 89 as double)/10000e0 as lon
from (select event_id, user_id, user_id % 150 as site, cast(floor(epoch(ts)) as bigint) as t from events) y""",
    "argo": """select p.eid, p.lat, p.lon, p.t, p.oceanBasin, p.hc + r.o as cyc, (p.hc + r.o)*21600 + (p.eid % 4)*5400 - 10800 as snapped,
  cast(l.depth as double) as depth,
  case when p.eid % 37 = 0 and l.depth = 3 then null when p.eid % 101 = 0 then 0.12e0 else cast(3000 + (p.eid % 50)*10 + l.depth as double)/100e0 end as salinity
from prof p cross join (values (-4),(-3),(-2),(-1),(0),(1),(2),(3),(4)) r(o) cross join (values (1),(3),(5),(7)) l(depth)""",
    "idx": """select wmo, eid as prof_cyc, concat('dac/', cast(wmo as varchar), '/', cast(eid as varchar), '.nc') as file,
  t + (eid % 3)*60 + case when eid % 41 = 0 then 1200 else 0 end as t,
  case when eid % 211 = 0 then null else lat + case when eid % 20 = 7 then 0.5e0 when eid % 53 = 0 then 0.02e0 else 0e0 end end as latitude, lon as longitude,
  case when wmo % 2 = 0 then 'east' else 'west' end as dac
from prof""",
    "del": """select concat('dac/', cast(p.wmo as varchar), '/', cast(p.eid as varchar), '.nc') as file, cast(l.pres as double) as pres,
  cast(3000 + (p.eid % 50)*10 + l.pres as double)/100e0 as psal,
  case when p.eid % 4 = 0 then null else cast(300000 + (p.eid % 50)*1000 + l.pres*100 + (p.eid % 7) - 3 as double)/10000e0 end as psal_adjusted,
  case when p.eid % 4 = 0 then 'R' when p.eid % 4 = 1 then 'A' else 'D' end as data_mode, cast(1 + p.eid % 3 as int) as psal_qc
from prof p cross join (values (1),(3),(5),(8)) l(pres)""",
}

_NEEDS = {"sat": [], "prof": [], "argo": ["prof"], "idx": ["prof"], "del": ["prof"]}


def ctes(*names: str) -> list[tuple[str, str]]:
    """Named SQL parts for the given fixtures, dependencies first."""
    out: list[tuple[str, str]] = []
    for name in names:
        for part in [*_NEEDS[name], name]:
            if all(part != seen for seen, _ in out):
                out.append((part, SQL[part]))
    return out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(prepare(spark), f"{sf}/{name}.parquet")


def _slot_columns(slot) -> list:
    hours = F.array(*[F.lit(h) for h in ("00", "06", "12", "18")])
    return [
        F.date_from_unix_date(F.floor(slot / 4).cast("int")).alias("cycle_date"),
        F.element_at(hours, (slot % 4 + 1).cast("int")).alias("cycle_hour"),
    ]


def _time(seconds):
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the table on first use, read it afterwards."""

    @functools.wraps(build)
    def load(spark: SparkSession, sf: str) -> DataFrame:
        app = prepare(spark).sparkContext.applicationId
        where = f"{shared_folder(spark)}/fixtures-{app}/{sf.strip('/').replace('/', '-')}/{build.__name__}"
        if not path_exists(spark, f"{where}/_SUCCESS"):
            write_table(build(spark, sf), where)
        return read_table(spark, where)

    return load


def _sat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Satellite rows with both sensors' quality values and the time in epoch seconds."""
    site = F.col("l_partkey") % 150
    ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    raw = table(spark, sf, "lineitem").select(
        site.alias("site"),
        (-7800 + (site * 370) % 15600 + (ok % 9 - 4) * 5).alias("lat_c"),
        (-18000 + (site * 830) % 36000 + (F.col("l_suppkey") % 9 - 4) * 5).alias("lon_c"),
        (EPOCH_2024 + (ok * 7919 + pk * 104729 + ln * 31) % 2592000).alias("t"),
        F.when((ln == 6) & (ok % 11 == 0), None)
        .when(ok % 97 == 0, F.lit(1.5))
        .otherwise((3000 + F.col("l_quantity").cast("long") * 10).cast("double") / 100.0)
        .alias("sss"),
        F.when(ln == 7, 4).otherwise(0).alias("preqc_smap"),
        F.when(ok % 5 == 0, 999).otherwise(pk % 900).cast("int").alias("preqc_smos"),
    )
    lon_c = F.col("lon_c")
    wrapped = F.when(lon_c < -18000, lon_c + 36000).when(lon_c >= 18000, lon_c - 36000).otherwise(lon_c)
    return raw.select(
        (F.col("lat_c").cast("double") / 100.0).alias("lat"),
        (wrapped.cast("double") / 100.0).alias("lon"),
        "t",
        (F.col("site") % 6).cast("int").alias("oceanBasin"),
        "sss",
        "preqc_smap",
        "preqc_smos",
    )


@stored
def sat_all(spark: SparkSession, sf: str) -> DataFrame:
    """Satellite rows with both sensors' quality values."""
    t = F.col("t")
    return _sat_rows(spark, sf).select(
        "lat", "lon", _time(t).alias("datetime"), "oceanBasin", "sss", "preqc_smap", "preqc_smos",
        *_slot_columns(F.floor((t + 10800) / 21600)),
    )


def sat_obs(spark: SparkSession, sf: str, sensor: str = "smap") -> DataFrame:
    other = {"smap": "preqc_smos", "smos": "preqc_smap"}[sensor]
    return sat_all(spark, sf).withColumnRenamed(f"preqc_{sensor}", "preqc").drop(other)


@stored
def prof(spark: SparkSession, sf: str) -> DataFrame:
    """One row per true profile."""
    eid, site = F.col("event_id"), F.col("user_id") % 150
    return table(spark, sf, "events").select(
        eid.alias("eid"),
        (5900000 + F.col("user_id")).alias("wmo"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
        F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) + 10800) / 21600).alias("hc"),
        (site % 6).cast("int").alias("oceanBasin"),
        (((-7800 + (site * 370) % 15600) * 100 + eid % 97).cast("double") / 10000.0).alias("lat"),
        (((-18000 + (site * 830) % 36000) * 100 + eid % 89).cast("double") / 10000.0).alias("lon"),
    )


@stored
def argo_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Nine cycle copies of every profile, four depth levels each."""
    eid, depth = F.col("eid"), F.col("level")
    levels = (
        prof(spark, sf)
        .withColumn("slot", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda o: F.col("hc") + o)))
        .withColumn("level", F.explode(F.array(*[F.lit(d) for d in (1, 3, 5, 7)])))
    )
    return levels.select(
        "lat",
        "lon",
        "oceanBasin",
        F.col("t").alias("original_datetime"),
        _time(F.col("slot") * 21600 + (eid % 4) * 5400 - 10800).alias("datetime"),
        depth.cast("double").alias("depth"),
        F.when((eid % 37 == 0) & (depth == 3), None)
        .when(eid % 101 == 0, F.lit(0.12))
        .otherwise((3000 + (eid % 50) * 10 + depth).cast("double") / 100.0)
        .alias("salinity"),
        *_slot_columns(F.col("slot")),
    )


def _file(wmo, eid):
    return F.concat(F.lit("dac/"), wmo.cast("string"), F.lit("/"), eid.cast("string"), F.lit(".nc"))


@stored
def profile_index(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("eid")
    moved = F.when(eid % 20 == 7, 0.5).when(eid % 53 == 0, 0.02).otherwise(0.0)
    return prof(spark, sf).select(
        _time(F.col("t") + (eid % 3) * 60 + F.when(eid % 41 == 0, 1200).otherwise(0)).alias("date"),
        F.when(eid % 211 != 0, F.col("lat") + moved).alias("latitude"),
        F.col("lon").alias("longitude"),
        "wmo",
        eid.alias("cyc"),
        _file(F.col("wmo"), eid).alias("file"),
        F.when(F.col("wmo") % 2 == 0, "east").otherwise("west").alias("dac"),
    )


_kept: dict[tuple[str, str], KeptPoints] = {}


def kept_index(spark: SparkSession, sf: str) -> KeptPoints:
    """The profile index as a bucketed table, made on first use."""
    key = (prepare(spark).sparkContext.applicationId, sf)
    if key not in _kept:
        _kept[key] = keep_index(index_in_range(profile_index(spark, sf)))
    return _kept[key]


@stored
def delayed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    eid, pres = F.col("eid"), F.col("level")
    return (
        prof(spark, sf)
        .withColumn("level", F.explode(F.array(*[F.lit(d) for d in (1, 3, 5, 8)])))
        .select(
            _file(F.col("wmo"), eid).alias("file"),
            pres.cast("double").alias("pres"),
            ((3000 + (eid % 50) * 10 + pres).cast("double") / 100.0).alias("psal"),
            F.when(
                eid % 4 != 0,
                (300000 + (eid % 50) * 1000 + pres * 100 + eid % 7 - 3).cast("double") / 10000.0,
            ).alias("psal_adjusted"),
            F.when(eid % 4 == 0, "R").when(eid % 4 == 1, "A").otherwise("D").alias("data_mode"),
            (1 + eid % 3).cast("int").alias("psal_qc"),
        )
    )


# A matchup-like table straight from the profiles: every profile once per sensor, with an
# instrument number that is missing for some and, for some, only appears late.
SQL["pairs"] = """select eid, sensor, argo_lat, argo_lon, argo_t, argo_oceanBasin, argo_salinity, argo_depth,
  case when sensor = 'smap' then argo_salinity + cast((eid*7) % 41 - 15 as double)/10e0 else argo_salinity + cast((eid*11) % 61 - 40 as double)/10e0 end as sat_sss,
  cast(lat_c as double)/100e0 as sat_lat, cast(case when lon_c < -18000 then lon_c + 36000 else lon_c end as double)/100e0 as sat_lon,
  argo_t + (eid % 7 - 3)*1500 as sat_t, case when eid % 83 = 0 then null else argo_oceanBasin end as sat_oceanBasin, cyc,
  case when wmo % 10 = 3 then null when wmo % 5 = 0 and cyc < 78976 then null else wmo end as wmo
from (select eid, s.sensor, lat as argo_lat, lon as argo_lon, t as argo_t, oceanBasin as argo_oceanBasin, wmo,
    cast(3000 + (eid % 50)*10 + 3 as double)/100e0 as argo_salinity, 3e0 as argo_depth, hc - 4 as cyc,
    -7800 + (((wmo - 5900000) % 150)*370) % 15600 + (eid % 9 - 4)*5 as lat_c,
    -18000 + (((wmo - 5900000) % 150)*830) % 36000 + (eid % 7 - 3)*5 as lon_c
  from prof cross join (values ('smap'),('smos')) s(sensor)) z"""
_NEEDS["pairs"] = ["prof"]


@stored
def pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    """Matchup rows of both sensors with a ``sensor`` column."""
    eid, wmo = F.col("eid"), F.col("wmo")
    site = (wmo - 5900000) % 150
    salinity = (3000 + (eid % 50) * 10 + 3).cast("double") / 100.0
    lon_c = -18000 + (site * 830) % 36000 + (eid % 7 - 3) * 5
    slot = F.col("hc") - 4
    rows = prof(spark, sf).withColumn("sensor", F.explode(F.array(F.lit("smap"), F.lit("smos"))))
    offset = F.when(F.col("sensor") == "smap", ((eid * 7) % 41 - 15).cast("double") / 10.0).otherwise(
        ((eid * 11) % 61 - 40).cast("double") / 10.0
    )
    return rows.select(
        "sensor",
        F.col("lat").alias("argo_lat"),
        F.col("lon").alias("argo_lon"),
        _time(F.col("t")).alias("argo_datetime"),
        F.col("oceanBasin").alias("argo_oceanBasin"),
        salinity.alias("argo_salinity"),
        F.lit(3.0).alias("argo_depth"),
        (salinity + offset).alias("sat_sss"),
        ((-7800 + (site * 370) % 15600 + (eid % 9 - 4) * 5).cast("double") / 100.0).alias("sat_lat"),
        (F.when(lon_c < -18000, lon_c + 36000).otherwise(lon_c).cast("double") / 100.0).alias("sat_lon"),
        _time(F.col("t") + (eid % 7 - 3) * 1500).alias("sat_datetime"),
        F.when(eid % 83 != 0, F.col("oceanBasin")).alias("sat_oceanBasin"),
        F.when((wmo % 10 == 3) | ((wmo % 5 == 0) & (slot < 78976)), None).otherwise(wmo).alias("wmo"),
        *_slot_columns(slot),
    )


def pairs(spark: SparkSession, sf: str, sensor: str = "smap") -> DataFrame:
    return pairs_all(spark, sf).where(F.col("sensor") == sensor).drop("sensor")


# Satellite rows with a truth the corrections can learn, their month stretched to the three
# years of the default split windows.
EPOCH_2021 = 1609459200
SQL["learn_all"] = """select *, sat_sss - 0.5e0 - 0.05e0*abs(sat_lat) - 0.3e0*sin(2e0*pi()*dayofyear(make_timestamp(sat_t*1000000))/365.25e0) + (sat_t % 7 - 3)*0.01e0 as argo_salinity,
  cast(floor((sat_t+10800)/21600e0) as bigint) as cyc
from (select lat as sat_lat, lon as sat_lon, sss as sat_sss, oceanBasin as sat_oceanBasin, 1609459200 + cast(floor((t - 1704067200)*73/2e0) as bigint) as sat_t
  from sat) z"""
SQL["learn"] = "select * from learn_all where sat_sss between 20 and 42"
_NEEDS["learn_all"] = ["sat"]
_NEEDS["learn"] = ["sat", "learn_all"]


def learnable(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that pass the library's range filter, as in every matchup table."""
    return learnable_all(spark, sf).where(in_range(F.col("sat_sss")))


@stored
def learnable_all(spark: SparkSession, sf: str) -> DataFrame:
    sat = _sat_rows(spark, sf)
    passed = F.col("t") - EPOCH_2024
    seconds = F.col("sat_t")
    season = F.sin(F.lit(2 * math.pi) * F.dayofyear(_time(seconds)) / 365.25)
    return sat.withColumn("sat_t", EPOCH_2021 + F.floor(passed * 73 / 2)).select(
        F.col("lat").alias("sat_lat"),
        F.col("lon").alias("sat_lon"),
        F.col("sss").alias("sat_sss"),
        _time(seconds).alias("sat_datetime"),
        F.col("oceanBasin").alias("sat_oceanBasin"),
        (F.col("sss") - 0.5 - 0.05 * F.abs("lat") - 0.3 * season + (seconds % 7 - 3) * 0.01).alias("argo_salinity"),
        *_slot_columns(F.floor((seconds + 10800) / 21600)),
    )
