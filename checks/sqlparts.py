"""SQL text shared by the oracle queries, written for plain brute-force evaluation."""

from __future__ import annotations

from checks.fixtures import ctes

# Split windows of the fixtures.
TRAIN = ("2024-01-01", "2024-01-14")
VAL = ("2024-01-16", "2024-01-20")
TEST = ("2024-01-22", "2024-01-27")


def r(expr: str, digits: int = 6) -> str:
    """Rounding that settles exact decimal ties the same way in both engines."""
    return f"round({expr} + 2e-10, {digits})"


def cdate(cyc: str = "cyc") -> str:
    return f"cast(date '1970-01-01' + cast(floor({cyc}/4e0) as int) as varchar)"


def chour(cyc: str = "cyc") -> str:
    return f"lpad(cast(({cyc} % 4)*6 as varchar), 2, '0')"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2e0*6371e0*asin(sqrt(least(1e0, pow(sin(radians({lat2}-{lat1})/2e0),2) + "
        f"cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2e0),2))))"
    )


def part(cyc: str = "cyc", windows=(TRAIN, VAL, TEST)) -> str:
    d = cdate(cyc)
    named = zip(("train", "val", "test"), windows)
    return "case " + " ".join(f"when {d} between '{lo}' and '{hi}' then '{name}'" for name, (lo, hi) in named) + " end"


def learn_part() -> str:
    """Default split windows, used by the stretched model fixture."""
    return part(windows=(("2021-01-01", "2022-12-31"), ("2023-01-15", "2023-06-30"), ("2023-07-15", "2023-12-31")))


def query(fixtures: list[str], parts: list[tuple[str, str]], final: str) -> str:
    named = ctes(*fixtures)
    seen = {name for name, _ in named}
    for name, text in parts:
        if name not in seen:
            named.append((name, text))
            seen.add(name)
    return "with " + ",\n".join(f"{n} as materialized ({t})" for n, t in named) + "\n" + final


SATQ = {
    "smap": ("satq", "select * from sat where sss is not null and preqc_smap = 0 and sss between 20 and 42"),
    "smos": ("satq", "select * from sat where sss is not null and preqc_smos < 600 and sss between 20 and 42"),
}
LEVELS = (
    "lev",
    "select * from argo where salinity is not null and depth <= 5 and salinity between 20 and 42 "
    "and t between 946684800 and 1893456000",
)
PROFILES = (
    "aprof",
    "select cyc, lat, lon, t, oceanBasin, avg(salinity) as salinity, avg(depth) as depth from lev "
    "group by cyc, lat, lon, t, oceanBasin",
)
CYCLES = (
    "cycles",
    "select cyc, row_number() over (order by cyc) as ci from (select cyc from sat union select cyc from argo)",
)


def nearest_parts(sensor: str, window: int, max_diff: float | None, max_km: float = 50.0, max_gap: int = 10800):
    """Valid nearest observation of every (profile, searched cycle)."""
    limit = "" if max_diff is None else f" and abs(sss - salinity) <= {max_diff}"
    return [
        SATQ[sensor],
        LEVELS,
        PROFILES,
        CYCLES,
        ("v", "select a.*, c.ci from aprof a join cycles c using (cyc)"),
        ("s", "select q.lat as slat, q.lon as slon, q.t as st, q.sss, q.oceanBasin as sb, c.ci as j from satq q join cycles c using (cyc)"),
        (
            "wanted",
            "select distinct lat, lon, t, oceanBasin, salinity, depth, ci + o as j from v "
            f"cross join (select unnest(range(-{window}, {window} + 1)) as o)",
        ),
        (
            "cand",
            f"select *, cast(floor(d*1e6 + 0.5e0) as bigint) as mm from (select w.*, s.slat, s.slon, s.st, s.sss, s.sb, {km('w.lat', 'w.lon', 's.slat', 's.slon')} as d "
            "from wanted w join s on w.j = s.j and s.slat between w.lat - 1 and w.lat + 1) z "
            f"where d <= {max_km}",
        ),
        (
            "hits",
            "select * from (select *, row_number() over (partition by lat, lon, t, oceanBasin, salinity, depth, j "
            "order by mm, st, sss, sb, slat, slon) as rn from cand) z "
            f"where rn = 1 and abs(t - st) <= {max_gap}{limit}",
        ),
    ]


def matched_parts(sensor: str, window: int = 4, max_diff: float = 3.0):
    """Best match of every (profile, cycle) row."""
    return nearest_parts(sensor, window, max_diff) + [
        (
            "best",
            "select * from (select h.*, v.cyc, row_number() over (partition by h.lat, h.lon, h.t, h.oceanBasin, h.salinity, h.depth, v.ci "
            "order by h.mm, h.j) as rn2 from hits h join v on h.lat = v.lat and h.lon = v.lon and h.t = v.t and h.oceanBasin = v.oceanBasin "
            f"and h.salinity = v.salinity and h.depth = v.depth and abs(v.ci - h.j) <= {window}) z where rn2 = 1",
        )
    ]


def best_valid_parts(sensor: str, window: int = 4, max_diff: float = 3.0, max_gap: int = 10800):
    """Nearest of all observations that pass the limits, for every (profile, cycle) row."""
    return [part for part in nearest_parts(sensor, window, max_diff) if part[0] != "hits"] + [
        (
            "best",
            "select * from (select h.*, v.cyc, row_number() over (partition by h.lat, h.lon, h.t, h.oceanBasin, h.salinity, h.depth, v.ci "
            "order by h.mm, h.j, h.st, h.sss, h.sb, h.slat, h.slon) as rn2 from cand h join v on h.lat = v.lat and h.lon = v.lon and h.t = v.t "
            "and h.oceanBasin = v.oceanBasin and h.salinity = v.salinity and h.depth = v.depth "
            f"and abs(v.ci - h.j) <= {window} where abs(h.t - h.st) <= {max_gap} and abs(h.sss - h.salinity) <= {max_diff}) z where rn2 = 1",
        )
    ]


def matchup_parts(sensor: str, window: int = 4, max_diff: float = 3.0):
    """The deduplicated matchup table."""
    return matched_parts(sensor, window, max_diff) + [
        (
            "matchups",
            "select * from (select *, row_number() over (partition by lat, lon, t order by cyc, oceanBasin, mm, j) as rn3 from best) z where rn3 = 1",
        )
    ]


def matchup_select(source: str, cyc: str = "cyc") -> str:
    return (
        "select lat as argo_lat, lon as argo_lon, t as argo_t, oceanBasin as argo_oceanBasin, "
        f"{r('salinity')} as argo_salinity, {r('depth')} as argo_depth, sss as sat_sss, slat as sat_lat, slon as sat_lon, st as sat_t, "
        f"sb as sat_oceanBasin, {r('d')} as dist_km, cast(abs(t - st) as double) as time_delta_s, "
        f"{cdate(cyc)} as cycle_date, {chour(cyc)} as cycle_hour from {source}"
    )


def metrics(pred: str, actual: str) -> str:
    return (
        f"cast(count(*) as bigint) as n, {r(f'sqrt(avg(({pred} - {actual})*({pred} - {actual})))')} as rmse, "
        f"{r(f'avg({pred} - {actual})')} as bias, {r(f'corr({pred}, {actual})')} as corr"
    )


def describe(value: str) -> str:
    return (
        f"cast(count({value}) as bigint) as n, {r(f'avg({value})')} as mean, {r(f'stddev_samp({value})')} as std, "
        f"{r(f'min({value})')} as min, {r(f'max({value})')} as max, "
        + ", ".join(f"{r(f'quantile_cont({value}, {p})')} as p{int(p*100)}" for p in (0.25, 0.5, 0.75))
    )


def gidx(lat: str, lon: str) -> str:
    return (
        f"cast(least(greatest(floor(({lat} + 90e0)/5e0), 0), 35) as int) as lat_idx, "
        f"cast(least(greatest(floor(({lon} + 180e0)/5e0), 0), 71) as int) as lon_idx"
    )
