"""Pairing profiles with satellite observations in space and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.functions import geo
from brinelink.functions import quality as q
from brinelink.functions.scalars import micros
from brinelink.operators.nearest import HOT_CELL, nearest
from brinelink.operators.nearest_valid import nearest_valid
from brinelink.operators.profiles import argo_profiles, usable_sat
from brinelink.session import cut_lineage
from brinelink.sources.cycles import list_cycles, with_cycle_idx

_VARIANT = ["lat", "lon", "t", "oceanBasin", "salinity", "depth"]


def _profile_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "lat", "lon", micros(F.col("datetime")).alias("t"), "oceanBasin", "salinity", "depth", "cycle_idx"
    )


def _sat_points(sat: DataFrame) -> DataFrame:
    return sat.select(
        F.col("cycle_idx").alias("part"), "lat", "lon", micros(F.col("datetime")).alias("sat_t"), "sss",
        F.col("oceanBasin").alias("sat_basin"),
    )


def _cycle_spans(points: DataFrame) -> DataFrame:
    """First and last observation time of every cycle: one row per cycle of the archive."""
    return points.groupBy("part").agg(F.min("sat_t").alias("first_t"), F.max("sat_t").alias("last_t"))


def _of_near_cycles(sat: DataFrame, rows: DataFrame, cycles: DataFrame, window: int) -> DataFrame:
    """Satellite rows of the cycles within ``window`` of some profile's (``cycle_idx`` of ``rows``).

    The join is on the columns the archive is partitioned by and its other side is a filtered list of
    cycles (four rows a day), so a scan of the archive opens the files of those cycles only.
    """
    around = rows.groupBy("cycle_idx").agg(F.count(F.lit(1)).alias("n"))
    around = around.select(F.explode(F.sequence(F.col("cycle_idx") - window, F.col("cycle_idx") + window)).alias("cycle_idx"), "n")
    asked = cycles.join(around, "cycle_idx").groupBy("cycle_date", "cycle_hour").agg(F.sum("n").alias("n"))
    asked = cut_lineage(asked).where("n > 0")
    return sat.join(F.broadcast(asked), ["cycle_date", "cycle_hour"], "left_semi")


def _reachable(wanted: DataFrame, spans: DataFrame, max_gap_s: float) -> DataFrame:
    """Drop (profile, cycle) rows whose cycle has no observation near the profile in time.

    Exact: the nearest observation of such a cycle fails the time limit whatever it is.
    """
    gap = F.lit(int(max_gap_s * 1e6))
    return (
        wanted.join(F.broadcast(spans), "part")
        .where(F.col("t").between(F.col("first_t") - gap, F.col("last_t") + gap))
        .drop("first_t", "last_t")
    )


def _within_limits(max_gap_s: float, max_abs_diff: float | None) -> Column:
    ok = F.abs(F.col("t") - F.col("hit.sat_t")) <= int(max_gap_s * 1e6)
    if max_abs_diff is not None:
        ok = ok & (F.abs(F.col("hit.sss") - F.col("salinity")) <= max_abs_diff)
    return ok


def _as_time(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def _matchup_columns(df: DataFrame) -> DataFrame:
    """Profile, hit and cycle columns in the matchup layout."""
    return df.select(
        F.col("lat").alias("argo_lat"),
        F.col("lon").alias("argo_lon"),
        _as_time(F.col("t")).alias("argo_datetime"),
        F.col("oceanBasin").alias("argo_oceanBasin"),
        F.col("salinity").alias("argo_salinity"),
        F.col("depth").alias("argo_depth"),
        F.col("hit.sss").alias("sat_sss"),
        F.col("hit.lat").alias("sat_lat"),
        F.col("hit.lon").alias("sat_lon"),
        _as_time(F.col("hit.sat_t")).alias("sat_datetime"),
        F.col("hit.sat_basin").alias("sat_oceanBasin"),
        geo.haversine_km(F.col("lat"), F.col("lon"), F.col("hit.lat"), F.col("hit.lon")).alias("dist_km"),
        (F.abs(F.col("t") - F.col("hit.sat_t")) / 1e6).alias("time_delta_s"),
        "cycle_date",
        "cycle_hour",
    )


def _named_cycle(df: DataFrame, cycles: DataFrame) -> DataFrame:
    names = cycles.select("cycle_idx", "cycle_date", "cycle_hour")
    return df.join(F.broadcast(names), "cycle_idx").drop("cycle_idx")


def _variants(rows: DataFrame, gather: Callable[[str], Column]) -> DataFrame:
    """One row per profile, with the ``cycles`` that copies of it are filed under.

    Kept, so that the means are the same numbers wherever the rows are used, and not written copy by copy.
    """
    return cut_lineage(rows.groupBy(*_VARIANT).agg(gather("cycle_idx").alias("cycles")))


def _filed_under(variants: DataFrame) -> DataFrame:
    return variants.select(F.explode("cycles").alias("cycle_idx"))


def _near_part(window: int) -> Callable[[Column], Column]:
    """Whether a cycle has the searched one (``part``) in its window."""
    return lambda c: F.abs(c - F.col("part")) <= window


def _wanted(variants: DataFrame, points: DataFrame, max_dist_km: float, max_gap_s: float, window: int) -> DataFrame:
    """Every profile once per cycle to be searched for it: those in the window of any of its copies."""
    near = F.array_distinct(F.flatten(F.transform("cycles", lambda c: F.sequence(c - window, c + window))))
    copies = variants.withColumn("part", F.explode(near))
    return _reachable(copies, _cycle_spans(points), max_gap_s).withColumn("radius_km", F.lit(float(max_dist_km)))


def _valid_hits(
    variants: DataFrame,
    points: DataFrame,
    max_dist_km: float,
    max_gap_s: float,
    max_abs_diff: float,
    window: int,
    hot_cell: int,
) -> DataFrame:
    """Valid nearest observation per (profile, searched cycle)."""
    wanted = _wanted(variants, points, max_dist_km, max_gap_s, window)
    hits = nearest(wanted, points, ["sat_t", "sss", "sat_basin"], hot_cell=hot_cell)
    return hits.where(_within_limits(max_gap_s, max_abs_diff))


def match_windowed(
    profiles: DataFrame,
    sat: DataFrame,
    cycles: DataFrame,
    max_dist_km: float = q.MAX_DIST_KM,
    max_gap_s: float = q.MAX_TIME_GAP_S,
    max_abs_diff: float = q.MAX_ABS_DIFF,
    window: int = q.CYCLE_WINDOW,
    hot_cell: int = HOT_CELL,
    mode: str = "cycle_nearest",
) -> DataFrame:
    """Best match of every (profile, cycle) row over the cycles within ``window`` of its own.

    ``cycle_nearest``: in each searched cycle only the spatially nearest observation is
    considered; it must then pass the distance, time and difference limits (all inclusive).
    ``best_valid``: the limits come first, so a nearer observation that fails one hides nothing.
    Over the cycles the smallest distance wins, the earlier cycle on a tie, then the earlier time.
    """
    if mode not in ("cycle_nearest", "best_valid"):
        raise ValueError(f"unknown mode {mode}")
    rows = _profile_rows(with_cycle_idx(profiles, cycles))
    if mode == "best_valid":
        variants, search = _variants(rows, F.collect_list), _nearest_valid_hits
    else:
        variants, search = _variants(rows.dropna(subset=_VARIANT), F.collect_set), _valid_hits
    points = _sat_points(with_cycle_idx(_of_near_cycles(sat, _filed_under(variants), cycles, window), cycles))
    hits = search(variants, points, max_dist_km, max_gap_s, max_abs_diff, window, hot_cell)
    # a profile's few hits stay together and each of its copies chooses among them
    found = hits.groupBy(*_VARIANT).agg(
        F.any_value("cycles").alias("cycles"), F.collect_list(F.struct("hit.mm", "part", "hit")).alias("found")
    )
    copies = found.withColumn("cycle_idx", F.explode("cycles")).drop("cycles")
    best = F.array_min(F.filter("found", lambda f: F.abs(F.col("cycle_idx") - f["part"]) <= window))
    kept = copies.withColumn("hit", best["hit"]).drop("found").where(F.col("hit").isNotNull())
    return _matchup_columns(_named_cycle(kept, cycles))


def _nearest_valid_hits(
    variants: DataFrame,
    points: DataFrame,
    max_dist_km: float,
    max_gap_s: float,
    max_abs_diff: float,
    window: int,
    hot_cell: int,
) -> DataFrame:
    """Nearest of the observations that pass the limits, per (profile, searched cycle).

    Crowded cells are searched by bounds on place, time and value.
    """
    wanted = _wanted(variants, points, max_dist_km, max_gap_s, window)
    numbered = cut_lineage(wanted.withColumn("qid", F.monotonically_increasing_id()))
    asked = numbered.select("qid", "lat", "lon", "part", "radius_km", F.col("t").alias("mid_sat_t"), F.col("salinity").alias("mid_sss"))
    allowed = {"sat_t": int(max_gap_s * 1e6), "sss": max_abs_diff}
    best = nearest_valid(asked, points, ["sat_t", "sss", "sat_basin"], allowed, hot_cell=hot_cell)
    return numbered.join(best, "qid")


def build_matchups(
    argo: DataFrame,
    sat: DataFrame,
    sensor: str,
    cycles: DataFrame | None = None,
    max_dist_km: float = q.MAX_DIST_KM,
    max_gap_s: float = q.MAX_TIME_GAP_S,
    max_depth: float = q.MAX_DEPTH,
    min_salinity: float = q.MIN_SALINITY,
    max_salinity: float = q.MAX_SALINITY,
    max_abs_diff: float = q.MAX_ABS_DIFF,
    window: int = q.CYCLE_WINDOW,
    hot_cell: int = HOT_CELL,
) -> DataFrame:
    """Raw observation tables to the deduplicated matchup table.

    Equal to ``match_windowed`` followed by ``first_match_per_profile``, without
    building the copies in between: of the cycles a profile is filed under, only the
    earliest one with a match survives, so one minimum per profile settles cycle,
    distance and tie.

    ``cycles`` lists the cycles that exist (``sources.cycles``); without it both tables are asked. Satellite
    files of cycles that no profile is near to are not opened if the table is partitioned by cycle.
    """
    if cycles is None:
        cycles = cut_lineage(list_cycles(argo, sat))
    profiles = argo_profiles(argo, max_depth=max_depth, min_salinity=min_salinity, max_salinity=max_salinity)
    variants = _variants(_profile_rows(with_cycle_idx(profiles, cycles)), F.collect_set)
    usable = usable_sat(_of_near_cycles(sat, _filed_under(variants), cycles, window), sensor, min_salinity, max_salinity)
    points = _sat_points(with_cycle_idx(usable, cycles))
    hits = _valid_hits(variants, points, max_dist_km, max_gap_s, max_abs_diff, window, hot_cell)
    hits = hits.withColumn("first_cycle", F.array_min(F.filter("cycles", _near_part(window))))
    order = F.struct("first_cycle", "oceanBasin", "hit.mm", "part", "salinity", "depth", "hit")
    kept = (
        hits.groupBy("lat", "lon", "t")
        .agg(F.min(order).alias("best"))
        .select("lat", "lon", "t", "best.*")
        .withColumnRenamed("first_cycle", "cycle_idx")
    )
    return _matchup_columns(_named_cycle(kept, cycles))


def first_match_per_profile(matches: DataFrame) -> DataFrame:
    """One row per (argo_lat, argo_lon, argo_datetime): the one of the earliest cycle.

    The basin is no part of the key; within a cycle the smaller basin code is kept.
    """
    key = ["argo_lat", "argo_lon", "argo_datetime"]
    rest = [c for c in matches.columns if c not in (*key, "cycle_date", "cycle_hour", "argo_oceanBasin")]
    order = F.struct("cycle_date", "cycle_hour", "argo_oceanBasin", *rest)
    kept = matches.groupBy(*key).agg(F.min(order).alias("first")).select(*key, "first.*")
    return kept.select(*matches.columns)


def same_cycle_nearest(
    profiles: DataFrame,
    sat: DataFrame,
    cycles: DataFrame,
    max_dist_km: float = q.MAX_DIST_KM,
    max_gap_s: float = q.MAX_TIME_GAP_S,
    hot_cell: int = HOT_CELL,
) -> DataFrame:
    """Space-time candidates of each (profile, cycle) row in its own cycle, before the gross check."""
    # kept, so that the means are the same numbers wherever the rows are used
    rows = cut_lineage(_profile_rows(with_cycle_idx(profiles, cycles)))
    points = _sat_points(with_cycle_idx(_of_near_cycles(sat, rows, cycles, 0), cycles))
    rows = rows.withColumnRenamed("cycle_idx", "part")
    wanted = _reachable(rows, _cycle_spans(points), max_gap_s).withColumn("radius_km", F.lit(float(max_dist_km)))
    hits = nearest(wanted, points, ["sat_t", "sss", "sat_basin"], hot_cell=hot_cell)
    near = hits.where(_within_limits(max_gap_s, None)).withColumnRenamed("part", "cycle_idx")
    return _matchup_columns(_named_cycle(near, cycles))


def gross_mismatch(max_abs_diff: float = q.MAX_ABS_DIFF) -> Column:
    """True for a pair that differs by more than the limit."""
    return F.abs(F.col("sat_sss") - F.col("argo_salinity")) > max_abs_diff


def match_diagnostics(candidates: DataFrame, max_abs_diff: float = q.MAX_ABS_DIFF) -> DataFrame:
    """Per cycle: candidate pairs and how many of them fail the gross check."""
    return candidates.groupBy("cycle_date", "cycle_hour").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(gross_mismatch(max_abs_diff)).alias("n_gross_fail")
    )
