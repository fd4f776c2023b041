"""Descriptive statistics, quality funnels and match logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelink.functions import quality as q
from brinelink.operators.profiles import CYCLE, PROFILE_KEY, profile_means, with_true_time
from brinelink.session import cut_lineage

#: Rank error of the sketch that brackets a percentile, as a part of the group.
_SKETCH = 10_000
#: A group of no more rows is its own bracket.
_SMALL_GROUP = 20_000
#: Different values of one bracket that a task may rank; wider brackets are narrowed first.
RANK_LIMIT = 200_000
#: Bins that a bracket is narrowed by in a round.
_BINS = 512


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated percentiles per group, without holding a group in one task.

    A sketch of each group brackets every wanted rank between two of its values that lie less than
    a thousandth of the group apart; only the different values inside are ranked, and those below
    are counted. Brackets follow the data, so outliers do not widen them. Where a thousandth of the largest group is more
    than ``RANK_LIMIT`` values, rounds of counted histograms shrink the brackets until a task can rank them. ``probs`` maps
    output column names to fractions.
    """
    by = list(by)
    keyed = df.where(F.col(value).isNotNull()).select(F.struct(*by, F.lit(0).alias("_")).alias("g"), F.col(value).alias("v"))
    delta = 4 / _SKETCH
    ends = [[max(0.0, p - delta), min(1.0, p + delta)] for p in probs.values()]
    sketch = F.percentile_approx("v", [float(x) for pair in ends for x in pair], _SKETCH)
    span = keyed.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), sketch.alias("q"))
    span = cut_lineage(span)  # one row per group
    largest = span.agg(F.max("n")).first()[0] or 0
    small = F.col("n") <= _SMALL_GROUP
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("pos"),
                F.when(small, F.col("lo")).otherwise(F.col("q")[2 * i]).alias("from"),
                F.when(small, F.col("hi")).otherwise(F.col("q")[2 * i + 1]).alias("to"),
            )
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    brackets = span.select("g", wanted.alias("ws"))
    if not by:
        brackets = F.broadcast(brackets)  # one row
    counts = keyed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    placed = counts.join(brackets, "g").select("g", "v", "c", F.explode("ws").alias("w")).where(F.col("v") <= F.col("w.to"))
    inside = F.col("v") >= F.col("w.from")
    key = ["g", "w"]
    below = placed.groupBy(*key).agg(F.sum(F.when(~inside, F.col("c")).otherwise(0)).alias("before"))
    running = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = placed.where(inside).select(*key, "v", "c")
    ends_of = F.explode(F.array_distinct(F.array(F.floor("w.pos"), F.ceil("w.pos")))).alias("rank")
    if max(min(largest, _SMALL_GROUP), 3 * delta * largest) > RANK_LIMIT:
        # the two ranks around a position may lie far apart, so each has its own bracket from here on
        held, below = _narrowed(held.select("*", ends_of), below.select("*", ends_of))
        key = ["g", "w", "rank"]
        running = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("upto", F.sum("c").over(running)).join(below, key)
    ranked = ranked.withColumn("top", F.col("before") + F.col("upto"))
    values = (
        ranked.select("g", "v", "top", "c", "w", "rank" if "rank" in key else ends_of)
        .where((F.col("rank") < F.col("top")) & (F.col("rank") >= F.col("top") - F.col("c")))
        .select("g", "v", F.struct("w.name", "w.pos", "rank").alias("w"))
    )
    share = F.when(F.floor("w.pos") == F.ceil("w.pos"), F.lit(1.0)).when(
        F.col("w.rank") == F.floor("w.pos"), 1.0 - (F.col("w.pos") - F.floor("w.pos"))
    ).otherwise(F.col("w.pos") - F.floor("w.pos"))
    out = values.groupBy("g").agg(
        *[F.sum(F.when(F.col("w.name") == name, F.col("v") * share)).alias(name) for name in probs]
    )
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], *probs)


def _narrowed(held: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values (g, w, rank, v, c) of every bracket cut down to ``RANK_LIMIT`` around its rank, and the rows before them.

    A round counts each crowded bracket in ``_BINS`` bins between its least and greatest value, keeps the bin that holds the
    rank and adds the bins below to the rows before. The least and the greatest value never share a bin, so
    rounds end. No task sees more of a bracket than its bins.
    """
    key = ["g", "w", "rank"]
    below, held = cut_lineage(below), cut_lineage(held)
    while True:
        sizes = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        sizes = cut_lineage(sizes)  # one row per bracket
        crowded = F.col("n") > RANK_LIMIT
        if sizes.where(crowded).isEmpty():
            return held, below
        at = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _BINS)
        binned = held.join(F.broadcast(sizes.where(crowded)), key).withColumn("bin", F.least(at, F.lit(_BINS - 1)))
        upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = binned.groupBy(*key, "bin").agg(F.sum("c").alias("m")).join(below, key)
        bins = bins.withColumn("last", F.col("before") + F.sum("m").over(upto)).withColumn("first", F.col("last") - F.col("m"))
        holds = (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("last"))
        chosen = cut_lineage(bins.where(holds).select(*key, "bin", F.col("first").alias("before")))
        kept = binned.join(F.broadcast(chosen), [*key, "bin"], "left_semi").select(*key, "v", "c")
        calm = held.join(F.broadcast(sizes.where(crowded).select(*key)), key, "left_anti").select(*key, "v", "c")
        below = cut_lineage(below.select(*key, "before").join(chosen.select(*key), key, "left_anti").unionByName(chosen.select(*key, "before")))
        held = cut_lineage(calm.unionByName(kept))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max of a column per group."""
    by = list(by)
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_percentiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    return _beside(stats, quartiles, by)


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two tables that hold one row per group; a missing group key equals itself."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), "left")
    r = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return left.join(r, on, "left").drop(*[f"_{c}" for c in by])


def sat_cycle_summary(sat: DataFrame) -> DataFrame:
    """Per cycle: range, mean, median, population deviation and count of the valid values."""
    valid = sat.where(F.col("sss").isNotNull())
    stats = valid.groupBy(*CYCLE).agg(
        F.min("sss").alias("sss_min"),
        F.max("sss").alias("sss_max"),
        F.avg("sss").alias("sss_mean"),
        F.stddev_pop("sss").alias("sss_std"),
        F.count("sss").alias("n"),
    )
    return _beside(stats, exact_percentiles(valid, "sss", {"sss_median": 0.5}, CYCLE), list(CYCLE))


def argo_cycle_summary(argo: DataFrame, max_depth: float = q.MAX_DEPTH) -> DataFrame:
    """Per cycle: observation counts, near-surface share and statistics of the profile means.

    Profiles are grouped by position and true time, the basin being no part of the key,
    and no salinity range is applied.
    """
    timed = with_true_time(argo)
    shallow = q.near_surface(F.col("depth"), max_depth)
    totals = timed.groupBy(*CYCLE).agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if(shallow).alias("n_near"),
    )
    totals = totals.withColumn("pct_near", F.col("n_near") * 100.0 / F.col("n_obs"))
    means = profile_means(timed.where(shallow & F.col("salinity").isNotNull()), PROFILE_KEY[:3])
    # kept: the statistics and each pass of the median read the means, not the levels again
    means = cut_lineage(means.select(*CYCLE, "salinity", "depth"))
    stats = means.groupBy(*CYCLE).agg(
        F.count(F.lit(1)).alias("n_profiles"),
        F.min("salinity").alias("sal_min"),
        F.max("salinity").alias("sal_max"),
        F.avg("salinity").alias("sal_mean"),
        F.stddev_pop("salinity").alias("sal_std"),
        F.min("depth").alias("depth_min"),
        F.max("depth").alias("depth_max"),
        F.avg("depth").alias("depth_mean"),
    )
    median = exact_percentiles(means, "salinity", {"sal_median": 0.5}, CYCLE)
    return totals.join(stats, list(CYCLE), "left").join(median, list(CYCLE), "left")


def sat_funnel(
    sat: DataFrame,
    sensor: str,
    by: Sequence[str] = CYCLE,
    min_salinity: float = q.MIN_SALINITY,
    max_salinity: float = q.MAX_SALINITY,
) -> DataFrame:
    """Valid satellite values, rejected by quality, then by range, and passing; one pass."""
    valid = F.col("sss").isNotNull()
    good = q.quality_pass(sensor, F.col("preqc"))
    ranged = q.in_range(F.col("sss"), min_salinity, max_salinity)
    return sat.groupBy(*by).agg(
        F.count_if(valid).alias("sat_raw"),
        F.count_if(valid & ~good).alias("sat_quality_fail"),
        F.count_if(valid & good & ~ranged).alias("sat_range_fail"),
        F.count_if(valid & good & ranged).alias("sat_pass"),
    )


def argo_funnel(
    argo: DataFrame,
    by: Sequence[str] = CYCLE,
    max_depth: float = q.MAX_DEPTH,
    min_salinity: float = q.MIN_SALINITY,
    max_salinity: float = q.MAX_SALINITY,
) -> DataFrame:
    """Near-surface levels, rejected by range, passing, and profiles they form per cycle."""
    timed = with_true_time(argo)
    near = (
        F.col("salinity").isNotNull()
        & q.near_surface(F.col("depth"), max_depth)
        & q.plausible_time(F.col("datetime"))
    )
    ranged = q.in_range(F.col("salinity"), min_salinity, max_salinity)
    keyed = near & ranged
    for c in PROFILE_KEY:
        keyed = keyed & F.col(c).isNotNull()
    profile = F.when(keyed, F.struct(*CYCLE, *PROFILE_KEY))
    return timed.groupBy(*by).agg(
        F.count_if(near).alias("argo_raw"),
        F.count_if(near & ~ranged).alias("argo_range_fail"),
        F.count_if(near & ranged).alias("argo_pass"),
        F.count_distinct(profile).alias("argo_profiles"),
    )


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def funnel_totals(sat_counts: DataFrame, argo_counts: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """Grand totals and rates out of the per-cycle counts (three small tables).

    The range rate is given both of all valid values and of those that pass quality.
    """
    sat = sat_counts.agg(*[F.sum(c).alias(c) for c in ("sat_raw", "sat_quality_fail", "sat_range_fail", "sat_pass")])
    argo = argo_counts.agg(*[F.sum(c).alias(c) for c in ("argo_raw", "argo_range_fail", "argo_pass", "argo_profiles")])
    pairs = pair_counts.agg(
        F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("n_gross_fail"), F.lit(0)).alias("gross_fail"),
    )
    total = sat.join(F.broadcast(argo), F.lit(True)).join(F.broadcast(pairs), F.lit(True))
    c = F.col
    return total.select(
        "*",
        percent(c("sat_quality_fail"), c("sat_raw")).alias("sat_quality_fail_pct"),
        percent(c("sat_range_fail"), c("sat_raw")).alias("sat_range_fail_pct_of_raw"),
        percent(c("sat_range_fail"), c("sat_raw") - c("sat_quality_fail")).alias("sat_range_fail_pct_of_good"),
        percent(c("sat_pass"), c("sat_raw")).alias("sat_pass_pct"),
        percent(c("sat_quality_fail") + c("sat_range_fail"), c("sat_raw")).alias("sat_suspicious_pct"),
        percent(c("argo_range_fail"), c("argo_raw")).alias("argo_range_fail_pct"),
        percent(c("argo_pass"), c("argo_raw")).alias("argo_pass_pct"),
        percent(c("gross_fail"), c("candidates")).alias("gross_fail_pct"),
        (c("candidates") - c("gross_fail")).alias("final_pairs"),
    )


def match_log(cycles: DataFrame, profiles: DataFrame, sat: DataFrame, matches: DataFrame) -> DataFrame:
    """Per cycle: profiles, own-cycle satellite rows and matches before deduplication."""

    def per_cycle(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*CYCLE).agg(F.count(F.lit(1)).alias(name))

    log = cycles.select(*CYCLE)
    names = ["n_profiles", "n_sat", "n_matches"]
    for table, name in zip((profiles, sat, matches), names):
        log = log.join(per_cycle(table, name), list(CYCLE), "left")
    return log.na.fill(0, names)


def match_totals(log: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Grand totals of the log and the row count after deduplication."""
    total = log.agg(
        F.sum("n_profiles").alias("n_profiles"),
        F.sum("n_sat").alias("n_sat"),
        F.sum("n_matches").alias("n_before_dedup"),
    )
    return total.join(F.broadcast(deduplicated.agg(F.count(F.lit(1)).alias("n_after_dedup"))), F.lit(True))


def distinct_and_rate(df: DataFrame, column: str) -> DataFrame:
    """Rows, rows with a value, distinct values and percent of rows with a value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(column).alias("n_known"),
        F.count_distinct(column).alias("n_distinct"),
        (F.avg(F.col(column).isNotNull().cast("double")) * 100.0).alias("known_pct"),
    )
