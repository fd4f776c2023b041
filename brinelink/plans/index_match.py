"""Instrument lookup for the profiles of all matchup tables, and its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelink.operators.enrich import (
    MAX_INDEX_DIST_KM,
    MAX_INDEX_GAP_S,
    attach_wmo,
    match_to_index,
    unique_profiles,
)
from brinelink.operators.mergeable import LG_K
from brinelink.operators.nearest import KeptPoints
from brinelink.operators.summaries import describe
from brinelink.sources.readers import index_in_range
from brinelink.sources.writers import observed, replace_table


def build_lookup(
    matchups: Sequence[DataFrame],
    index: DataFrame | KeptPoints,
    start: str | None = None,
    end: str | None = None,
    max_dist_km: float = MAX_INDEX_DIST_KM,
    max_gap_s: float = MAX_INDEX_GAP_S,
) -> DataFrame:
    """Nearest index entry of the profiles of all tables. An index kept by ``keep_index`` is taken whole."""
    if not isinstance(index, KeptPoints):
        index = index_in_range(index, start, end)
    elif start is not None or end is not None:
        raise ValueError("dates are chosen before an index is kept")
    return match_to_index(unique_profiles(*matchups), index, max_dist_km, max_gap_s)


def lookup_report(lookup: DataFrame) -> DataFrame:
    """Distance statistics of matched and unmatched profiles, with their share of all."""
    stats = describe(lookup, "dist_km", ["matched"])
    total = lookup.agg(F.count(F.lit(1)).alias("n_profiles"))
    return stats.join(F.broadcast(total), F.lit(True)).withColumn("pct", F.col("n") * 100.0 / F.col("n_profiles"))


def attach_in_place(spark: SparkSession, path: str, lookup: DataFrame) -> dict[str, int]:
    """Give the matchup table at ``path`` its instruments: n_rows, n_known and n_floats (estimated) of what was written.

    The counts, before and after, are taken in passing by the job that writes, so nothing is read again for them and
    Spark cannot leave the check of the row count out. If it fails the table stays as it was. Spark drops the counting from the plan
    of a table that it finds empty, so an empty one is counted beforehand.
    """
    matchups = spark.read.parquet(path)
    if matchups.isEmpty():
        replace_table(attach_wmo(matchups, lookup), path)
        return {"n_rows": 0, "n_known": 0, "n_floats": 0}
    before, came = observed(matchups, {"n_rows": F.count(F.lit(1))})
    floats = F.hll_sketch_estimate(F.hll_sketch_agg(F.col("wmo").cast("string"), LG_K))
    measures = {"n_rows": F.count(F.lit(1)), "n_known": F.count("wmo"), "n_floats": F.coalesce(floats, F.lit(0))}
    after, went = observed(attach_wmo(before, lookup), measures)

    def same_rows() -> None:
        if came.get["n_rows"] != went.get["n_rows"]:
            raise ValueError(f"attaching changed {came.get['n_rows']} rows to {went.get['n_rows']}")

    replace_table(after, path, same_rows)
    return dict(went.get)
