"""Where observations are lost: quality, range and gross-error counts of one sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brinelink.functions import quality as q
from brinelink.operators.match import match_diagnostics, same_cycle_nearest
from brinelink.operators.profiles import argo_profiles, usable_sat
from brinelink.operators.summaries import argo_funnel, funnel_totals, sat_funnel
from brinelink.session import cut_lineage
from brinelink.sources.cycles import list_cycles


def quality_report(
    argo: DataFrame, sat: DataFrame, sensor: str, max_abs_diff: float = q.MAX_ABS_DIFF
) -> DataFrame:
    """One row of totals and rates.

    Pairs are counted within each profile's own cycle and without deduplication, so they
    are not the rows of the matchup table.
    """
    cycles = cut_lineage(list_cycles(argo, sat))
    pairs = same_cycle_nearest(argo_profiles(argo), usable_sat(sat, sensor), cycles)
    return funnel_totals(sat_funnel(sat, sensor), argo_funnel(argo), match_diagnostics(pairs, max_abs_diff))
