"""Exact nearest neighbour on the sphere as equi-joins on nested grid cells.

``nearest`` finds, for every (query, part), the closest point of that part within the
query's radius.  Ordinary cells are joined directly: both sides meet on
``(part, cell)``, the few candidates of a cell are measured, and the best one survives a
partially combined ``min``.  Points are first combined to one row per position.  A cell
holding more than ``hot_cell`` positions is never joined point by point: queries walk
down the nested grid against per-cell summaries, keeping only the cells
that can still hold the nearest point.  A query therefore meets a bounded number of rows
per cell however the points are spread, and no candidate is dropped unseen.

What a join meets is never sorted or exchanged.  A first join bounds the smallest distance of
every query from above, a number that is combined in passing; a second one, with the
radius cut down to it, fetches the few rows that are left.  The bound needs no more than
single precision, which halves what the first join, the one over all cells in reach, moves.
Neither side of these joins is broadcast: both grow with the data, and Spark takes the queries for
as few as they were before they were spread over cells.

Queries are taken to be the small side.  They are written once to the shared folder, so
that a row number names each of them from then on.  Points of cells that no query touches
are left out by a semi-join on the key of the join that follows, and what is left is kept
in the shared folder: the points are read once, whatever their number and spread.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.functions import geo
from brinelink.session import cut_lineage, shared_folder

HOT_CELL = 256
MAX_LEVEL = 6
_SLACK_KM = 1e-6
#: More than the rounding of two unit vectors to single precision (3e-8 for each number) adds to or takes from their chord.
_SLACK_CHORD = 2e-7
_QUERY = ("qid", "lat", "lon", "part", "radius_km")


def nearest(
    queries: DataFrame,
    points: DataFrame,
    payload: Sequence[str],
    cell_deg: Column | float = 1.0,
    hot_cell: int = HOT_CELL,
) -> DataFrame:
    """Nearest point of every query row, as the query's columns plus ``hit``.

    ``queries``: ``lat``, ``lon``, ``part``, ``radius_km`` and any further columns.
    ``points``: ``part``, ``lat``, ``lon`` and the ``payload`` columns.
    ``cell_deg``: base cell size, a number or an expression over ``part``.

    ``hit`` = struct(mm, payload..., lat, lon), ``mm`` being the distance in millimetres;
    queries without a point in reach do not appear.  Points at equal distance are ranked
    by the payload columns in order, then by position, so the answer does not depend on
    row order.
    """
    h = F.lit(float(cell_deg)) if isinstance(cell_deg, (int, float)) else cell_deg
    numbered = cut_lineage(queries.withColumn("qid", F.monotonically_increasing_id()))
    located = _locate_points(points, h, payload)
    asked = _cells_of_queries(numbered, h)

    touched = asked.select("part", "cell").distinct()
    located = cut_lineage(_one_row_per_position(located.join(touched, ["part", "cell"], "left_semi")))
    counts = located.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(counts.where(F.col("n") > hot_cell).select("part", "cell"))
    if hot.isEmpty():
        best = _closest(numbered, h, located, None)
    else:
        cold_points = located.join(hot, ["part", "cell"], "left_anti")
        crowded = located.join(hot, ["part", "cell"], "left_semi")
        frontier = asked.join(hot, ["part", "cell"], "left_semi")
        best = _closest(numbered, h, cold_points, hot, _descend(frontier, crowded, h, hot_cell))
    return numbered.join(best, "qid").drop("qid")


@dataclass(frozen=True)
class KeptPoints:
    """Points kept as a table bucketed and sorted by grid cell, and the list of its crowded cells."""

    table: DataFrame
    crowded: DataFrame
    any_crowded: bool
    cell_deg: float


def keep_points(points: DataFrame, payload: Sequence[str], cell_deg: float, hot_cell: int = HOT_CELL, buckets: int | None = None) -> KeptPoints:
    """Write points (lat, lon, ``payload``; one row per position) once, so that later searches move the queries only.

    The table lies in the shared folder and in the session's catalogue, bucketed by cell into as many buckets as there are
    shuffle partitions, unless told otherwise.
    """
    spark = points.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    here = points.select(F.lit(0).cast("long").alias("part"), "lat", "lon", *payload)
    placed = _locate_points(here, F.lit(float(cell_deg)), payload)
    first = F.struct("point.lat", "point.lon", *[f"point.{c}" for c in payload])  # position before payload
    placed = placed.select("cell", first.alias("point"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = placed.repartition(n, "cell").write.bucketBy(n, "cell").sortBy("cell").format("parquet")
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    crowded = cut_lineage(table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_cell).select("cell"))
    return KeptPoints(table, crowded, not crowded.isEmpty(), cell_deg)


def nearest_kept(queries: DataFrame, kept: KeptPoints, hot_cell: int = HOT_CELL) -> DataFrame:
    """Nearest kept point of every query (lat, lon, radius_km, ...) within its radius, as the query's columns plus ``hit``.

    ``hit`` = struct(mm, lat, lon, payload...), the smallest of the nearest. The queries are moved to the buckets; the kept table is not exchanged.
    """
    h = F.lit(float(kept.cell_deg))
    numbered = cut_lineage(queries.withColumn("qid", F.monotonically_increasing_id()))
    part = F.lit(0).cast("long")
    placed = numbered.withColumn("part", part)
    if not kept.any_crowded:
        best = _closest(placed, h, kept.table, None, on=["cell"])
    else:
        crowded = kept.table.join(kept.crowded, "cell", "left_semi").select(part.alias("part"), "cell", "point")
        frontier = _cells_of_queries(placed, h).join(kept.crowded, "cell", "left_semi").select(*_QUERY, "cell")
        best = _closest(placed, h, kept.table, kept.crowded, _descend(frontier, crowded, h, hot_cell), ["cell"])
    return numbered.join(best, "qid").drop("qid")


def _join_key(cell: Column) -> Column:
    """Declare a cell number never null, so a join adds no null test that would be
    pushed down and evaluate the whole expression a second time at the scan."""
    return F.coalesce(cell, F.lit(-1).cast("long"))


def _locate_points(points: DataFrame, h: Column, payload: Sequence[str]) -> DataFrame:
    """Points with their base cell: part, point, cell."""
    known = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = on_grid(known.select("part", F.struct(*payload, "lat", "lon").alias("point")), h)
    return placed.withColumn("cell", _join_key(geo.level_key(F.col("x"), F.col("z"), 0))).drop("x", "z")


def on_grid(points: DataFrame, h: Column) -> DataFrame:
    """``points`` with their band and cell position, ``x`` and ``z``.

    Both follow from the place, so they are made where they are asked and not moved with the points.
    """
    placed = points.withColumn("_h", h).withColumn("x", geo.band_position(F.col("point.lat"), F.col("_h")))
    in_band = geo.cells_in_band(F.floor("x"), F.col("_h"))
    return placed.withColumn("z", geo.cell_position(F.col("point.lon"), in_band)).drop("_h")


def _cells_of_queries(queries: DataFrame, h: Column, more: Sequence[str] = ()) -> DataFrame:
    """One row per base cell touched by a query's disc, with ``more`` of its columns."""
    lat, lon, radius = F.col("lat"), F.col("lon"), F.col("radius_km")
    by_band = queries.where(lat.isNotNull() & lon.isNotNull()).select(
        *_QUERY, *more, h.alias("h"), F.explode(geo.disc_bands(lat, radius, h)).alias("band")
    )
    band = F.col("band")
    by_cell = by_band.select(
        *_QUERY,
        *more,
        "band",
        geo.cells_in_band(band, F.col("h")).alias("n_cells"),
        F.explode(geo.disc_cells(lat, lon, radius, band, F.col("h"))).alias("c"),
    )
    cell = _join_key(geo.cell_key(band, F.pmod("c", "n_cells")))
    return by_cell.select(*_QUERY, *more, cell.alias("cell"))


def _measure(asked: DataFrame, located: DataFrame, on: Sequence[str] = ("part", "cell")) -> DataFrame:
    """Candidates inside the radius, from the cells both sides share."""
    left = asked.select(*on, "qid", "radius_km", geo.unit_vector(F.col("lat"), F.col("lon")).alias("u"))
    right = located.select(*on, "point", geo.unit_vector(F.col("point.lat"), F.col("point.lon")).alias("v"))
    return (
        left.join(right.hint("merge"), list(on))
        .withColumn("km", geo.chord_to_km(geo.chord_squared(F.col("u"), F.col("v"))))
        .where(F.col("km") <= F.col("radius_km") + 1e-9)
        .select("qid", F.struct(geo.distance_mm(F.col("km")).alias("mm"), "point.*").alias("hit"))
    )


def _chords(asked: DataFrame, located: DataFrame, on: Sequence[str] = ("part", "cell")) -> DataFrame:
    """Squared chords, in single precision, between queries and the candidates inside the radius, from the cells both sides share."""

    def short(lat: Column, lon: Column) -> Column:
        return geo.unit_vector(lat, lon).cast("struct<x: float, y: float, z: float>")

    most = F.greatest(geo.km_to_chord(F.col("radius_km") + 1e-9) + _SLACK_CHORD, F.lit(0.0))
    left = asked.select(*on, "qid", (most * most).alias("most"), short(F.col("lat"), F.col("lon")).alias("u"))
    right = located.select(*on, short(F.col("point.lat"), F.col("point.lon")).alias("v"))
    apart = [F.col(f"u.{c}").cast("double") - F.col(f"v.{c}").cast("double") for c in "xyz"]
    met = left.join(right.hint("merge"), list(on)).withColumn("chord", reduce(Column.__add__, [d * d for d in apart]))
    return met.where("chord <= most").select("qid", "chord")


def _closest(
    numbered: DataFrame,
    h: Column,
    ordinary: DataFrame,
    crowded: DataFrame | None,
    descended: Sequence[tuple[DataFrame, DataFrame]] = (),
    on: Sequence[str] = ("part", "cell"),
) -> DataFrame:
    """``qid`` and ``hit`` of every query, out of its ordinary cells (all but ``crowded``) and the pairs of
    cells and points that are left of the crowded ones."""

    def asked(queries: DataFrame) -> DataFrame:
        cells = _cells_of_queries(queries, h)
        return cells if crowded is None else cells.join(crowded, list(on), "left_anti")

    met = [_chords(asked(numbered), ordinary, on), *[_chords(small, points) for small, points in descended]]
    least = reduce(DataFrame.unionByName, met).groupBy("qid").agg(F.min("chord").alias("chord"))
    bound = geo.chord_to_km(F.pow(F.sqrt("chord") + _SLACK_CHORD, F.lit(2.0)))
    least = cut_lineage(least.select("qid", (geo.distance_mm(bound) + 1).alias("mm")))
    again = [_measure(asked(within_least(numbered, least)), ordinary, on)]
    again += [_measure(within_least(small, least), points) for small, points in descended]
    return reduce(DataFrame.unionByName, again).groupBy("qid").agg(F.min("hit").alias("hit"))


def within_least(asked: DataFrame, least: DataFrame) -> DataFrame:
    """Queries with the radius cut down to the smallest distance found or its bound (``mm``), rounding included."""
    reach = F.least("radius_km", (F.col("mm") + 0.5) / 1e6)
    return asked.join(least, "qid").withColumn("radius_km", reach).drop("mm")


def _one_row_per_position(located: DataFrame) -> DataFrame:
    """The preferred point of each position; the others can never win."""
    return (
        located.groupBy("part", "cell", "point.lat", "point.lon")
        .agg(F.min("point").alias("point"))
        .drop("lat", "lon")
    )


def _descend(frontier: DataFrame, crowded: DataFrame, h: Column, hot_cell: int) -> list[tuple[DataFrame, DataFrame]]:
    """Small cells of crowded ones that can hold a query's nearest point, with their points, one grid level per round.

    Each round bounds the distance to every cell from below (its disc) and from above
    (one of its points), drops the cells that cannot win, sets the small ones aside and
    hands the rest to the next level.
    """
    crowded = cut_lineage(on_grid(crowded, h))
    left = []
    for level in range(MAX_LEVEL + 1):
        here = crowded.withColumn("below", _join_key(geo.level_key(F.col("x"), F.col("z"), level)))
        summary = here.groupBy("part", "cell", "below").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("point.lat", "point.lon")).alias("member")
        )
        summary = cut_lineage(summary.withColumn("disc", geo.level_disc(F.col("below"), h, level)))
        to_member = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("member.lat"), F.col("member.lon"))
        to_disc = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("disc.lat"), F.col("disc.lon"))
        bounds = frontier.join(summary, ["part", "cell"]).groupBy("qid").agg(F.min(to_member).alias("most_km"))
        reached = (
            frontier.join(bounds, "qid")
            .withColumn("radius_km", F.least("radius_km", F.col("most_km") + _SLACK_KM))
            .drop("most_km")
            .join(summary, ["part", "cell"])
            .where(to_disc - F.col("disc.radius_km") - _SLACK_KM <= F.col("radius_km"))
            .select("qid", "lat", "lon", "part", "radius_km", F.col("below").alias("cell"), "n")
        )
        reached = cut_lineage(reached)
        deepest = level == MAX_LEVEL or reached.where(F.col("n") > hot_cell).isEmpty()
        here = here.drop("cell").withColumnRenamed("below", "cell")
        small = reached if deepest else reached.where(F.col("n") <= hot_cell)
        left.append((small.drop("n"), here))
        if deepest:
            return left
        frontier = reached.where(F.col("n") > hot_cell).drop("n")
        crowded = here
    return left
