"""Exact nearest neighbour among the points that a query accepts, by branch and bound.

A query accepts a point if given columns of it, say its time and its value, differ by no more than is allowed.
Such limits depend on the pair, so a near point bounds nothing unless it is accepted.  Crowded cells
are therefore summed up with the range of every limited column besides their extent.  Against a query a cell

* is left out, if one of its ranges is out of the query's reach or it is farther than the best bound;
* bounds the distance by its member, if the member, or by its ranges every point, is accepted;
* is settled by its preferred point, if every point is accepted and all lie at one position;
* is measured point by point, if it is small;
* and is cut finer otherwise, in turn in space and in the limited columns.

So of a cell that holds a third of all rows, at one position or spread out, a query meets summaries and
a bounded number of points.  A point goes on with the cells that are cut finer or stays with the small cell it lies in,
so it is kept once, whatever the number of rounds, and what only one round reads goes after it.  As in ``nearest``, a first join finds each query's bound or smallest
distance and a second one fetches what is left within it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.functions import geo
from brinelink.operators import nearest as nn
from brinelink.session import cut_in_parts, cut_lineage, dropped

#: Parts a limited column is cut into per round.
CUTS = 4
MAX_ROUNDS = 14
_SLACK_KM = 1e-6
#: What a query does with a cell: takes its preferred point, measures all of them, or goes on in the parts of it.
_SETTLED, _SMALL, _LARGE = 0, 1, 2


def _accepted(allowed: Mapping[str, float], point: Column) -> Column:
    """Whether every limited column of the point is within reach of the query."""
    ok = F.lit(True)
    for n, a in allowed.items():
        ok = ok & (F.abs(point[n] - F.col(f"mid_{n}")) <= a)
    return F.coalesce(ok, F.lit(False))


def nearest_valid(
    queries: DataFrame,
    points: DataFrame,
    payload: Sequence[str],
    allowed: Mapping[str, float],
    cell_deg: float = 1.0,
    hot_cell: int = nn.HOT_CELL,
) -> DataFrame:
    """Nearest accepted point of every query: ``qid`` and ``hit`` as in ``nearest``.

    ``points``: ``part``, ``lat``, ``lon`` and the ``payload`` columns. ``allowed`` names the limited ones and how far each
    may be from the query's, both ends included.
    ``queries``: ``qid``, ``lat``, ``lon``, ``part``, ``radius_km`` and ``mid_c`` for each limited column c; a query may
    come with several parts, with the same values in each. Of equally distant points the payload decides in order, then the position.
    Points without a position or without a limited value, and queries without one, find nothing.
    """
    names = list(allowed)
    h = F.lit(float(cell_deg))
    # written once; cells are filled in where they are asked
    queries = cut_lineage(queries.select("qid", "lat", "lon", "part", "radius_km", *[f"mid_{n}" for n in names]))
    asked = _cells_of(queries, names, h)
    located = nn._locate_points(points.dropna(subset=names), h, payload)
    located = located.join(asked.select("part", "cell").distinct(), ["part", "cell"], "left_semi")
    # rows that agree in all that matters are one
    alike = ["part", "cell", "point.lat", "point.lon", *[f"point.{n}" for n in names]]
    located = cut_lineage(located.groupBy(*alike).agg(F.min("point").alias("point")).select("part", "cell", "point"))
    counts = located.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(counts.where(F.col("n") > hot_cell).select("part", "cell"))
    on = ["part", "cell"]
    done, left, cold = [], [], located
    any_hot = not hot.isEmpty()
    if any_hot:
        cold = located.join(hot, on, "left_anti")
        crowded = located.join(hot, on, "left_semi")
        done, left = _descend(asked.join(hot, on, "left_semi"), crowded, allowed, h, hot_cell)

    def ordinary(q: DataFrame) -> DataFrame:
        cells = _cells_of(q, names, h)
        return cells.join(hot, on, "left_anti") if any_hot else cells

    inner = ["part", "base", "cell"]
    met = [_measure(ordinary(queries), cold, allowed), *[_measure(a, p, allowed, inner) for a, p in left], *done]
    least = reduce(DataFrame.unionByName, [m.select("qid", "hit.mm") for m in met])
    least = cut_lineage(least.groupBy("qid").agg(F.min("mm").alias("mm")))
    again = [_measure(ordinary(nn.within_least(queries, least)), cold, allowed)]
    again += [_measure(nn.within_least(a, least), p, allowed, inner) for a, p in left]
    again += [d.join(least.withColumnRenamed("mm", "least"), "qid").where("hit.mm = least").drop("least") for d in done]
    return reduce(DataFrame.unionByName, again).groupBy("qid").agg(F.min("hit").alias("hit"))


def _cells_of(queries: DataFrame, names: Sequence[str], h: Column) -> DataFrame:
    """One row per base cell touched by a query's disc, with the query's own values."""
    mids = F.struct(*[f"mid_{n}" for n in names]).alias("mids")
    kept = queries.select("qid", "lat", "lon", "part", "radius_km", mids)
    return nn._cells_of_queries(kept, h, ["mids"]).select("qid", "lat", "lon", "part", "radius_km", "cell", "mids.*")


def _measure(asked: DataFrame, located: DataFrame, allowed: Mapping[str, float], on: Sequence[str] = ("part", "cell")) -> DataFrame:
    limits = [f"mid_{n}" for n in allowed]
    left = asked.select(*on, "qid", "radius_km", *limits, geo.unit_vector(F.col("lat"), F.col("lon")).alias("u"))
    right = located.select(*on, "point", geo.unit_vector(F.col("point.lat"), F.col("point.lon")).alias("v"))
    return (
        left.join(right, list(on))
        .where(_accepted(allowed, F.col("point")))
        .withColumn("km", geo.chord_to_km(geo.chord_squared(F.col("u"), F.col("v"))))
        .where(F.col("km") <= F.col("radius_km") + 1e-9)
        .select("qid", F.struct(geo.distance_mm(F.col("km")).alias("mm"), "point.*").alias("hit"))
    )


def _finer(allowed: Mapping[str, float], step: int) -> Column:
    """Number of the part of its cell a point falls in at a round: in space and in the limited columns by turns."""
    depth = step // 2 + 1
    if step % 2 == 0:
        return geo.level_key(F.col("x"), F.col("z"), min(depth, nn.MAX_LEVEL))
    return F.xxhash64(*[F.floor(F.col(f"point.{n}") / F.lit(max(a, 1) / CUTS**depth)) for n, a in allowed.items()])


def _box(h: Column) -> Column:
    """struct(lat, lon, radius_km) of a disc that holds the points between the corners of a cell's summary."""
    n_cells = geo.cells_in_band(F.floor("x0"), h)
    lat = (F.col("x0") + F.col("x1")) / 2 * h - 90.0
    lon = (F.col("z0") + F.col("z1")) / 2 / n_cells * 360.0 - 180.0
    half_lat, half_lon = (F.col("x1") - F.col("x0")) * h / 2, (F.col("z1") - F.col("z0")) / n_cells * 180.0
    radius = (half_lat + F.cos(F.radians(lat)) * half_lon) * geo.KM_PER_DEGREE
    return F.struct(lat.alias("lat"), lon.alias("lon"), radius.alias("radius_km"))


def _descend(
    frontier: DataFrame, crowded: DataFrame, allowed: Mapping[str, float], h: Column, hot_cell: int
) -> tuple[list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """What crowded cells leave after one cut per round: hits of settled cells, and small cells with their points."""
    names = list(allowed)
    limits = [f"mid_{n}" for n in names]
    on = ["part", "base", "cell"]
    crowded = first = cut_lineage(nn.on_grid(crowded, h).withColumn("base", F.col("cell")))
    frontier = frontier.withColumn("base", F.col("cell"))
    done, left, ended = [], [], []
    for step in range(MAX_ROUNDS):
        here = crowded.withColumn("below", F.xxhash64("cell", _finer(allowed, step)))
        spans = [f(f"point.{n}").alias(f"{p}_{n}") for n in names for f, p in ((F.min, "least"), (F.max, "most"))]
        corners = [f(c).alias(f"{c}{i}") for c in ("x", "z") for i, f in enumerate((F.min, F.max))]
        one = (F.min("point.lat") == F.max("point.lat")) & (F.min("point.lon") == F.max("point.lon"))
        summary = here.groupBy(*on, "below").agg(F.count(F.lit(1)).alias("n"), F.min("point").alias("member"), one.alias("one"), *spans, *corners)
        summary = cut_lineage(summary.withColumn("disc", _box(h)))
        within, apart = F.lit(True), F.lit(False)
        for n, a in allowed.items():
            least, most = F.col(f"least_{n}") - F.col(f"mid_{n}"), F.col(f"most_{n}") - F.col(f"mid_{n}")
            within = within & (F.abs(least) <= a) & (F.abs(most) <= a)
            apart = apart | (most < -a) | (least > a)
        km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("member.lat"), F.col("member.lon"))
        least_km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("disc.lat"), F.col("disc.lon")) - F.col("disc.radius_km") - _SLACK_KM
        met = frontier.join(summary, on).where(~apart)
        bounds = met.groupBy("qid").agg(F.min(F.when(within | _accepted(allowed, F.col("member")), km + _SLACK_KM)).alias("most_km"))
        settled = within & F.col("one")
        reached = (
            frontier.join(bounds, "qid")
            .withColumn("radius_km", F.least("radius_km", "most_km"))
            .drop("most_km")
            .join(summary, on)
            .where(~apart & (least_km <= F.col("radius_km")))
            .select(
                "qid", "lat", "lon", "part", "base", F.col("below").alias("cell"), "radius_km", *limits, "n",
                F.when(settled, F.col("member")).alias("settled"),
            )
        )
        together = cut_lineage(reached)
        dropped(summary)
        kind = F.when(F.col("settled").isNotNull(), _SETTLED).when(F.col("n") <= hot_cell, _SMALL).otherwise(_LARGE)
        reached = cut_in_parts(together.withColumn("kind", kind).drop("n"), "kind")
        dropped(together)
        member = F.col("settled")
        single = geo.chord_to_km(geo.chord_squared(geo.unit_vector(F.col("lat"), F.col("lon")), geo.unit_vector(member["lat"], member["lon"])))
        hits = reached.where(F.col("kind") == _SETTLED).withColumn("km", single).where(F.col("km") <= F.col("radius_km") + 1e-9)
        done.append(hits.select("qid", F.struct(geo.distance_mm(F.col("km")).alias("mm"), "settled.*").alias("hit")))
        rest = reached.where(F.col("kind") != _SETTLED).drop("settled")
        # a cell is of one kind for all queries that ask it
        asked = rest.select(*on, "kind").distinct()
        points = here.drop("cell").withColumnRenamed("below", "cell").join(asked, on)
        points = cut_in_parts(points, "kind")
        for old in ended:
            dropped(old, f"kind={_LARGE}")
        large = rest.where(F.col("kind") == _LARGE)
        deepest = step == MAX_ROUNDS - 1 or large.isEmpty()
        aside = F.lit(True) if deepest else F.col("kind") == _SMALL
        left.append((rest.where(aside).drop("kind"), points.where(aside).select(*on, "point")))
        if deepest:
            break
        frontier, crowded, ended = large.drop("kind"), points.where(F.col("kind") == _LARGE).drop("kind"), [reached, points]
    dropped(first)
    return done, left
