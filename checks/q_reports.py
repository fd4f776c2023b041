"""Metrics, grids, splits, features, models, diagnostics and audits."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from brinelink.models import compare, linear, network, scaler, validation
from brinelink.operators import audits, extra_qc, features, gating, grid, groups, match, metrics, split
from brinelink.operators.boxes import within_box_bounds
from brinelink.operators.support_tree import Tier, support_tree, tiered_correction
from brinelink.plans import ageing, index_match, leakage, train_and_compare
from brinelink.plans.coverage import coverage_scan
from brinelink.session import cut_lineage, shared_folder
from brinelink.sources.writers import write_table
from checks import fixtures as fx
from checks import sqlparts as sp
from checks.regression_sql import least_squares
from checks.q_match import _GROUP, _KNOWN, _LOOKUP, _SPLIT, DELAYED, labelled
from checks.registry import WINDOWS, check, metrics_out, rnd, rounded, secs, text
from checks.sqlparts import cdate, gidx, part, query, r

_DOY = "2e0*pi()*dayofyear(make_timestamp(sat_t*1000000))/365.25e0"
_FEATURES = {
    "sat_sss": "sat_sss", "sat_lat": "sat_lat", "lon_sin": "sin(radians(sat_lon))", "lon_cos": "cos(radians(sat_lon))",
    "doy_sin": f"sin({_DOY})", "doy_cos": f"cos({_DOY})",
    **{f"basin_{i}": f"case when sat_oceanBasin = {i} then 1e0 else 0e0 end" for i in range(6)},
}


def fitted_on(name, train, test, names=tuple(_FEATURES)):
    """CTEs that fit the constant and the linear correction on the matchup rows of ``train`` and predict those of ``test``."""
    added = ", ".join(f"{e} as {n}" for n, e in _FEATURES.items() if e != n)
    fit, linear_sql = least_squares(f"{name}_ols", f"{name}_train", names, "argo_salinity")
    offset = f"(select avg(sat_sss - argo_salinity) from {name}_train)"
    return [
        (f"{name}_train", f"select *, {added} from ({train}) z"),
        *fit,
        (name, f"select *, sat_sss - {offset} as pred_constant, {linear_sql} as pred_linreg from (select *, {added} from ({test}) z) y cross join {name}_ols_w"),
    ]


METHODS = {"raw": "pred_raw", "constant_bias": "pred_constant", "linear_regression": "pred_linreg"}
METHODS_SQL = {**METHODS, "raw": "sat_sss"}
M = sp.metrics("sat_sss", "argo_salinity")
BAND = (
    "case when sat_lat >= -90 and sat_lat < -60 then -90 when sat_lat >= -60 and sat_lat < -30 then -60 when sat_lat >= -30 and sat_lat < 30 then -30 "
    "when sat_lat >= 30 and sat_lat < 60 then 30 when sat_lat >= 60 and sat_lat < 90 then 60 end"
)
BAND_HI = BAND.replace("then -90 ", "then -60_ ").replace("then -60 ", "then -30 ").replace("then -30 when sat_lat >= 30", "then 30 when sat_lat >= 30").replace("then 30 when sat_lat >= 60", "then 60 when sat_lat >= 60").replace("then 60 end", "then 90 end").replace("-60_", "-60")


def _diff():
    return F.col("sat_sss") - F.col("argo_salinity")


@check("A8_error_metrics", query(["pairs"], [], f"select {M} from pairs"))
def _(spark, sf):
    return metrics_out(metrics.error_metrics(fx.pairs_all(spark, sf), "sat_sss", "argo_salinity"))


@check(
    "A9_metrics_by_lat_band",
    query(["pairs"], [], f"select sensor, {BAND} as lat_lo, {BAND_HI} as lat_hi, {M} from pairs where {BAND} is not null group by all"),
)
def _(spark, sf):
    return metrics_out(metrics.metrics_by_lat_band(fx.pairs_all(spark, sf), "sat_sss", "argo_salinity", by=["sensor"]))


@check("A10_metrics_by_basin", query(["pairs"], [], f"select sensor, sat_oceanBasin, {M} from pairs where sat_oceanBasin is not null group by sensor, sat_oceanBasin"))
def _(spark, sf):
    return metrics_out(metrics.metrics_by_basin(fx.pairs_all(spark, sf), "sat_sss", "argo_salinity", by=["sensor"]))


_PFIT = fitted_on("pfit", "select * from sp where sensor = 'smap' and part = 'train'", "select * from grp where sensor = 'smap'")
_M_GROUP = (
    "mg",
    " union all ".join(
        f"select '{m}' as method, g.gname as \"group\", {p} as pred, argo_salinity from pfit cross join lateral (select unnest(['overall', float_group]) as gname) g"
        for m, p in METHODS_SQL.items()
    ),
)


def _pair_predictions(spark, sf):
    """Raw, constant and linear predictions on the test days of the first sensor's matchups."""
    return train_and_compare.fit_and_predict(fx.pairs(spark, sf), WINDOWS, with_network=False)[1]


def _by_group(spark, sf):
    train = split.split_by_date(fx.pairs(spark, sf), WINDOWS).where(F.col("partition") == "train")
    rows = groups.label_membership(_pair_predictions(spark, sf), train)
    return metrics.metrics_by_group(rows, METHODS, "argo_salinity", "float_group")


@check("A11_metrics_by_float_group", query(["pairs"], [_SPLIT, _GROUP, *_PFIT, _M_GROUP], f"select method, \"group\", {sp.metrics('pred', 'argo_salinity')} from mg group by method, \"group\""))
def _(spark, sf):
    return metrics_out(_by_group(spark, sf))


@check("A12_group_composition", query(["pairs"], [_SPLIT, _GROUP], "select float_group, cast(count(*) as bigint) as n from grp where sensor = 'smap' group by float_group"))
def _(spark, sf):
    return groups.group_counts(labelled(spark, sf))


_AGEING = (
    "ag",
    "select sensor, float_group, data_mode, abs(argo_salinity - delayed_salinity) as a from known join delayed using (file)",
)


def _ageing(spark, sf):
    tables = {s: fx.pairs(spark, sf, s) for s in ("smap", "smos")}
    lookup = index_match.build_lookup(list(tables.values()), fx.kept_index(spark, sf))
    return ageing.ageing_table(tables, lookup, fx.delayed_profiles(spark, sf), WINDOWS)


_AGE_PARTS = [*_LOOKUP, _SPLIT, _GROUP, _KNOWN, DELAYED, _AGEING]


@check(
    "A15_discrepancy_by_group",
    query(["pairs", "idx", "del"], _AGE_PARTS, f"select sensor, float_group, cast(count(*) as bigint) as n, {r('avg(a)')} as mean, {r('median(a)')} as p50, {r('stddev_samp(a)')} as std from ag group by sensor, float_group"),
)
def _(spark, sf):
    return rounded(ageing.discrepancy_by_group(cut_lineage(_ageing(spark, sf))), "mean", "p50", "std")


@check(
    "A16_cross_tabulation",
    query(["pairs", "idx", "del"], _AGE_PARTS, "select float_group, " + ", ".join(f"cast(count(*) filter (where data_mode = '{m}') as bigint) as \"{m}\"" for m in "ADR") + " from ag group by float_group"),
)
def _(spark, sf):
    return ageing.modes_by_group(_ageing(spark, sf))


@check(
    "D3_sensor_ageing",
    query(["pairs", "idx", "del"], _AGE_PARTS, f"select sensor, float_group, data_mode, {r('a')} as abs_discrepancy from ag"),
)
def _(spark, sf):
    return rounded(_ageing(spark, sf).select("sensor", "float_group", "data_mode", "abs_discrepancy"), "abs_discrepancy")


_GRID = ("g", f"select *, {gidx('sat_lat', 'sat_lon')}, sat_sss - argo_salinity as d from pairs")
_GRID_OUT = f"cast(count(*) as bigint) as n, case when count(*) >= 5 then {r('avg(d)')} end as bias, case when count(*) >= 5 then {r('sqrt(avg(d*d))')} end as rmse"


@check("A17_grid_statistics", query(["pairs"], [_GRID], f"select sensor, lat_idx, lon_idx, {_GRID_OUT} from g group by sensor, lat_idx, lon_idx"))
def _(spark, sf):
    return rounded(grid.grid_stats(fx.pairs_all(spark, sf), "sat_lat", "sat_lon", _diff(), by=["sensor"]), "bias", "rmse")


@check(
    "A17_dense_grid",
    query(
        ["pairs"],
        [_GRID],
        f"select cast(i as int) as lat_idx, cast(j as int) as lon_idx, coalesce(n, 0) as n, bias, rmse from (select unnest(range(36)) as i) a cross join (select unnest(range(72)) as j) b "
        f"left join (select lat_idx, lon_idx, {_GRID_OUT} from g where sensor = 'smap' group by lat_idx, lon_idx) c on i = lat_idx and j = lon_idx",
    ),
)
def _(spark, sf):
    cells = grid.grid_stats(fx.pairs(spark, sf), "sat_lat", "sat_lon", _diff())
    return rounded(grid.dense_grid(spark, cells), "bias", "rmse")


@check("A18_density", query(["sat"], [("g", f"select {gidx('lat', 'lon')} from sat")], f"select lat_idx, lon_idx, cast(count(*) as bigint) as n, {r('log10(count(*))')} as log10_n from g group by lat_idx, lon_idx"))
def _(spark, sf):
    return rounded(grid.grid_density(fx.sat_obs(spark, sf), "lat", "lon"), "log10_n")


_DENS = (
    "dens",
    "select *, greatest(coalesce(log10_train, -1), coalesce(log10_test, -1)) as top from (select sensor, lat_idx, lon_idx, n_train, n_test, "
    "case when n_train > 0 then log10(n_train) end as log10_train, case when n_test > 0 then log10(n_test) end as log10_test from ("
    "select sensor, lat_idx, lon_idx, cast(count(*) filter (where part = 'train') as bigint) as n_train, cast(count(*) filter (where part = 'test') as bigint) as n_test "
    f"from (select *, {part()} as part from g) z group by sensor, lat_idx, lon_idx) y where n_train > 0 or n_test > 0) x",
)
_DENS_OUT = f"select sensor, lat_idx, lon_idx, n_train, n_test, {r('log10_train')} as log10_train, {r('log10_test')} as log10_test, {r('max(top) over (partition by sensor)')} as vmax from dens"


def _density(spark, sf):
    return grid.split_density(split.split_by_date(fx.pairs_all(spark, sf), WINDOWS))


@check("A19_train_test_density", query(["pairs"], [_GRID, _DENS], _DENS_OUT))
def _(spark, sf):
    return rounded(_density(spark, sf), "log10_train", "log10_test", "vmax")


# The matchup table that the matching job writes, in SQL.
_BUILT = (
    "built",
    "select 'smap' as sensor, lat as argo_lat, lon as argo_lon, t as argo_t, salinity as argo_salinity, sss as sat_sss, slat as sat_lat, slon as sat_lon, st as sat_t, sb as sat_oceanBasin, cyc from matchups",
)
_BUILT_PARTS = [*sp.matchup_parts("smap", max_diff=10.0), _BUILT]


def _built(spark, sf):
    return cut_lineage(match.build_matchups(fx.argo_obs(spark, sf), fx.sat_obs(spark, sf), "smap"))


@check("D6_density_tables", query(["sat", "argo"], [*_BUILT_PARTS, ("g", _GRID[1].replace("from pairs", "from built")), _DENS], _DENS_OUT))
def _(spark, sf):
    """From raw observations to the density of the matchups that train and test."""
    rows = split.split_by_date(_built(spark, sf), WINDOWS).withColumn("sensor", F.lit("smap"))
    return rounded(grid.split_density(rows), "log10_train", "log10_test", "vmax")


_SOURCES = ("all", "smap", "smos")
_COVER = [
    ("cov", "select distinct round_even(lat, 4) as lat, round_even(lon, 4) as lon, t from argo where depth <= 5"),
    (
        "u",
        "select 'all' as source, lat, lon from cov union all select sensor, argo_lat, argo_lon from pairs where (sensor = 'smap' and sat_sss > argo_salinity) or (sensor = 'smos' and sat_sss < argo_salinity)",
    ),
    ("c", f"select lat_idx, lon_idx, {', '.join(f"cast(count(*) filter (where source = '{s}') as bigint) as n_{s}" for s in _SOURCES)} from (select source, {gidx('lat', 'lon')} from u) z group by lat_idx, lon_idx"),
]
_COVER_OUT = (
    "select lat_idx, lon_idx, n_all, n_smap, n_smos, "
    + ", ".join(f"case when n_{s} > 0 then {r(f'log10(n_{s})')} end as log10_{s}" for s in _SOURCES)
    + f", {r('log10(greatest((select max(n_all) from c), (select max(n_smap) from c), (select max(n_smos) from c)))')} as vmax from c"
)


@check("A20_coverage_grids", query(["argo", "pairs"], _COVER, _COVER_OUT))
def _(spark, sf):
    matched = {"smap": fx.pairs(spark, sf, "smap").where(_diff() > 0), "smos": fx.pairs(spark, sf, "smos").where(_diff() < 0)}
    out = grid.coverage_density(coverage_scan(fx.argo_obs(spark, sf)), matched)
    return rounded(out, "log10_all", "log10_smap", "log10_smos", "vmax")


_COVER_BUILT = [
    _COVER[0],
    ("u", "select 'all' as source, lat, lon from cov union all select sensor, argo_lat, argo_lon from built"),
    ("c", f"select lat_idx, lon_idx, {', '.join(f"cast(count(*) filter (where source = '{s}') as bigint) as n_{s}" for s in ('all', 'smap'))} from (select source, {gidx('lat', 'lon')} from u) z group by lat_idx, lon_idx"),
]


@check(
    "D7_coverage_comparison",
    query(
        ["sat", "argo"],
        [*_BUILT_PARTS, *_COVER_BUILT],
        "select lat_idx, lon_idx, n_all, n_smap, "
        + ", ".join(f"case when n_{s} > 0 then {r(f'log10(n_{s})')} end as log10_{s}" for s in ("all", "smap"))
        + f", {r('log10(greatest((select max(n_all) from c), (select max(n_smap) from c)))')} as vmax from c",
    ),
)
def _(spark, sf):
    """All profiles of the archive beside those that the matching job kept."""
    out = grid.coverage_density(coverage_scan(fx.argo_obs(spark, sf)), {"smap": _built(spark, sf)})
    return rounded(out, "log10_all", "log10_smap", "vmax")


def _geo_parts(full, fit):
    """Raw error of the rows of ``full`` and that of the fitted line on held-out rows, per cell."""
    cell = gidx("sat_lat", "sat_lon")
    return [
        ("ge", f"select 'raw' as source, {cell}, sat_sss - argo_salinity as d from {full} union all select 'corrected', {cell}, pred_linreg - argo_salinity from {fit}"),
        ("e", "select source, lat_idx, lon_idx, count(*) as n, avg(d) as b, sqrt(avg(d*d)) as q from ge group by all"),
    ]


_GEO = [_SPLIT, _GROUP, *_PFIT, *_geo_parts("(select * from pairs where sensor = 'smap') z", "pfit")]
_GEO_OUT = f"select source, lat_idx, lon_idx, cast(n as bigint) as n, case when n >= 5 then {r('b')} end as bias, case when n >= 5 then {r('q')} end as rmse from e"


def _geo(spark, sf):
    return grid.geographic_error(fx.pairs(spark, sf), _pair_predictions(spark, sf), "pred_linreg")


@check("A21_geographic_error", query(["pairs"], _GEO, _GEO_OUT))
def _(spark, sf):
    return rounded(_geo(spark, sf), "bias", "rmse")


_BUILT_FIT = fitted_on(
    "bfit",
    f"select * from built where {part()} = 'train'",
    f"select * from built where {part()} = 'test'",
    [n for n in _FEATURES if n != "basin_0"],
)


@check("D8_geographic_error_tables", query(["sat", "argo"], [*_BUILT_PARTS, *_BUILT_FIT, *_geo_parts("built", "bfit")], _GEO_OUT))
def _(spark, sf):
    """From raw observations through matching and fitting to the error per cell."""
    matchups = _built(spark, sf)
    _, predictions = train_and_compare.fit_and_predict(matchups, WINDOWS, with_network=False)
    return rounded(grid.geographic_error(matchups, predictions, "pred_linreg"), "bias", "rmse")


@check("A21_display_scale", query(["pairs"], _GEO, f"select {r('quantile_cont(abs(b), 0.95)')} as bias_scale, {r('quantile_cont(q, 0.95)')} as rmse_scale from e where n >= 5"))
def _(spark, sf):
    return rounded(grid.display_scale(_geo(spark, sf)), "bias_scale", "rmse_scale")


_ID = "argo_lat, argo_lon, argo_t, sensor"


def _split_out(df):
    return df.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "sensor", "partition")


@check("P1_split_by_date", query(["pairs"], [_SPLIT], f"select {_ID}, part as \"partition\" from sp where part is not null"))
def _(spark, sf):
    return _split_out(split.split_by_date(fx.pairs_all(spark, sf), WINDOWS))


_OWNER = (
    "own",
    "select wmo, min(case part when 'train' then 0 when 'val' then 1 else 2 end) as o from sp where wmo is not null and part is not null group by wmo",
)
_FINAL = "coalesce(case o when 0 then 'train' when 1 then 'val' when 2 then 'test' end, part)"


@check("P2_split_by_float_drop", query(["pairs"], [_SPLIT, _OWNER], f"select {_ID}, {_FINAL} as \"partition\" from sp left join own using (wmo) where part is not null"))
def _(spark, sf):
    return _split_out(split.split_by_float(fx.pairs_all(spark, sf), WINDOWS))


@check("P2_split_by_float_follow", query(["pairs"], [_SPLIT, _OWNER], f"select {_ID}, {_FINAL} as \"partition\" from sp left join own using (wmo) where {_FINAL} is not null"))
def _(spark, sf):
    return _split_out(split.split_by_float(fx.pairs_all(spark, sf), WINDOWS, outside="follow"))


_FEAT = ("feat", f"select {sp.learn_part()} as part, argo_salinity, sat_lon, sat_t, " + ", ".join(f"{e} as {n}" for n, e in _FEATURES.items()) + " from learn")


def _feature_rows(spark, sf):
    return features.add_features(split.split_by_date(fx.learnable(spark, sf)))


@check("P3_features", query(["learn"], [_FEAT], "select sat_t, " + ", ".join(f"{r(n)} as {n}" for n in _FEATURES) + " from feat"))
def _(spark, sf):
    out = features.add_features(fx.learnable(spark, sf))
    return out.select(secs("sat_datetime").alias("sat_t"), *[rnd(c).alias(c) for c in features.FEATURE_COLUMNS])


def _fit(spark, sf):
    rows = _feature_rows(spark, sf)
    return rows, scaler.fit_scaler(rows.where(F.col("partition") == "train"), features.FEATURE_COLUMNS)


@check(
    "P4_scaler",
    query(["learn"], [_FEAT], " union all ".join(f"select '{n}' as feature, {r(f'avg({n})')} as mean, {r(f'stddev_pop({n})')} as std from feat where part = 'train'" for n in _FEATURES)),
)
def _(spark, sf):
    _, fitted = _fit(spark, sf)
    return rounded(fitted.to_frame(spark), "mean", "std")


_STATS = ("st", "select " + ", ".join(f"avg({n}) as m_{n}, case when stddev_pop({n}) = 0 then 1 else stddev_pop({n}) end as s_{n}" for n in _FEATURES) + " from feat where part = 'train'")
_SCALED = ("scaled", "select part, argo_salinity, " + ", ".join(f"({n} - m_{n})/s_{n} as {n}" for n in _FEATURES) + " from feat cross join st")


@check("P4_scaled_rows", query(["learn"], [_FEAT, _STATS, _SCALED], "select part as \"partition\", " + ", ".join(f"{r(n)} as {n}" for n in _FEATURES) + " from scaled where part is not null"))
def _(spark, sf):
    rows, fitted = _fit(spark, sf)
    out = fitted.transform(rows)
    return out.select("partition", *[rnd(c).alias(c) for c in features.FEATURE_COLUMNS])


@check("M1_no_correction", query(["learn"], [_FEAT], f"select {sp.metrics('sat_sss', 'argo_salinity')} from feat where part = 'test'"))
def _(spark, sf):
    test = _feature_rows(spark, sf).where(F.col("partition") == "test").withColumn("pred_raw", F.col("sat_sss"))
    return metrics_out(metrics.error_metrics(test, "pred_raw", "argo_salinity"))


_CONST = "(select avg(sat_sss - argo_salinity) from feat where part = 'train')"


@check("M2_constant_bias", query(["learn"], [_FEAT], f"select {sp.metrics(f'(sat_sss - {_CONST})', 'argo_salinity')} from feat where part = 'test'"))
def _(spark, sf):
    rows = _feature_rows(spark, sf)
    offset = linear.fit_constant(rows.where(F.col("partition") == "train"))
    test = rows.where(F.col("partition") == "test").withColumn("pred", F.col("sat_sss") - F.lit(offset))
    return metrics_out(metrics.error_metrics(test, "pred", "argo_salinity"))


_GRAM_NAMES = [*_FEATURES, "argo_salinity"]


@check(
    "M3_gram_matrix",
    query(
        ["learn"],
        [_FEAT, _STATS, _SCALED],
        " union all ".join(
            f"select cast({i} as int) as i, cast({j} as int) as j, {r(f'sum({a}*{b})', 3)} as value from scaled where part = 'train'"
            for i, a in enumerate([*_GRAM_NAMES, "1e0"])
            for j, b in enumerate([*_GRAM_NAMES, "1e0"])
            if i <= j
        ),
    ),
)
def _(spark, sf):
    rows, fitted = _fit(spark, sf)
    train = fitted.transform(rows.where(F.col("partition") == "train"))
    value = F.when(F.abs(F.col("value")) < 1e-6, F.lit(0.0)).otherwise(F.col("value"))
    return linear.gram_matrix(train, _GRAM_NAMES).withColumn("value", rnd(value, 3))


# Every row of ``learn`` has a basin, so the six indicators add up to the constant and one is left out of the elimination.
_LP = ("lp", f"select *, {sp.learn_part()} as part from learn")
_FIT_PARTS = [_LP, *fitted_on("fitted", "select * from lp where part = 'train'", "select * from lp where part = 'test'", [n for n in _FEATURES if n != "basin_0"])]


def _predictions(spark, sf):
    """Raw, constant and linear predictions on the test window."""
    return train_and_compare.fit_and_predict(fx.learnable(spark, sf), with_network=False)[1]


@check("M3_linear_regression", query(["learn"], _FIT_PARTS, f"select sat_lat, sat_lon, sat_sss, {r('argo_salinity')} as argo_salinity, {r('pred_linreg')} as pred_linreg from fitted"))
def _(spark, sf):
    rows = split.split_by_date(fx.learnable(spark, sf))
    fitted = compare.fit_corrections(rows, with_network=False)
    test = compare.apply_corrections(rows.where(F.col("partition") == "test"), fitted)
    return rounded(test.select("sat_lat", "sat_lon", "sat_sss", "argo_salinity", "pred_linreg"), "argo_salinity", "pred_linreg")


@check(
    "M3_residuals_against_features",
    query(["learn"], [_FEAT], " union all ".join(f"select '{n}' as feature, count(*) as n, 0e0 as dot, {r('avg(argo_salinity)')} as mean_pred from feat where part = 'train'" for n in [*_FEATURES, "intercept"])),
)
def _(spark, sf):
    """What makes a fit the least-squares one: its residuals are at right angles to every input, and so to the constant."""
    rows = split.split_by_date(fx.learnable(spark, sf)).where(F.col("partition") == "train")
    fitted = compare.fit_corrections(split.split_by_date(fx.learnable(spark, sf)), with_network=False)
    done = features.add_features(compare.apply_corrections(rows, fitted)).withColumn("intercept", F.lit(1.0))
    left = F.col("pred_linreg") - F.col("argo_salinity")
    names = [*features.FEATURE_COLUMNS, "intercept"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (left * F.col(c)).alias("dot")) for c in names])).alias("p")
    sums = done.select(pairs, "pred_linreg").groupBy("p.feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p.dot").alias("dot"), F.avg("pred_linreg").alias("mean_pred")
    )
    return sums.select("feature", "n", F.when(F.abs("dot") > 1e-6, F.col("dot")).otherwise(0.0).alias("dot"), rnd("mean_pred").alias("mean_pred"))


def _gradient_sql() -> list[tuple[str, str]]:
    """Forward and backward pass of the untrained network over the train rows, written out."""
    net = network.new_network(len(features.FEATURE_COLUMNS))
    (w0, b0), (w1, b1), (w2, b2) = net.layers
    x = list(features.FEATURE_COLUMNS)
    num = lambda v: f"({float(v)!r}::double)"
    dot = lambda names, w: " + ".join(f"{n}*{num(v)}" for n, v in zip(names, w))
    h0, h1 = [f"h0_{j}" for j in range(w0.shape[1])], [f"h1_{k}" for k in range(w1.shape[1])]
    e0, e1 = [f"e0_{j}" for j in range(w0.shape[1])], [f"e1_{k}" for k in range(w1.shape[1])]
    parts = [
        ("g0", "select y, " + ", ".join(x) + ", " + ", ".join(f"greatest(0e0, {dot(x, w0[:, j])} + {num(b0[j])}) as {n}" for j, n in enumerate(h0)) + " from grad_in"),
        ("g1", "select *, " + ", ".join(f"greatest(0e0, {dot(h0, w1[:, k])} + {num(b1[k])}) as {n}" for k, n in enumerate(h1)) + " from g0"),
        ("g2", f"select *, 2e0*({dot(h1, w2[:, 0])} + {num(b2[0])} - y) as e from g1"),
        ("g3", "select *, " + ", ".join(f"case when {h} > 0 then e*{num(w2[k, 0])} else 0e0 end as {n}" for k, (h, n) in enumerate(zip(h1, e1))) + " from g2"),
        ("g4", "select *, " + ", ".join(f"case when {h} > 0 then {dot(e1, w1[j])} else 0e0 end as {n}" for j, (h, n) in enumerate(zip(h0, e0))) + " from g3"),
    ]
    terms = [f"{a}*{b}" for a in x for b in e0] + e0 + [f"{a}*{b}" for a in h0 for b in e1] + e1 + [f"{a}*e" for a in h1] + ["e"]
    parts.append(("g5", "select [" + ", ".join(f"avg({t})" for t in terms) + "] as g from g4"))
    return parts


@check(
    "M4_start_gradient",
    query(
        ["learn"],
        [_FEAT, _STATS, ("grad_in", "select argo_salinity - sat_sss as y, " + ", ".join(f"({n} - m_{n})/s_{n} as {n}" for n in _FEATURES if n != "sat_sss") + ", (sat_sss - m_sat_sss)/s_sat_sss as sat_sss_s from feat cross join st where part = 'train'"),
         *[(n, t.replace("sat_sss", "sat_sss_s")) for n, t in _gradient_sql()]],
        f"select cast(unnest(range(len(g))) as int) as i, {r('unnest(g)', 5)} as value from g5",
    ),
)
def _(spark, sf):
    """All 961 sums of the backward pass at the start weights."""
    rows = features.add_residual(_feature_rows(spark, sf))
    fitted = scaler.fit_scaler(rows.where(F.col("partition") == "train"), features.FEATURE_COLUMNS)
    train = fitted.transform(rows.where(F.col("partition") == "train"), "_s")
    names = [f"{c}_s" for c in features.FEATURE_COLUMNS]
    found = network.mean_gradient(train, names, "residual", network.new_network(len(names)))
    return found.select("i", rnd("value", 5).alias("value"))


@check("M4_network_predictions")
def _(spark, sf):
    _, predictions = train_and_compare.fit_and_predict(fx.learnable(spark, sf))
    return predictions.select(*compare.PREDICTION_COLUMNS)


def _forward_sql(source: str, keep: str) -> list[tuple[str, str]]:
    """The untrained network written out as sums over the scaled features of ``source``."""
    net = network.new_network(len(features.FEATURE_COLUMNS))
    parts, names = [], list(features.FEATURE_COLUMNS)
    for depth, (w, b) in enumerate(net.layers):
        last = depth == len(net.layers) - 1
        sums = []
        for k in range(w.shape[1]):
            total = " + ".join([f"{n}*({float(w[i, k])!r}::double)" for i, n in enumerate(names)] + [f"({float(b[k])!r}::double)"])
            sums.append(f"{total} as y" if last else f"greatest(0e0, {total}) as h{depth}_{k}")
        parts.append((f"layer{depth}", f"select {keep}, {', '.join(sums)} from {source}"))
        source, names = f"layer{depth}", [f"h{depth}_{k}" for k in range(w.shape[1])]
    return parts


_SCALED_ALL = (
    "scaled_all",
    "select sat_lat as id_lat, sat_lon as id_lon, sat_sss as id_sss, " + ", ".join(f"({n} - m_{n})/s_{n} as {n}" for n in _FEATURES if n not in ("sat_lat", "sat_sss"))
    + ", (sat_lat - m_sat_lat)/s_sat_lat as sat_lat, (sat_sss - m_sat_sss)/s_sat_sss as sat_sss from feat cross join st where part is not null",
)


@check(
    "M5_scored_table",
    query(["learn"], [_FEAT, _STATS, _SCALED_ALL, *_forward_sql("scaled_all", "id_lat, id_lon, id_sss")], f"select id_lat as sat_lat, id_lon as sat_lon, id_sss as sat_sss, {r('id_sss + y')} as pred_ffann from layer2"),
)
def _(spark, sf):
    rows, fitted = _fit(spark, sf)
    scored = network.score(rows, network.new_network(len(features.FEATURE_COLUMNS)), fitted)
    return scored.select("sat_lat", "sat_lon", "sat_sss", rnd("pred_ffann").alias("pred_ffann"))


_CMP = ("cmp", " union all ".join(f"select '{m}' as method, {p} as pred, argo_salinity, sat_lat, sat_oceanBasin from fitted" for m, p in METHODS_SQL.items()))


def _scaled_test(fit, keep):
    """Test rows of ``fitted_on`` with their features brought to the scale of its train rows."""
    stats = ", ".join(f"avg({n}) as m_{n}, case when stddev_pop({n}) = 0 then 1 else stddev_pop({n}) end as s_{n}" for n in _FEATURES)
    return [
        ("dst", f"select {stats} from {fit}_train"),
        ("dsc", f"select {keep}, sat_sss as id_sss, " + ", ".join(f"({n} - m_{n})/s_{n} as {n}" for n in _FEATURES) + f" from {fit} cross join dst"),
    ]


def _with_given_network(fitted):
    """Fitted corrections and, in place of the trained network, one whose weights are known: the one training starts from."""
    return replace(fitted, network=network.new_network(len(features.FEATURE_COLUMNS)))


_ALL_FOUR = [
    *_FIT_PARTS,
    *_scaled_test("fitted", "argo_salinity, pred_constant, pred_linreg"),
    *_forward_sql("dsc", "argo_salinity, id_sss, pred_constant, pred_linreg"),
    ("four", " union all ".join(f"select '{m}' as method, {p} as pred, argo_salinity from layer2" for m, p in (("raw", "id_sss"), ("constant_bias", "pred_constant"), ("linear_regression", "pred_linreg"), ("ffann", "id_sss + y")))),
]


@check("M6_compare_four_methods", query(["learn"], _ALL_FOUR, f"select method, {sp.metrics('pred', 'argo_salinity')} from four group by method"))
def _(spark, sf):
    rows = split.split_by_date(fx.learnable(spark, sf))
    fitted = _with_given_network(compare.fit_corrections(rows, with_network=False))
    return metrics_out(train_and_compare.comparison(compare.apply_corrections(rows.where(F.col("partition") == "test"), fitted)))


@check("M6_compare_methods", query(["learn"], [*_FIT_PARTS, _CMP], f"select method, {sp.metrics('pred', 'argo_salinity')} from cmp group by method"))
def _(spark, sf):
    return metrics_out(train_and_compare.comparison(_predictions(spark, sf)))


@check(
    "M6_compare_by_lat_band",
    query(["learn"], [*_FIT_PARTS, _CMP], f"select method, {BAND} as lat_lo, {BAND_HI} as lat_hi, {sp.metrics('pred', 'argo_salinity')} from cmp where {BAND} is not null group by all"),
)
def _(spark, sf):
    return metrics_out(train_and_compare.comparison_by_lat_band(_predictions(spark, sf)))


@check("M6_compare_by_basin", query(["learn"], [*_FIT_PARTS, _CMP], f"select method, sat_oceanBasin, {sp.metrics('pred', 'argo_salinity')} from cmp group by method, sat_oceanBasin"))
def _(spark, sf):
    return metrics_out(train_and_compare.comparison_by_basin(_predictions(spark, sf)))


@check(
    "M7_saved_model",
    query(["learn"], [_FEAT], " union all ".join(f"select '{n}' as feature, {r(f'avg({n})')} as mean, {r(f'case when stddev_pop({n}) = 0 then 1 else stddev_pop({n}) end')} as std, cast(961 as int) as n_weights from feat where part = 'train'" for n in _FEATURES)),
)
def _(spark, sf):
    """Weights and scaler written, read back and laid out by feature."""
    _, fitted = _fit(spark, sf)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    write_table(network.network_frame(spark, network.new_network(len(features.FEATURE_COLUMNS)), fitted), path)
    saved = spark.read.parquet(path)
    by_feature = saved.select(F.explode(F.arrays_zip("columns", "means", "stds")).alias("f"), F.size("weights").alias("n_weights"))
    return by_feature.select(F.col("f.columns").alias("feature"), rnd("f.means").alias("mean"), rnd("f.stds").alias("std"), "n_weights")


_LEAK = [
    _SPLIT,
    _GROUP,
    *_PFIT,
    *_scaled_test("pfit", "argo_salinity, float_group"),
    *_forward_sql("dsc", "argo_salinity, float_group, id_sss"),
    ("lk", " union all ".join(f"select '{m}' as method, g.gname as \"group\", {p} as pred, argo_salinity from layer2 cross join lateral (select unnest(['overall', float_group]) as gname) g" for m, p in (("raw", "id_sss"), ("ffann", "id_sss + y")))),
]


@check("D2_leakage_of_given_network", query(["pairs"], _LEAK, f"select method, \"group\", {sp.metrics('pred', 'argo_salinity')} from lk group by method, \"group\""))
def _(spark, sf):
    pairs = fx.pairs(spark, sf)
    fitted = _with_given_network(compare.fit_corrections(split.split_by_date(pairs, WINDOWS), with_network=False))
    return metrics_out(leakage.leakage_diagnostic(pairs, WINDOWS, fitted=fitted))


@check("D2_leakage_diagnostic")
def _(spark, sf):
    return leakage.leakage_diagnostic(fx.pairs(spark, sf), WINDOWS)


@check(
    "E1_time_audit",
    query(
        ["argo"],
        [],
        f"select {cdate()} as cycle_date, lpad(cast((cyc % 4)*6 as varchar), 2, '0') as cycle_hour, cast(count(*) as bigint) as n, {r('avg(case when snapped = t then 1e0 else 0e0 end)')} as frac_equal, "
        f"{r('min((snapped - t)/3600e0)')} as min_offset_h, {r('max((snapped - t)/3600e0)')} as max_offset_h from argo group by cyc",
    ),
)
def _(spark, sf):
    out = audits.time_audit(fx.argo_obs(spark, sf))
    return rounded(out, "frac_equal", "min_offset_h", "max_offset_h").withColumn("cycle_date", text("cycle_date"))


@check(
    "E2_ambiguous_profile_keys",
    query(["argo"], [], "select round_even(lat, 1) as lat, round_even(lon, 1) as lon, snapped, min(t) as first_time, max(t) as last_time from argo group by 1, 2, 3 having min(t) < max(t)"),
)
def _(spark, sf):
    """Positions coarsened to a tenth of a degree, so that casts do share keys."""
    argo = fx.argo_obs(spark, sf)
    coarse = argo.withColumn("lat", F.bround("lat", 1)).withColumn("lon", F.bround("lon", 1))
    out = audits.ambiguous_profile_keys(coarse)
    return out.select("lat", "lon", secs("datetime").alias("snapped"), "first_time", "last_time")


@check(
    "E3_replication",
    query(["argo"], [], "select n_cycles, cast(count(*) as bigint) as n_profiles from (select cast(count(distinct cyc) as bigint) as n_cycles from argo group by lat, lon, t) z group by n_cycles"),
)
def _(spark, sf):
    return audits.replication(fx.argo_obs(spark, sf))


@check(
    "E3_duplicate_rows",
    query(["pairs"], [], "select cast(sum(c) as bigint) as n_rows, cast(count(*) as bigint) as n_keys, cast(sum(c - 1) as bigint) as n_surplus from (select count(*) as c from pairs group by argo_lat, argo_lon, argo_t) z"),
)
def _(spark, sf):
    return audits.duplicate_rows(fx.pairs_all(spark, sf), ["argo_lat", "argo_lon", "argo_datetime"])


@check(
    "E3_exact_duplicates",
    query(
        ["pairs"],
        [("k", "select argo_oceanBasin, argo_salinity, sensor, sat_oceanBasin, count(*) as c from pairs group by all")],
        "select cast(sum(c) as bigint) as n_rows, cast(sum(c) - count(*) as bigint) as n_surplus_exact, cast(count(*) - (select count(*) from (select distinct argo_oceanBasin, argo_salinity from k)) as bigint) as n_surplus_differing from k",
    ),
)
def _(spark, sf):
    coarse = fx.pairs_all(spark, sf).select("argo_oceanBasin", "argo_salinity", "sensor", "sat_oceanBasin")
    return audits.exact_duplicates(coarse, ["argo_oceanBasin", "argo_salinity"])


@check(
    "E4_matches_per_cycle",
    query(
        ["pairs"],
        [],
        f"select period, cast(sum(c) as bigint) as n_matches, cast(count(*) as bigint) as n_cycles, {r('sum(c)/cast(count(*) as double)')} as per_cycle from (select concat(left({cdate()}, 7), '-01') as period, cyc, count(*) as c from pairs group by all) z group by period",
    ),
)
def _(spark, sf):
    out = audits.matches_per_cycle(fx.pairs_all(spark, sf), "month")
    return rounded(out, "per_cycle").withColumn("period", text("period"))


@check(
    "E5_tropical_shift",
    query(
        ["pairs"],
        [_SPLIT],
        f"select sensor, cast(count(*) filter (where part = 'train') as bigint) as n_train, cast(count(*) filter (where part = 'test') as bigint) as n_test, {r('tr')} as train_bias, {r('te')} as test_bias, {r('te - tr')} as shift from ("
        "select *, avg(case when part = 'train' then sat_sss - argo_salinity end) over (partition by sensor) as tr, avg(case when part = 'test' then sat_sss - argo_salinity end) over (partition by sensor) as te "
        "from sp where abs(sat_lat) < 30 and part is not null) z group by sensor, tr, te",
    ),
)
def _(spark, sf):
    return rounded(audits.tropical_shift(split.split_by_date(fx.pairs_all(spark, sf), WINDOWS)), "train_bias", "test_bias", "shift")


@check(
    "E6_coverage_gaps",
    query(
        ["pairs"],
        [_GRID, _DENS],
        "select sensor, case when n_train = 0 then 'no_train' when n_train < 30 then 'low_train' else 'train_fine' end as gap, cast(count(*) as bigint) as n_cells from dens where n_test > 0 and n_test < 30 group by all",
    ),
)
def _(spark, sf):
    return audits.coverage_gaps(_density(spark, sf), min_count=30)


@check(
    "E7_group_composition",
    query(
        ["pairs"],
        [_SPLIT, _GROUP],
        f"select float_group, sat_oceanBasin, n, {r('sum(s) over (partition by float_group)/sum(n) over (partition by float_group)')} as group_mean_abs_lat, {r('n/cast(sum(n) over (partition by float_group) as double)')} as basin_share from ("
        "select float_group, sat_oceanBasin, cast(count(*) as bigint) as n, sum(abs(sat_lat)) as s from grp where sensor = 'smap' group by float_group, sat_oceanBasin) z",
    ),
)
def _(spark, sf):
    return rounded(audits.group_composition(labelled(spark, sf)), "group_mean_abs_lat", "basin_share")


@check(
    "E8_improvement_over_raw",
    query(
        ["pairs"],
        [_SPLIT, _GROUP, *_PFIT, _M_GROUP, ("mm", "select method, \"group\", cast(count(*) as bigint) as n, sqrt(avg((pred - argo_salinity)*(pred - argo_salinity))) as rmse from mg group by all")],
        f"select a.method, a.\"group\", a.n, {r('a.rmse')} as rmse, {r('b.rmse')} as base_rmse, {r('(b.rmse - a.rmse)/b.rmse*100e0')} as improvement_pct from mm a join mm b on a.\"group\" = b.\"group\" and b.method = 'raw'",
    ),
)
def _(spark, sf):
    return rounded(metrics.improvement_over(_by_group(spark, sf), "raw", ["group"]), "rmse", "base_rmse", "improvement_pct")


@check(
    "E9_confidence_gate",
    query(
        ["pairs"],
        [
            _GRID,
            ("gp", f"select *, {part()} as part from g where sensor = 'smap'"),
            ("sup", "select lat_idx, lon_idx, cast(count(*) as bigint) as n_train from gp where part = 'train' group by lat_idx, lon_idx"),
        ],
        f"select argo_lat, argo_lon, argo_t, coalesce(n_train, 0) as n_train, {r('case when coalesce(n_train, 0) >= 30 then sat_sss - 0.5e0 else sat_sss end')} as pred_gated from gp left join sup using (lat_idx, lon_idx) where part = 'test'",
    ),
)
def _(spark, sf):
    rows = split.split_by_date(fx.pairs(spark, sf), WINDOWS)
    support = gating.training_support(rows.where(F.col("partition") == "train"))
    test = rows.where(F.col("partition") == "test").withColumn("learned", F.col("sat_sss") - 0.5)
    out = gating.gate_correction(test, support, "learned", "sat_sss", min_train=30)
    return out.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "n_train", rnd("pred_gated").alias("pred_gated"))


_TIERS = [Tier("linear_regression", "pred_linreg", 3.0), Tier("constant_bias", "pred_constant", 12.0)]
_ENOUGH = 20
_SMALL = "cast(least(greatest(floor((sat_lat + 90e0)/0.3515625e0), 0), 511) as int) as fr, cast(least(greatest(floor((sat_lon + 180e0)/0.3515625e0), 0), 1023) as int) as fc"
_CHOSEN = "case tier when 'linear_regression' then pred_linreg when 'constant_bias' then pred_constant else sat_sss end"


@check(
    "E9_tiered_correction",
    query(
        ["pairs"],
        [
            _SPLIT,
            _GROUP,
            *_PFIT,
            ("lv", "select cast(unnest(range(8)) as int) as level"),
            ("tc", f"select level, fr >> (7 - level) as a, fc >> (7 - level) as b, cast(count(*) as bigint) as n from (select {_SMALL} from pfit_train) z cross join lv group by all having count(*) >= {_ENOUGH}"),
            ("pl", f"select eid, {_SMALL} from pfit"),
            ("su", "select eid, max(level) as level, arg_max(n, level) as n from (select pl.eid, lv.level, tc.n from pl cross join lv join tc on tc.level = lv.level and tc.a = fr >> (7 - lv.level) and tc.b = fc >> (7 - lv.level)) z group by eid"),
            ("ti", "select pfit.*, 45e0/pow(2, level) as support_deg, su.n as n_train from pfit left join su using (eid)"),
            ("tj", "select *, case when support_deg <= 3 then 'linear_regression' when support_deg <= 12 then 'constant_bias' else 'raw' end as tier from ti"),
        ],
        f"select argo_lat, argo_lon, argo_t, support_deg, n_train, tier, {r(_CHOSEN)} as pred_tiered from tj",
    ),
)
def _(spark, sf):
    """The fitted line where data lie close, the constant where they lie within some degrees, else the value as observed."""
    train = split.split_by_date(fx.pairs(spark, sf), WINDOWS).where(F.col("partition") == "train")
    out = tiered_correction(_pair_predictions(spark, sf), support_tree(train, _ENOUGH), _TIERS, ("raw", "pred_raw"))
    return out.select("argo_lat", "argo_lon", secs("argo_datetime").alias("argo_t"), "support_deg", "n_train", "tier", rnd("pred_tiered").alias("pred_tiered"))


_REGIONS = [
    extra_qc.POLAR_NORTH,
    extra_qc.Region("inland_sea", 30.0, 46.0, -6.0, 36.0, *extra_qc.REGION_BOUNDS["mediterranean"]),
    extra_qc.Region("warm_gulf", 12.0, 30.0, 32.0, 44.0, *extra_qc.REGION_BOUNDS["red_sea"]),
    extra_qc.Region("northern_shelf", 40.0, 75.0, -20.0, 20.0, *extra_qc.REGION_BOUNDS["nw_shelves"]),
]


def _region_sql():
    ordered = sorted(_REGIONS, key=lambda g: g.area)

    def pick(value, last):
        return "case " + " ".join(
            f"when lat between {g.lat_lo}e0 and {g.lat_hi}e0 and lon between {g.lon_lo}e0 and {g.lon_hi}e0 then {value(g)}" for g in ordered
        ) + f" else {last} end"

    return (
        f"select lat, lon, sss, region, low, high, coalesce(sss between low and high, false) as in_bounds from (select lat, lon, sss, {pick(lambda g: repr(g.name), repr('global'))} as region, "
        f"{pick(lambda g: f'{g.low}e0', '2e0')} as low, {pick(lambda g: f'{g.high}e0', '41e0')} as high from sat) z"
    )


@check("E10_region_bounds", query(["sat"], [], _region_sql()))
def _(spark, sf):
    out = extra_qc.within_region_bounds(fx.sat_obs(spark, sf), "sss", _REGIONS)
    return out.select("lat", "lon", "sss", "region", "low", "high", "in_bounds")




@check(
    "E11_spike_and_step",
    query(
        ["del"],
        [("w", "select *, coalesce(psal_adjusted, psal + 0.02e0*(cast(pres as int) % 3)) as v from del"), ("n", "select *, lag(v) over (partition by file order by pres) as a, lead(v) over (partition by file order by pres) as b from w")],
        f"select file, pres, {r('v')} as v, coalesce(abs(v - (a + b)/2) - abs(b - a)/2 > 0.0151e0, false) as is_spike, coalesce(abs(v - a) > 0.0151e0, false) and not coalesce(abs(v - (a + b)/2) - abs(b - a)/2 > 0.0151e0, false) as is_step from n",
    ),
)
def _(spark, sf):
    wobble = F.col("psal") + (F.col("pres").cast("int") % 3) * 0.02
    lev = fx.delayed_profiles(spark, sf).withColumn("v", F.coalesce("psal_adjusted", wobble))
    out = extra_qc.spike_and_step(lev, ["file"], "pres", "v", tolerance=0.0151)
    return out.select("file", "pres", rnd("v").alias("v"), "is_spike", "is_step")


@check("E12_native_flag", query(["del"], [], "select file, pres, psal_qc, psal_qc = 1 as good, psal_qc in (1, 2) as usable from del"))
def _(spark, sf):
    flag = F.col("psal_qc")
    return fx.delayed_profiles(spark, sf).select(
        "file", "pres", "psal_qc", extra_qc.native_flag_pass(flag).alias("good"), extra_qc.native_flag_pass(flag, True).alias("usable")
    )


@check(
    "E13_best_mode",
    query(
        ["del"],
        [("m", "select split_part(file, '/', 2) as wmo, pres, data_mode, coalesce(psal_adjusted, psal) as value from del")],
        "select wmo, pres, data_mode, value from (select *, row_number() over (partition by wmo, pres order by case data_mode when 'D' then 1 when 'A' then 2 else 3 end, value) as rn from m) z where rn = 1",
    ),
)
def _(spark, sf):
    lev = fx.delayed_profiles(spark, sf).withColumn("wmo", F.split("file", "/")[1])
    return extra_qc.best_mode(lev, ["wmo", "pres"])


@check("E14_operational_limits", query(["sat"], [], "select lat, lon, sss, coalesce(sss between 0.1e0 and 40, false) and abs(lon)*10e0 >= 100 as ok from sat"))
def _(spark, sf):
    sat = fx.sat_obs(spark, sf).withColumn("distance_from_coast_km", F.abs("lon") * 10.0)
    return sat.select("lat", "lon", "sss", extra_qc.operational_limits(sat).alias("ok"))


_FOLDS = split.expanding_folds(date(2024, 1, 1), 10, 5, 2, 3)


@check(
    "E15_expanding_folds",
    query(
        ["pairs"],
        [("f", " union all ".join(f"select cast({k} as int) as fold, '{a}' as t0, '{b}' as t1, '{c}' as v0, '{d}' as v1" for k, a, b, c, d in _FOLDS))],
        f"select fold, case when {cdate()} between t0 and t1 then 'train' else 'val' end as \"partition\", cast(count(*) as bigint) as n from pairs join f on {cdate()} between t0 and t1 or {cdate()} between v0 and v1 group by all",
    ),
)
def _(spark, sf):
    return split.assign_folds(fx.pairs_all(spark, sf), _FOLDS).groupBy("fold", "partition").agg(F.count(F.lit(1)).alias("n"))


_LEARN_FOLDS = split.expanding_folds(date(2021, 1, 1), 365, 90, 14, 7)
_LF = (
    "lf",
    " union all ".join(f"select cast({k} as int) as fold, '{a}' as t0, '{b}' as t1, '{c}' as v0, '{d}' as v1" for k, a, b, c, d in _LEARN_FOLDS),
)
_FOLD_ROWS = (
    "fr",
    f"select fold, case when {cdate()} between t0 and t1 then 'train' else 'val' end as side, sat_sss - argo_salinity as d from learn join lf on {cdate()} between t0 and t1 or {cdate()} between v0 and v1",
)
_FOLD_SUMS = ("fs", "select fold, cast(count(*) filter (where side = 'train') as bigint) as n_train, cast(count(*) filter (where side = 'val') as bigint) as n_val, avg(d) filter (where side = 'train') as m from fr group by fold")
_FOLD_OUT = " union all ".join(
    f"select s.fold, '{name}' as method, n_train, n_val, {r(f'sqrt(avg(({e})*({e})))')} as rmse, {r(f'avg({e})')} as bias from fr join fs s using (fold) where side = 'val' group by s.fold, n_train, n_val"
    for name, e in (("raw", "d"), ("constant_bias", "d - m"))
)


def _fold_errors(spark, sf):
    rows = features.add_features(fx.learnable(spark, sf))
    return rounded(validation.fold_errors(rows, _LEARN_FOLDS, features.FEATURE_COLUMNS), "rmse", "bias")


@check("E15_fold_errors", query(["learn"], [_LF, _FOLD_ROWS, _FOLD_SUMS], _FOLD_OUT))
def _(spark, sf):
    return _fold_errors(spark, sf).where("method <> 'linear_regression'")


@check("E15_fold_errors_linear")
def _(spark, sf):
    return _fold_errors(spark, sf).where("method = 'linear_regression'")


_BOXES = (
    "bx",
    "select *, (lat_hi - lat_lo)*(case when lon_lo > lon_hi then lon_hi - lon_lo + 360e0 else lon_hi - lon_lo end) as area from (select concat('box', cast(p_partkey as varchar)) as region, cast((p_partkey*37) % 170 - 85 as double) as lat_lo, "
    "cast((p_partkey*37) % 170 - 84 + p_partkey % 4 as double) as lat_hi, cast((p_partkey*71) % 360 - 180 as double) as lon_lo, "
    "cast(case when (p_partkey*71) % 360 - 179 + p_partkey % 7 > 180 then (p_partkey*71) % 360 - 539 + p_partkey % 7 else (p_partkey*71) % 360 - 179 + p_partkey % 7 end as double) as lon_hi, "
    "cast(p_partkey % 33 as double) as low, cast(p_partkey % 33 + 8 as double) as high from part) z",
)
_BOX_HIT = (
    "hit",
    "select lat, lon, min({'area': area, 'region': region, 'low': low, 'high': high}) as box from (select distinct lat, lon from sat) p join bx on lat between lat_lo and lat_hi "
    "and case when lon_lo > lon_hi then lon >= lon_lo or lon <= lon_hi else lon between lon_lo and lon_hi end group by lat, lon",
)


def _boxes(spark, sf):
    """A box for every part, some over the date line."""
    key = F.col("p_partkey")
    west = (key * 71) % 360 - 180
    east = west + 1 + key % 7
    south = (key * 37) % 170 - 85
    return fx.table(spark, sf, "part").select(
        F.concat(F.lit("box"), key.cast("string")).alias("region"),
        south.cast("double").alias("lat_lo"),
        (south + 1 + key % 4).cast("double").alias("lat_hi"),
        west.cast("double").alias("lon_lo"),
        F.when(east > 180, east - 360).otherwise(east).cast("double").alias("lon_hi"),
        (key % 33).cast("double").alias("low"),
        (key % 33 + 8).cast("double").alias("high"),
    )


@check(
    "E10_box_table",
    query(
        ["sat"],
        [_BOXES, _BOX_HIT],
        "select s.lat, s.lon, sss, coalesce(box.region, 'global') as region, coalesce(box.low, 2e0) as low, coalesce(box.high, 41e0) as high, "
        "coalesce(sss between coalesce(box.low, 2e0) and coalesce(box.high, 41e0), false) as in_bounds from sat s left join hit h on s.lat = h.lat and s.lon = h.lon",
    ),
)
def _(spark, sf):
    out = within_box_bounds(fx.sat_obs(spark, sf), "sss", _boxes(spark, sf), extra_qc.GLOBAL_BOUNDS)
    return out.select("lat", "lon", "sss", "region", "low", "high", "in_bounds")
