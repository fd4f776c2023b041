import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelink.functions import quality as q
from brinelink.functions.scalars import one_hot, prefer_adjusted
from brinelink.models import compare, linear, network
from brinelink.models.scaler import Scaler, fit_scaler
from brinelink.operators import extra_qc, grid, groups, metrics, profiles, split, summaries
from brinelink.operators.features import FEATURE_COLUMNS, add_features, add_residual
from brinelink.sources import backfill, readers, writers
from brinelink.streaming.scoring import correct_stream, write_corrected

NAN, INF = float("nan"), float("inf")
T0 = datetime(2023, 8, 1)


def one(df):
    return df.collect()[0]


def test_metrics_of_one_row_and_of_a_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0), ("b", 3.0, 5.0), ("b", None, 5.0)], "g string, p double, a double")
    rows = {r.g: r for r in metrics.error_metrics(df, "p", "a", ["g"]).collect()}
    assert (rows["a"].n, rows["a"].rmse, rows["a"].bias, rows["a"]["corr"]) == (1, 1.0, -1.0, None)
    assert rows["b"].n == 2 and rows["b"]["corr"] is None


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(0)
    p, a = rng.normal(35, 1, 500), rng.normal(35, 1, 500)
    got = one(metrics.error_metrics(spark.createDataFrame([(float(x), float(y)) for x, y in zip(p, a)], "p double, a double"), "p", "a"))
    assert got.rmse == pytest.approx(np.sqrt(np.mean((p - a) ** 2)))
    assert got["corr"] == pytest.approx(np.corrcoef(p, a)[0, 1])


def test_pole_is_in_no_band_and_empty_bands_are_absent(spark):
    df = spark.createDataFrame([(90.0,), (60.0,), (-90.0,), (29.9,), (30.0,)], "sat_lat double").withColumns({"p": F.lit(1.0), "a": F.lit(1.0)})
    rows = metrics.metrics_by_lat_band(df, "p", "a").collect()
    assert sorted((r.lat_lo, r.lat_hi, r.n) for r in rows) == [(-90, -60, 1), (-30, 30, 1), (30, 60, 1), (60, 90, 1)]


def test_grid_edges(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 200.0), (None, 1.0)], "lat double, lon double")
    got = [(r.lat_idx, r.lon_idx) for r in grid.with_grid(df, "lat", "lon").collect()]
    assert got == [(35, 71), (0, 0), (18, 4)]
    assert [r.lon_idx for r in grid.with_grid(df, "lat", "lon", clip=True).collect()] == [71, 0, 71]


def test_thin_cells_hide_their_errors(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 4 + [(11.0, 1.0)] * 5, "lat double, lon double")
    rows = {r.lat_idx: r for r in grid.grid_stats(df, "lat", "lon", F.lit(2.0)).collect()}
    assert rows[18].bias is None and rows[18].n == 4
    assert (rows[20].bias, rows[20].rmse) == (2.0, 2.0)


def test_quality_rules(spark):
    df = spark.createDataFrame([(0,), (1,), (599,), (600,), (999,), (None,)], "p int")
    a, b = (
        [r[0] for r in df.select(q.quality_pass(s, F.col("p"))).collect()] for s in ("smap", "smos")
    )
    assert a == [True, False, False, False, False, False]
    assert b == [True, True, True, False, False, False]


def test_prefer_adjusted_and_one_hot(spark):
    df = spark.createDataFrame([(NAN, 1.0), (NAN, NAN), (INF, 2.0), (3.0, 1.0), (None, -INF)], "a double, r double")
    assert [r[0] for r in df.select(prefer_adjusted(F.col("a"), F.col("r"))).collect()] == [1.0, None, 2.0, 3.0, None]
    basins = spark.createDataFrame([(7,), (None,), (2,)], "b int")
    assert [r[0] for r in basins.select(one_hot(F.col("b"), 2)).collect()] == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5001])
def test_exact_percentiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(0, 1, n), 2)
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "g int, v double")
    got = {r.g: r for r in summaries.exact_percentiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.95}, ["g"]).collect()}
    for g in got:
        mine = v[np.arange(n) % 2 == g]
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(list(np.percentile(mine, [25, 50, 95])), abs=1e-9)


def test_percentile_brackets_follow_the_data(spark):
    """An outlier must not put all other values into one task."""
    df = spark.range(0, 400_000, 1, 8).select(F.rand(3).alias("v")).union(spark.range(1).select(F.lit(1e9)))
    values = np.sort(np.array([r.v for r in df.collect()]))
    got = one(summaries.exact_percentiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.999}))
    assert list(got) == pytest.approx(list(np.percentile(values, [25, 50, 99.9])), abs=1e-12)
    sketch = df.agg(F.percentile_approx("v", [0.5 - 4e-4, 0.5 + 4e-4], 10_000)).first()[0]
    assert 0 < ((values >= sketch[0]) & (values <= sketch[1])).sum() < 0.002 * len(values)


def test_percentiles_of_one_repeated_value(spark):
    df = spark.range(10000).select(F.lit(3.5).alias("v"))
    assert one(summaries.exact_percentiles(df, "v", {"m": 0.5})).m == 3.5


MATCH = "argo_lat double, argo_lon double, argo_datetime timestamp_ntz, wmo bigint, cycle_date date"


def test_split_bounds_and_owners(spark):
    days = [date(2021, 1, 1), date(2022, 12, 31), date(2023, 1, 1), date(2023, 7, 15), date(2024, 5, 1), date(2023, 12, 31)]
    df = spark.createDataFrame([(float(i), 0.0, T0, 5 if i < 5 else None, d) for i, d in enumerate(days)], MATCH)
    naive = {r.argo_lat: r.partition for r in split.split_by_date(df).collect()}
    assert naive == {0.0: "train", 1.0: "train", 3.0: "test", 5.0: "test"}
    drop = {r.argo_lat: r.partition for r in split.split_by_float(df).collect()}
    assert drop == {0.0: "train", 1.0: "train", 3.0: "train", 5.0: "test"}
    follow = {r.argo_lat: r.partition for r in split.split_by_float(df, outside="follow").collect()}
    assert follow == {**drop, 2.0: "train", 4.0: "train"}
    without = {r.argo_lat: r.partition for r in split.split_by_float(df.drop("wmo")).collect()}
    assert without == naive


def test_no_float_is_in_two_partitions(spark):
    from checks import fixtures as fx
    from checks.registry import WINDOWS

    rows = split.split_by_float(fx.pairs_all(spark, "/root/testdata/sf0.001"), WINDOWS, outside="follow")
    assert rows.where("wmo is not null").groupBy("wmo").agg(F.count_distinct("partition").alias("n")).where("n > 1").isEmpty()


def test_membership_labels(spark):
    train = spark.createDataFrame([(1,), (1,), (None,)], "wmo bigint")
    rows = spark.createDataFrame([(1.0, 0.0, T0, 1, T0.date()), (2.0, 0.0, T0, 2, T0.date()), (3.0, 0.0, T0, None, T0.date())], MATCH)
    got = {r.argo_lat: r.float_group for r in groups.label_membership(rows, train).collect()}
    assert got == {1.0: "seen", 2.0: "unseen", 3.0: "unknown"}


def test_scaler_keeps_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    fitted = fit_scaler(df, ["a", "b"])
    assert fitted.stds == (1.0, 1.0)
    assert [tuple(r) for r in fitted.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_linear_fit_is_the_least_norm_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(200)])  # dependent and constant columns
    y = x[:, 0] * 2 - x[:, 2] + 4 + rng.normal(0, 0.1, 200)
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "y"])
    model = linear.fit_linear(df, names, "y")
    centred = x - x.mean(axis=0)
    expected = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    assert model.weights == pytest.approx(list(expected), abs=1e-8)
    assert [r[0] for r in df.select(model.predict()).collect()] == pytest.approx(list(centred @ expected + y.mean()))


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    net = network.new_network(4, (5, 3), seed=1)
    x, y = rng.normal(0, 1, (20, 4)), rng.normal(0, 1, 20)
    _, g = net.loss_gradient(x, y)
    w = net.flat()
    for i in range(0, len(w), 3):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (net.with_flat(w + s).loss_gradient(x, y)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def training_rows(spark, n=3000):
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(-80, 80, n), rng.uniform(-180, 180, n)
    sss = rng.uniform(31, 37, n)
    truth = sss - 0.5 - 0.05 * np.abs(lat)
    part = np.where(np.arange(n) % 5 == 3, "val", np.where(np.arange(n) % 5 == 4, "test", "train"))
    rows = [(float(a), float(b), float(s), float(t), T0, int(i % 6), str(p)) for i, (a, b, s, t, p) in enumerate(zip(lat, lon, sss, truth, part))]
    return spark.createDataFrame(rows, "sat_lat double, sat_lon double, sat_sss double, argo_salinity double, sat_datetime timestamp_ntz, sat_oceanBasin int, partition string")


def test_network_loss_does_not_depend_on_partitions(spark):
    rows = training_rows(spark)
    histories = []
    for parts in (1, 8):
        fitted = compare.fit_corrections(rows.repartition(parts), max_epochs=40)
        histories.append(fitted.network.history)
    assert len(histories[0]) == 40
    assert np.allclose(histories[0], histories[1], rtol=1e-9)


def test_network_learns_what_a_constant_cannot(spark):
    """Ten times the default step, so that a short run gets past the mean offset."""
    rows = add_residual(add_features(training_rows(spark)))
    train, test = (rows.where(F.col("partition") == p) for p in ("train", "test"))
    scaler = fit_scaler(train, FEATURE_COLUMNS)
    net = network.train_network(scaler.transform(rows), FEATURE_COLUMNS, "residual", learning_rate=0.01, max_epochs=150)
    scored = network.score(test, net, scaler).withColumn("constant", F.col("sat_sss") - F.lit(linear.fit_constant(train)))
    rmse = {c: one(metrics.error_metrics(scored, c, "argo_salinity")).rmse for c in ("pred_ffann", "constant", "sat_sss")}
    assert rmse["pred_ffann"] < 0.5 * rmse["constant"] < rmse["sat_sss"]


def test_early_stop_restores_the_best_weights(spark):
    rows = training_rows(spark, 300).withColumn("noise", F.rand(1)).withColumn("y", F.when(F.col("partition") == "val", F.lit(5.0)).otherwise(F.col("noise")))
    net = network.train_network(rows, ["sat_lat"], "y", max_epochs=60, patience=3, learning_rate=0.05)
    losses = [v for _, v in net.history]
    assert len(losses) < 60 and min(losses) < losses[-1]


def test_model_survives_saving(spark, tmp_path):
    net = network.new_network(len(FEATURE_COLUMNS))
    scaler = Scaler(tuple(FEATURE_COLUMNS), tuple([0.5] * 12), tuple([2.0] * 12))
    writers.write_table(network.network_frame(spark, net, scaler), f"{tmp_path}/deep/model")
    back, scaler2 = network.load_network(spark.read.parquet(f"{tmp_path}/deep/model"))
    assert np.array_equal(back.flat(), net.flat()) and scaler2 == scaler


def test_replace_table_while_reading_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.write_table(spark.range(10), path)
    writers.replace_table(spark.read.parquet(path).withColumn("twice", F.col("id") * 2), path)
    assert one(spark.read.parquet(path).agg(F.sum("twice")))[0] == 90
    assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["t"]


def test_unreadable_and_absent_files_give_no_rows(spark, tmp_path):
    path = f"{tmp_path}/sat"
    writers.write_table(spark.createDataFrame([(1.0, NAN)], "lat double, sss double"), path)
    (tmp_path / "sat" / "part-broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)part-broken"):
        readers.read_partitioned(spark, path, readers.SAT_SCHEMA).collect()
    rows = readers.read_partitioned(spark, path, readers.SAT_SCHEMA, skip_bad_files=True).collect()
    skipped = readers.files_without_rows(spark, path, readers.SAT_SCHEMA).collect()
    assert ("part-broken.parquet", 11) in [(r.path.rsplit("/", 1)[1], r.length) for r in skipped]
    assert [(r.lat, r.sss) for r in rows] == [(1.0, None)]
    assert readers.read_partitioned(spark, f"{tmp_path}/none", readers.SAT_SCHEMA).isEmpty()


def test_limits_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    sat = "lat double, lon double, datetime timestamp_ntz, oceanBasin int, sss double, preqc int, sensor string, cycle_date date, cycle_hour string"
    rows = [(1.0, 1.0, T0, 1, v, 0, "smap", date(2021, 1, 1), "00") for v in (35.0, NAN, None, 1.0)]
    writers.write_table(spark.createDataFrame(rows, sat), f"{tmp_path}/sat")
    read = readers.read_sat_obs(spark, f"{tmp_path}/sat", "smap", where=profiles.usable_condition("smap"))
    plan = profiles.usable_sat(read, "smap")._jdf.queryExecution().executedPlan().toString()
    for bound in ("LessThanOrEqual(sss,42.0)", "GreaterThanOrEqual(sss,20.0)", "EqualTo(preqc,0)", "EqualTo(sensor,smap)"):
        assert bound in plan
    assert [r.sss for r in read.collect()] == [35.0]
    argo = "lat double, lon double, oceanBasin int, original_datetime bigint, datetime timestamp_ntz, depth double, salinity double, cycle_date date, cycle_hour string"
    rows = [(1.0, 1.0, 1, t, T0, d, 35.0, date(2021, 1, 1), "00") for t, d in ((10**9, 1.0), (10**9, NAN), (10**9, 9.0), (0, 1.0), (1893456000, 5.0), (1893456001, 5.0))]
    writers.write_table(spark.createDataFrame(rows, argo), f"{tmp_path}/argo")
    read = readers.read_argo_obs(spark, f"{tmp_path}/argo", where=profiles.near_surface_condition())
    plan = profiles.near_surface_levels(read)._jdf.queryExecution().executedPlan().toString()
    for bound in ("LessThanOrEqual(depth,5.0)", "LessThanOrEqual(salinity,42.0)", "GreaterThanOrEqual(salinity,20.0)", "GreaterThanOrEqual(original_datetime,946684800)", "LessThanOrEqual(original_datetime,1893456000)"):
        assert bound in plan
    assert read.count() == profiles.near_surface_levels(readers.read_argo_obs(spark, f"{tmp_path}/argo")).count() == 2


def test_backfill_makes_good_an_early_end_and_records_empty_chunks(spark, tmp_path):
    path = f"{tmp_path}/raw"
    rows = spark.createDataFrame([(datetime(2021, 1, d), 1.0, d) for d in (2, 20)] + [(datetime(2021, 3, 3), 1.0, 1)], "TIME timestamp_ntz, PRES double, PLATFORM_NUMBER int")
    for end in (date(2021, 1, 10), date(2021, 2, 28), date(2021, 3, 31)):
        backfill.backfill(rows, path, date(2021, 1, 1), end, months=1)
    assert spark.read.parquet(path).count() == 3
    done = backfill.finished_chunks(spark, path, date(2021, 1, 1), date(2021, 3, 31), 1).collect()
    assert sorted(r.chunk_start.month for r in done) == [1, 2, 3]
    assert backfill.finished_chunks(spark, path, date(2021, 1, 1), date(2021, 4, 1), 1).count() == 3
    with pytest.raises(ValueError):
        backfill.backfill(rows, path, date(2021, 1, 1), date(2021, 4, 1), months=2)


def test_month_chunks_match_their_rows(spark):
    start, end = date(2021, 1, 20), date(2021, 8, 10)
    chunks = [(r.chunk_start, r.chunk_end) for r in backfill.month_chunks(spark, start, end, 3).collect()]
    assert chunks == [(date(2021, 1, 1), date(2021, 4, 1)), (date(2021, 4, 1), date(2021, 7, 1)), (date(2021, 7, 1), date(2021, 8, 11))]
    rows = spark.createDataFrame([(datetime(2021, 8, 10, 23), 1.0, 5), (datetime(2021, 8, 11), 1.0, 5), (datetime(2021, 1, 1), 11.0, 5), (datetime(2021, 5, 5), 10.0, 6)], "TIME timestamp_ntz, PRES double, PLATFORM_NUMBER int")
    got = {r.chunk_start: r.n_rows for r in backfill.chunk_report(backfill.pending_rows(rows, start, end, 3)).collect()}
    assert got == {date(2021, 7, 1): 1, date(2021, 4, 1): 1}


def test_narrowest_region_wins(spark):
    box = extra_qc.Region("bay", 60.0, 70.0, 0.0, 10.0, 0.0, 10.0)
    df = spark.createDataFrame([(65.0, 5.0, 12.0), (65.0, 50.0, 12.0), (0.0, 0.0, 1.0)], "lat double, lon double, s double")
    got = [(r.region, r.in_bounds) for r in extra_qc.within_region_bounds(df, "s", [box, extra_qc.POLAR_NORTH]).collect()]
    assert got == [("bay", False), ("polar_north", True), ("global", False)]


def test_stream_is_scored_like_a_batch(spark, tmp_path):
    sat = spark.createDataFrame(
        [(1.0, 2.0, T0, 3, 35.0, 0), (1.0, 2.0, T0, 3, 35.0, 4), (5.0, 6.0, T0, None, 36.0, 0), (5.0, 6.0, T0, 1, None, 0)],
        "lat double, lon double, datetime timestamp_ntz, oceanBasin int, sss double, preqc int",
    )
    writers.write_table(sat, f"{tmp_path}/in")
    net = network.new_network(len(FEATURE_COLUMNS))
    scaler = Scaler(tuple(FEATURE_COLUMNS), tuple([0.0] * 12), tuple([10.0] * 12))
    stream = spark.readStream.schema(sat.schema).parquet(f"{tmp_path}/in")
    query = write_corrected(correct_stream(stream, "smap", net, scaler), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, correct_stream(sat, "smap", net, scaler).collect())) and len(got) == 2
    assert all(math.isfinite(r[-1]) for r in got)


def test_cycle_summary_reads_the_levels_for_the_means_once(spark, tmp_path):
    from brinelink.operators.summaries import argo_cycle_summary

    row = "0.5D as lat, 1.5D as lon, 1 as oceanBasin, id as original_datetime, timestamp_ntz'2024-01-01 00:00:00' as datetime"
    cycle = "2.0D as depth, 35.0D + id as salinity, date'2024-01-01' as cycle_date, '00' as cycle_hour"
    spark.range(4).selectExpr(*[c for c in f"{row}, {cycle}".split(", ")]).write.parquet(f"{tmp_path}/levels")
    out = argo_cycle_summary(spark.read.parquet(f"{tmp_path}/levels"))
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("original_datetime" in leaves.apply(i).toString() for i in range(leaves.size())) <= 1
    got = out.collect()
    assert [(r.n_obs, r.n_profiles, r.sal_median, r.sal_max) for r in got] == [(4, 4, 36.5, 38.0)]
