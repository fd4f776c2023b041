"""Least squares by QR against numpy on the whole table, and validation over folds against fits of each fold."""

from datetime import date, timedelta

import numpy as np
import pytest

from brinelink.models import linear, validation
from brinelink.operators.split import expanding_folds


def frame(spark, x, y, parts=7):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(parts), names


def from_gram(df, names):
    """The fit through sums of products, which squares the condition."""
    k = len(names)
    gram = np.zeros((k + 2, k + 2))
    for i, j, v in linear.gram_matrix(df, [*names, "y"]).collect():
        gram[i, j] = gram[j, i] = v
    means = gram[: k + 1, k + 1] / gram[k + 1, k + 1]
    centred = gram[: k + 1, : k + 1] / gram[k + 1, k + 1] - np.outer(means, means)
    return np.linalg.lstsq(centred[:k, :k], centred[:k, k], rcond=1e-10)[0]


def test_badly_scaled_and_nearly_dependent_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 5)) * np.array([1, 1e2, 1e4, 1e7, 1])
    x[:, 4] = x[:, 0] + 1e-5 * rng.normal(size=2000)
    want = np.array([1.0, 2e-2, -3e-4, 4e-7, 0.5])
    y = x @ want + 3.0 + 0.01 * rng.normal(size=2000)
    df, names = frame(spark, x, y)
    model = linear.fit_linear(df, names, "y")
    by_numpy = np.linalg.lstsq(np.column_stack([x / np.abs(x).max(0), np.ones(2000)]), y, rcond=None)[0]
    by_numpy[:5] /= np.abs(x).max(0)
    error = lambda w: np.max(np.abs((x - x.mean(0)) @ (np.asarray(w) - by_numpy[:5])))
    assert error(model.weights) < 1e-8
    assert np.max(np.abs(np.array(model.weights) / by_numpy[:5] - 1)) < 1e-6
    assert error(from_gram(df, names)) > 100 * error(model.weights)


def test_least_norm_constant_columns_and_missing_rows(spark):
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 3, 500)
    x = np.column_stack([rng.normal(size=500), *(kind == i for i in range(3)), np.full(500, 7.0)]).astype(float)
    y = x[:, 0] * 2 + kind + rng.normal(size=500)
    df, names = frame(spark, x, y)
    model = linear.fit_linear(df.union(df.limit(1).selectExpr("c0", "c1", "c2", "c3", "c4", "double('NaN')")), names, "y")
    want = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    np.testing.assert_allclose(model.weights, want, atol=1e-10)
    assert model.intercept == pytest.approx(y.mean() - want @ x.mean(0), abs=1e-10)
    with pytest.raises(ValueError):
        linear.fit_linear(df.where("false"), names, "y")


def test_many_tasks_are_factored_in_stacks(spark):
    rng = np.random.default_rng(6)
    df, names = frame(spark, rng.normal(size=(300, 3)), rng.normal(size=300), 30)
    a, b = linear.r_factor(df, names), linear.r_factor(df, names, fan_in=2)
    np.testing.assert_allclose(a.T @ a, b.T @ b, atol=1e-9)


def test_fold_errors_equal_separate_fits(spark):
    rng = np.random.default_rng(7)
    n, start = 600, date(2024, 1, 1)
    day = rng.integers(0, 60, n)
    x = np.column_stack([rng.normal(35, 1, n), rng.normal(size=n)])
    y = x[:, 0] - 0.5 + 0.3 * x[:, 1] + 0.05 * rng.normal(size=n)
    rows = [(start + timedelta(days=int(d)), *map(float, a), float(b)) for d, a, b in zip(day, x, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "cycle_date date, sat_sss double, z double, argo_salinity double").repartition(4)
    folds = expanding_folds(start, 20, 10, 3, 5)
    got = {(r.fold, r.method): r for r in validation.fold_errors(df, folds, ["sat_sss", "z"]).collect()}
    assert len(got) == 15
    for k, t0, t1, v0, v1 in folds:
        a, b, c, d = ((t - start).days for t in (t0, t1, v0, v1))
        train, val = (day >= a) & (day <= b), (day >= c) & (day <= d)
        design = np.column_stack([x, np.ones(n)])
        w = np.linalg.lstsq(design[train], y[train], rcond=None)[0]
        offset = np.mean(x[train, 0] - y[train])
        for method, pred in (("raw", x[:, 0]), ("constant_bias", x[:, 0] - offset), ("linear_regression", design @ w)):
            r = got[k, method]
            assert (r.n_train, r.n_val) == (train.sum(), val.sum())
            if val.any():
                e = pred[val] - y[val]
                assert (r.rmse, r.bias) == (pytest.approx(np.sqrt(np.mean(e**2)), abs=1e-8), pytest.approx(e.mean(), abs=1e-8))
            else:
                assert r.rmse is None
