"""Exact percentiles of large groups: no task ranks more than a fixed number of values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelink.operators import summaries


@pytest.fixture
def narrow(monkeypatch):
    """Few values may be ranked; what is left of the brackets is noted."""
    monkeypatch.setattr(summaries, "RANK_LIMIT", 200)
    monkeypatch.setattr(summaries, "_BINS", 16)
    left = []
    plain = summaries._narrowed

    def noted(held, below):
        held, below = plain(held, below)
        left.append(held.groupBy("g", "w", "rank").count().agg(F.max("count")).first()[0])
        return held, below

    monkeypatch.setattr(summaries, "_narrowed", noted)
    return left


PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9999, "e": 1.0}


def wanted(values):
    return list(np.percentile(values, [100 * p for p in PROBS.values()]))


def test_two_million_values_in_one_group(spark, narrow):
    df = spark.range(2_000_000, numPartitions=8).select((F.pow((F.col("id") * 7919 + 13) % 2_000_003, 2.0) / 1e3).alias("v"))
    values = (((np.arange(2_000_000, dtype=np.int64) * 7919 + 13) % 2_000_003).astype(float)) ** 2 / 1e3
    got = summaries.exact_percentiles(df, "v", PROBS).first()
    assert list(got) == pytest.approx(wanted(values), rel=1e-12)
    assert narrow and max(narrow) <= 200


def test_groups_outliers_and_ties(spark, narrow):
    rng = np.random.default_rng(8)
    groups = {
        "spread": np.concatenate([rng.normal(size=3000), [1e12, -1e12]]),
        "ties": rng.integers(0, 5, 3000).astype(float),
        "clustered": np.concatenate([rng.uniform(0, 1e-9, 1500), rng.uniform(1, 1 + 1e-9, 1501)]),
        "one": np.array([4.0]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double").repartition(5)
    got = {r.g: r for r in summaries.exact_percentiles(df, "v", PROBS, ["g"]).collect()}
    for g, x in groups.items():
        assert [got[g][c] for c in PROBS] == pytest.approx(wanted(x), rel=1e-12, abs=1e-15)
    assert max(narrow) <= 200
