"""Quantiles, bins and drift of many columns against NumPy."""

import numpy as np
import pandas as pd
import pytest

from tocsin.operators.binned import bin_counts, brackets, column_quantiles
from tocsin.plans.study import DECILES, drift_fastest, feature_drift
from pyspark.sql import functions as F


def table(n, seed):
    rnd = np.random.default_rng(seed)
    d = pd.DataFrame({
        "h": rnd.permutation(n),
        "normal": rnd.normal(size=n),
        "moving": rnd.normal(size=n),
        "counts": rnd.poisson(0.4, n).astype(float),
        "rare": np.where(rnd.random(n) < 0.03, rnd.integers(1, 9, n), 0).astype(float),
        "ties": rnd.choice([1.0, 2.0, 2.5], n),
        "flat": np.full(n, 4.0),
        "none": np.full(n, np.nan),
        "holes": np.where(rnd.random(n) < 0.6, np.nan, rnd.normal(size=n)),
        "endless": np.where(rnd.random(n) < 0.1, np.inf, rnd.random(n)),
    })
    d["moving"] += d["h"] / n * 3
    return d


def frame(spark, d):
    # pandas' NaN as NULL in one column, kept in the others
    return spark.createDataFrame(d).withColumn("holes", F.when(~F.isnan("holes"), F.col("holes")))


@pytest.mark.parametrize("n", [1, 2, 6, 57, 4000])
def test_quantiles_of_all_columns(spark, n):
    d = table(n, n)
    cols = [c for c in d.columns if c != "h"]
    got = {(r.feature, round(r.q, 1)): r.value for r in column_quantiles(frame(spark, d).repartition(3), cols, DECILES).collect()}
    want = {}
    for c in cols:
        v = d[c][np.isfinite(d[c])]
        if len(v):
            want |= {(c, round(q, 1)): x for q, x in zip(DECILES, np.quantile(v, DECILES))}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_few_values_leave_a_task(spark):
    """Of 40,000 distinct values only those around the quantiles do."""
    df = spark.range(40_000).select(F.rand(3).alias("x"))
    spans = brackets(df, ["x"], [0.25, 0.5])["x"]
    inside = sum(df.where(F.col("x").between(float(a), float(b))).count() for a, b in spans)
    assert len(spans) == 2 and inside < 600


def psi(ref, cur):
    ref, cur = ref[np.isfinite(ref)], cur[np.isfinite(cur)]
    e = np.unique(np.quantile(ref, DECILES)) if len(ref) else []
    if len(e) < 3:
        u = np.unique(ref)
        if len(u) < 2:
            return None
        e = np.append(u, u[-1] + 1)
    e = e.copy()
    e[0], e[-1] = -np.inf, np.inf
    a, b = (np.clip(np.histogram(x, e)[0] / max(len(x), 1), 1e-4, None) for x in (ref, cur))
    return float(np.sum((b - a) * np.log(b / a)))


def test_drift_of_all_columns(spark):
    d = table(6000, 7)
    cols = [c for c in d.columns if c != "h"]
    got = feature_drift(frame(spark, d), cols, 2000, 1500, 1000, 3)
    back = {(r.feature, r.lag): r.psi for r in got.collect()}
    for c in cols:
        ref = d[c][(d.h >= 500) & (d.h < 2000)].to_numpy()
        for lag in (1, 2, 3):
            want = psi(ref, d[c][(d.h >= 1000 + 1000 * lag) & (d.h < 2000 + 1000 * lag)].to_numpy())
            assert back.get((c, lag)) == (None if want is None else pytest.approx(want, abs=1e-9)), (c, lag)
    families = spark.createDataFrame([(c, "f") for c in cols], "feature string, family string")
    assert drift_fastest(got, families, 3, 1).first().feature == "moving"


def test_empty(spark):
    df = spark.createDataFrame([], "h bigint, x double")
    assert column_quantiles(df, ["x"], DECILES).count() == 0
    assert feature_drift(df, ["x"], 10, 5, 5, 2).count() == 0


def test_no_row_per_feature(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "h bigint, x double, y double")
    plan = bin_counts(df, ["x", "y"], F.col("h") * 0, 1, {"x": [0.5]})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
