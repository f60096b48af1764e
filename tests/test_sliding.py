"""Quantiles of sliding windows beside numpy, and how many rows meet windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.operators import sliding
from tocsin.plans import alarms, state


def brute(rows, windows):
    out = {}
    for g, w, a, b, qs in windows:
        v = [x for k, c, x in rows if k == g and a <= c < b and x is not None]
        for i, q in enumerate(qs if v else []):
            out[g, w, i] = (len(v), pytest.approx(float(np.quantile(v, q))))
    return out


def found(df):
    return {(r["g"], r["w0"], r["i"]): (r["n"], r["value"]) for r in df.collect()}


def test_windows_beside_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", int(c), float(x)) for c, x in zip(rng.integers(0, 90, 4_000), rng.normal(size=4_000))]
    rows += [("b", int(c), float(x) / 4) for c, x in zip(rng.integers(0, 40, 900), rng.integers(0, 4, 900))]  # ties
    rows += [("c", c, 1.0) for c in range(30)] + [("d", 5, None), ("e", 3, -2.0), ("b", 200, 9.0)]
    qs = [0.0, 0.2, 0.5, 0.995, 1.0]
    windows = [(g, 100 * k + d, k - d, k, qs[: 3 + d % 3]) for g in "abcdef" for k in range(0, 95, 4) for d in (1, 7, 30)] + [("b", -1, 60, 150, qs), ("b", -2, 0, 500, qs)]
    df = spark.createDataFrame(rows, "g string, c int, x double")
    w = spark.createDataFrame(windows, "g string, w0 long, a long, b long, qs array<double>")
    got = found(sliding.sliding_quantiles(df, ["g"], "c", "x", w, ["w0"], 30))
    assert got == brute(rows, windows)
    assert found(sliding.sliding_quantiles(df.where("false"), ["g"], "c", "x", w, ["w0"], 30)) == {}
    assert found(sliding.sliding_quantiles(df, ["g"], "c", "x", w.where("false"), ["w0"], 30)) == {}


def test_rows_do_not_multiply_with_the_window(spark, monkeypatch):
    """Of 60,000 rows in a window for every hour of 200 that looks back 150 hours, few meet a window."""
    seen, real = [], sliding.interval_join

    def counted(points, spans, *args, **kwargs):
        out = real(points, spans, *args, **kwargs)
        seen.append(out.count())
        return out

    monkeypatch.setattr(sliding, "interval_join", counted)
    rows = spark.range(60_000).select(F.lit("a").alias("type"), (F.col("id") % 200).alias("h"), (F.hash("id") / 2.0**32).alias("p"))
    windows = spark.range(200).select(F.lit("a").alias("type"), F.col("id").alias("at"), (F.col("id") - 149).alias("a"), (F.col("id") + 1).alias("b"), F.array(F.lit(0.9), F.lit(0.995)).alias("qs"))
    out = sliding.sliding_quantiles(rows, ["type"], "h", "p", windows, ["at"], 150)
    assert out.count() == 400
    assert seen[0] < 60_000 / 4  # copying to the windows would make over 6 million


def test_thresholds_of_days_and_hours(spark):
    rng = np.random.default_rng(4)
    rows = [("t", int(h), float(p)) for h, p in zip(rng.integers(0, 24 * 20, 3_000), rng.random(3_000))]
    df = spark.createDataFrame(rows, "type string, h long, p double")
    got = {(r["day"], r["days"], r["share"]): r["thr"] for r in alarms.rolling_thresholds(df, ["type"], [3, 9], [0.1, 0.005], 400).collect()}
    for day in range(20):
        for days in (3, 9):
            v = [p for _, h, p in rows if day - days <= h // 24 < day]
            for share in (0.1, 0.005):
                assert ((day, days, share) in got) == (len(v) >= 400)
                if len(v) >= 400:
                    assert got[day, days, share] == pytest.approx(float(np.quantile(v, 1 - share)))
    asks = spark.createDataFrame([("t", h) for h in (0, 100, 300, 5_000, -40)], "type string, h long")
    share = spark.createDataFrame([("t", 0.02)], "type string, share double")
    ignored = spark.createDataFrame([(90, 95)], "a long, b long")
    kept = [(h, p) for _, h, p in rows if not 90 <= h < 95]
    last = max(h for h, _ in kept)
    for r in state.threshold_90d(df, asks, share, ignored, window=60).collect():
        to = r["h"] if 0 <= r["h"] <= last + 59 else last
        assert r["thr"] == pytest.approx(float(np.quantile([p for h, p in kept if to - 60 < h <= to], 0.98)))


@pytest.mark.parametrize("sizes", [(1_000, 16), (7, 2)])
def test_isotonic_blocks_and_lines(spark, sizes):
    """Blocks beside the max-min formula, however the scores are cut; lines beside numpy."""
    from fractions import Fraction

    from tocsin.operators.isotonic import along, isotonic

    rng = np.random.default_rng(3)
    rows = [(g, float(round(x, 2)), int(rng.random() < x)) for g in "ab" for x in rng.random(300)] + [("c", 0.5, 1), ("d", 0.1, 1), ("d", 0.9, 0), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    blocks = isotonic(df, ["g"], "p", F.col("y"), *sizes)
    got = {}
    for r in blocks.collect():
        got.setdefault(r["g"], []).append((r["lo"], r["hi"], r["n"], r["value"]))
    for g in "abcd":
        at = sorted({p for k, p, _ in rows if k == g and p is not None})
        total, n = ([sum(y if w else 1 for k, p, y in rows if k == g and p == q) for q in at] for w in (1, 0))
        mean = lambda a, b: Fraction(sum(total[a : b + 1]), sum(n[a : b + 1]))  # noqa: B023, E731
        fit = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
        want = [(min(p for p, f in zip(at, fit) if f == v), max(p for p, f in zip(at, fit) if f == v), sum(k for k, f in zip(n, fit) if f == v), float(v)) for v in sorted(set(fit))]
        assert sorted(got[g]) == want
        asked = spark.createDataFrame([(g, x / 40) for x in range(-4, 45)], "g string, p double")
        for r in along(blocks, asked, ["g"], "p", "c").collect():
            assert r["c"] == pytest.approx(float(np.interp(r["p"], at, [float(f) for f in fit])))
    assert isotonic(df.where("false"), ["g"], "p", F.col("y")).count() == 0


def test_counts_between_moments(spark):
    """Windows that share ends, points on the ends, keys without points."""
    from tocsin.operators.moments import counts_within

    rng = np.random.default_rng(8)
    points = [(int(k), int(t), int(v)) for k, t, v in zip(rng.integers(0, 3, 500), rng.integers(0, 300, 500), rng.integers(0, 5, 500))]
    rows = [(k, t, k * 1000 + t) for k in range(5) for t in range(-20, 330, 9)]
    df, e = spark.createDataFrame(points, "k int, t long, v int"), spark.createDataFrame(rows, "k int, at long, id long")
    windows = {"short": (F.col("at") - 10, F.col("at")), "long": (F.col("at") - 100, F.col("at")), "next": (F.col("at"), F.col("at") + 7)}
    got = counts_within(df, ["k"], "t", {"n": F.lit(1), "v": F.col("v")}, e, ["k", "id", "at"], windows, 16).collect()
    assert len(got) == len(rows)
    for r in got:
        for name, (a, b) in {"short": (-10, 0), "long": (-100, 0), "next": (0, 7)}.items():
            hit = [v for k, t, v in points if k == r["k"] and r["at"] + a <= t < r["at"] + b]
            assert (r[f"{name}_n"], r[f"{name}_v"]) == (len(hit), sum(hit))
