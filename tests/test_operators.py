"""Timeline operators against brute force, with a key that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.operators.interval import interval_join
from tocsin.operators.ranks import exact_quantiles, ranked
from tocsin.operators.settle import settle
from tocsin.operators.scan import asof_join, distinct_within, previous_row, running_total, sessions


def hot(n, seed, span=300):
    """Rows (k, t, v); key 0 holds two thirds of them, times repeat."""
    rnd = random.Random(seed)
    return [(0 if rnd.random() < 0.66 else rnd.randint(1, 3), rnd.randint(-span, span), i) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof(spark, direction, strict, how):
    left, right = hot(120, 1), hot(60, 2)
    l = spark.createDataFrame(left, "k int, t bigint, id int")
    r = spark.createDataFrame(right, "k int, rt bigint, v int")
    got = {
        x["id"]: (x["got"], x["val"])
        for x in asof_join(l, r, ["k"], "t", "rt", {"rt": "got", "v": "val"}, direction, strict, how, width=37).collect()
    }
    want = {}
    for k, t, i in left:
        ok = {
            ("backward", False): lambda x: x <= t,
            ("backward", True): lambda x: x < t,
            ("forward", False): lambda x: x >= t,
            ("forward", True): lambda x: x > t,
        }[direction, strict]
        mine = [(rt, v) for rk, rt, v in right if rk == k and ok(rt)]
        if mine:
            at = (max if direction == "backward" else min)(rt for rt, _ in mine)
            want[i] = (at, max(v for rt, v in mine if rt == at))
        elif how == "left":
            want[i] = (None, None)
    assert got == want


def test_running_total_and_previous(spark):
    rows = hot(200, 3)
    df = spark.createDataFrame(rows, "k int, t bigint, id int").withColumn("one", F.lit(1))
    got = {x["id"]: x["s"] for x in running_total(df, ["k"], "t", ["id"], "one", "s", width=41).collect()}
    prev = {x["id"]: x["p"] for x in previous_row(df, ["k"], "t", ["id"], {"id": "p"}, width=41).collect()}
    for k in {r[0] for r in rows}:
        line = sorted((t, i) for kk, t, i in rows if kk == k)
        for n, (t, i) in enumerate(line):
            assert got[i] == n + 1
            assert prev[i] == (line[n - 1][1] if n else None)


@pytest.mark.parametrize("gap", [1, 7, 40])
def test_sessions(spark, gap):
    rows = hot(150, 4)
    df = spark.createDataFrame(rows, "k int, t bigint, id int").withColumn("item", F.col("id") % 5)
    got = {(x["k"], x["t0"]): (x["t1"], x["rows"], x["items"]) for x in sessions(df, ["k"], "t", gap, item="item").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        cur = None
        for t, i in sorted((t, i) for kk, t, i in rows if kk == k):
            if cur is None or t - cur[1] > gap:
                cur = [t, t, 0, set()]
                want[k, t] = cur
            cur[1], cur[2] = t, cur[2] + 1
            cur[3].add(i % 5)
    assert got == {k: (v[1], v[2], len(v[3])) for k, v in want.items()}


@pytest.mark.parametrize("before,after", [(10, 10), (25, 0), (0, 3)])
def test_distinct_within(spark, before, after):
    rows = hot(150, 5)
    df = spark.createDataFrame(rows, "k int, t bigint, id int").withColumn("item", F.col("id") % 9)
    got = {(x["k"], x["t"]): x["n"] for x in distinct_within(df, ["k"], "t", "item", before, after, "n", width=50).collect()}
    want = {(k, t): len({i % 9 for kk, s, i in rows if kk == k and t - before <= s <= t + after}) for k, t, _ in rows}
    assert got == want


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join(spark, closed):
    points = hot(100, 6)
    rnd = random.Random(7)
    spans = [(rnd.randint(0, 3), a, a + rnd.randint(0, 120), i) for i, a in enumerate(rnd.randint(-300, 300) for _ in range(40))]
    p = spark.createDataFrame(points, "k int, t bigint, id int")
    s = spark.createDataFrame(spans, "k int, a bigint, b bigint, sid int")
    got = {(x["id"], x["sid"]) for x in interval_join(p, s, ["k"], "t", "a", "b", 30, closed).collect()}
    want = {(i, sid) for k, t, i in points for kk, a, b, sid in spans if k == kk and a <= t and (t <= b if closed else t < b)}
    assert got == want
    anti = {x["id"] for x in interval_join(p, s, ["k"], "t", "a", "b", 30, closed, "left_anti").collect()}
    assert anti == {i for _, _, i in points} - {i for i, _ in want}


def test_quantiles_and_ranks(spark):
    rnd = random.Random(8)
    rows = [("a" if rnd.random() < 0.8 else "b", float(rnd.choice([0, 0, 0, rnd.random(), rnd.randint(1, 30)]))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    got = {(x["g"], round(x["q"], 6)): x["value"] for x in exact_quantiles(df, ["g"], "v", qs).collect()}
    for g in "ab":
        mine = [v for k, v in rows if k == g]
        for q in qs:
            assert got[g, q] == pytest.approx(float(np.quantile(mine, q)), abs=1e-12)
    for x in ranked(df, ["g"], "v", slices=8).collect():
        assert x["cum_n"] == sum(1 for k, v in rows if k == x["g"] and v <= x["v"])
    for x in ranked(df, ["g"], "v", descending=True, slices=8).collect():
        assert x["cum_n"] == sum(1 for k, v in rows if k == x["g"] and v >= x["v"])


def test_settle_computes_a_stage_once(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    got = settle(spark.range(20).select(F.udf(seen, "bigint")("id").alias("x"), F.lit(None).cast("string").alias("none")))
    assert n.value == 20  # an eager checkpoint runs its last stage twice
    assert sorted(r["x"] for r in got.where("none is null").collect()) == list(range(20)) and n.value == 20


def test_settle_keeps_types(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS BOOLEAN) AS b, null AS v, TIMESTAMP_NTZ '2024-01-01 00:00:00.123456' AS t, named_struct('x', array(1.5D, 'NaN')) AS s")
    got = settle(df)
    assert got.dtypes == df.dtypes and str(got.collect()) == str(df.collect())


def test_packets_take_each_field_once(spark):
    from tocsin.sources import packets as P

    event = f'{{"{P.EVENT_ID}": " 7 ", "{P.CHANNEL}": 3.9, "{P.DATE}": "2024-01-05", "{P.TIME}": "10:00:01", "{P.ALARM}": " T ", "{P.VALUE}": 2.50}}'
    bodies = [f"[{event}, 17, {{}}]", f'{{"events": [{event}]}}', f'{{"события": [{event}]}}', f'{{"events": 5, "события": [{event}]}}', "not json", "5", '{"events": null}', "[]"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "packet int, body string")
    events, bad = P.unpack(rows)
    assert sorted(r["packet"] for r in bad.collect()) == [3, 4, 5, 6]
    assert {r["reason"] for r in bad.collect()} == {P.BAD_PACKET}
    n = P.normalize(events)
    got = {(r["packet"], r["pos"]): (r["reason"], r["channel_id"], str(r["ts"]), r["alarm"], r["value"], r["event_id"]) for r in n.collect()}
    good = (None, 3, "2024-01-05 10:00:01", True, "2.5", 7)
    assert {k: v for k, v in got.items() if v[0] is None} == {(0, 0): good, (1, 0): good, (2, 0): good}
    assert (got[0, 1][0], got[0, 2][0]) == (P.NOT_OBJECT, P.NO_CHANNEL) and len(got) == 5
    plan = n.where("reason is null").select("event_id", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(") <= 7 and plan.count("parseJson(") == 1
