"""Service sessions against a walk through the disarms."""

import random

from pyspark.sql import functions as F

from tocsin.plans.labels import service_sessions

FIELDS = "object_id int, collector_id int, us long, armed boolean"


def walk(rows, limit):
    """Disarms in order: one older than the limit is replaced by the next, an arm closes."""
    out = set()
    for o in {r[0] for r in rows}:
        arms = sorted(t for k, _, t, armed in rows if k == o and armed)
        offs = {}
        for k, c, t, armed in rows:
            end = next((a for a in arms if a > t), None)
            if k == o and not armed and end is not None:
                offs.setdefault((c, end), set()).add(t)
        for (c, end), times in offs.items():
            start = None
            for t in sorted(times):
                if start is None or t - start > limit:
                    start = t
            if end - start <= limit:
                out.add((o, c, start, end))
    return out


def sessions_of(df):
    return {tuple(r) for r in df.select("object_id", "collector_id", "t0", "t1").collect()}


def test_sessions_equal_a_walk(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), 5, rnd.randrange(900), rnd.random() < 0.05) for _ in range(300)]
    guard = spark.createDataFrame(rows, FIELDS)
    got = {limit: sessions_of(service_sessions(guard, limit, width=11)) for limit in (7, 40, 2000)}
    assert got == {limit: walk(rows, limit) for limit in got}
    assert got[7] and got[2000]


def test_no_rows_and_no_arms(spark):
    assert service_sessions(spark.createDataFrame([], FIELDS)).count() == 0
    assert service_sessions(spark.createDataFrame([(1, 1, 5, False)], FIELDS)).count() == 0


def test_one_block_of_many_disarms(spark):
    """200,000 disarms of one object before its only arm, the limit a hundredth of the block."""
    n, limit = 200_000, 20_000
    offs = spark.range(n).select(F.lit(1).alias("object_id"), F.lit(2).alias("collector_id"), (F.col("id") * 10 + F.pmod(F.hash("id"), F.lit(9))).alias("us"), F.lit(False).alias("armed"))
    times = sorted(r[0] for r in offs.select("us").collect())
    arm = times[-1] + 3
    start = times[0]
    for t in times:
        start = t if t - start > limit else start
    rows = offs.unionByName(spark.createDataFrame([(1, 2, arm, True)], FIELDS))
    assert sessions_of(service_sessions(rows, limit, width=5_000)) == {(1, 2, start, arm)}
