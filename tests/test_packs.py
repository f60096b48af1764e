"""Pair counters against brute force, with the production vocabulary."""

import itertools
import random

from pyspark.sql import functions as F

from tocsin.functions.site_words import FAMILIES, PAIRS
from tocsin.functions.timebase import HOUR, ORIGIN_US
from tocsin.plans import packs as K

FIELDS = "object_id int, channel_id int, pk int, fam string, h long"


def brute(rows, pairs, hours, near):
    want = {}
    for tp, a, b in pairs:
        for (o, c, p, f, h), (q, d, r, g, i) in itertools.product([x for x in rows if x[3] == a], [x for x in rows if x[3] == b]):
            if o == q and c != d and abs(h - i) <= hours and abs(p - r) <= near:
                want.setdefault((o, max(h, i), f"{tp}_{a}_{b}"), set()).add(frozenset((c, d)))
    return {k: len(v) for k, v in want.items()}


def counted(df):
    return {(r.object_id, r.h, r.pair): r.n for r in df.collect()}


def test_pair_counters_of_channels_in_several_families(spark):
    rnd = random.Random(5)
    names = ["smoke", "heat", "door", "fault"]
    pairs = [("t", a, b) for a, b in itertools.combinations_with_replacement(names, 2)]
    pk = {c: rnd.randrange(14) for c in range(24)}
    rows = sorted({(c % 2, c, pk[c], rnd.choice(names), rnd.randrange(40)) for c in rnd.choices(range(24), k=420)})
    act = spark.createDataFrame(rows, FIELDS)
    for hours, near in ((6, 5), (0, 0), (2, 1)):
        assert counted(K.pair_hours(act, pairs, hours, near)) == brute(rows, pairs, hours, near)


def test_one_hot_picket(spark):
    """Thousands of channels of one hour and picket are one row of counts."""
    n = 3000
    act = spark.range(n).select(F.lit(1).alias("object_id"), F.col("id").cast("int").alias("channel_id"), F.lit(7).alias("pk"), F.lit("door").alias("fam"), F.lit(10).cast("bigint").alias("h"))
    got = counted(K.pair_hours(act, [("t", "door", "door")]))
    assert got == {(1, 10, "t_door_door"): n * (n - 1) // 2}


def test_no_activations_no_rows(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert K.pair_hours(empty, PAIRS).count() == 0
    objects = spark.createDataFrame([(1,)], "object_id int")
    assert K.pair_features(empty, PAIRS, objects, 0, 10).count() == 0


def test_production_families(spark):
    rnd = random.Random(9)
    words = [(f, s, w) for f, sign in FAMILIES for s in (sign.stypes or ("Датчик движения",)) for w in sign.states]
    kind = {c: rnd.choice(words) for c in range(60)}
    events = [(1, c, kind[c][1], kind[c][2], ORIGIN_US + rnd.randrange(30) * HOUR + rnd.randrange(HOUR)) for c in rnd.choices(range(60), k=300)]
    journal = spark.createDataFrame(events, "object_id int, channel_id int, stype string, state string, us long")
    pickets = spark.createDataFrame([(c, c % 12) for c in range(60) if c % 9], "channel_id int, pk int")
    act = K.active_hours(journal, pickets, FAMILIES)
    rows = [(r.object_id, r.channel_id, r.pk, r.fam, r.h) for r in act.collect()]
    # the first family whose words match takes the row
    first = {(s, w): next(f for f, sign in FAMILIES if (not sign.stypes or s in sign.stypes) and w in sign.states) for _, s, w in words}
    assert {(c, f) for _, c, _, f, _ in rows} == {(c, first[kind[c][1:]]) for _, c, *_ in events if c % 9}
    assert counted(K.pair_hours(act, PAIRS)) == brute(rows, PAIRS, 6, 5)


def test_one_scan_and_no_join(spark):
    act = spark.createDataFrame([(1, 1, 1, "door", 1)], FIELDS)
    plan = K.pair_counters(act, PAIRS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
