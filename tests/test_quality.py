"""Channel quality against brute force, on the scan, cell and join paths."""

import random

import numpy as np
import pytest

from tocsin.functions.timebase import DAY, HOUR
from tocsin.plans import quality as Q


def readings(seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    # a busy channel, a sparse one with long pauses, and one in between
    for ch, n, days in ((1, 260, 75), (2, 45, 400), (3, 120, 200)):
        for _ in range(n):
            i += 1
            t = int(rnd.random() * days * DAY)
            if ch == 1 and rnd.random() < 0.3:
                t -= t % DAY  # equal moments
            rows.append((ch, t, i, float(rnd.choice([1.0, 1.5, 2.0, 2.5, 40.0 if rnd.random() < 0.05 else 2.0]))))
    return rows


def expected(rows):
    out = {}
    for ch, t, i, v in rows:
        past = sorted((s, x) for c, s, _, x in rows if c == ch and s < t)
        if not past:
            out[i] = (None, None, 0, False)
            continue
        if len(past) <= Q.MIN_HISTORY:
            x = [p[1] for p in past]
        else:
            days = 30
            while True:
                x = [p[1] for p in past if p[0] >= t - days * DAY]
                if len(x) > Q.MIN_HISTORY or len(x) == len(past):
                    break
                days += 30
        med, std = float(np.median(x)), float(np.std(x, ddof=1)) if len(x) > 1 else float("nan")
        out[i] = (med, std, len(x), len(x) >= 2 and std > 0 and abs(v - med) / std > 3)
    return out


@pytest.mark.parametrize("cell,smooth", [(DAY, False), (10 * DAY, False), (6 * HOUR, True), (DAY, True)])
def test_spikes(spark, cell, smooth):
    rows = readings(11)
    if smooth:  # every value another
        rows = [(ch, t, i, v + i / 1000) for ch, t, i, v in rows]
    df = spark.createDataFrame(rows, "channel_id bigint, us bigint, event_id bigint, num double")
    got = {r["event_id"]: r for r in Q.spike_flag(df, cell).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert any(w[3] for w in want.values())
    for i, (med, std, n, spike) in want.items():
        r = got[i]
        assert (r["median"], r["history"], r["spike"]) == (pytest.approx(med), n, spike), i
        if n > 1:
            assert r["std"] == pytest.approx(std)


@pytest.mark.parametrize("width", [HOUR, 3 * DAY])
def test_flapping(spark, width):
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 2), rnd.randint(0, 60) * DAY // 2 + rnd.choice([0, 0, 5]), i, rnd.choice("aab")) for i in range(160)]
    df = spark.createDataFrame(rows, "channel_id bigint, us bigint, event_id bigint, value string")
    got = {r["event_id"]: r["flapping"] for r in Q.flapping_flag(df, 30, width).collect()}
    for ch, t, i, _ in rows:
        past = [v for _, _, v in sorted((s, j, v) for c, s, j, v in rows if c == ch and t - 30 * DAY <= s < t)][-12:]
        want = len(past) >= 12 and sum(a != b for a, b in zip(past, past[1:])) >= 6
        assert got[i] == want, i


def test_silence_of_busy_channel(spark):
    """Cells give the same spells as a walk over every row."""
    rnd = random.Random(3)
    limit, t, rows = HOUR, 0, []
    for i in range(400):
        t += rnd.choice([1, 60, 600, 1200, 9000, 40000]) * 1_000_000 if rnd.random() < 0.3 else 30_000_000
        rows += [(1, t)] * rnd.choice([1, 1, 2])
    now = t + 10 * HOUR
    df = spark.createDataFrame(rows, "channel_id bigint, us bigint")
    got = [(r["since"], r["back_at"]) for r in Q.channel_silence(df, limit, now).orderBy("since").collect()]
    last = gap = None
    seen, want = 0, []
    for _, u in rows:
        if last is not None and u > last:
            pause = u - last
            if seen >= 3 and pause > max(limit, 4 * (gap or 0)):
                want.append((last, u))
            else:
                gap = pause if gap is None else 0.8 * gap + 0.2 * pause
        last, seen = u, seen + 1
    if now - last > max(limit, 4 * gap):
        want.append((last, None))
    assert got == want and len(want) > 3


def test_key_flags(spark):
    df = spark.createDataFrame([("Затоплен",), ("Норма",)], "state string")
    assert [r["flag"] for r in Q.key_state_flag(df).collect()] == ["flood", None]


def test_silence_walks_whole_channels(spark):
    """Many channels in few tasks, also one without an id: no Python call a channel, and the spells of
    each are those of a walk over its rows alone."""
    limit, now = 10, 1000
    moments = lambda c: [c % 7, c % 7 + 4, c % 7 + 8, c % 7 + 8, 60 + c, 64 + c, 300 + 3 * c]
    rows = [(c if c else None, t) for c in range(40) for t in moments(c)]
    want = set()
    for c in range(40):
        last, gap, seen = None, None, 0
        for t in sorted(set(moments(c))):
            if last is not None:
                bound = max(float(limit), Q.LIMIT_FACTOR * (gap or 0.0))
                if seen >= Q.LEAST_EVENTS and t - last > bound:
                    want.add((c or None, last, last + int(bound), t))
                else:
                    gap = t - last if gap is None else Q.KEEP * gap + Q.TAKE * (t - last)
            last, seen = t, seen + moments(c).count(t)
        want.add((c or None, last, last + int(max(float(limit), Q.LIMIT_FACTOR * (gap or 0.0))), None))
    got = Q.channel_silence(spark.createDataFrame(rows, "channel_id bigint, us bigint"), limit, now)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert len(want) > 80 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
