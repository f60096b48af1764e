"""The summary of observation: index and grade of the last day reach its result."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from harness import compare, types_of
from tocsin.catalog import load
from tocsin.catalog.q_detect import NOW, observe_summary
from tocsin.functions.timebase import HOUR

OBJECTS, LAST = 6, 299


def index(ref, win):
    """Inner deciles of the reference as edges, outer bins open."""
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))[1:-1]
    share = lambda x: np.maximum(np.bincount(np.searchsorted(edges, x, side="right"), minlength=len(edges) + 1) / len(x), 1e-6)
    a, b = share(ref), share(win)
    return float(np.sum((b - a) * np.log(b / a)))


def grade(psi):
    return 0 if psi < 0.1 else 1 if psi < 0.25 else 2


def test_last_day_is_compared_with_older_than_a_week(spark):
    rnd = np.random.default_rng(4)
    powers = {"gas": 1.0, "sensor": 0.65, "fire": 0.2}
    h = np.repeat(np.arange(LAST + 1), OBJECTS)
    old, day = h <= LAST - 168, h > LAST - 24
    rows, want = [], {}
    for t, k in powers.items():
        p = rnd.permutation(np.linspace(0, 1, len(h)))
        p[day] = np.linspace(0, 1, day.sum()) ** k
        p[~old & ~day] = 50.0  # hours between are on neither side
        want[t] = index(p[old], p[day])
        rows.append(pd.DataFrame({"run": "busy", "type": t, "object_id": np.tile(np.arange(OBJECTS), LAST + 1), "h": h, "p": p}))
    rows.append(rows[0].assign(type="equipment", p=7.0))  # nothing to compare
    rows += [x.assign(run="recency", p=-x["p"] ** 2) for x in rows]
    scores = spark.createDataFrame(pd.concat(rows))
    journal = spark.createDataFrame([(NOW - HOUR, "smoke"), (NOW - 5 * HOUR, "gas")], "us long, stype string")
    got = {r["type"]: r for r in observe_summary(SimpleNamespace(scores=scores, alarms=scores.where("p > 1"), journal=journal)).collect()}
    assert [grade(want[t]) for t in powers] == [0, 1, 2]
    for t in powers:
        assert got[t]["psi"] == pytest.approx(want[t], abs=1e-6) and got[t]["grade"] == grade(want[t])
    assert got["equipment"]["psi"] is None and got["equipment"]["grade"] is None
    assert {t: r["window_size"] for t, r in got.items()} == dict.fromkeys([*powers, "equipment"], len(h))
    assert {t: r["stale"] for t, r in got.items()} == {"fire": False, "sensor": False, "gas": True, "equipment": True}


def test_whole_query_equals_its_sql(spark, tmp_path):
    rnd = random.Random(8)
    kinds = ["view", "view", "click", "purchase", "signup", "error"]
    # more errors in the end, so that the last day differs
    at = sorted(rnd.random() ** 0.7 * 30 for _ in range(1500))
    events = pd.DataFrame(
        {
            "event_id": range(len(at)),
            "ts": [datetime(2024, 1, 1) + timedelta(days=x) for x in at],
            "user_id": [rnd.randrange(30) for _ in at],
            "event_type": ["error" if x > 28 and rnd.random() < 0.5 else rnd.choice(kinds) for x in at],
            "value": [rnd.random() * 100 for _ in at],
            "props": "{}",
        }
    )
    events.astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    df, sql = entry.queries()["observe_summary"](spark, str(tmp_path)), load()[1]["observe_summary"]
    assert compare("observe_summary", df, con, sql) == ""
    assert not types_of(df, con, sql)
    assert all(r["psi"] > 0 and r["grade"] == grade(r["psi"]) for r in df.collect())
