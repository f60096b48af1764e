"""Streams against their batch twins, in several micro-batches."""

import random

from pyspark.sql import functions as F

from tocsin.functions.timebase import HOUR
from tocsin.plans import quality as Q
from tocsin.plans import state as S
from tocsin.sources.sinks import scratch
from tocsin.streaming import ingest, rules, silence
from tocsin.streaming.common import ROCKSDB, files, run_available


def chunks(spark, df, order, n, path):
    """Write the rows as n files in time order, one file per micro-batch."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return f"{path}/*"


def stream(spark, pattern, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(pattern)


def test_rules_twin(spark):
    rnd = random.Random(2)
    ticks, facts, decisions = [], [], []
    for o in (1, 2):
        for h in range(120):
            ticks.append((o, "fire", h, rnd.random(), 0.5, 0.9 if o == 1 else float("inf"), True))
            if rnd.random() < 0.05:
                facts.append((o, "fire", h))
            if rnd.random() < 0.1:
                a = rnd.choice(["REJECT", "MUTE", "REOPEN", "TAKE"])
                decisions.append((o, "fire", h, a, h + 9 if a == "MUTE" else None, True))
    feed = S.rule_inputs(
        spark.createDataFrame(ticks, "object_id bigint, type string, h bigint, score double, thr double, strict double, rejectable boolean"),
        spark.createDataFrame(facts, "object_id bigint, type string, h bigint"),
        spark.createDataFrame(decisions, "object_id bigint, type string, h bigint, action string, until bigint, rejectable boolean"),
    )
    base = scratch(spark, "twin-rules")
    pattern = chunks(spark, feed, ["h", "step"], 5, f"{base}/in")
    run_available(rules.alarm_rules(stream(spark, pattern, feed.schema)), lambda b, n: b.write.mode("append").parquet(f"{base}/out"), f"{base}/ck")
    cols = ["object_id", "h", "alarm", "since", "status", "cleared"]
    live = sorted(map(repr, spark.read.parquet(f"{base}/out").select(*cols).collect()))
    assert live == sorted(map(repr, S.alarm_rules(feed).select(*cols).collect()))


def test_silence_twin(spark):
    rnd = random.Random(4)
    rows = []
    for ch in (1, 2, 3):
        t = 0
        for _ in range(60):
            t += rnd.choice([60, 300, 900, 20000, 90000]) * 1_000_000
            rows.append((ch, t))
    rows += [(9, i * 60_000_000) for i in range(5)]  # speaks at the start only
    df = spark.createDataFrame(rows, "channel_id bigint, us bigint").withColumn("at", F.timestamp_micros("us"))
    base = scratch(spark, "twin-silence")
    pattern = chunks(spark, df.select("channel_id", "us"), ["us"], 4, f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        live = stream(spark, pattern, "channel_id bigint, us bigint").withColumn("at", F.timestamp_micros("us"))
        run_available(silence.channel_silence(live, HOUR, "1 minute"), lambda b, n: b.write.mode("append").parquet(f"{base}/out"), f"{base}/ck")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{base}/out")
    got = {(r["channel_id"], r["since"], r["back_at"]) for r in out.where("back_at is not null").collect()}
    now = max(t for _, t in rows) + 1
    want = {(r["channel_id"], r["since"], r["back_at"]) for r in Q.channel_silence(df, HOUR, now).where("back_at is not null").collect()}
    assert got == want and len(want) > 5
    # a timer told of the channel that never spoke again, once
    told = [(r["channel_id"], r["since"]) for r in out.where("back_at is null").collect()]
    assert told.count((9, 240_000_000)) == 1 and set(told) <= set(rows)


def test_intake_replays_without_doubling(spark):
    base = scratch(spark, "twin-intake")
    bodies = ['{"channel_id": %d, "ts": "2024-01-01T00:00:%02d", "value": "%s"}' % (i % 3, i % 20, "on" if i % 2 else "5") for i in range(60)]
    bodies += ["{broken", '{"channel_id": 99, "ts": "2024-01-01T00:00:00", "value": "x"}', '{"channel_id": 0, "ts": "2024-01-01T00:00:00", "value": "01.02.2020"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    pattern = chunks(spark, df, ["n"], 3, f"{base}/in")
    channels = spark.createDataFrame([(0, "guard", 1), (1, "door", 1), (2, "door", 2)], "channel_id bigint, stype string, object_id bigint")
    paths = ingest.intake(stream(spark, pattern, df.schema), channels, f"{base}/t", f"{base}/ck", "guard")
    # a second run finds nothing new
    ingest.intake(stream(spark, pattern, df.schema), channels, f"{base}/t", f"{base}/ck", "guard")
    journal = spark.read.parquet(paths["journal"])
    keys = {(i % 3, i % 20, "on" if i % 2 else "5") for i in range(60)}
    assert journal.count() == len(keys)
    assert spark.read.parquet(paths["dead"]).count() == 1
    n = spark.read.parquet(paths["counters"]).agg(F.sum("received"), F.sum("accepted"), F.sum("dropped"), F.sum("dead")).first()
    assert tuple(n) == (63, 60, 2, 1)


def test_streamed_sessions_match_batch(spark):
    from tocsin.operators.scan import sessions

    rnd = random.Random(9)
    rows = sorted((rnd.randint(0, 400) * 60_000_000, rnd.randint(1, 2)) for _ in range(150))
    df = spark.createDataFrame([(t, k) for t, k in rows], "us bigint, k int")
    # both join rows exactly one gap apart
    want = {(r["k"], r["t0"], r["t1"]) for r in sessions(df, ["k"], "us", 600_000_000).collect()}
    base = scratch(spark, "twin-sessions")
    far = spark.createDataFrame([(10_000 * 60_000_000, 3)], "us bigint, k int")
    pattern = chunks(spark, df.unionByName(far), ["us"], 3, f"{base}/in")
    live = stream(spark, pattern, df.schema).withColumn("at", F.timestamp_micros("us"))
    out = ingest.sessions(live, "at", ["k"], "10 minutes", "1 minute")
    run_available(out, lambda b, n: b.write.mode("append").parquet(f"{base}/out"), f"{base}/ck")
    got = {(r["k"], r["a"], r["b"]) for r in spark.read.parquet(f"{base}/out").select("k", F.unix_micros("t0").alias("a"), F.unix_micros("t1").alias("b")).collect()}
    assert got == want


def test_file_source(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    s = files(spark, str(tmp_path / "in"), "*.parquet", 1)
    assert s.isStreaming and s.columns == ["id"]


def test_advance_from_memory_equals_one_pass(spark):
    rnd = random.Random(8)
    ticks = [(o, "gas", h, rnd.random(), 0.5, float("inf"), True) for o in (1, 2) for h in range(60) if o == 1 or h < 25]
    facts = [(1, "gas", h) for h in (9, 31, 44)]
    decisions = [(o, "gas", h, a, None, True) for o, h, a in ((1, 5, "REJECT"), (1, 28, "MUTE"), (2, 20, "REJECT"), (1, 40, "REJECT"))]
    feed = S.rule_inputs(
        spark.createDataFrame(ticks, "object_id bigint, type string, h bigint, score double, thr double, strict double, rejectable boolean"),
        spark.createDataFrame(facts, "object_id bigint, type string, h bigint"),
        spark.createDataFrame(decisions, "object_id bigint, type string, h bigint, action string, until bigint, rejectable boolean"),
    )
    cols = ["object_id", "type", "h", "alarm", "since", "status", "cleared"]
    got, memory = [], spark.createDataFrame([], S.MEMORY)
    for a in (0, 20, 40):
        out = S.advance(feed.where((F.col("h") >= a) & (F.col("h") < a + 20)), memory).cache()
        got += map(repr, out.where("of = 'rule'").select(*cols).collect())
        memory = spark.createDataFrame(out.where("of = 'memory'").select(*[f.split(" ")[0] for f in S.MEMORY.split(", ")]).collect(), S.MEMORY)
        assert memory.count() == 2
    assert sorted(got) == sorted(map(repr, S.alarm_rules(feed).select(*cols).collect()))


def test_intake_reads_only_days_of_late_rows(spark, monkeypatch):
    """A hundred days of journal, then rows of the newest hours, repeats and late rows:
    no batch lists or reads other days than those of its late rows."""
    base = scratch(spark, "bounded-intake")
    body = lambda day, second, v: '{"channel_id": 1, "ts": "2024-%02d-%02dT00:00:%02d", "value": "%s"}' % (1 + day // 28, 1 + day % 28, second, v)
    first = [body(d, k, "on") for d in range(100) for k in range(3)]
    second = [body(99, 1, "on"), body(99, 5, "off"), body(99, 5, "off")]  # a repeat, a new row twice
    third = [body(7, 1, "on"), body(7, 9, "late"), body(40, 2, "on"), body(99, 5, "off"), body(100, 1, "on")]
    fourth = [body(7, 9, "late"), body(100, 1, "on"), body(200, 1, "on")]
    rows = [(n, b) for n, part in enumerate((first, second, third, fourth)) for b in part]
    df = spark.createDataFrame(rows, "n int, body string")
    for n in range(4):
        df.where(F.col("n") == n).coalesce(1).write.mode("append").parquet(f"{base}/in")
    channels = spark.createDataFrame([(1, "door", 1)], "channel_id bigint, stype string, object_id bigint")
    read, real = [], ingest.of_days

    def watched(spark_, journal, days):
        out = real(spark_, journal, days)
        read.append((sorted(days), 0 if out is None else len({f.split("day=")[1][:10] for f in out.inputFiles()})))
        return out

    monkeypatch.setattr(ingest, "of_days", watched)
    run = lambda: ingest.intake(files(spark, f"{base}/in", "*.parquet", 1), channels, f"{base}/t", f"{base}/ck", "guard", "1 day")
    paths = run()
    assert read == [([], 0), (["2024-01-08", "2024-02-13"], 2), (["2024-01-08"], 1)]
    assert spark.read.parquet(paths["journal"]).count() == 300 + 1 + 2 + 1
    assert spark.read.parquet(f"{paths['seen']}/batch=3").count() == 1  # only keys within a day of the newest
    assert spark.read.parquet(paths["counters"]).agg(F.sum("accepted")).first()[0] == len(rows)
    # the last batch replayed: its commit is lost, its rows are there
    before = sorted(map(repr, spark.read.parquet(paths["journal"]).collect()))
    import os

    folder = f"{base}/ck/commits".replace("file:", "")
    for name in ("3", ".3.crc"):
        os.remove(f"{folder}/{name}")
    run()
    assert sorted(map(repr, spark.read.parquet(paths["journal"]).collect())) == before


def test_recurrence_twin_with_late_rows(spark):
    """Onsets and decisions out of order by up to 30 hours, joined as streams."""
    from tocsin.functions.timebase import hour_start
    from tocsin.streaming import recurrence
    from tocsin.streaming.common import put

    rnd = random.Random(12)
    onsets = sorted({(o, t, rnd.randint(0, 900)) for o in (1, 2, 3) for t in ("fire", "gas") for _ in range(25)})
    told = sorted({(o, t, rnd.randint(0, 900), rnd.choice(["REJECT", "MUTE", "TAKE"])) for o in (1, 2, 3) for t in ("fire", "gas") for _ in range(25)})
    base = scratch(spark, "twin-recurrence")

    def live(rows, schema, name, far):
        late = sorted(rows, key=lambda r: r[2] + rnd.randint(0, 30))
        for k in range(3):
            spark.createDataFrame(late[k * len(late) // 3 : (k + 1) * len(late) // 3], schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        spark.createDataFrame([far], schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        return files(spark, f"{base}/{name}", "*.parquet", 1).withColumn("at", F.timestamp_micros(hour_start("h")))

    schema = "object_id bigint, type string, h bigint"
    a, b = live(onsets, schema, "onsets", (-1, "", 10**6)), live(told, f"{schema}, action string", "told", (-1, "", 10**6, "MUTE"))
    out = recurrence.recurred(a, b, "40 hours", reach=120)
    run_available(out, lambda d, n: put(d, f"{base}/out", n), f"{base}/ck")
    got = sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{base}/out").select(*out.columns).collect())
    batch = S.recurred(spark.createDataFrame([(*r, "c") for r in told], f"{schema}, action string, command_id string"), spark.createDataFrame(onsets, schema))
    want = sorted(tuple(r) for r in batch.where("hours_after_decision <= 120").select(*out.columns).collect())
    assert got == want and len(want) > 30


def test_cards_twin_with_late_rows(spark):
    """Hours out of order by up to ten, missing hours among them; open counts by type."""
    from tocsin.functions.timebase import hour_start
    from tocsin.streaming import cards

    rnd = random.Random(6)
    rows = [(t, o, h, rnd.random() < 0.6) for t in ("fire", "gas") for o in (1, 2, 3) for h in range(80) if rnd.random() < 0.9]
    schema = "type string, object_id bigint, h bigint, alarm boolean"
    base = scratch(spark, "twin-cards")
    late = sorted(rows, key=lambda r: r[2] + rnd.randint(0, 10))
    for part in (late[: len(late) // 2], late[len(late) // 2 :], [("", 0, 10**6, False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        live = files(spark, f"{base}/in", "*.parquet", 1).withColumn("at", F.timestamp_micros(hour_start("h")))
        paths = cards.card_lifecycle(live, base, f"{base}/ck", "12 hours")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    df = spark.createDataFrame(rows, schema)
    want = [tuple(r) for r in S.card_lifecycle(df.where("alarm"), df).select("type", "object_id", "start", F.when(F.col("closed").isNotNull(), F.col("last")), "closed", "open").collect()]
    got = [tuple(r) for r in cards.cards_of(spark, paths).select("type", "object_id", "start", "last", "closed", "open").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60
    import glob

    newest = max(glob.glob(f"{paths['counts']}/at=*".replace("file:", "")), key=lambda p: int(p.rsplit("=", 1)[1]))
    counts = {r["type"]: r["cards"] for r in spark.read.parquet(newest).collect()}
    assert counts == {t: sum(w[0] == t and w[5] for w in want) for t in ("fire", "gas")}
