"""Streaming jobs run to completion over the given tables."""

from pyspark.sql import DataFrame, functions as F

from ..functions.timebase import HOUR, ORIGIN_US, hour_of, hour_start, us_of
from ..sources import sinks
from ..streaming import cards as streamed_cards, ingest, recurrence, rules, silence
from ..streaming.common import ROCKSDB, files, put, run_available
from .q_detect import LIMIT
from .q_sources import channel_map, messages
from .q_state import busy, decisions, feed, schedule
from .registry import part, query
from .site import SCORED, SHARE, Site


class Live(Site):
    """The same site with the events table read as a stream."""

    def __init__(self, s: Site):
        self.spark, self.dir, self.still = s.spark, s.dir, s

    def table(self, name: str):
        return files(self.spark, self.dir, f"{name}.parquet") if name == "events" else self.still.table(name)


def spot(s: Site, name: str) -> str:
    return sinks.scratch(s.spark, name)


@query(
    "stream_ingest",
    "chmap",
    """SELECT count(*) AS received, count(*) FILTER (NOT ok) AS dead, count(*) FILTER (ok AND c.channel_id IS NOT NULL) AS accepted, count(*) FILTER (ok AND c.channel_id IS NULL) AS dropped, 
 (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('second', ts), event_type FROM events JOIN chmap ON channel_id = user_id WHERE event_id % 19 <> 0 AND event_id % 23 <> 0)) AS journal
FROM (SELECT *, event_id % 19 <> 0 AND event_id % 23 <> 0 AS ok FROM events) e LEFT JOIN chmap c ON c.channel_id = e.user_id""",
)
def stream_ingest(s: Site):
    base = spot(s, "intake")
    paths = ingest.intake(messages(Live(s)), channel_map(s), base, f"{base}/offsets", "guard")
    n = s.spark.read.parquet(paths["counters"]).agg(*[F.sum(c).alias(c) for c in ("received", "dead", "accepted", "dropped")])
    rows = s.spark.read.parquet(paths["journal"]).agg(F.count(F.lit(1)).alias("journal"))
    return n.withColumn("_k", F.lit(1)).join(rows.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("late_data_policy", "", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS rows FROM events GROUP BY 1, 2")
def late_data_policy(s: Site):
    """Hourly counts in update mode; the last update of an hour stands."""
    base = spot(s, "late")
    live = Live(s).table("events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    counts = ingest.hourly_counts(live, "at", ["event_type"], "2 hours")

    def each(batch, number):
        put(batch.select("event_type", F.col("window.start").alias("hour"), "rows"), f"{base}/rows", number)

    q = counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    got = s.spark.read.parquet(f"{base}/rows").groupBy("event_type", "hour").agg(F.max_by("rows", "batch").alias("rows"))
    return got.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("channel_silence_stream", "spells", "SELECT channel_id, since, silent_at // 1000000 AS silent_s, back_at FROM spells WHERE back_at IS NOT NULL")
def channel_silence_stream(s: Site):
    """Spells that ended, from the stream; the timers add those still open."""
    base = spot(s, "silence")
    old = s.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        live = Live(s).table("events").select(F.col("user_id").alias("channel_id"), us_of("ts").alias("us"), F.col("ts").cast("timestamp").alias("at"))
        out = silence.channel_silence(live, LIMIT, "1 hour")
        run_available(out, lambda b, n: put(b, f"{base}/rows", n), f"{base}/offsets")
    finally:
        s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = s.spark.read.parquet(f"{base}/rows").where("back_at is not null")
    return got.select("channel_id", "since", F.floor(F.col("silent_at") / 1000000).alias("silent_s"), "back_at")


@query("alarm_rules_stream")
def alarm_rules_stream(s: Site):
    """The rule machine over a streamed feed; the tests compare it with the
    batch one."""
    base = spot(s, "rules")
    feed(s).write.parquet(f"{base}/feed")
    live = files(s.spark, f"{base}/feed", "*.parquet")
    out = rules.alarm_rules(live)
    run_available(out, lambda b, n: put(b, f"{base}/rows", n), f"{base}/offsets")
    return s.spark.read.parquet(f"{base}/rows").where("alarm is not null").select("object_id", "type", "h", "alarm", "since", "status")


WINDOW = 200
part(
    "hthr",
    "scores",
    f"SELECT a.type, a.h, quantile_cont(s.p, {1 - SHARE}) AS thr FROM (SELECT DISTINCT type, h FROM scores WHERE run = 'busy') a JOIN scores s ON s.run = 'busy' AND s.type = a.type AND s.h BETWEEN a.h - {WINDOW - 1} AND a.h GROUP BY a.type, a.h",
)


@query(
    "hourly_job",
    "scores hthr sched",
    """SELECT s.type, count(*) AS raw, count(*) FILTER (EXISTS (SELECT 1 FROM sched w WHERE w.object_id IN (s.object_id, s.collector_id) AND list_contains(w.types, s.type) AND s.type <> 'sensor'
 AND 1546300800000000 + s.h * 3600000000 >= w.a AND 1546300800000000 + s.h * 3600000000 < w.b)) AS works FROM scores s JOIN hthr USING (type, h) WHERE run = 'busy' AND p >= thr GROUP BY s.type""",
)
def hourly_job(s: Site):
    """The hourly job over the busy score run in ten micro-batches, with
    decisions and facts."""
    base = spot(s, "hourly")
    src = s.scores.where("run = 'busy'").select("type", "object_id", "collector_id", "h", "p")
    lo, hi = src.agg(F.min("h"), F.max("h")).first()
    step = (hi - lo) // 10 + 1
    for k in range(10):  # one file after the other, so that batches come in order
        src.where(F.col("h").between(lo + k * step, lo + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    live = files(s.spark, f"{base}/in", "*.parquet", 1)
    facts = s.episodes.where("noise is null").select("object_id", "type", hour_of("t0").alias("h")).distinct().where(F.col("type").isin(*SCORED))
    paths = rules.hourly_job(live, facts, decisions(s), schedule(s), SHARE, base, f"{base}/offsets", window=WINDOW)
    st = s.spark.read.parquet(paths["status"])
    return st.groupBy("type").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason") == "works").alias("works"))


FAR = 10**6  # an hour after all others: its row lets the watermark pass them


def hours_in_files(s: Site, rows: DataFrame, folder: str, n: int, **far: str) -> DataFrame:
    """The rows as a stream of n files, one after the other, and a last one far ahead of a
    pair by itself, with the values ``far``; ``at`` is the moment of the hour."""
    lo, hi = rows.agg(F.coalesce(F.min("h"), F.lit(0)), F.coalesce(F.max("h"), F.lit(0))).first()
    step = (hi - lo) // n + 1
    for k in range(n):
        rows.where(F.col("h").between(lo + k * step, lo + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(folder)
    last = [F.lit(({"h": FAR, "object_id": -1, "type": ""} | far).get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
    s.spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(folder)
    return files(s.spark, folder, "*.parquet", 1).withColumn("at", F.timestamp_micros(hour_start("h")))


REACH = 168


@query(
    "recurred_audit_stream",
    "dec inc",
    f"""SELECT object_id, type, h, decided, h - decided AS hours_after_decision, h - decided <= 24 AS within_horizon FROM (
 SELECT i.object_id, i.type, i.h, (SELECT max(d.h) FROM dec d WHERE d.action IN ('REJECT', 'MUTE') AND d.object_id = i.object_id AND d.type = i.type AND d.h < i.h AND d.h >= i.h - {REACH}) AS decided
 FROM (SELECT DISTINCT object_id, type, (t0 - {ORIGIN_US}) // {HOUR} AS h FROM inc WHERE noise IS NULL) i) WHERE decided IS NOT NULL""",
)
def recurred_audit_stream(s: Site):
    """Onsets and decisions as two streams, joined within the life of a rejection."""
    base = spot(s, "recurred")
    onsets = s.episodes.where("noise is null").select("object_id", "type", hour_of("t0").alias("h")).distinct()
    facts, told = hours_in_files(s, onsets, f"{base}/onsets", 3), hours_in_files(s, decisions(s).select("object_id", "type", "h", "action"), f"{base}/decisions", 3, action="REJECT")
    out = recurrence.recurred(facts, told, "2 hours", REACH)
    run_available(out, lambda b, n: put(b, f"{base}/rows", n), f"{base}/offsets")
    return s.spark.read.schema(out.schema).parquet(f"{base}/rows").select(out.columns)


@query("card_lifecycle_stream", "cards1", "SELECT type, object_id, start, CASE WHEN closed IS NOT NULL THEN last END AS last, closed, closed IS NULL AS open FROM cards1")
def card_lifecycle_stream(s: Site):
    """The cards of the busy score run from its hours as a stream."""
    base = spot(s, "cards")
    rows = busy(s).select("type", "object_id", "h", (F.col("p") >= F.col("thr")).alias("alarm"))
    old = s.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        paths = streamed_cards.card_lifecycle(hours_in_files(s, rows, f"{base}/hours", 3), base, f"{base}/offsets", "2 hours")
    finally:
        s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return streamed_cards.cards_of(s.spark, paths)
