"""Alarm state, decisions, commands, messages."""

from pyspark.sql import functions as F

from ..functions.timebase import DAY, HOUR, ORIGIN_US, hour_of, us_of
from ..plans import state as T
from .q_detect import NOW
from .registry import part, query
from .site import SCORED, SHARE, Site


def busy(s: Site):
    return s.scores.where("run = 'busy'").join(s.thresholds(SHARE).select("run", "type", "split", "thr"), ["run", "type", "split"])


part("bz", "scores thr", "SELECT * FROM scores JOIN thr USING (run, type, split) WHERE run = 'busy'")


@query(
    "alarm_threshold_90d",
    "scores",
    """SELECT a.type, CAST(a.h AS BIGINT) AS h, round(quantile_cont(s.p, 0.8), 6) AS thr FROM (SELECT * FROM (VALUES (44000), (44100), (44450), (46000)) v(h), (SELECT DISTINCT type FROM scores)) a
 JOIN (SELECT *, max(h) OVER (PARTITION BY type) AS last, min(h) OVER (PARTITION BY type) AS first FROM scores WHERE run = 'busy' AND NOT (h >= 44050 AND h < 44060)) s ON s.type = a.type
 AND s.h BETWEEN CASE WHEN a.h - 199 <= last AND a.h >= first THEN a.h ELSE last END - 199 AND CASE WHEN a.h - 199 <= last AND a.h >= first THEN a.h ELSE last END GROUP BY a.type, a.h""",
)
def alarm_threshold_90d(s: Site):
    asks = s.spark.createDataFrame([(t, h) for t in SCORED for h in (44000, 44100, 44450, 46000)], "type string, h bigint")
    share = s.spark.createDataFrame([(t, 0.2) for t in SCORED], "type string, share double")
    bad = s.spark.createDataFrame([(44050, 44060)], "a bigint, b bigint")
    t = T.threshold_90d(s.scores.where("run = 'busy'"), asks, share, bad, window=200)
    return t.withColumn("thr", F.round("thr", 6))


@query(
    "share_estimate",
    "scores",
    """SELECT run, type, round(max(t), 6) AS threshold, round(count(*) FILTER (p >= t) / (count(*) / 24), 6) AS alarms_per_object_day, round(count(*) / 24, 1) AS object_days
 FROM (SELECT *, quantile_cont(p, 0.9) OVER (PARTITION BY run, type) AS t FROM scores) GROUP BY run, type""",
)
def share_estimate(s: Site):
    e = T.share_estimate(s.scores, ["run", "type"], 0.1)
    return e.withColumns({c: F.round(c, 6) for c in ("threshold", "alarms_per_object_day")})


def feed(s: Site):
    """Ticks of the busy score, decisions read out of the events, true onsets."""
    b = busy(s)
    strict = F.when(F.col("type") == "sensor", F.lit(None).cast("double")).otherwise(F.col("thr") * 2)
    ticks = b.select("object_id", "type", "h", F.col("p").alias("score"), "thr", strict.alias("strict"), (F.col("type") != "sensor").alias("rejectable"))
    facts = s.episodes.where("noise is null").select("object_id", "type", hour_of("t0").alias("h")).distinct()
    return T.rule_inputs(ticks, facts.where(F.col("type").isin(*SCORED)), decisions(s))


def decisions(s: Site):
    e = s.table("events").where("event_type = 'signup'")
    i = F.col("event_id")
    names = F.array(*[F.lit(a) for a in ("TAKE", "REJECT", "MUTE", "REOPEN", "REJECT")])
    types = F.array(*[F.lit(t) for t in SCORED])
    h = hour_of(us_of("ts"))
    t = F.element_at(types, (i % 4 + 1).cast("int"))
    return e.select(
        (F.col("user_id") % 12).alias("object_id"), t.alias("type"), h.alias("h"),
        F.element_at(names, (i % 5 + 1).cast("int")).alias("action"),
        F.when(i % 5 == 2, h + 12).alias("until"), (t != "sensor").alias("rejectable"),
        F.concat(F.lit("c"), i).alias("command_id"),
    )


part(
    "dec",
    "",
    f"""SELECT event_id, user_id % 12 AS object_id, ['fire', 'gas', 'equipment', 'sensor'][event_id % 4 + 1] AS type, (epoch_us(ts) - {ORIGIN_US}) // {HOUR} AS h,
 ['TAKE', 'REJECT', 'MUTE', 'REOPEN', 'REJECT'][event_id % 5 + 1] AS action, 'c' || event_id AS command_id FROM events WHERE event_type = 'signup'""",
)


@query("alarm_rules")
def alarm_rules(s: Site):
    return T.alarm_rules(feed(s)).where("alarm is not null").select("object_id", "type", "h", "alarm", "since", "status")


@query("decision_events")
def decision_events(s: Site):
    """Hours of each status a decision led to."""
    return T.alarm_rules(feed(s)).where("status is not null").groupBy("type", "status").agg(F.count(F.lit(1)).alias("hours"))


@query("fact_clears")
def fact_clears(s: Site):
    return T.alarm_rules(feed(s)).where("cleared is not null").select("object_id", "type", "h", "cleared")


@query(
    "recurred_audit",
    "dec inc",
    f"""SELECT object_id, type, h, decided, h - decided AS hours_after_decision, h - decided <= 24 AS within_horizon FROM (
 SELECT i.object_id, i.type, i.h, (SELECT max(d.h) FROM dec d WHERE d.action IN ('REJECT', 'MUTE') AND d.object_id = i.object_id AND d.type = i.type AND d.h < i.h) AS decided
 FROM (SELECT DISTINCT object_id, type, (t0 - {ORIGIN_US}) // {HOUR} AS h FROM inc WHERE noise IS NULL) i) WHERE decided IS NOT NULL""",
)
def recurred_audit(s: Site):
    onsets = s.episodes.where("noise is null").select("object_id", "type", hour_of("t0").alias("h")).distinct()
    r = T.recurred(decisions(s), onsets)
    return r.select("object_id", "type", "h", "decided", "hours_after_decision", "within_horizon")


def envelopes(s: Site):
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("decision.take", "decision.reject", "settings.works", "what", "settings.gaps")]), (i % 5 + 1).cast("int"))
    cid = F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("id"), F.floor(i / 2) * 5 + i % 5))
    payload = F.when(i % 5 < 2, F.concat(F.lit('{"object_id": '), F.col("user_id") % 12, F.when(i % 31 == 0, "}").otherwise(F.lit(', "type": "fire"}')))).otherwise(
        F.when(i % 37 == 0, "5").otherwise(F.concat(F.lit('{"version": '), F.floor(F.col("value")), F.lit("}")))
    )
    body = F.when(i % 23 == 0, "{not json").otherwise(
        F.concat(F.lit('{"schema": '), F.when(i % 41 == 0, "2").otherwise("1"), F.lit(', "command_id": "'), cid, F.lit('", "kind": "'), kind, F.lit('", "payload": '), payload, F.lit("}"))
    )
    return s.table("events").select(i.alias("arrival"), body.alias("body"))


part(
    "env",
    "",
    """SELECT event_id AS arrival, CASE WHEN event_id % 23 <> 0 THEN CASE WHEN event_id % 29 = 0 THEN '' ELSE 'id' || (event_id // 2 * 5 + event_id % 5) END END AS command_id,
 CASE WHEN event_id % 23 <> 0 THEN ['decision.take', 'decision.reject', 'settings.works', 'what', 'settings.gaps'][event_id % 5 + 1] END AS kind,
 CAST(floor(value) AS BIGINT) AS version, CASE WHEN event_id % 23 = 0 OR event_id % 41 = 0 THEN 'envelope is not schema 1' WHEN event_id % 29 = 0 THEN 'no command_id' WHEN event_id % 5 = 3 THEN 'unknown kind'
  WHEN event_id % 5 >= 2 AND event_id % 37 = 0 THEN 'payload is not an object' WHEN event_id % 5 < 2 AND event_id % 31 = 0 THEN 'object_id and type are needed' END AS refusal FROM events""",
)
part("env2", "env", "SELECT *, refusal IS NULL AND arrival = min(CASE WHEN refusal IS NULL THEN arrival END) OVER (PARTITION BY command_id) AS acts FROM env")


@query(
    "commands_dedupe",
    "env2",
    """SELECT arrival, command_id, kind, refusal, CASE WHEN refusal IS NOT NULL THEN 'refused' WHEN NOT acts THEN 'duplicate' WHEN kind LIKE 'settings.%' AND version <= coalesce(
  (SELECT max(b.version) FROM env2 b WHERE b.acts AND b.kind = e.kind AND b.arrival < e.arrival), 0) THEN 'stale' ELSE 'applied' END AS fate FROM env2 e""",
)
def commands_dedupe(s: Site):
    return T.commands(envelopes(s)).select("arrival", "command_id", "kind", "refusal", "fate")


def schedule(s: Site):
    e = s.table("events").where("event_type = 'purchase' and value > 100")
    i = F.col("event_id")
    start = us_of(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    return e.select(
        F.concat(F.lit("w"), i).alias("work_id"), F.when(i % 4 == 0, 100 + (F.col("user_id") % 12) % 4).otherwise(F.col("user_id") % 12).alias("object_id"),
        F.when(i % 3 == 0, F.array(F.lit("fire"), F.lit("sensor"))).otherwise(F.array(F.lit("equipment"))).alias("types"),
        start.alias("a"), (start + 12 * HOUR).alias("b"),
    )


part(
    "sched",
    "",
    f"""SELECT 'w' || event_id AS work_id, CASE WHEN event_id % 4 = 0 THEN 100 + (user_id % 12) % 4 ELSE user_id % 12 END AS object_id, CASE WHEN event_id % 3 = 0 THEN ['fire', 'sensor'] ELSE ['equipment'] END AS types,
 epoch_us(date_trunc('hour', ts)) AS a, epoch_us(date_trunc('hour', ts)) + 12 * {HOUR} AS b FROM events WHERE event_type = 'purchase' AND value > 100""",
)
part(
    "wmute",
    "bz sched",
    f"""SELECT s.object_id, s.type, s.h, min(w.work_id) AS work_id FROM bz s JOIN sched w ON w.object_id IN (s.object_id, s.collector_id) AND list_contains(w.types, s.type)
 AND {ORIGIN_US} + s.h * {HOUR} >= w.a AND {ORIGIN_US} + s.h * {HOUR} < w.b WHERE s.type <> 'sensor' GROUP BY ALL""",
)


@query("works_mute", "wmute", "SELECT * FROM wmute")
def works_mute(s: Site):
    return T.works_mute(busy(s).select("object_id", "collector_id", "type", "h"), schedule(s))


def decided(s: Site):
    r = T.alarm_rules(feed(s)).where("alarm is not null").select("object_id", "type", "h", "alarm", F.when(F.col("status") != "ALARM", F.col("status")).alias("decided"))
    raw = busy(s).select("object_id", "type", "h", (F.col("p") >= F.col("thr")).alias("raw"))
    return r.join(raw, ["object_id", "type", "h"]).withColumn("command_id", F.lit(None).cast("string"))


@query(
    "status_table",
    "bz wmute",
    """SELECT object_id, type, h, CASE WHEN work_id IS NOT NULL THEN 'MUTED' ELSE 'ALARM' END AS status, CASE WHEN work_id IS NOT NULL THEN 'works' END AS reason, work_id AS ref
 FROM bz LEFT JOIN wmute USING (object_id, type, h) WHERE p >= thr""",
)
def status_table(s: Site):
    """Statuses of an hour with no decisions taken; the tests add decisions."""
    rows = busy(s).select(
        "object_id", "type", "h", (F.col("p") >= F.col("thr")).alias("raw"), (F.col("p") >= F.col("thr")).alias("alarm"),
        F.lit(None).cast("string").alias("decided"), F.lit(None).cast("string").alias("command_id"),
    )
    muted = T.works_mute(busy(s).select("object_id", "collector_id", "type", "h"), schedule(s))
    return T.status_table(rows, muted)


@query(
    "forecast_message",
    "bz",
    """SELECT object_id, h, count(*) AS types, count(*) FILTER (p >= thr) AS alarms, round(max(p) FILTER (type = 'fire'), 6) AS fire_score FROM bz GROUP BY 1, 2""",
)
def forecast_message(s: Site):
    rows = busy(s).select(
        "object_id", "h", "type", F.col("p").alias("score"), F.col("thr").alias("threshold"), (F.col("p") >= F.col("thr")).alias("alarm"), F.lit(0).alias("since"),
        F.array(F.lit("busy")).alias("reasons"), F.array(F.col("object_id")).alias("evidence"),
    )
    m = T.forecast_message(rows, "v1")
    back = F.from_json("message", "schema int, kind string, types map<string, struct<score: double, threshold: double, alarm: boolean>>")
    j = m.select("object_id", "h", back.alias("m"))
    on = F.filter(F.map_values("m.types"), lambda b: b["alarm"])
    return j.select("object_id", "h", F.size("m.types").cast("bigint").alias("types"), F.size(on).cast("bigint").alias("alarms"), F.round(F.col("m.types")["fire"]["score"], 6).alias("fire_score"))


part(
    "factrows",
    "inc teps",
    f"""SELECT object_id, (t0 - {ORIGIN_US}) // {HOUR} AS h, type, min(t0) AS started, CAST(NULL AS VARCHAR) AS direction FROM inc WHERE type IN ('fire', 'gas') AND noise IS NULL GROUP BY ALL
 UNION ALL SELECT object_id, t0, 'temperature', t0 * {HOUR} + {ORIGIN_US}, max(direction) FROM teps GROUP BY object_id, t0""",
)


@query(
    "fact_message",
    "factrows",
    """SELECT object_id, h, count(*) FILTER (NOT merged) AS types, count(*) FILTER (merged) AS merged FROM (SELECT *, type = 'temperature' AND direction = 'hot' AND max(CAST(type = 'fire' AS INT)) OVER (PARTITION BY object_id, h) = 1 AS merged FROM factrows) GROUP BY 1, 2""",
)
def fact_message(s: Site):
    from ..functions.timebase import hour_start
    from .q_detect import temp_eps

    e = s.episodes.where("type in ('fire', 'gas') and noise is null").groupBy("object_id", hour_of("t0").alias("h"), "type").agg(F.min("t0").alias("started"), F.max("t1").alias("last"))
    t = temp_eps(s).groupBy("object_id", F.col("t0").alias("h")).agg(F.max("direction").alias("direction"), F.max("t1").alias("last")).select(
        "object_id", "h", F.lit("temperature").alias("type"), hour_start("h").alias("started"), hour_start("last").alias("last"), "direction"
    )
    facts = e.withColumn("direction", F.lit(None).cast("string")).unionByName(t)
    facts = facts.withColumns({"new": F.lit(True), "note": F.lit(None).cast("string"), "work_id": F.lit(None).cast("string")})
    m = T.fact_message(facts, "v1")
    back = F.from_json("message", "types map<string, struct<started_at: bigint, temperature: struct<direction: string>>>")
    j = m.select("object_id", "h", back.alias("m"))
    warm = F.filter(F.map_values("m.types"), lambda b: b["temperature"].isNotNull())
    return j.select("object_id", "h", F.size("m.types").cast("bigint").alias("types"), F.size(warm).cast("bigint").alias("merged"))


part(
    "notes",
    "",
    """SELECT CASE WHEN event_id % 19 = 0 THEN '' ELSE 'n' || event_id % 200 END AS notice_id, CASE event_id % 200 % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'telegram' ELSE 'pigeon' END AS channel,
 CASE WHEN event_id % 17 = 0 THEN ' ' ELSE event_type END AS text, user_id, epoch_us(ts) AS at_us, event_id FROM events""",
)


def notices(s: Site):
    i = F.col("event_id")
    rec = F.array(F.concat(F.lit(" User"), F.col("user_id"), F.lit("@x.io ")), F.concat(F.lit("user"), F.col("user_id"), F.lit("@x.io")), F.concat(F.lit("U"), F.col("user_id") % 7))
    return s.table("events").select(
        F.when(i % 19 == 0, "").otherwise(F.concat(F.lit("n"), i % 200)).alias("notice_id"),
        F.when(i % 200 % 3 == 0, "email").when(i % 200 % 3 == 1, "telegram").otherwise("pigeon").alias("channel"),
        F.lit("s").alias("subject"), F.when(i % 17 == 0, " ").otherwise(F.col("event_type")).alias("text"), rec.alias("recipients"), us_of("ts").alias("at"),
    )


@query(
    "retry_dedupe_notices",
    "notes",
    """SELECT notice_id, recipient, CAST((row_number() OVER (PARTITION BY notice_id ORDER BY recipient) - 1) // 5 AS BIGINT) AS chunk FROM (
 SELECT DISTINCT notice_id, unnest(CASE channel WHEN 'email' THEN ['user' || user_id || '@x.io', 'u' || user_id % 7] ELSE ['User' || user_id || '@x.io', 'user' || user_id || '@x.io', 'U' || user_id % 7] END) AS recipient
 FROM notes WHERE notice_id <> '' AND channel IN ('email', 'telegram') AND trim(text) <> '') WHERE recipient NOT IN ('u3', 'U3')""",
)
def retry_dedupe_notices(s: Site):
    n = notices(s)
    # those served earlier: every recipient numbered 3
    sent = n.select("notice_id", F.explode(F.array(F.lit("u3"), F.lit("U3"))).alias("recipient"), "at").groupBy("notice_id", "recipient").agg(F.max("at").alias("at"))
    todo, _ = T.plan_notices(n, sent, 5, 365 * DAY)
    return todo.select("notice_id", "recipient", "chunk")


part(
    "cards1",
    "bz runs",
    """SELECT type, object_id, start, last, last - start + 1 AS age, (SELECT min(b.h) FROM bz b WHERE b.type = c.type AND b.object_id = c.object_id AND b.p < b.thr AND b.h > c.last) AS closed FROM (
 SELECT type, object_id, min(h) AS start, max(h) AS last FROM (SELECT *, sum(n2) OVER (PARTITION BY type, object_id ORDER BY h) AS r FROM (
  SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY type, object_id ORDER BY h) = 1 THEN 0 ELSE 1 END AS n2 FROM bz WHERE p >= thr)) GROUP BY type, object_id, r) c""",
)


def cards(s: Site):
    rows = busy(s).select("type", "object_id", "h", (F.col("p") >= F.col("thr")).alias("alarm"))
    return T.card_lifecycle(rows.where("alarm"), rows)


@query("card_lifecycle", "cards1", "SELECT type, object_id, start, last, age, closed, closed IS NULL AS open FROM cards1")
def card_lifecycle(s: Site):
    return cards(s)


@query(
    "object_status",
    "obj inc beps cards1",
    f"""SELECT object_id, CASE WHEN EXISTS (SELECT 1 FROM inc i WHERE i.object_id = o.object_id AND i.type IN ('fire', 'gas') AND i.t0 < {NOW} AND least(i.t1, {NOW}) >= {NOW - 2 * HOUR}) THEN 'ALARM'
 WHEN EXISTS (SELECT 1 FROM beps b WHERE b.object_id = o.object_id AND b.t0 < {NOW} AND coalesce(b.t1, {NOW}) >= {NOW - 2 * HOUR}) THEN 'OFFLINE'
 WHEN EXISTS (SELECT 1 FROM cards1 c WHERE c.object_id = o.object_id AND c.closed IS NULL) THEN 'WATCH' ELSE 'NORMAL' END AS status FROM obj o""",
)
def object_status(s: Site):
    from .q_detect import blind_eps

    facts = s.episodes.where(F.col("t0") < NOW).select("object_id", "type", F.least("t1", F.lit(NOW)).alias("last"))
    blind = blind_eps(s).where(F.col("t0") < NOW).select("object_id", F.coalesce("t1", F.lit(NOW)).alias("last"))
    return T.object_status(s.objects, facts, blind, cards(s).where("open").select("object_id"), ["fire", "gas"], NOW)


@query(
    "evidence_pickets",
    "al j",
    f"""SELECT a.object_id, a.type, a.h, count(DISTINCT j.channel_id) AS sensors FROM (SELECT * FROM al WHERE run = 'busy' AND split = 'test') a JOIN j ON j.object_id = a.object_id AND j.us >= {ORIGIN_US} + (a.h - 23) * {HOUR}
 AND j.us < {ORIGIN_US} + (a.h + 1) * {HOUR} WHERE j.channel_id % 40 BETWEEN 5 AND 12 GROUP BY 1, 2, 3""",
)
def evidence_pickets(s: Site):
    hours = s.journal.select("object_id", hour_of("us").alias("h0"), "channel_id").distinct()
    seen = hours.select("object_id", "channel_id", F.explode(F.sequence(F.col("h0"), F.col("h0") + 23)).alias("h")).distinct()
    alarms = s.alarms.where("run = 'busy' and split = 'test'").select("object_id", "type", "h")
    near = alarms.join(seen, ["object_id", "h"]).groupBy("object_id", "type", "h").agg(F.collect_set("channel_id").alias("evidence"))
    pickets = s.channels.select("channel_id", (F.col("channel_id") % 40).alias("picket")).distinct()
    return T.evidence_pickets(near, pickets, 5, 12)


# ---- settings tables, versions
part("set_old", "", "SELECT 'k' || p_partkey AS key, p_brand, p_size FROM part WHERE p_partkey % 3 <> 0")
part("set_new", "", "SELECT 'k' || p_partkey AS key, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 4 <> 0")


def settings(s: Site):
    p = s.table("part")
    k = F.col("p_partkey")
    key = F.concat(F.lit("k"), k).alias("key")
    old = p.where(k % 3 != 0).select(key, "p_brand", "p_size")
    new = p.where(k % 4 != 0).select(key, "p_brand", F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return old, new


@query(
    "versioned_table",
    "set_old set_new",
    "SELECT key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM set_old a FULL JOIN set_new b USING (key) WHERE a.key IS NULL OR b.key IS NULL OR a.p_brand <> b.p_brand OR a.p_size <> b.p_size".replace("SELECT key", "SELECT coalesce(a.key, b.key) AS key").replace("USING (key)", "ON a.key = b.key"),
)
def versioned_table(s: Site):
    old, new = settings(s)
    current = old.withColumn("version", F.lit(3))
    kept = T.replace_if_newer(current, new.withColumn("version", F.lit(4)))
    return T.versioned_diff(old, kept.drop("version"), "key", ["p_brand", "p_size"])


@query(
    "works_validate",
    "",
    """SELECT row, rule FROM (SELECT event_id AS row, 'w' || (event_id - CASE WHEN event_id % 13 = 0 AND event_id > 0 THEN 1 ELSE 0 END) AS w, event_id, count(*) OVER (PARTITION BY 'w' || (event_id - CASE WHEN event_id % 13 = 0 AND event_id > 0 THEN 1 ELSE 0 END)) AS n FROM events) x,
 LATERAL (SELECT unnest(list_filter([CASE WHEN event_id % 13 = 0 AND event_id > 0 THEN 'work_id blank or repeated' END, CASE WHEN event_id % 11 = 0 THEN 'object_id is not a number' END, CASE WHEN event_id % 7 = 0 THEN 'unknown incident types' END,
 CASE WHEN event_id % 17 = 0 THEN 'bad start or end' END, CASE WHEN event_id % 17 <> 0 AND event_id % 19 = 0 THEN 'start is not before end' END], lambda r: r IS NOT NULL)) AS rule) r""",
)
def works_validate(s: Site):
    i = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd HH:mm")
    rows = s.table("events").select(
        i.alias("row"), F.concat(F.lit("w"), i - F.when((i % 13 == 0) & (i > 0), 1).otherwise(0)).alias("work_id"), F.when(i % 11 == 0, "7a").otherwise(F.col("user_id").cast("string")).alias("object_id"),
        F.when(i % 7 == 0, "fire,rain").otherwise("fire,gas").alias("incident_types"), day.alias("starts_at"),
        F.when(i % 17 == 0, "soon").when(i % 19 == 0, day).otherwise(F.date_format(F.col("ts") + F.expr("interval 1 day"), "yyyy-MM-dd HH:mm")).alias("ends_at"),
    )
    return T.works_validate(rows, ("fire", "gas", "flood", "equipment", "sensor", "intrusion"))


@query(
    "operating_validate",
    "",
    """SELECT type, problem FROM (SELECT coalesce(b.type, s.type) AS type, CASE WHEN b.type IS NULL THEN 'unknown type' WHEN s.type IS NULL THEN 'type is missing' WHEN share < 0.005 OR share > 0.5 THEN 'share out of bounds'
 WHEN k < 0 OR k > 0.5 THEN 'reject_k out of bounds' WHEN coalesce(trim(reason), '') = '' THEN 'no reason' END AS problem FROM (SELECT 't' || p_partkey AS type FROM part WHERE p_partkey % 9 <> 0) b FULL JOIN
 (SELECT 't' || p_partkey AS type, p_size / 60.0 - 0.1 AS share, CASE WHEN p_partkey % 2 = 0 THEN p_size / 70.0 END AS k, CASE WHEN p_partkey % 8 = 0 THEN ' ' ELSE p_name END AS reason FROM part WHERE p_partkey % 10 <> 0) s ON s.type = b.type) WHERE problem IS NOT NULL""",
)
def operating_validate(s: Site):
    p = s.table("part")
    k = F.col("p_partkey")
    t = F.concat(F.lit("t"), k).alias("type")
    bounds = p.where(k % 9 != 0).select(t, F.lit(0.005).alias("share_min"), F.lit(0.5).alias("share_max"), F.lit(0.0).alias("k_min"), F.lit(0.5).alias("k_max"))
    given = p.where(k % 10 != 0).select(
        t, (F.col("p_size") / 60.0 - 0.1).alias("share"), F.when(k % 2 == 0, F.col("p_size") / 70.0).alias("reject_k"), F.when(k % 8 == 0, " ").otherwise(F.col("p_name")).alias("reason")
    )
    return T.operating_validate(given, bounds)
