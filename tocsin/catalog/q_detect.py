"""By-fact detectors and data quality queries."""

from pyspark.sql import functions as F

from ..functions.rules import any_sign
from ..functions.timebase import DAY, HOUR, ORIGIN_US, literal_us
from ..operators.settle import settle
from ..plans import detect as D
from ..plans import quality as Q
from .q_features import hour_sql
from .registry import part, query
from .site import PARAMS, VOC, Site

TP = D.TempParams(base_min=4, base_rows=24, low=0, high=40, deviation=10, gap_hours=6)
# Each channel's hourly medians in one list: the history of place k is a slice of it.
part(
    "ta",
    "j",
    f"""WITH hourly AS (SELECT object_id, channel_id, {hour_sql('us')} AS h, list(num) AS seen FROM j WHERE stype = 'temperature' AND num >= -40 AND num <= 80 GROUP BY ALL),
 line AS (SELECT object_id, channel_id, list(h ORDER BY h) AS hs, list(list_aggregate(seen, 'median') ORDER BY h) AS vs FROM hourly GROUP BY ALL),
 spot AS (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM line),
 past AS (SELECT object_id, channel_id, k, hs[k] AS h, vs[k] AS v, CASE WHEN k > 1 THEN list_aggregate(vs[greatest(1, k - 24):k - 1], 'median') END AS base, least(24, k - 1) AS nb FROM spot)
SELECT *, CASE WHEN nb < 4 THEN NULL WHEN v > 40 AND v >= base + 10 THEN 'hot' WHEN v < 0 AND v <= base - 10 THEN 'cold' END AS direction FROM past""",
)
# A run lasts from a place whose direction differs from the one before to the place before the next such.
part(
    "turns",
    "ta",
    "SELECT a.object_id, a.channel_id, a.direction, a.k, a.h FROM ta a LEFT JOIN ta b ON b.object_id = a.object_id AND b.channel_id = a.channel_id AND b.k = a.k - 1 WHERE a.direction IS DISTINCT FROM b.direction",
)
part(
    "truns",
    "ta turns",
    """WITH held AS (SELECT a.*, (SELECT max(t.k) FROM turns t WHERE t.object_id = a.object_id AND t.channel_id = a.channel_id AND t.k <= a.k) AS k0 FROM ta a WHERE direction IS NOT NULL),
 ends AS (SELECT object_id, channel_id, k0, min(h) AS r0, max(h) AS r1 FROM held GROUP BY ALL)
SELECT object_id, channel_id, direction, h, v, base, k - k0 + 1 AS kth, r0, r1 FROM held JOIN ends USING (object_id, channel_id, k0)""",
)
# Runs of an object whose spans, six hours longer, meet are one episode: it begins where no earlier run reaches.
part(
    "tfirst",
    "truns",
    """SELECT DISTINCT object_id, direction, r0 AS e0 FROM truns a WHERE NOT EXISTS (
 SELECT 1 FROM truns b WHERE b.object_id = a.object_id AND b.direction = a.direction AND b.r0 < a.r0 AND b.r1 + 6 >= a.r0)""",
)
part(
    "teps",
    "truns tfirst",
    """WITH own AS (SELECT r.*, (SELECT max(e0) FROM tfirst f WHERE f.object_id = r.object_id AND f.direction = r.direction AND f.e0 <= r.r0) AS e0 FROM truns r),
 starts AS (SELECT object_id, direction, e0, list_sort(list(f)) AS fs FROM (SELECT object_id, direction, e0, channel_id, min(h) AS f FROM own GROUP BY ALL) GROUP BY ALL),
 spans AS (SELECT object_id, direction, e0, min(h) AS t0, max(h) AS t1, min(h) FILTER (kth = 2) AS again FROM own GROUP BY ALL)
SELECT object_id, direction, t0, t1, least(again, fs[2]) AS confirm_h, len(fs) AS channels FROM spans JOIN starts USING (object_id, direction, e0)""",
)


def reading():
    return VOC.temperature.column()


@query("temp_anomaly", "ta", "SELECT object_id, channel_id, h, round(v, 6) AS v, round(base, 6) AS base, nb, direction FROM ta")
def temp_anomaly(s: Site):
    a = D.temp_anomaly(s.journal, reading(), TP)
    return a.withColumns({c: F.round(c, 6) for c in ("v", "base")})


@query("temp_runs", "truns", "SELECT object_id, channel_id, direction, h, round(v, 6) AS v, CAST(kth AS INTEGER) AS kth, r0, r1 FROM truns")
def temp_runs(s: Site):
    r = D.temp_runs(D.temp_anomaly(s.journal, reading(), TP))
    return r.select("object_id", "channel_id", "direction", "h", F.round("v", 6).alias("v"), "kth", "r0", "r1")


def temp_eps(s: Site):
    if not hasattr(s, "_temp"):
        s._temp = settle(D.temp_episodes(settle(D.temp_runs(D.temp_anomaly(s.journal, reading(), TP))), TP))
    return s._temp


@query("temp_episodes", "teps", "SELECT object_id, direction, t0, t1, confirm_h, CAST(channels AS INTEGER) AS channels FROM teps")
def temp_episodes(s: Site):
    e = D.temp_episodes(D.temp_runs(D.temp_anomaly(s.journal, reading(), TP)), TP)
    return e.withColumn("channels", F.size("channels"))


# The hits of an incident in one list; a hit at the channel of the one before is dropped, the last eight stay.
part(
    "routes",
    "inc guard j",
    """WITH fires AS (SELECT DISTINCT object_id, collector_id, t0, t1 FROM inc WHERE type = 'fire'),
 ended AS (SELECT f.object_id, f.t0, least(f.t1 + 36000000000, d.us) AS te FROM fires f ASOF LEFT JOIN (SELECT DISTINCT collector_id, us FROM guard WHERE NOT armed) d ON d.collector_id = f.collector_id AND f.t0 < d.us),
 seen AS (SELECT e.object_id, e.t0, list({'c': channel_id, 'u': us} ORDER BY us, channel_id) AS hits FROM ended e JOIN j ON j.object_id = e.object_id AND j.us >= e.t0 AND j.us <= e.te WHERE stype IN ('door', 'motion') GROUP BY ALL),
 moves AS (SELECT object_id, t0, list_filter(hits, lambda x, i: i = 1 OR x.c <> hits[i - 1].c) AS hits FROM seen)
SELECT object_id, t0, array_to_string(list_transform(hits[-8:], lambda x: x.c || '@' || x.u), ',') AS route, len(list_distinct(list_transform(hits[-8:], lambda x: x.c))) AS sensors FROM moves""",
)


def routes(s: Site):
    points = F.col("stype").isin("door", "motion")
    # few intrusions in the given journal: routes are followed for fires
    eps = s.episodes.where("type = 'fire'")
    return D.intruder_route(eps, s.guard, s.journal, points, tail=10 * HOUR, most=8)


@query("intruder_route", "routes", "SELECT object_id, t0, route FROM routes")
def intruder_route(s: Site):
    text = F.concat_ws(",", F.transform("route", lambda x: F.concat(x["sensor_id"], F.lit("@"), x["at"])))
    return routes(s).select("object_id", "t0", text.alias("route"))


BP = D.BlindParams(link_share=0.05, link_window=12 * HOUR, power_share=0.6, power_before=6 * HOUR, recover_share=0.3, confirm=HOUR)
W = BP.link_window
part("nch", "ch", "SELECT object_id, count(*) AS n FROM ch WHERE stype <> 'guard' GROUP BY 1")
# Link: faulted channels beside each fault within the window; channels heard in any two neighbouring half windows.
part(
    "link",
    "j nch",
    f"""WITH bad AS (SELECT DISTINCT object_id, channel_id, us FROM j WHERE stype <> 'guard' AND state = 'faulted'),
 lost AS (SELECT a.object_id, a.us, count(DISTINCT b.channel_id) AS k FROM (SELECT DISTINCT object_id, us FROM bad) a JOIN bad b ON b.object_id = a.object_id AND b.us <= a.us AND b.us >= a.us - {W} GROUP BY ALL),
 good AS (SELECT object_id, channel_id, us, us // {W // 2} AS half FROM j WHERE stype <> 'guard' AND coalesce(state <> 'faulted', num IS NOT NULL)),
 heard AS (SELECT object_id, max(us) AS us, count(DISTINCT channel_id) AS k FROM (SELECT *, unnest([half - 1, half]) AS pair FROM good) GROUP BY object_id, pair)
SELECT object_id, us, back, k / n AS share, 'link' AS cause FROM (SELECT *, false AS back FROM lost UNION ALL SELECT *, true FROM heard) JOIN nch USING (object_id)
WHERE k >= CASE WHEN back THEN 0.3 ELSE 0.05 END * n""",
)
# Power: after each guard event the channels whose latest one is off.
part(
    "pwr",
    "j",
    """WITH ph AS (SELECT object_id, channel_id, us, event_id, state = 'disarmed' AS off FROM j WHERE stype = 'guard'),
 latest AS (SELECT a.object_id, a.us, a.event_id, b.channel_id, arg_max(b.off, {'u': b.us, 'e': b.event_id}) AS off
  FROM ph a JOIN ph b ON b.object_id = a.object_id AND (b.us, b.channel_id, b.event_id) <= (a.us, a.channel_id, a.event_id) GROUP BY ALL),
 shares AS (SELECT object_id, us, event_id, count(*) FILTER (off) / any_value(n) AS share FROM latest JOIN (SELECT object_id, count(DISTINCT channel_id) AS n FROM ph GROUP BY 1) USING (object_id) GROUP BY 1, 2, 3)
SELECT object_id, us, share <= 0.3 AS back, share, 'power' AS cause FROM shares WHERE share >= 0.6 OR share <= 0.3""",
)
part("bpts", "link pwr", "SELECT * FROM link UNION ALL SELECT * FROM pwr")
# Points of loss with equally many points of return before them belong to one episode.
part(
    "beps",
    "bpts obj j",
    """WITH told AS (SELECT s.*, (SELECT count(*) FROM bpts b WHERE b.back AND b.object_id = s.object_id AND b.cause = s.cause AND (b.us, b.back, b.share) < (s.us, s.back, s.share)) AS returns FROM bpts s WHERE NOT back),
 begun AS (SELECT object_id, cause, min(us) AS t0, arg_min(share, {'u': us, 's': share}) AS share FROM told GROUP BY object_id, cause, returns)
SELECT e.object_id, o.collector_id, CASE WHEN e.cause = 'link' AND EXISTS (SELECT 1 FROM j p WHERE p.stype = 'pump' AND p.collector_id = o.collector_id AND p.us BETWEEN e.t0 - 21600000000 AND e.t0) THEN 'power' ELSE e.cause END AS cause,
 round(e.share, 2) AS share, e.t0, (SELECT min(b.us) FROM bpts b WHERE b.back AND b.object_id = e.object_id AND b.cause = e.cause AND b.us > e.t0) AS t1 FROM begun e JOIN obj o USING (object_id)""",
)


def link_points(s: Site):
    return D.blind_link(s.journal, s.channels, list(VOC.undefined), list(VOC.link_skip), BP)


def power_points(s: Site):
    return D.blind_power(s.journal, F.col("stype") == "guard", F.col("state") == "disarmed", BP)


@query("blind_link", "link", "SELECT object_id, us, back, round(share, 6) AS share FROM link")
def blind_link(s: Site):
    return link_points(s).select("object_id", "us", "back", F.round("share", 6).alias("share"))


@query("blind_power", "pwr", "SELECT object_id, us, back, round(share, 6) AS share FROM pwr")
def blind_power(s: Site):
    return power_points(s).select("object_id", "us", "back", F.round("share", 6).alias("share"))


def blind_eps(s: Site):
    if not hasattr(s, "_blind"):
        points = settle(link_points(s).unionByName(power_points(s)))
        s._blind = settle(D.blind_episodes(points, s.objects, s.journal, any_sign(VOC.power_lost), BP))
    return s._blind


@query("blind_episodes", "beps", "SELECT * FROM beps")
def blind_episodes(s: Site):
    points = settle(link_points(s).unionByName(power_points(s)))
    return D.blind_episodes(points, s.objects, s.journal, any_sign(VOC.power_lost), BP)


@query(
    "accident_year_tables",
    "teps beps routes",
    f"""SELECT 'temperature ' || direction AS kind, CAST(year(TIMESTAMP '2019-01-01' + to_hours(t0)) AS INTEGER) AS year, count(*) AS episodes, count(confirm_h) AS announced, count(DISTINCT object_id) AS objects, NULL::DOUBLE AS middle FROM teps GROUP BY 1, 2
UNION ALL SELECT 'blind ' || cause, CAST(year(make_timestamp(t0)) AS INTEGER), count(*), count(*) FILTER (t1 IS NULL OR t1 - t0 >= {HOUR}), count(DISTINCT object_id), round(median((t1 - t0) / 60000000)) FROM beps GROUP BY 1, 2
UNION ALL SELECT 'route', NULL, count(*), NULL, max(sensors), median(sensors) FROM routes""",
)
def accident_year_tables(s: Site):
    t = D.temp_year_table(temp_eps(s)).select(
        F.concat(F.lit("temperature "), "direction").alias("kind"), "year", "episodes", "announced", "objects", F.lit(None).cast("double").alias("middle")
    )
    b = D.blind_year_table(blind_eps(s), BP).select(F.concat(F.lit("blind "), "cause").alias("kind"), "year", "episodes", "announced", "objects", F.col("median_min").alias("middle"))
    r = D.route_sizes(routes(s)).select(
        F.lit("route").alias("kind"), F.lit(None).cast("int").alias("year"), F.col("routes").alias("episodes"), F.lit(None).cast("bigint").alias("announced"),
        F.col("most").cast("bigint").alias("objects"), F.col("p50").alias("middle"),
    )
    return t.unionByName(b).unionByName(r)


NOW = literal_us("2024-01-21")
NOW_H = (NOW - ORIGIN_US) // HOUR


@query(
    "live_facts",
    "inc trig",
    f"""SELECT i.object_id, i.collector_id, i.type, i.t0, i.t1, i.noise, t0 >= {NOW - HOUR} AS new, (SELECT min(t.stype) FROM trig t WHERE t.object_id = i.object_id AND t.type = i.type AND t.us = i.t0) AS stype
FROM inc i WHERE noise IS NULL AND t1 >= {NOW - HOUR} AND t0 < {NOW} AND (type <> 'fire' OR EXISTS (SELECT 1 FROM trig t WHERE t.object_id = i.object_id AND t.type = 'fire' AND t.us BETWEEN i.t0 AND i.t1 AND t.stype <> 'temperature'))""",
)
def live_facts(s: Site):
    return D.live_facts(s.episodes, s.triggers, NOW, "temperature", PARAMS.works_code)


part(
    "sil",
    "ch j",
    "SELECT object_id, channel_id, stype, max(us) AS since FROM j WHERE stype <> 'guard' GROUP BY ALL HAVING max(us) < " + str(NOW - 3 * DAY),
)


def silent_now(s: Site):
    last = s.journal.where("stype <> 'guard'").groupBy("object_id", "channel_id", "stype").agg(F.max("us").alias("since"))
    return last.where(F.col("since") < NOW - 3 * DAY)


@query(
    "live_accidents",
    "beps sil nch teps",
    f"""SELECT object_id, 'blind' AS type, CASE max(CAST(cause = 'power' AS INT)) WHEN 1 THEN 'power' ELSE 'link' END AS detail, max(share) AS share, min(t0) AS t0, coalesce(CASE WHEN count(t1) = count(*) THEN max(t1) END, {NOW}) AS t1, min(t0) + {HOUR} >= {NOW - HOUR} AS new FROM (
 SELECT object_id, cause, share, t0, t1 FROM (SELECT object_id, cause, share, t0, CASE WHEN t1 < {NOW} THEN t1 END AS t1 FROM beps WHERE t0 < {NOW}) WHERE (t1 IS NULL OR t1 >= {NOW - HOUR}) AND coalesce(t1, {NOW}) - t0 >= {HOUR}
 UNION ALL SELECT object_id, 'link', round(silent / n, 2), t0, NULL FROM (SELECT object_id, n, count(*) AS silent, max(since) FILTER (i = k) AS t0, max(k) AS k FROM (
   SELECT *, greatest(1, ceil(0.05 * n - 1e-9)) AS k, row_number() OVER (PARTITION BY object_id ORDER BY since, channel_id) AS i FROM sil JOIN nch USING (object_id)) GROUP BY object_id, n) WHERE silent >= k AND {NOW} - t0 >= {HOUR}) GROUP BY object_id
UNION ALL SELECT object_id, 'temperature', direction, NULL, t0 * {HOUR} + {ORIGIN_US}, t1 * {HOUR} + {ORIGIN_US}, confirm_h >= {NOW_H - 1} FROM teps WHERE confirm_h IS NOT NULL AND t1 >= {NOW_H - 1} AND confirm_h < {NOW_H}""",
)
def live_accidents(s: Site):
    from ..functions.timebase import hour_start

    silent = D.silent_blindness(silent_now(s), s.channels, list(VOC.link_skip), NOW, BP)
    b = D.live_blind(blind_eps(s), silent, NOW, BP)
    t = D.live_temperature(temp_eps(s), NOW_H)
    return b.select("object_id", F.lit("blind").alias("type"), F.col("cause").alias("detail"), "share", "t0", "t1", "new").unionByName(
        t.select("object_id", F.lit("temperature").alias("type"), F.col("direction").alias("detail"), F.lit(None).cast("double").alias("share"), hour_start("t0").alias("t0"), hour_start("t1").alias("t1"), "new")
    )


@query("hours_since_end", "inc", f"SELECT object_id, type, round(greatest(0, ({NOW} - max(t1)) / {HOUR}), 6) AS hours FROM inc WHERE t0 < {NOW} GROUP BY 1, 2")
def hours_since_end(s: Site):
    return D.hours_since_end(s.episodes, NOW).withColumn("hours", F.round("hours", 6))


FAMS = {"smoke": "smo", "temp": "temper", "gas": "gas", "pump": "pump", "door": "door", "motion": "motion", "phase": "phase"}
TYPE_FAMS = {"fire": ("smoke", "temp"), "gas": ("gas",), "flood": ("phase",), "equipment": ("pump",), "sensor": ("smoke", "temp"), "intrusion": ("door", "motion")}
part(
    "fresh",
    "j",
    f"""SELECT type, coalesce(({NOW} - max(us)) / {HOUR}, 720.0) AS hours FROM (SELECT * FROM (VALUES ('fire', 'smo'), ('fire', 'temper'), ('gas', 'gas'), ('flood', 'phase'), ('equipment', 'pump'), ('sensor', 'smo'), ('sensor', 'temper'),
 ('intrusion', 'door'), ('intrusion', 'motion')) v(type, word)) f LEFT JOIN (SELECT * FROM j WHERE us < {NOW} AND us >= {NOW - 30 * DAY}) j ON contains(j.stype, f.word) GROUP BY type""",
)


@query("freshness", "fresh", "SELECT type, round(hours, 6) AS hours FROM fresh")
def freshness(s: Site):
    return D.freshness(s.journal, NOW, 30, FAMS, TYPE_FAMS).withColumn("hours", F.round("hours", 6))


@query(
    "silence_penalty",
    "scores sil",
    """SELECT object_id, type, h, round(p * coalesce((SELECT product(1 - c.cost) FROM (VALUES ('fire', 'smoke', 0.3), ('fire', 'temperature', 0.2), ('gas', 'gas', 0.5)) c(type, family, cost)
 WHERE c.type = s.type AND c.family IN (SELECT stype FROM sil WHERE sil.object_id = s.object_id)), 1), 6) AS c FROM scores s WHERE run = 'busy' AND split = 'test'""",
)
def silence_penalty(s: Site):
    c = s.scores.where("run = 'busy' and split = 'test'").select("object_id", "type", "h", F.col("p").alias("c"))
    cost = s.spark.createDataFrame([("fire", "smoke", 0.3), ("fire", "temperature", 0.2), ("gas", "gas", 0.5)], "type string, family string, cost double")
    silent = silent_now(s).select("object_id", F.col("stype").alias("family"))
    return D.silence_penalty(c, silent, cost).withColumn("c", F.round("c", 6))


# Stability: the last day of the history against what is older than a week, in the bins of the older part.
part("obs", "scores", "SELECT type, p, h - max(h) OVER (PARTITION BY type) AS back FROM scores WHERE run = 'busy'")
part(
    "obs_edges",
    "obs",
    """SELECT type, CASE WHEN len(q) >= 3 THEN q[2:len(q) - 1] ELSE u[2:] END AS e FROM (
 SELECT type, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q, list_sort(list(DISTINCT p)) AS u FROM obs WHERE back <= -168 GROUP BY type) WHERE len(u) > 1""",
)
part(
    "obs_psi",
    "obs obs_edges",
    """SELECT type, sum((b - a) * ln(b / a)) AS psi FROM (
 SELECT type, greatest(1e-6, a / sum(a) OVER (PARTITION BY type)) AS a, greatest(1e-6, b / sum(b) OVER (PARTITION BY type)) AS b FROM (
  SELECT type, len(list_filter(e, lambda v: v <= p)) AS bin, count(*) FILTER (back <= -168) AS a, count(*) FILTER (back > -24) AS b FROM obs JOIN obs_edges USING (type) GROUP BY 1, 2)) GROUP BY type""",
)


@query(
    "observe_summary",
    "scores thr fresh obs_psi",
    f"""SELECT type, window_size, alarm_share, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 0 WHEN psi < 0.25 THEN 1 WHEN psi IS NOT NULL THEN 2 END AS grade, hours, stale FROM (
 SELECT type, count(*) AS window_size, round(avg(CAST(p >= thr AS DOUBLE)) FILTER (h = last), 6) AS alarm_share, round(any_value(f.hours), 6) AS hours, any_value(f.hours) >= 2 AS stale
 FROM (SELECT *, max(h) OVER (PARTITION BY type) AS last FROM scores JOIN thr USING (run, type, split) WHERE run = 'busy') JOIN fresh f USING (type) GROUP BY type) LEFT JOIN obs_psi USING (type)""",
)
def observe_summary(s: Site):
    hist = s.scores.where("run = 'busy'").select("type", "object_id", "h", "p")
    o = D.observe_summary(hist, s.alarms.where("run = 'busy'"), D.freshness(s.journal, NOW, 30, FAMS, TYPE_FAMS), 2.0)
    return o.select("type", "window_size", *[F.round(c, 6).alias(c) for c in ("alarm_share", "psi")], "grade", F.round("hours", 6).alias("hours"), "stale")


# ---- quality
part("rd", "j", "SELECT channel_id, us, event_id, num FROM j WHERE num IS NOT NULL")
part(
    "rdk",
    "rd",
    f"""SELECT r.*, (SELECT count(*) FROM rd b WHERE b.channel_id = r.channel_id AND b.us < r.us) AS nb,
 (SELECT b.us FROM rd b WHERE b.channel_id = r.channel_id AND b.us < r.us ORDER BY b.us DESC LIMIT 1 OFFSET 30) AS back31 FROM rd r""",
)
part(
    "spk",
    "rdk rd",
    f"""SELECT k.channel_id, k.us, k.event_id, k.num, median(b.num) AS median, stddev_samp(b.num) AS std, count(b.us) AS history FROM
 (SELECT *, CASE WHEN nb <= 30 THEN 0 ELSE us - greatest(1, ceil((us - back31) / {30 * DAY})) * {30 * DAY} END AS a FROM rdk) k LEFT JOIN rd b ON b.channel_id = k.channel_id AND b.us < k.us AND b.us >= k.a GROUP BY ALL""",
)


def readings(s: Site):
    return s.journal.where("num is not null").select("channel_id", "us", "event_id", "num")


@query("spike_flag", "spk", "SELECT event_id, round(median, 6) AS median, round(std, 6) AS std, CAST(history AS BIGINT) AS history, coalesce(history >= 2 AND std > 0 AND abs(num - median) / std > 3, false) AS spike FROM spk")
def spike_flag(s: Site):
    f = Q.spike_flag(readings(s))
    std = F.when(~F.isnan("std"), F.col("std"))
    return f.select("event_id", F.round("median", 6).alias("median"), F.round(std, 6).alias("std"), F.col("history").cast("bigint").alias("history"), "spike")


VALUE = "coalesce(state, CAST(CAST(floor(num) AS BIGINT) AS VARCHAR))"


@query(
    "flapping_flag",
    "j",
    f"""SELECT event_id, len(v) >= 12 AND len(list_filter(range(2, 13), lambda i: v[i] <> v[i - 1])) >= 6 AS flapping FROM (
 SELECT a.event_id, coalesce(list(b.v ORDER BY b.us, b.event_id) FILTER (b.r <= 12), []) AS v FROM j a LEFT JOIN (
  SELECT x.event_id AS id, y.us, y.event_id, {VALUE.replace('state', 'y.state').replace('num', 'y.num')} AS v, row_number() OVER (PARTITION BY x.event_id ORDER BY y.us DESC, y.event_id DESC) AS r
  FROM j x JOIN j y ON y.channel_id = x.channel_id AND y.us < x.us AND y.us >= x.us - {30 * DAY}) b ON b.id = a.event_id GROUP BY a.event_id)""",
)
def flapping_flag(s: Site):
    v = F.coalesce("state", F.floor("num").cast("bigint").cast("string"))
    return Q.flapping_flag(s.journal.select("channel_id", "us", "event_id", v.alias("value"))).select("event_id", "flapping")


FLAGS = {"smoke_detected": "smoke", "faulted": "fault", "open": "contact_open"}


@query("key_state_flag", "j", "SELECT event_id, CASE state WHEN 'smoke_detected' THEN 'smoke' WHEN 'faulted' THEN 'fault' WHEN 'open' THEN 'contact_open' END AS flag FROM j")
def key_state_flag(s: Site):
    return Q.key_state_flag(s.journal, FLAGS).select("event_id", "flag")


LIMIT = 6 * HOUR
part(
    "seq",
    "j",
    "SELECT channel_id, us, n, row_number() OVER (PARTITION BY channel_id ORDER BY us) AS i FROM (SELECT channel_id, us, count(*) AS n FROM j GROUP BY ALL)",
)
part(
    "walk",
    "seq",
    f"""SELECT channel_id, i, us, CAST(NULL AS DOUBLE) AS gap, CAST(n AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS silent_at FROM seq WHERE i = 1
UNION ALL SELECT w.channel_id, s.i, s.us, CASE WHEN w.seen >= 3 AND s.us - w.us > greatest({LIMIT}, 4 * coalesce(w.gap, 0)) THEN w.gap WHEN w.gap IS NULL THEN s.us - w.us ELSE 0.8 * w.gap + 0.2 * (s.us - w.us) END,
 w.seen + s.n, CASE WHEN w.seen >= 3 AND s.us - w.us > greatest({LIMIT}, 4 * coalesce(w.gap, 0)) THEN w.us END,
 CASE WHEN w.seen >= 3 AND s.us - w.us > greatest({LIMIT}, 4 * coalesce(w.gap, 0)) THEN w.us + CAST(floor(greatest({LIMIT}, 4 * coalesce(w.gap, 0))) AS BIGINT) END FROM walk w JOIN seq s ON s.channel_id = w.channel_id AND s.i = w.i + 1""",
)
NOW_ALL = literal_us("2024-01-31")
part(
    "spells",
    "walk",
    f"""SELECT channel_id, since, silent_at, us AS back_at FROM walk WHERE since IS NOT NULL UNION ALL
 SELECT channel_id, us, us + CAST(floor(greatest({LIMIT}, 4 * coalesce(gap, 0))) AS BIGINT), NULL FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY i DESC) = 1)
 WHERE seen >= 3 AND us + CAST(floor(greatest({LIMIT}, 4 * coalesce(gap, 0))) AS BIGINT) < {NOW_ALL}""",
)


@query("channel_silence", "spells", "SELECT channel_id, since, silent_at // 1000000 AS silent_s, back_at FROM spells")
def channel_silence(s: Site):
    return Q.channel_silence(s.journal, LIMIT, NOW_ALL).select("channel_id", "since", F.floor(F.col("silent_at") / 1000000).alias("silent_s"), "back_at")


@query(
    "source_silence",
    "j",
    f"SELECT us AS since, nxt AS back_at FROM (SELECT us, lead(us) OVER (ORDER BY us) AS nxt FROM j) WHERE coalesce(nxt, {NOW_ALL}) - us > {15 * 60 * 1000000}",
)
def source_silence(s: Site):
    return Q.source_silence(s.journal, 15 * 60 * 1000000, NOW_ALL)


@query("silence_snapshot", "spells", "SELECT channel_id, since, (SELECT count(*) FROM spells WHERE back_at IS NULL) AS silent FROM spells WHERE back_at IS NULL ORDER BY since, channel_id LIMIT 10")
def silence_snapshot(s: Site):
    return Q.silence_snapshot(Q.channel_silence(s.journal, LIMIT, NOW_ALL), 10)
