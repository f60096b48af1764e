"""Study queries: profiles of catches and misses, drift, confidence, notices."""

from pyspark.sql import functions as F

from ..functions.timebase import HOUR, ORIGIN_US
from ..operators.settle import settle
from ..plans import metrics as M
from ..plans import study as S
from ..plans.features import feature_groups
from .q_alarms import curve
from .q_features import KEYS as COUNTERS
from .q_features import TYPES, nudged, past, since_sql
from .q_metrics import K
from .registry import part, query
from .site import BY, SCORED, SHARE, Site

KINDS = {"all": "", "primary": "_prim", "confirmed": "_conf"}
RT = "run, type"


def r6(*cols):
    return {c: F.round(F.col(c).cast("double"), 6) for c in cols}


part(
    "lrows",
    "smart scores",
    " UNION ALL ".join(
        f"SELECT s.{', s.'.join(BY)}, s.object_id, s.h, s.p, '{k}' AS target, CAST(m.next_{t}{x} <= 24 AS INT) AS y FROM scores s JOIN smart m ON m.object_id = s.object_id AND m.h = s.h WHERE s.type = '{t}'"
        for t in SCORED
        for k, x in KINDS.items()
    ),
)
part("lthr2", "lrows", f"SELECT {K}, target, quantile_cont(p, 0.8) AS thr FROM lrows GROUP BY {K}, target")


@query(
    "eval_matrix",
    "lrows lthr2",
    f"SELECT {K}, target, count(*) AS rows, round(avg(y), 6) AS base_rate, round(avg(y) FILTER (p >= thr), 6) AS precision, round(avg(CAST(p >= thr AS INT)) FILTER (y = 1), 6) AS recall_rows FROM lrows JOIN lthr2 USING ({K}, target) GROUP BY {K}, target",
)
def eval_matrix(s: Site):
    by = [*BY, "target"]
    rows = settle(S.long_targets(s.mart, s.scores, KINDS, SCORED))
    thr = M.threshold_for_share(rows, by, [SHARE])
    e = S.eval_matrix(rows, thr, None, by)
    return e.select(*by, "rows", "base_rate", "precision", "recall_rows").withColumns(r6("base_rate", "precision", "recall_rows"))


part("f1t", "curve", f"SELECT run, type, min(p) FILTER (f >= m - 1e-15) AS thr FROM (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f, max(2 * precision * recall / greatest(precision + recall, 1e-12)) OVER (PARTITION BY run, type) AS m FROM curve WHERE split = 'val') GROUP BY 1, 2")


@query(
    "operating_points",
    "scores f1t curve",
    f"""SELECT {RT}, rule, count(*) AS alarm_hours, count(*) FILTER (y = 0) AS false_hours FROM (
 SELECT s.*, 'f1' AS rule FROM scores s JOIN f1t USING ({RT}) WHERE split = 'test' AND p >= thr
 UNION ALL SELECT s.*, 'precision' FROM scores s JOIN (SELECT {RT}, min(p) FILTER (precision >= 0.5 AND alarms >= 20) AS thr FROM curve WHERE split = 'val' GROUP BY {RT}) USING ({RT}) WHERE split = 'test' AND p >= thr
 UNION ALL SELECT s.*, 'budget' FROM scores s JOIN (SELECT {RT}, v[1 + CAST(floor(pos) AS INT)] + (v[1 + CAST(ceil(pos) AS INT)] - v[1 + CAST(floor(pos) AS INT)]) * (pos - floor(pos)) AS thr FROM (
  SELECT {RT}, list(p ORDER BY p) AS v, (1 - least(1, 60.0 / count(*))) * (count(*) - 1) AS pos FROM scores WHERE split = 'val' GROUP BY {RT})) USING ({RT}) WHERE split = 'test' AND p >= thr
 UNION ALL SELECT s.*, 'topk' FROM scores s JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {RT}, d ORDER BY m DESC, object_id) AS r FROM (SELECT {RT}, h // 24 AS d, object_id, max(p) AS m FROM scores WHERE split = 'test' GROUP BY ALL)) WHERE r <= 3) t USING ({RT}, object_id)
  WHERE split = 'test' AND h // 24 = t.d) GROUP BY ALL""",
)
def operating_points(s: Site):
    o = S.operating_points(s.scores, ["run", "type"], 0.5, 6.0, 10.0, 3)
    return o.select("run", "type", "rule", "alarm_hours", "false_hours")


@query(
    "dispatcher_summary",
    "meas seen spans6 al",
    f"""SELECT {K}, caught, episodes, episodes - caught AS left_to_fact, caught - fresh AS standing, false_signals, round(false_signals / 10, 6) AS false_per_day, round(quantile_cont(b - a + 1, 0.5), 6) AS duration_p50, round(quantile_cont(b - a + 1, 0.9), 6) AS duration_p90
FROM meas JOIN (SELECT {K}, count(*) AS episodes FROM seen GROUP BY {K}) USING ({K}) JOIN spans6 USING ({K}) GROUP BY {K}, caught, episodes, fresh, false_signals""",
)
def dispatcher_summary(s: Site):
    d = S.dispatcher_summary(s.alarms, s.seen, BY, 10.0)
    return d.select(*BY, "caught", "episodes", "left_to_fact", "standing", "false_signals", "false_per_day", "duration_p50", "duration_p90").withColumns(r6("false_per_day", "duration_p50", "duration_p90"))


def hour_context(s: Site):
    """Per (type, object, hour): what the hour before an episode looked like."""
    if hasattr(s, "_hctx"):
        return s._hctx
    cells = []
    for t in SCORED:
        coll = F.col(f"coll_onset_{t}_24h") - F.col(f"onset_{t}_24h") > 0.5
        other = sum((F.col(f"onset_{x}_24h") for x in SCORED if x != t), F.lit(0.0)) > 0.5
        nxt = F.least(*[F.col(f"next_{x}") for x in SCORED if x != t])
        clock = (F.col("hour") + 1) % 24
        cells.append(
            F.struct(
                F.lit(t).alias("type"), (F.col(f"next_{t}_prim") == F.col(f"next_{t}")).alias("primary"), (F.col(f"next_{t}_conf") == F.col(f"next_{t}")).alias("confirmed"),
                (F.col("events_24h") < 0.5).alias("quiet"), F.col(f"since_{t}").alias("since"), (F.col(f"trig_{t}_24h") > 0.5).alias("trigger"), coll.alias("collector"), other.alias("other"),
                ((clock < 7) | (clock >= 22)).alias("night"), F.col(f"next_{t}").alias("next"), nxt.alias("other_next"), (F.col(f"trig_{t}_24h") > 0.5).alias("noise"), (F.col("visit_24h") > 0.5).alias("visit"),
            )
        )
    s._hctx = settle(s.mart.select("object_id", "h", F.explode(F.array(*cells)).alias("c")).select("object_id", "h", "c.*"))
    return s._hctx


part(
    "hctx",
    "g valid tg cal",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS type, object_id, h, next_{t}_prim = next_{t} AS prim, next_{t}_conf = next_{t} AS conf, since_{t} AS since, trig_{t} > 0 AS trigger, coll - own > 0 AS collector, oth > 0 AS other, (hour + 1) % 24 < 7 OR (hour + 1) % 24 >= 22 AS night, next_{t} AS next,
 least({', '.join(f'next_{x}' for x in SCORED if x != t)}) AS other_next, visit > 0 AS visit, quiet FROM (SELECT g.object_id, g.h, {since_sql(f'onset_{t} > 0')} AS since_{t}, {past(f'sum(trig_{t})', 24)} AS trig_{t}, {past(f'sum(onset_{t})', 24)} AS own,
  {past(f'sum(c_{t})', 24)} AS coll, {past('sum(' + ' + '.join(f'onset_{x}' for x in SCORED if x != t) + ')', 24)} AS oth, {past('sum(visit)', 24)} AS visit, {past('sum(n_events)', 24)} = 0 AS quiet, {past('sum(n_events)', 168)} AS e168
  FROM (SELECT *, sum(onset_{t}) OVER (PARTITION BY collector_id, h) AS c_{t} FROM g) g) JOIN valid USING (object_id, h) JOIN tg USING (object_id, h) JOIN cal USING (h) WHERE e168 > 0"""
        for t in SCORED
    ),
)


@query(
    "miss_profile",
    "epflag hctx",
    f"""SELECT e.run, e.type, e.split, NOT got AS missed, count(*) AS episodes, round(avg(CAST(prim AS INT)), 6) AS primary_share, round(avg(CAST(trigger AS INT)), 6) AS trigger_share, round(avg(CAST(collector AS INT)), 6) AS collector, round(avg(CAST(other AS INT)), 6) AS other, round(avg(CAST(night AS INT)), 6) AS night,
 round(quantile_cont(since, 0.5), 6) AS since_median, count(*) FILTER (NOT prim) AS repeats, count(*) FILTER (prim AND quiet) AS silent FROM epflag e LEFT JOIN hctx x ON x.type = e.type AND x.object_id = e.object_id AND x.h = e.e - 1 GROUP BY e.run, e.type, e.split, NOT got""",
)
def miss_profile(s: Site):
    got = M.catches(s.alarms, s.seen, BY)
    m = S.miss_profile(s.seen, got, hour_context(s), BY)
    m = m.select(*BY, "missed", "episodes", F.col("primary").alias("primary_share"), F.col("trigger").alias("trigger_share"), "collector", "other", "night", "since_median", "repeats", "silent")
    return m.withColumns(r6("primary_share", "trigger_share", "collector", "other", "night", "since_median"))


@query(
    "false_causes",
    "spans6 hctx",
    f"""SELECT {K}, hit, CASE WHEN xa.since < 168 THEN 'own tail' WHEN xb.trigger THEN 'noise or trigger without an episode' WHEN xa.other_next <= b - a + 1 + 24 THEN 'another type on the object' WHEN xb.next > 24 AND xb.next <= 72 THEN 'own episode in 24-72 h'
 WHEN xz.collector THEN 'own type in the collector' WHEN xb.visit THEN 'visit to the collector' ELSE 'none' END AS cause, count(*) AS signals FROM (SELECT * FROM spans6) s LEFT JOIN hctx xa ON xa.type = s.type AND xa.object_id = s.object_id AND xa.h = s.a
 LEFT JOIN hctx xb ON xb.type = s.type AND xb.object_id = s.object_id AND xb.h = s.b LEFT JOIN hctx xz ON xz.type = s.type AND xz.object_id = s.object_id AND xz.h = s.b + 24 GROUP BY s.run, s.type, s.split, hit, cause""".replace("SELECT run, type, split, hit", "SELECT s.run, s.type, s.split, hit"),
)
def false_causes(s: Site):
    return S.false_causes(s.alarms, hour_context(s), BY).drop("length_p50")


PRE = ["smoke_24h", "pump_fault_24h", "temp_fault_24h", "door_24h", "motion_24h"]


part("pfeat", "g", "SELECT object_id, h, " + ", ".join(f"{past(f'sum({c[:-4]})', 24)} AS {c}" for c in PRE) + " FROM g")
part("pmark", "epflag hctx pfeat", "SELECT e.type, CASE WHEN got THEN 'caught' ELSE 'missed' END AS grp, f.* EXCLUDE (object_id, h) FROM epflag e JOIN hctx x ON x.type = e.type AND x.object_id = e.object_id AND x.h = e.e - 1 JOIN pfeat f ON f.object_id = x.object_id AND f.h = x.h WHERE run = 'busy' AND prim"
 " UNION ALL SELECT x.type, 'control', f.* EXCLUDE (object_id, h) FROM hctx x JOIN pfeat f USING (object_id, h) WHERE next > 48 AND since >= 24")
part("plong", "pmark", " UNION ALL ".join(f"SELECT type, grp, '{c}' AS feature, avg(CAST({c} > 0 AS INT)) AS share FROM pmark GROUP BY 1, 2" for c in PRE))


@query(
    "precursor_lift",
    "plong",
    "SELECT a.type, a.grp, a.feature, round(a.share, 6) AS share, round(c.share, 6) AS background, round(a.share / greatest(c.share, 1e-3), 5) AS lift FROM plong a JOIN plong c ON c.grp = 'control' AND c.type = a.type AND c.feature = a.feature WHERE a.grp <> 'control' AND a.share >= 0.1",
)
def precursor_lift(s: Site):
    """Primary episodes, missed and caught, against quiet control hours."""
    got = M.catches(s.alarms, s.seen, BY).where("run = 'busy'")
    e = s.seen.where("run = 'busy'").join(got.select("type", "split", "object_id", "e", F.lit(1).alias("_g")), ["type", "split", "object_id", "e"], "left")
    ctx = hour_context(s).select("type", "object_id", "h", "primary", "since", "next")
    feats = s.mart.select("object_id", "h", *PRE)
    before = e.withColumn("h", F.col("e") - 1).join(ctx, ["type", "object_id", "h"]).where("primary").join(feats, ["object_id", "h"])
    marked = before.select("type", F.when(F.col("_g").isNull(), "missed").otherwise("caught").alias("grp"), *PRE)
    control = ctx.where("next > 48 and since >= 24").join(feats, ["object_id", "h"]).select("type", F.lit("control").alias("grp"), *PRE)
    out = S.precursor_lift(marked.unionByName(control), ["type"], PRE)
    return out.withColumns(r6("share", "background")).withColumn("lift", F.round("lift", 5))


part("fends", "spans6 hctx", "SELECT s.type, x.since, x.next FROM spans6 s JOIN hctx x ON x.type = s.type AND x.object_id = s.object_id AND x.h = s.b WHERE NOT hit AND run = 'busy'")
part("fback", "scores hctx thr", "SELECT s.type, x.since, x.next FROM scores s JOIN thr USING (run, type, split) JOIN hctx x ON x.type = s.type AND x.object_id = s.object_id AND x.h = s.h WHERE run = 'busy' AND s.p < thr AND s.y = 0")
BAND = "CASE WHEN since < 24 THEN 0 WHEN since < 72 THEN 1 WHEN since < 168 THEN 2 WHEN since < 720 THEN 3 ELSE 4 END"


@query(
    "early_false",
    "fends fback",
    f"""SELECT f.type, f.n AS false_signals, round(early, 6) AS early, round(background, 6) AS background FROM (SELECT type, count(*) AS n, avg(CAST(next > 24 AND next <= 72 AS INT)) AS early FROM fends GROUP BY 1) f JOIN (
 SELECT type, sum(w.n * coalesce(rate, 0)) / sum(w.n) AS background FROM (SELECT type, {BAND} AS b, count(*) AS n FROM fends GROUP BY 1, 2) w LEFT JOIN (SELECT type, {BAND} AS b, avg(CAST(next > 24 AND next <= 72 AS INT)) AS rate FROM fback GROUP BY 1, 2) USING (type, b) GROUP BY 1) USING (type)""",
)
def early_false(s: Site):
    busy = s.alarms.where("run = 'busy'")
    ctx = hour_context(s).select("type", "object_id", "h", "since", F.col("next").alias("next"))
    spans = M.signal_spans(busy, BY, 6).where("not hit").select("type", "object_id", F.col("b").alias("h"))
    keys = ["type", "split", "object_id", "h"]
    quiet = s.scores.where("run = 'busy' and next > 24").join(busy.select(*keys), keys, "left_anti").select("type", "object_id", "h")
    e = S.early_false(spans.join(ctx, ["type", "object_id", "h"]), quiet.join(ctx, ["type", "object_id", "h"]), ["type"])
    return e.select("type", "false_signals", "early", "background").withColumns(r6("early", "background"))


@query(
    "repeat_rhythm",
    "epflag hctx",
    "SELECT e.type, got, count(*) AS repeats, round(avg(CAST(abs((since + 1 + 12) % 24 - 12) <= 1 AS INT)), 6) AS near_day FROM epflag e JOIN hctx x ON x.type = e.type AND x.object_id = e.object_id AND x.h = e.e - 1 WHERE run = 'busy' AND since + 1 >= 20 AND since + 1 < 168 GROUP BY 1, 2",
)
def repeat_rhythm(s: Site):
    got = M.catches(s.alarms, s.seen, BY).select(*BY, "object_id", "e", F.lit(True).alias("got"))
    e = s.seen.where("run = 'busy'").join(got, [*BY, "object_id", "e"], "left").withColumn("got", F.coalesce("got", F.lit(False))).withColumn("h", F.col("e") - 1)
    rows = e.join(hour_context(s).select("type", "object_id", "h", (F.col("since") + 1).alias("interval")), ["type", "object_id", "h"])
    return S.repeat_rhythm(rows, ["type", "got"]).withColumns(r6("near_day"))


@query("walk_compare")
def walk_compare(s: Site):
    """Caught and fresh of both runs at the cost of the first, by fold."""
    return S.walk_compare(curve(s), ["type", "split"], "busy")


part(
    "seeds",
    "scores",
    "SELECT type, split, object_id, h, y, seed, p + ((object_id * 31 + h * 17 + seed * 7) % 13) / 64.0 AS p FROM scores, (SELECT unnest([0, 1, 2]) AS seed) WHERE run = 'busy'",
)
part("smean", "seeds", "SELECT type, split, n AS seeds, object_id, h, y, avg(p) AS p FROM seeds, (SELECT unnest([1, 3]) AS n) WHERE seed < n GROUP BY ALL")


@query(
    "seed_sweep",
    "smean",
    """SELECT type, split, seeds, round(sum(pos * hits / alarms) / nullif(max(tp), 0), 5) AS pr_auc FROM (SELECT *, sum(n) OVER w AS alarms, sum(pos) OVER w AS hits, sum(pos) OVER (PARTITION BY type, split, seeds) AS tp FROM (
 SELECT type, split, seeds, round(p, 9) AS p, count(*) AS n, sum(y) AS pos FROM smean GROUP BY ALL) WINDOW w AS (PARTITION BY type, split, seeds ORDER BY p DESC)) GROUP BY ALL""",
)
def seed_sweep(s: Site):
    seed = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed")
    jitter = ((F.col("object_id") * 31 + F.col("h") * 17 + F.col("seed") * 7) % 13) / 64.0
    rows = s.scores.where("run = 'busy'").select("*", seed).withColumn("p", F.col("p") + jitter)
    n = F.explode(F.array(F.lit(1), F.lit(3))).alias("seeds")
    return S.seed_sweep(rows, ["type", "split"], [1, 3]).withColumn("pr_auc", F.round("pr_auc", 5))


# ---- drift: reference = the first stretch of valid hours, then 24-hour windows
REF_H, WIN_H = 100, 24
KEYS_OF_MART = {"object_id", "collector_id", "h", "ts", "year"}


def drift_features(s: Site):
    """Every feature of the mart."""
    return [c for c in s.mart.columns if c not in KEYS_OF_MART and not c.startswith("next_")]


def drift_frame(s: Site):
    if not hasattr(s, "_drift"):
        end = s.bounds[0] + 168 + REF_H
        cols = drift_features(s)
        # sums in another order differ in the last place: both sides round
        rows = s.mart.select("h", *[nudged(F.col(c).cast("double")).alias(c) for c in cols])
        s._drift = settle(S.feature_drift(rows, cols, end, REF_H, WIN_H, 2))
    return s._drift


def mean_sql(c, w):
    return f"{past(f'sum({c}_sum)', w)} / nullif({past(f'sum({c}_n)', w)}, 0)"


ONSETS = [f"onset_{t}" for t in TYPES] + ["noise_fire", "noise_flood"]
WIDE = {f"{c}_{w}h": past(f"sum({c})", w) for c in COUNTERS for w in (1, 6, 24, 168)}
WIDE |= {f"events_{w}h": past("sum(n_events)", w) for w in (1, 6, 24, 168)}
WIDE |= {f"channels_{w}h": f"{past('sum(n_channels)', w)} / {w}" for w in (1, 6, 24, 168)}
WIDE |= {f"gas_max_{w}h": past("max(gas_max)", w) for w in (1, 6, 24, 168)}
WIDE |= {f"{c}_mean_{w}h": mean_sql(c, w) for c in ("gas", "temp") for w in (1, 24, 168)}
WIDE |= {f"temp_{f}_{w}h": past(f"{f}(temp_{f})", w) for f in ("max", "min") for w in (24, 168)}
WIDE |= {f"since_{n}": since_sql(x) for n, x in (("event", "n_events > 0"), ("temp", "temp_n > 0"), ("guard", "arm + disarm > 0"), ("visit", "visit > 0"))}
WIDE |= {f"since_{t}": since_sql(f"onset_{t} > 0") for t in TYPES}
WIDE |= {"armed": "last_value(guard_last IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY h)"}
WIDE |= {f"{c}_{w}h": past(f"sum({c})", w) for c in ONSETS for w in (24, 168, 720, 2160)}
WIDE |= {f"trig_{t}_{w}h": past(f"sum(trig_{t})", w) for t in TYPES for w in (1, 6, 24)}
WIDE |= {f"{c}_{w}h": past(f"sum({c})", w) for c in ("arrival", "visit") for w in (24, 168)}
WIDE |= {f"{c}_trend": f"{mean_sql(c, 24)} - {mean_sql(c, 168)}" for c in ("gas", "temp")}
part("wide", "g", "SELECT object_id, collector_id, h, " + ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in WIDE.items()) + " FROM g")
TOGETHER = ONSETS + [f"trig_{t}" for t in TYPES]
part("collw", "g", "SELECT collector_id, h, " + ", ".join(f"CAST({past(f'sum({c})', w, 'collector_id')} AS DOUBLE) AS coll_{c}_{w}h" for c in TOGETHER for w in (24, 168)) + " FROM (SELECT collector_id, h, " + ", ".join(f"sum({c}) AS {c}" for c in TOGETHER) + " FROM g GROUP BY 1, 2)")
part(
    "dlong",
    "wide valid collw cal comp lim",
    """SELECT r, feature, round(v + 1e-9, 6) AS v FROM (UNPIVOT (SELECT h - lo - 268 AS r, CAST(COLUMNS(* EXCLUDE (object_id, collector_id, h, lo, hi)) AS DOUBLE)
 FROM wide JOIN valid USING (object_id, h) JOIN collw USING (collector_id, h) JOIN cal USING (h) JOIN comp USING (object_id), lim WHERE events_168h > 0) ON COLUMNS(* EXCLUDE (r)) INTO NAME feature VALUE v)""",
)
FAMILY_SQL = """CASE WHEN feature IN ('hour', 'dow', 'month', 'doy_sin', 'doy_cos', 'holiday', 'long_holiday', 'may9', 'days_to_holiday') THEN 'calendar' WHEN feature LIKE 'comp\\_%' ESCAPE '\\' THEN 'composition' WHEN feature LIKE 'coll\\_%' ESCAPE '\\' THEN 'collector'
 WHEN regexp_matches(feature, '^(onset|noise)_') OR feature IN ('since_fire', 'since_gas', 'since_flood', 'since_equipment', 'since_sensor', 'since_intrusion') THEN 'history' WHEN feature LIKE 'trig\\_%' ESCAPE '\\' THEN 'triggers'
 WHEN regexp_matches(feature, '^(gas|temp)_(max|min|mean|trend)') OR feature = 'since_temp' THEN 'readings' WHEN regexp_matches(feature, '^(armed|since_guard|arrival|visit|since_visit)') THEN 'guard' ELSE 'counters' END"""
part("dref", "dlong", "SELECT feature, v FROM dlong WHERE r >= -100 AND r < 0")
part("dcur", "dlong", "SELECT feature, r // 24 + 1 AS lag, v FROM dlong WHERE r >= 0 AND r < 48")
part("dbin", "dref", "SELECT feature, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q, list_sort(list(DISTINCT v)) AS u FROM dref GROUP BY feature")
part("dinner", "dbin", "SELECT feature, CASE WHEN len(q) >= 3 THEN q[2:len(q) - 1] ELSE u[2:] END AS e FROM dbin WHERE len(u) > 1")
part(
    "dpsi",
    "dref dcur dinner",
    """SELECT feature, lag, sum((b - a) * ln(b / a)) AS psi FROM (SELECT feature, lag, bin, greatest(1e-4, sum(a) / (SELECT count(*) FROM dref r WHERE r.feature = x.feature)) AS a, greatest(1e-4, sum(b) / (SELECT count(*) FROM dcur c WHERE c.feature = x.feature AND c.lag = x.lag)) AS b FROM (
  SELECT feature, lag, len(list_filter(e, lambda z: z <= v)) AS bin, 1 AS a, 0 AS b FROM dref JOIN dinner USING (feature), (SELECT DISTINCT lag FROM dcur) UNION ALL SELECT feature, lag, len(list_filter(e, lambda z: z <= v)), 0, 1 FROM dcur JOIN dinner USING (feature)) x GROUP BY feature, lag, bin) GROUP BY ALL""",
)


@query("feature_drift", "dpsi", "SELECT feature, lag, round(psi, 6) AS psi FROM dpsi")
def feature_drift(s: Site):
    return drift_frame(s).withColumns(r6("psi"))


@query("drift_families", "dpsi", f"SELECT {FAMILY_SQL} AS family, lag, round(median(psi), 6) AS median_psi, count(*) AS features FROM dpsi GROUP BY 1, 2")
def drift_families(s: Site):
    return S.family_drift(drift_frame(s), families(s)).withColumns(r6("median_psi"))


@query("drift_fastest", "dpsi", f"SELECT feature, {FAMILY_SQL} AS family, round(psi, 6) AS psi FROM dpsi QUALIFY lag = 2 AND row_number() OVER (PARTITION BY lag ORDER BY round(psi, 6) DESC, feature) <= 15")
def drift_fastest(s: Site):
    return S.drift_fastest(drift_frame(s), families(s), 2).withColumns(r6("psi"))


@query("drift_crossings", "dpsi", "SELECT feature, min(lag) FILTER (psi >= 0.1) AS moderate, min(lag) FILTER (psi >= 0.25) AS strong, round(max(psi), 6) AS worst FROM dpsi GROUP BY 1")
def drift_crossings(s: Site):
    return S.drift_crossings(drift_frame(s)).withColumns(r6("worst"))


def families(s: Site):
    groups = feature_groups(drift_features(s), TYPES)
    return s.spark.createDataFrame([(f, g) for g, fs in groups.items() for f in fs], "feature string, family string")


@query(
    "drift_weighted",
    "dpsi",
    """SELECT type, with_calendar, lag, round(sum(psi * w) / sum(w), 6) AS weighted_psi FROM dpsi JOIN (VALUES ('fire', 'events_24h', 0.4), ('fire', 'smoke_24h', 0.3), ('fire', 'hour', 0.3), ('gas', 'door_24h', 0.5), ('gas', 'hour', 0.5)) v(type, feature, w) USING (feature),
 (SELECT unnest([true, false]) AS with_calendar) WHERE with_calendar OR feature <> 'hour' GROUP BY ALL""",
)
def drift_weighted(s: Site):
    imp = s.spark.createDataFrame([("fire", "events_24h", 0.4), ("fire", "smoke_24h", 0.3), ("fire", "hour", 0.3), ("gas", "door_24h", 0.5), ("gas", "hour", 0.5)], "type string, feature string, importance double")
    return S.drift_weighted(drift_frame(s), imp, families(s)).withColumns(r6("weighted_psi"))


@query("target_drift", "scores lim", "SELECT type, (h - lo) // 72 AS window, count(*) AS rows, round(avg(y), 6) AS positive_rate FROM scores, lim WHERE run = 'busy' GROUP BY 1, 2".replace("AS window", 'AS "window"'))
def target_drift(s: Site):
    t = S.target_drift(s.scores.where("run = 'busy'"), ["type"], s.bounds[0], 72)
    return t.withColumns(r6("positive_rate"))


# ---- confidence, visits
part(
    "cftab",
    "runs al scores",
    """SELECT r.type, r.split, r.object_id, r.h, r.y, CAST(coalesce(r.p >= 0.05, false) AS INT) + CAST(o.h IS NOT NULL AS INT) + CAST(row_number() OVER (PARTITION BY r.type, r.split, r.object_id, r.run_id ORDER BY r.h) > 6 AS INT)
 + CAST((SELECT count(*) FROM al x WHERE x.run = 'busy' AND x.split = r.split AND x.object_id = r.object_id AND x.h = r.h) > 1 AS INT) AS signs FROM (SELECT * FROM runs WHERE run = 'busy') r LEFT JOIN (SELECT * FROM al WHERE run = 'recency') o
 ON o.type = r.type AND o.split = r.split AND o.object_id = r.object_id AND o.h = r.h""",
)


@query("confidence_table", "cftab", "SELECT type, split, signs, count(*) AS hours, round(avg(y), 6) AS rate FROM cftab GROUP BY ALL")
def confidence_table(s: Site):
    """The raw score stands for the calibrated one; the other run for the
    second model."""
    busy, other = s.alarms.where("run = 'busy'"), s.alarms.where("run = 'recency'")
    cal = busy.withColumn("confidence", F.col("p"))
    t = S.confidence_table(busy, other, ["type", "split"], cal, 6, 0.05)
    return t.select("type", "split", "signs", "hours", "rate").withColumns(r6("rate"))


part("vah", "visit obj", f"SELECT DISTINCT o.object_id, (v.t0 - {ORIGIN_US}) // {HOUR} AS vh FROM visit v JOIN obj o USING (collector_id)")
part("vbase", "scores vah", "SELECT object_id, h, CAST(EXISTS (SELECT 1 FROM vah v WHERE v.object_id = s.object_id AND v.vh > s.h AND v.vh <= s.h + 24) AS INT) AS got, h % 24 AS hod, (h // 24 + 1) % 7 >= 5 AS wknd FROM (SELECT DISTINCT object_id, h FROM scores) s")


@query(
    "visit_check",
    "spans vbase vah",
    """SELECT run, type, s.hit, count(*) AS signals, round(avg(CAST(EXISTS (SELECT 1 FROM vah v WHERE v.object_id = s.object_id AND v.vh > s.b AND v.vh <= s.b + 24) AS INT)), 6) AS visited, round(avg(coalesce(o.own, (SELECT avg(got) FROM vbase))), 6) AS object_background,
 round(avg(coalesce(c.cell, (SELECT avg(got) FROM vbase))), 6) AS hour_background FROM (SELECT * FROM spans WHERE split = 'test') s LEFT JOIN (SELECT object_id, avg(got) AS own FROM vbase GROUP BY 1) o USING (object_id)
 LEFT JOIN (SELECT object_id, hod, wknd, avg(got) AS cell FROM vbase GROUP BY ALL) c ON c.object_id = s.object_id AND c.hod = s.b % 24 AND c.wknd = ((s.b // 24 + 1) % 7 >= 5) GROUP BY run, type, s.hit""",
)
def visit_check(s: Site):
    spans = M.signal_spans(s.alarms.where("split = 'test'"), BY, 0)
    v = S.visit_check(spans, s.scores, s.visits, s.objects, ["run", "type"])
    return v.withColumns(r6("visited", "object_background", "hour_background"))


part("rday", "scores thr", "SELECT *, p >= thr AS alarm FROM scores JOIN thr USING (run, type, split) WHERE (h + 1) % 24 = 7")


@query(
    "retro_daily",
    "rday",
    """SELECT run, type, count(DISTINCT h) AS days, round(count(*) FILTER (alarm) / count(DISTINCT h), 6) AS per_day, round(count(*) FILTER (alarm AND y = 1) / greatest(count(*) FILTER (alarm), 1), 6) AS precision, CAST(sum(y) AS BIGINT) AS episodes,
 count(*) FILTER (alarm AND y = 1) AS caught, round(count(*) FILTER (alarm AND y = 1) / greatest(sum(y), 1), 6) AS recall, round(quantile_cont(next, 0.5) FILTER (alarm AND y = 1), 6) AS lead_median_h FROM rday GROUP BY 1, 2""",
)
def retro_daily(s: Site):
    return S.retro_daily(snap_rows(s), ["run", "type"]).withColumns(r6("per_day", "precision", "recall", "lead_median_h"))


def snap_rows(s: Site):
    thr = s.thresholds(SHARE).select(*BY, "thr")
    rows = s.scores.where((F.col("h") + 1) % 24 == 7).join(thr, BY)
    return rows.withColumn("alarm", F.col("p") >= F.col("thr")).withColumn("y", M.positive())


@query(
    "retro_months",
    "rday lim",
    """SELECT run, type, round(count(*) FILTER (alarm AND y = 1 AND w = 1) / greatest(count(*) FILTER (alarm AND w = 1), 1), 2) AS "1", round(count(*) FILTER (alarm AND y = 1 AND w = 3) / greatest(count(*) FILTER (alarm AND w = 3), 1), 2) AS "3" FROM (SELECT *, (h - lo) // 168 AS w FROM rday, lim) GROUP BY 1, 2""",
)
def retro_months(s: Site):
    """Precision by period; weeks stand for the months of a longer history."""
    week = F.floor((F.col("h") - s.bounds[0]) / 168).cast("int")
    return S.month_pivot(snap_rows(s), ["run", "type"], week, [1, 3])


@query(
    "baseline_eval_sensor",
    "smart_d stype1",
    """SELECT stype, count(*) AS rows, round(avg(CAST(next_single <= 7 AS INT)), 6) AS base_rate FROM smart_d JOIN stype1 USING (channel_id) GROUP BY 1""",
)
def baseline_eval_sensor(s: Site):
    """Channel-day rows and their fault rate by sensor group, from the metric
    row of a history score."""
    from .q_packs import smart

    rows = smart(s).select("stype", F.col("channel_id").alias("object_id"), F.col("d").alias("h"), F.col("next_single").alias("next"), (F.col("single_365") + F.col("fault_365") * 1e-3).alias("p"))
    rows = settle(rows)
    thr = M.threshold_for_share(rows, ["stype"], [0.05])
    e = M.evaluate(rows, thr, ["stype"], 7, 91)
    return e.select("stype", "rows", F.round("base_rate", 6).alias("base_rate"))


# ---- notices by fact
part("nhit", "inc marked", "SELECT e.object_id, e.type, e.t0, e.noise IS NULL AS real, e.confirmed, t.channel_id, t.us, t.noise IS NULL AS clean FROM inc e JOIN marked t ON t.object_id = e.object_id AND t.type = e.type AND t.us BETWEEN e.t0 AND e.t1")
E3 = "object_id, type, t0"
part(
    "nrule",
    "nhit",
    f"""SELECT {E3}, real, confirmed, min(us) AS t_first, min(us) FILTER (k = 2) AS t_n2, max(c2) AS t_nch2, min(us) FILTER (clean AND kc = 1) AS t_clean, min(us) FILTER (clean AND kc = 2) AS t_clean2, max(cc2) AS t_cleanch2,
 CASE WHEN count(*) FILTER (NOT clean AND us <= t0) = 0 THEN t0 + 600000000 END AS t_silent FROM (SELECT h.*, row_number() OVER (PARTITION BY {E3} ORDER BY us, channel_id) AS k, row_number() OVER (PARTITION BY {E3}, clean ORDER BY us, channel_id) AS kc, x.c2, x.cc2 FROM nhit h
 LEFT JOIN (SELECT {E3}, max(f) FILTER (r = 2) AS c2, max(fc) FILTER (rc = 2) AS cc2 FROM (SELECT *, row_number() OVER (PARTITION BY {E3} ORDER BY f, channel_id) AS r, row_number() OVER (PARTITION BY {E3} ORDER BY fc NULLS LAST, channel_id) AS rc FROM (
  SELECT {E3}, channel_id, min(us) AS f, min(us) FILTER (clean) AS fc FROM nhit GROUP BY ALL)) GROUP BY ALL) x USING ({E3})) GROUP BY {E3}, real, confirmed""",
)


def notices(s: Site):
    if not hasattr(s, "_notices"):
        s._notices = settle(S.notice_rules(s.episodes, s.marked))
    return s._notices


@query("notice_rules", "nrule", "SELECT * FROM nrule")
def notice_rules(s: Site):
    return S.notice_rules(s.episodes, s.marked)


part("nlong", "nrule", " UNION ALL ".join(f"SELECT type, t0, real, confirmed, '{r}' AS rule, t_{r} AS at_us FROM nrule" for r in S.RULES))
part(
    "ntab",
    "nlong",
    """SELECT type, rule, count(at_us) AS announced, count(at_us) FILTER (NOT real) AS false_n, count(*) FILTER (real AND at_us IS NULL) AS missed, quantile_cont((at_us - t0) / 60000000, 0.5) FILTER (real AND at_us IS NOT NULL) AS p50,
 quantile_cont((at_us - t0) / 60000000, 0.9) FILTER (real AND at_us IS NOT NULL) AS p90, avg(CAST(confirmed AS INT)) FILTER (at_us IS NOT NULL) AS visited FROM nlong GROUP BY 1, 2""",
)


@query("notice_table", "ntab", 'SELECT type, rule, announced, false_n AS "false", missed, round(p50, 6) AS delay_p50, round(p90, 6) AS delay_p90, round(visited, 6) AS visited FROM ntab')
def notice_table(s: Site):
    return S.notice_table(notices(s)).withColumns(r6("delay_p50", "delay_p90", "visited"))


@query(
    "notice_tradeoff",
    "ntab fcurve inc",
    """SELECT c.type, CAST(c.share AS DOUBLE) AS share, r.rule, caught, CAST(false_signals AS BIGINT) AS false_signals, CAST(round((episodes - caught) * cover) AS BIGINT) AS by_fact, episodes - caught - CAST(round((episodes - caught) * cover) AS BIGINT) AS unannounced, r.f AS fact_false
FROM fcurve c JOIN (SELECT p.type, p.b.rule AS rule, p.b.f AS f, (n - p.b.m) / greatest(n, 1) AS cover FROM (SELECT type, min({f: false_n, m: missed, rule: rule}) AS b FROM ntab WHERE rule IN ('first', 'clean', 'silent') GROUP BY 1) p
 JOIN (SELECT type, count(*) AS n FROM inc WHERE noise IS NULL GROUP BY 1) USING (type)) r USING (type) WHERE run = 'busy' AND split = 'test'""",
)
def notice_tradeoff(s: Site):
    totals = s.episodes.where("noise is null").groupBy("type").agg(F.count(F.lit(1)).alias("real"))
    c = curve(s).where("run = 'busy' and split = 'test'")
    return S.notice_tradeoff(S.notice_table(notices(s)), totals, c)
