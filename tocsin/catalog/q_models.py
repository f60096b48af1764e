"""Model jobs (pyspark.ml: rows-only checks) and their SQL-checkable parts."""

from pyspark.sql import functions as F

from ..operators.settle import settle
from ..plans import alarms as A
from ..plans import models as P
from .q_metrics import K
from .registry import part, query
from .site import BY, SCORED, SHARE, SPLIT_H, Site

NULLABLE = ["gas_mean_24h", "temp_mean_24h"]
TARGET = "next_equipment"


def weeks(s: Site):
    """The month in two halves stands for the years of a long history."""
    half = F.when(F.col("h") < s.bounds[0] + SPLIT_H, 1).otherwise(2)
    return P.time_split(s.mart, half, {"train": [1], "test": [2]})


@query("time_split", "smart lim", f"SELECT CASE WHEN h < lo + {SPLIT_H} THEN 'train' ELSE 'test' END AS split, count(*) AS rows FROM smart, lim GROUP BY 1")
def time_split(s: Site):
    return weeks(s).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "baseline_freq",
    "smart lim",
    f"SELECT m.object_id, m.h, round(coalesce(r.f, (SELECT avg(CAST(next_equipment <= 24 AS INT)) FROM smart, lim WHERE h < lo + {SPLIT_H})), 6) AS freq FROM smart m JOIN lim ON m.h >= lo + {SPLIT_H} LEFT JOIN (SELECT object_id, avg(CAST(next_equipment <= 24 AS INT)) AS f FROM smart, lim WHERE h < lo + {SPLIT_H} GROUP BY 1) r USING (object_id)",
)
def baseline_freq(s: Site):
    w = weeks(s)
    f = P.baseline_freq(w.where("split = 'train'"), w.where("split = 'test'"), TARGET, 24)
    return f.select("object_id", "h", F.round("freq", 6).alias("freq"))


@query("baseline_rules", "smart", "SELECT object_id, h, CAST(trig_equipment_24h AS DOUBLE) AS rules, CAST(-since_equipment AS DOUBLE) AS recency FROM smart")
def baseline_rules(s: Site):
    b = P.baseline_scores(s.mart, "equipment")
    return b.select("object_id", "h", F.round("rules", 6).alias("rules"), "recency")


#: Fixed order of all types of the journal; those without incidents stay as rows without a score.
TYPES = ["fire", "gas", "flood", "equipment", "sensor", "intrusion"]
COMMON = ["events_24h", "events_168h", "smoke_24h", "gas_mean_24h", "temp_mean_24h", "hour", "dow"]
VAL_HOURS = 72


def features_of(t: str) -> list[str]:
    """What all types read, and the type's own counters beside those of its neighbours."""
    return [*COMMON, *(f"since_{x}" for x in TYPES), *(f"onset_{x}_168h" for x in TYPES), f"trig_{t}_24h"]


def fitted(s: Site):
    """One model a type; the last days before the split are validation, a horizon apart."""
    if not hasattr(s, "_gbt"):
        rows = weeks(s).where("split = 'train'")
        s._gbt = P.train_types(rows, TYPES, features_of, NULLABLE, s.bounds[0] + SPLIT_H - VAL_HOURS, trees=8, depth=4)
    return s._gbt


@query("train_gbt")
def train_gbt(s: Site):
    return P.score_types(fitted(s), weeks(s).where("split = 'test'"), features_of, NULLABLE)


@query("importance_table")
def importance_table(s: Site):
    return P.importance_of_types(s.spark, fitted(s))


@query(
    "soft_label_train",
    "smart lim",
    f"SELECT CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, count(*) AS n FROM (SELECT unnest(CASE WHEN next_equipment > 24 THEN [{{y: 0, w: 1.0}}] WHEN next_equipment_conf <= 24 THEN [{{y: 1, w: 1.0}}] ELSE [{{y: 1, w: 0.5}}, {{y: 0, w: 0.5}}] END, recursive := true) FROM smart, lim WHERE h < lo + {SPLIT_H}) GROUP BY 1, 2",
)
def soft_label_train(s: Site):
    """The weighted rows soft-label training reads; train_gbt takes them."""
    rows = P.soft_labels(weeks(s).where("split = 'train'"), TARGET, "next_equipment_conf", 24, 0.5)
    return rows.groupBy("y", "w").agg(F.count(F.lit(1)).alias("n"))


part(
    "ebest",
    "onset scores",
    f"SELECT {K}, object_id, e, max(p) AS best FROM onset JOIN scores USING ({K}, object_id) WHERE h BETWEEN e - 24 AND e - 1 GROUP BY ALL",
)
part(
    "lthr",
    "ebest",
    f"SELECT {K}, level, list_sort(list(best), 'DESC')[greatest(1, CAST(ceil(level * count(*)) AS INTEGER))] AS thr FROM ebest, (SELECT unnest([0.4, 0.5, 0.6, 0.75])::DOUBLE AS level) GROUP BY {K}, level",
)


@query(
    "tune_false_hours",
    "lthr scores",
    f"SELECT {K}, level, thr, (SELECT count(*) FROM scores s WHERE s.run = l.run AND s.type = l.type AND s.split = l.split AND s.next > 24 AND s.p >= l.thr) AS false_hours FROM lthr l",
)
def tune_false_hours(s: Site):
    return P.false_hours_at_recall(s.scores, BY)


@query(
    "tune_objective",
    "lthr scores",
    f"SELECT {K}, round(avg(ln(1 + n)), 6) AS objective FROM (SELECT {K}, level, (SELECT count(*) FROM scores s WHERE s.run = l.run AND s.type = l.type AND s.split = l.split AND s.next > 24 AND s.p >= l.thr) AS n FROM lthr l) GROUP BY {K}",
)
def tune_objective(s: Site):
    return P.tuning_objective(P.false_hours_at_recall(s.scores, BY), BY).withColumn("objective", F.round("objective", 6))


part(
    "hcurve",
    "scores",
    f"""SELECT {K}, hz AS horizon, p, count(*) AS n, sum(CAST(next <= hz AS INT)) AS pos FROM scores, (SELECT unnest([6, 24, 72]) AS hz) GROUP BY ALL""",
)


@query(
    "horizon_sweep",
    "hcurve",
    f"""SELECT {K}, horizon, round(max(tp) / max(tn), 6) AS base_rate, round(sum(pos * hits / alarms) / nullif(max(tp), 0), 6) AS pr_auc FROM (SELECT *, sum(n) OVER w AS alarms, sum(pos) OVER w AS hits, sum(pos) OVER (PARTITION BY {K}, horizon) AS tp,
 sum(n) OVER (PARTITION BY {K}, horizon) AS tn FROM hcurve WINDOW w AS (PARTITION BY {K}, horizon ORDER BY p DESC)) GROUP BY {K}, horizon""",
)
def horizon_sweep(s: Site):
    h = P.horizon_sweep(s.scores, BY, [6, 24, 72], 6.0, 10.0)
    return h.select(*BY, "horizon", F.round("base_rate", 6).alias("base_rate"), F.round("pr_auc", 6).alias("pr_auc"))


part("ipts", "scores", f"SELECT {K}, p, count(*) AS n, count(*) FILTER (next <= 24) AS s, row_number() OVER (PARTITION BY {K} ORDER BY p) AS i FROM scores GROUP BY {K}, p")
part("isum", "ipts", f"SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM ipts WINDOW w AS (PARTITION BY {K} ORDER BY i)")
part("imean", "isum", f"SELECT {K}, a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m FROM isum a JOIN isum b USING ({K}) WHERE a.i <= b.i")
# the fit at a point: the largest over all starts before it of the least mean over all ends after it
part(
    "iso",
    "ipts imean",
    f"SELECT {K}, p, n, v FROM ipts JOIN (SELECT {K}, i, max(m) AS v FROM (SELECT {K}, b AS i, min(m) OVER (PARTITION BY {K}, a ORDER BY b DESC) AS m FROM imean) GROUP BY {K}, i) USING ({K}, i)",
)


@query("isotonic_blocks", "iso", f"SELECT {K}, min(p) AS lo, max(p) AS hi, sum(n)::BIGINT AS n, round(v, 6) AS value FROM iso GROUP BY {K}, v")
def isotonic_blocks(s: Site):
    """The calibration of every run, type and split."""
    return P.isotonic_fit(s.scores, BY).withColumn("value", F.round("value", 6))


@query(
    "isotonic_fit",
    "scores iso",
    """SELECT t.run, t.type, t.object_id, t.h, t.p, round(CASE WHEN a.p IS NULL THEN b.v WHEN b.p IS NULL OR a.p = b.p THEN a.v ELSE a.v + (b.v - a.v) * (t.p - a.p) / (b.p - a.p) END, 6) AS confidence
 FROM (SELECT * FROM scores WHERE split = 'test') t ASOF LEFT JOIN (SELECT * FROM iso WHERE split = 'val') a ON a.run = t.run AND a.type = t.type AND t.p >= a.p
 ASOF LEFT JOIN (SELECT * FROM iso WHERE split = 'val') b ON b.run = t.run AND b.type = t.type AND t.p <= b.p""",
)
def isotonic_fit(s: Site):
    """Test scores of every run and type, calibrated on validation."""
    by = ["run", "type"]
    out = P.confidence(P.isotonic_fit(s.scores.where("split = 'val'"), by), s.scores.where("split = 'test'"), by)
    return out.select("run", "type", "object_id", "h", "p", F.round("confidence", 6).alias("confidence"))


part("imp", "", "SELECT * FROM (VALUES ('fire', 'events_24h', 0.5), ('fire', 'since_fire', 0.3), ('fire', 'hour', 0.2), ('gas', 'since_gas', 0.6), ('gas', 'events_24h', 0.4)) v(type, feature, importance)")


def importances(s: Site):
    return s.spark.createDataFrame([("fire", "events_24h", 0.5), ("fire", "since_fire", 0.3), ("fire", "hour", 0.2), ("gas", "since_gas", 0.6), ("gas", "events_24h", 0.4)], "type string, feature string, importance double")


@query(
    "reasons_topk",
    "smart",
    "SELECT 'fire' AS type, object_id, h, 1 AS place, 'events_24h' AS feature, 'events of a day' AS label, CAST(events_24h AS DOUBLE) AS value FROM smart UNION ALL SELECT 'fire', object_id, h, 2, 'since_fire', NULL, CAST(since_fire AS DOUBLE) FROM smart UNION ALL SELECT 'gas', object_id, h, 1, 'since_gas', NULL, CAST(since_gas AS DOUBLE) FROM smart UNION ALL SELECT 'gas', object_id, h, 2, 'events_24h', 'events of a day', CAST(events_24h AS DOUBLE) FROM smart",
)
def reasons_topk(s: Site):
    labels = s.spark.createDataFrame([("events_24h", "events of a day")], "feature string, label string")
    rows = s.mart.withColumn("type", F.explode(F.array(F.lit("fire"), F.lit("gas"))))
    r = P.reasons_topk(rows, importances(s), labels, ["events_24h", "since_fire", "since_gas", "hour"], 2)
    return r.withColumn("value", F.round("value", 6))


@query(
    "feature_label",
    "comp",
    """SELECT 'onset_fire_' || object_id || 'h' AS feature, 'fires over ' || CASE WHEN object_id <= 24 THEN object_id || ' h' END AS label FROM comp
 UNION ALL SELECT 'coll_onset_fire_' || 24 * object_id || 'h', 'fires of the collector over ' || CASE WHEN object_id <= 1 THEN 24 * object_id || ' h' ELSE object_id || ' d' END FROM comp UNION ALL SELECT 'odd_' || object_id, 'odd_' || object_id FROM comp""",
)
def feature_label(s: Site):
    o = F.col("object_id")
    names = s.objects.select(
        F.explode(F.array(F.concat(F.lit("onset_fire_"), o, F.lit("h")), F.concat(F.lit("coll_onset_fire_"), o * 24, F.lit("h")), F.concat(F.lit("odd_"), o))).alias("feature")
    )
    bases = s.spark.createDataFrame([("onset_fire", "fires")], "base string, text string")
    return P.feature_label(names, bases, {"coll_": " of the collector"})


def second(s: Site):
    if not hasattr(s, "_second"):
        work = A.at_work_flags(s.mart.select("object_id", "collector_id", "h"), s.guard, s.visits, 12)
        al = s.alarms.where("run = 'busy'")
        s._second = settle(P.cascade_features(al, al, work, BY))
    return s._second


@query(
    "cascade_features",
    "runs al work",
    f"""SELECT r.type, r.split, r.object_id, r.h, CAST((SELECT count(*) - 1 FROM al x WHERE x.run = 'busy' AND x.split = r.split AND x.object_id = r.object_id AND x.h = r.h) AS DOUBLE) AS near,
 CAST(r.h - min(r.h) OVER (PARTITION BY {K}, r.object_id, run_id) + 1 AS DOUBLE) AS run_hours, CAST(w.disarmed AS DOUBLE) AS disarmed, CAST(w.visiting AS DOUBLE) AS visiting FROM runs r JOIN work w USING (object_id, h) WHERE run = 'busy'""",
)
def cascade_features(s: Site):
    return second(s).select("type", "split", "object_id", "h", "near", "run_hours", "disarmed", "visiting")


@query("cascade_oof")
def cascade_oof(s: Site):
    """Every type's second stage; folds keep the horizon of a target apart."""
    rows = second(s).withColumn("label", F.col("y").cast("double"))
    out = P.second_stages(rows, SCORED, "h", ["p", "near", "run_hours", "disarmed", "visiting"], "label", 3, 0.95, gap=24)
    return out.select("type", "object_id", "h", "split", "y", "oof", "passed", "unscored")


@query("walk_forward")
def walk_forward(s: Site):
    """Five days' folds over the whole period, for all types and strategies; folds
    without enough positives stay as rows without a score."""
    lo, hi = s.bounds
    return P.walks(s.mart, TYPES, ("all", "d10", "decay5", "frozen", "thrfix"), features_of, NULLABLE, lo + 120, hi, 120, val_hours=48, trees=4, depth=3)


part(
    "nfeat",
    "inc trig noise",
    """SELECT e.object_id, e.type, e.t0, CAST(e.noise IS NULL AS DOUBLE) AS real, (SELECT count(DISTINCT t.channel_id) FROM trig t WHERE t.object_id = e.object_id AND t.us BETWEEN e.t0 AND e.t0 + 600000000) AS ch10,
 (SELECT count(*) FROM trig t WHERE t.object_id = e.object_id AND t.us BETWEEN e.t0 AND e.t0 + 600000000) AS tr10,
 (SELECT count(*) FROM trig t WHERE t.object_id = e.object_id AND t.type = e.type AND t.us >= e.t0 - 3600000000 AND t.us < e.t0) AS prev_1h,
 (SELECT count(*) FROM trig t WHERE t.object_id = e.object_id AND t.type = e.type AND t.us >= e.t0 - 86400000000 AND t.us < e.t0) AS prev_24h,
 (SELECT count(*) FROM trig t WHERE t.object_id = e.object_id AND t.type = e.type AND t.us >= e.t0 - 604800000000 AND t.us < e.t0) AS prev_168h,
 (SELECT count(*) FROM noise t WHERE t.object_id = e.object_id AND t.type = e.type AND t.us BETWEEN e.t0 AND e.t0 + 600000000) AS marked10,
 (SELECT count(*) FROM inc i WHERE i.object_id = e.object_id AND i.type = e.type AND i.t0 < e.t0 AND i.t0 >= e.t0 - 2592000000000) AS ep_30d,
 (SELECT count(*) FROM inc i WHERE i.object_id = e.object_id AND i.type = e.type AND i.t0 < e.t0 AND i.t0 >= e.t0 - 15552000000000) AS ep_180d, CAST(hour(make_timestamp(e.t0)) AS DOUBLE) AS hour,
 coalesce((SELECT avg(CAST(i.noise IS NOT NULL AS INT)) FROM inc i WHERE i.object_id = e.object_id AND i.type = e.type AND i.t0 < e.t0 AND i.t0 >= e.t0 - 15552000000000), -1.0) AS noise_180d, CAST(dayofweek(make_timestamp(e.t0)) AS DOUBLE) AS dow FROM inc e""",
)


@query("notice_filter_features", "nfeat", "SELECT * REPLACE (round(noise_180d, 6) AS noise_180d) FROM nfeat")
def notice_filter_features(s: Site):
    f = P.notice_features(s.episodes, s.triggers, s.noise)
    return f.select("object_id", "type", "t0", "real", *P.NOTICE_FEATURES).withColumn("noise_180d", F.round("noise_180d", 6))


@query("notice_filter_oof")
def notice_filter_oof(s: Site):
    """Every type's filter of notices by what is known ten minutes after the start."""
    rows = P.notice_features(s.episodes, s.triggers, s.noise)
    rows = settle(rows.withColumns({c: F.col(c).cast("double") for c in P.NOTICE_FEATURES}))
    out = P.second_stages(rows, TYPES, "t0", P.NOTICE_FEATURES, "real", 3, 0.95)
    return out.select("object_id", "type", "t0", "real", "oof", "passed", "unscored")


@query("sensor_model")
def sensor_model(s: Site):
    """Channel-day boosting, judged at a daily inspection budget."""
    from .q_packs import day_bounds, smart

    feats = ["ev_7", "flips_7", "silent", "since_fault", "single_365", "fault_365", "obj_fault_30", "age"]
    m = smart(s).withColumn("y", (F.col("next_single") <= 7).cast("double"))
    lo = day_bounds(s)[0]
    model, _ = P.train_gbt(settle(m.where(F.col("d") < lo + 18)), feats, [], "y", trees=5, depth=3)
    test = P.score(model, m.where(F.col("d") >= lo + 18), feats, [])
    top = A.daily_share_top(test, [], "d", "channel_id", 0.05)
    return top.select("channel_id", "d", "stype", "next_single", "p")


@query(
    "urgent_overlay",
    "al caught scores seen",
    f"""SELECT x.type, x.split, extra_hours FROM (SELECT u.type, u.split, count(*) AS extra_hours FROM (SELECT *, quantile_cont(p, 0.9) OVER (PARTITION BY type, split) AS t FROM scores WHERE run = 'recency') u
 LEFT JOIN (SELECT * FROM al WHERE run = 'busy') d ON d.type = u.type AND d.split = u.split AND d.object_id = u.object_id AND d.h = u.h WHERE u.p >= u.t AND d.h IS NULL GROUP BY 1, 2) x""",
)
def urgent_overlay(s: Site):
    daily, quick = s.scores.where("run = 'busy'"), s.scores.where("run = 'recency'")
    u = P.urgent_overlay(daily, quick, ["type", "split"], SHARE, [0.1])
    return u.select("type", "split", "extra_hours")
