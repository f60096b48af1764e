"""Forecast metrics: curves, thresholds, signals, the full metric row."""

from pyspark.sql import functions as F

from ..plans import metrics as M
from .q_features import past, since_sql
from .registry import part, query
from .site import BY, SCORED, SHARE, SPLIT_H, Site

K = "run, type, split"
part(
    "sfeat",
    "g",
    "SELECT object_id, collector_id, h, "
    + past("sum(n_events)", 168) + " AS events_168h, " + past("sum(n_events)", 24) + " AS events_24h, "
    + ", ".join(f"{past(f'sum(trig_{t})', 24)} AS trig_{t}_24h, {past(f'sum(onset_{t})', 168)} AS onset_{t}_168h, {since_sql(f'onset_{t} > 0')} AS since_{t}" for t in SCORED)
    + " FROM g",
)
part("smart", "sfeat valid tg", "SELECT * FROM sfeat JOIN valid USING (object_id, h) JOIN tg USING (object_id, h) WHERE events_168h > 0")
part(
    "scores",
    "smart lim",
    " UNION ALL ".join(
        f"SELECT '{run}' AS run, '{t}' AS type, CASE WHEN h < lo + {SPLIT_H} THEN 'val' ELSE 'test' END AS split, object_id, collector_id, h, next_{t} AS next, CAST({p} AS DOUBLE) AS p, CAST(next_{t} <= 24 AS INT) AS y FROM smart, lim"
        for t in SCORED
        for run, p in (("busy", f"(trig_{t}_24h * 64 + onset_{t}_168h * 16 + events_24h) / 4096"), ("recency", f"-since_{t}"))
    ),
)
part("thr", "scores", f"SELECT {K}, quantile_cont(p, {1 - SHARE}) AS thr FROM scores GROUP BY {K}")
part("al", "scores thr", f"SELECT s.*, thr FROM scores s JOIN thr USING ({K}) WHERE p >= thr")
part(
    "runs",
    "al",
    f"""SELECT *, sum(n) OVER (PARTITION BY {K}, object_id ORDER BY h) AS run_id FROM (
 SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY {K}, object_id ORDER BY h) = 1 THEN 0 ELSE 1 END AS n FROM al)""",
)
part(
    "runs6",
    "al",
    f"""SELECT *, sum(n) OVER (PARTITION BY {K}, object_id ORDER BY h) AS run_id FROM (
 SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY {K}, object_id ORDER BY h) <= 7 THEN 0 ELSE 1 END AS n FROM al)""",
)
part("spans", "runs", f"SELECT {K}, object_id, min(h) AS a, max(h) AS b, count(*) AS hours, max(y) = 1 AS hit FROM runs GROUP BY {K}, object_id, run_id")
part("spans6", "runs6", f"SELECT {K}, object_id, min(h) AS a, max(h) AS b, count(*) AS hours, max(y) = 1 AS hit FROM runs6 GROUP BY {K}, object_id, run_id")
part("onset", "scores", f"SELECT DISTINCT {K}, object_id, h + next AS e FROM scores WHERE next < 168")
part("seen", "onset scores", f"SELECT DISTINCT o.* FROM onset o JOIN scores s USING ({K}, object_id) WHERE s.h BETWEEN e - 24 AND e - 1")
part(
    "caught",
    "seen runs",
    f"""SELECT {K}, object_id, e, max(e - h) AS lead, max(e - h) + arg_min(h - a, h) AS standing FROM seen JOIN
 (SELECT *, min(h) OVER (PARTITION BY {K}, object_id, run_id) AS a FROM runs) r USING ({K}, object_id) WHERE h BETWEEN e - 24 AND e - 1 GROUP BY ALL""",
)
part(
    "curve",
    "scores",
    f"""SELECT *, hits / alarms AS precision, hits / nullif(positives, 0) AS recall FROM (SELECT {K}, p, n, pos,
 sum(n) OVER (PARTITION BY {K} ORDER BY p DESC) AS alarms, sum(pos) OVER (PARTITION BY {K} ORDER BY p DESC) AS hits,
 sum(n) OVER (PARTITION BY {K}) AS rows, sum(pos) OVER (PARTITION BY {K}) AS positives
FROM (SELECT {K}, p, count(*) AS n, sum(y) AS pos FROM scores GROUP BY {K}, p))""",
)


@query("onsets", "onset", "SELECT * FROM onset")
def onsets(s: Site):
    return M.onsets(s.scores, BY)


@query(
    "pr_curve",
    "curve",
    f"SELECT {K}, round(p, 6) AS p, CAST(alarms AS BIGINT) AS alarms, CAST(hits AS BIGINT) AS hits, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve",
)
def pr_curve(s: Site):
    c = M.pr_curve(s.scores, BY)
    return c.select(*BY, F.round("p", 6).alias("p"), "alarms", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


F1 = "2 * precision * recall / greatest(precision + recall, 1e-12)"


@query(
    "best_f1_threshold",
    "curve",
    f"SELECT {K}, round(max(f), 6) AS f1, min(p) FILTER (f >= m - 1e-15) AS thr FROM (SELECT *, {F1} AS f, max({F1}) OVER (PARTITION BY {K}) AS m FROM curve) GROUP BY {K}",
)
def best_f1_threshold(s: Site):
    return M.best_f1_threshold(M.pr_curve(s.scores, BY), BY).withColumn("f1", F.round("f1", 6))


@query("threshold_for_precision", "curve", f"SELECT {K}, min(p) FILTER (precision >= 0.5 AND alarms >= 20) AS thr FROM curve GROUP BY {K}")
def threshold_for_precision(s: Site):
    return M.threshold_for_precision(M.pr_curve(s.scores, BY), BY, 0.5, 20)


@query(
    "threshold_for_rate",
    "scores",
    f"""SELECT {K}, round(v[1 + CAST(floor(pos) AS INT)] + (v[1 + CAST(ceil(pos) AS INT)] - v[1 + CAST(floor(pos) AS INT)]) * (pos - floor(pos)), 6) AS thr FROM (
 SELECT {K}, list(p ORDER BY p) AS v, (1 - least(1, 60.0 / count(*))) * (count(*) - 1) AS pos FROM scores GROUP BY {K})""",
)
def threshold_for_rate(s: Site):
    return M.threshold_for_rate(s.scores, BY, 6.0, 10.0).withColumn("thr", F.round("thr", 6))


@query(
    "signals",
    "spans spans6",
    f"""SELECT {K}, 0 AS gap, count(*) AS signals, count(*) FILTER (hit) AS signals_true FROM spans GROUP BY {K}
UNION ALL SELECT {K}, 6, count(*), count(*) FILTER (hit) FROM spans6 GROUP BY {K}""",
)
def signals(s: Site):
    both = [M.signals(s.alarms, BY, g).withColumn("gap", F.lit(g)) for g in (0, 6)]
    return both[0].unionByName(both[1])


@query("signal_spans", "spans6", f"SELECT {K}, object_id, a, b, hours, hit, b - a + 1 AS length FROM spans6")
def signal_spans(s: Site):
    return M.signal_spans(s.alarms, BY, 6)


part("edges", "scores", f"SELECT {K}, quantile_cont(p, [{', '.join(f'{i}/15.0' for i in range(16))}]) AS e FROM scores GROUP BY {K}")
part(
    "eces",
    "scores edges",
    f"""SELECT {K}, sum(abs(y - s)) / sum(n) AS ece FROM (SELECT {K}, greatest(0, least(14, len(list_filter(e, lambda x: x <= p)) - 1)) AS bin,
 count(*) AS n, sum(y) AS y, sum(p) AS s FROM scores JOIN edges USING ({K}) GROUP BY ALL) GROUP BY {K}""",
)


@query("ece", "eces", f"SELECT {K}, round(ece, 6) AS ece FROM eces")
def ece(s: Site):
    return M.ece(s.scores, BY).withColumn("ece", F.round("ece", 6))


EV = "rows base_rate threshold alarm_rate precision recall_rows pr_auc roc_auc signals signals_true signals_false episodes caught recall_episodes lead_median_h lead_p25_h lead_p75_h lead_ge_12h alarm_run_median_h alarm_run_capped".split()
INTS = {"rows", "signals", "signals_true", "signals_false", "episodes", "caught"}


part(
    "ev",
    "scores thr curve spans seen caught",
    f"""SELECT {K}, b.* EXCLUDE ({K}), c.* EXCLUDE ({K}), coalesce(g.signals, 0) AS signals, coalesce(g.signals_true, 0) AS signals_true,
 coalesce(g.signals, 0) - coalesce(g.signals_true, 0) AS signals_false, coalesce(e.episodes, 0) AS episodes, coalesce(l.caught, 0) AS caught,
 coalesce(l.caught, 0) / nullif(e.episodes, 0) AS recall_episodes, l.* EXCLUDE ({K}, caught)
FROM (SELECT {K}, count(*) AS rows, avg(y) AS base_rate, max(thr) AS threshold, avg(CAST(p >= thr AS INT)) AS alarm_rate,
  avg(y) FILTER (p >= thr) AS precision, avg(CAST(p >= thr AS INT)) FILTER (y = 1) AS recall_rows FROM scores JOIN thr USING ({K}) GROUP BY {K}) b
LEFT JOIN (SELECT {K}, sum(pos * precision) / nullif(max(positives), 0) AS pr_auc,
  sum((n - pos) * (hits - pos / 2)) / nullif(max(positives) * (max(rows) - max(positives)), 0) AS roc_auc FROM curve GROUP BY {K}) c USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS signals, count(*) FILTER (hit) AS signals_true FROM spans GROUP BY {K}) g USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS episodes FROM seen GROUP BY {K}) e USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS caught, quantile_cont(lead, 0.5) AS lead_median_h, quantile_cont(lead, 0.25) AS lead_p25_h,
  quantile_cont(lead, 0.75) AS lead_p75_h, avg(CAST(lead >= 12 AS INT)) AS lead_ge_12h,
  quantile_cont(least(standing, 168), 0.5) AS alarm_run_median_h, avg(CAST(standing >= 168 AS INT)) AS alarm_run_capped FROM caught GROUP BY {K}) l USING ({K})""",
)
EV_SQL = f"SELECT {K}, " + ", ".join(c if c in INTS else f"round({c}, 6) AS {c}" for c in EV) + " FROM ev"


@query("evaluate", "ev", EV_SQL)
def evaluate(s: Site):
    out = M.evaluate(s.scores, s.thresholds(SHARE), BY)
    return out.select(*BY, *[F.col(c) if c in INTS else F.round(c, 6).alias(c) for c in EV])


part(
    "meas",
    "al caught spans6",
    f"""SELECT {K}, alarm_hours, false_hours, coalesce(caught, 0) AS caught, coalesce(fresh, 0) AS fresh, lead_median_h, signals, signals - st AS false_signals FROM
 (SELECT {K}, count(*) AS alarm_hours, count(*) FILTER (y = 0) AS false_hours FROM al GROUP BY {K})
 LEFT JOIN (SELECT {K}, count(*) AS caught, count(*) FILTER (standing < 168) AS fresh, quantile_cont(lead, 0.5) AS lead_median_h FROM caught GROUP BY {K}) USING ({K})
 LEFT JOIN (SELECT {K}, count(*) AS signals, count(*) FILTER (hit) AS st FROM spans6 GROUP BY {K}) USING ({K})""",
)


@query("alarm_measure", "meas", "SELECT * FROM meas")
def alarm_measure(s: Site):
    return M.measure(s.alarms, s.seen, BY).drop("signals_true")


part("psi_ref", "scores", "SELECT type, p FROM scores WHERE run = 'busy' AND split = 'val'")
part("psi_cur", "scores", "SELECT type, p FROM scores WHERE run = 'busy' AND split = 'test'")
part(
    "psi_bins",
    "psi_ref",
    "SELECT type, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q, list_sort(list(DISTINCT p)) AS u FROM psi_ref GROUP BY type",
)
part("psi_inner", "psi_bins", "SELECT type, CASE WHEN len(q) >= 3 THEN q[2:len(q) - 1] ELSE u[2:] END AS e FROM psi_bins WHERE len(u) > 1")
part(
    "psi_out",
    "psi_ref psi_cur psi_inner",
    """SELECT type, sum((b - a) * ln(b / a)) AS psi FROM (SELECT type, bin,
  greatest(1e-4, coalesce(max(a), 0) / (SELECT count(*) FROM psi_ref r WHERE r.type = x.type)) AS a,
  greatest(1e-4, coalesce(max(b), 0) / (SELECT count(*) FROM psi_cur r WHERE r.type = x.type)) AS b FROM (
   SELECT type, len(list_filter(e, lambda v: v <= p)) AS bin, count(*) AS a, 0 AS b FROM psi_ref JOIN psi_inner USING (type) GROUP BY 1, 2
   UNION ALL SELECT type, len(list_filter(e, lambda v: v <= p)), 0, count(*) FROM psi_cur JOIN psi_inner USING (type) GROUP BY 1, 2) x GROUP BY 1, 2) GROUP BY type""",
)


@query("psi", "psi_out", "SELECT type, round(psi, 6) AS psi FROM psi_out")
def psi(s: Site):
    busy = s.scores.where("run = 'busy'")
    out = M.psi_table(busy.where("split = 'val'"), busy.where("split = 'test'"), ["type"], "p")
    return out.withColumn("psi", F.round("psi", 6))
