"""Alarm analytics queries over the model-free scores."""

from pyspark.sql import functions as F

from ..functions.timebase import HOUR, ORIGIN_US
from ..operators import grid as G
from ..plans import alarms as A
from ..plans import metrics as M
from .q_features import nudged, past, since_sql
from .q_metrics import K
from .registry import part, query
from .site import BY, SCORED, SHARE, Site

T = "type, split"


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def q6(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ---- which hours alarm
@query(
    "daily_topk",
    "scores",
    f"""SELECT {K}, object_id, h FROM scores JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K}, day ORDER BY m DESC, object_id) AS r
 FROM (SELECT {K}, h // 24 AS day, object_id, max(p) AS m FROM scores GROUP BY {K}, h // 24, object_id)) WHERE r <= 3) t USING ({K}, object_id) WHERE h // 24 = t.day""",
)
def daily_topk(s: Site):
    return A.daily_topk(s.scores, BY, 3).select(*BY, "object_id", "h")


@query(
    "daily_share_top",
    "scores",
    f"""SELECT {K}, object_id, h FROM (SELECT *, row_number() OVER (PARTITION BY {K}, h ORDER BY p DESC, (object_id * 7919) % 101, object_id) AS r,
 count(*) OVER (PARTITION BY {K}, h) AS n FROM scores) WHERE r <= ceil(n * 0.15)""",
)
def daily_share_top(s: Site):
    # the checked tie order is arithmetic; the default one is a hash
    tie = (F.col("object_id") * 7919) % 101
    return A.daily_share_top(s.scores, BY, "h", "object_id", 0.15, tie).select(*BY, "object_id", "h")


def mean_past(m):
    return f"avg(p) OVER (PARTITION BY {K}, object_id ORDER BY h RANGE BETWEEN {m - 1} PRECEDING AND CURRENT ROW)"


@query(
    "smooth_mean",
    "scores",
    f"SELECT {K}, object_id, h, {", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("mean_3h", "mean_12h", "mean_all"))} FROM (SELECT *, (mean_3h + mean_12h) / 2 AS mean_all FROM (SELECT *, {mean_past(3)} AS mean_3h, {mean_past(12)} AS mean_12h FROM scores))",
)
def smooth_mean(s: Site):
    m = A.smooth_mean(s.scores, BY, [3, 12])
    return m.select(*BY, "object_id", "h", *[nudged(F.col(c)).alias(c) for c in ("mean_3h", "mean_12h", "mean_all")])


@query(
    "k_consecutive",
    "scores thr",
    f"""SELECT {K}, object_id, h, y FROM (SELECT *, min(p) OVER w AS low, count(*) OVER w AS n FROM scores JOIN thr USING ({K})
 WINDOW w AS (PARTITION BY {K}, object_id ORDER BY h RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE low >= thr AND n = 3""",
)
def k_consecutive(s: Site):
    return A.k_consecutive(s.scores, s.thresholds(SHARE), BY, 3).select(*BY, "object_id", "h", "y")


part("snum", "scores", f"SELECT *, row_number() OVER (PARTITION BY {K}, object_id ORDER BY h) AS i FROM scores")
part(
    "ema",
    "snum",
    f"""SELECT {K}, object_id, i, p AS ema FROM snum WHERE i = 1 UNION ALL
 SELECT e.run, e.type, e.split, e.object_id, s.i, (1 - pow(0.5, 1.0 / 6)) * s.p + pow(0.5, 1.0 / 6) * e.ema FROM ema e JOIN snum s
 ON s.run = e.run AND s.type = e.type AND s.split = e.split AND s.object_id = e.object_id AND s.i = e.i + 1""",
)


@query(
    "smooth_variants",
    "snum ema",
    f"""SELECT {K}, object_id, h, {q6('mean', 'low', 'high', 'ema')} FROM (SELECT *, avg(p) OVER w AS mean, min(p) OVER w AS low, max(p) OVER w AS high
 FROM snum WINDOW w AS (PARTITION BY {K}, object_id ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) JOIN ema USING ({K}, object_id, i)""",
)
def smooth_variants(s: Site):
    return A.smooth_variants(s.scores, BY, 3, 6).select(*BY, "object_id", "h", *r6("mean", "low", "high", "ema"))


@query(
    "detrend_score",
    "scores",
    f"SELECT {K}, object_id, h, round(p - 0.5 * coalesce(avg(p) OVER (PARTITION BY {K}, object_id ORDER BY h RANGE BETWEEN 168 PRECEDING AND 1 PRECEDING), 0), 6) AS p FROM scores",
)
def detrend_score(s: Site):
    return A.detrend(s.scores, BY, 0.5).select(*BY, "object_id", "h", *r6("p"))


part(
    "lagged",
    "scores thr",
    f"""SELECT s.{', s.'.join(BY)}, s.object_id, s.h, s.y, j.lag, coalesce(o.p, m.low) AS p, t.thr FROM scores s CROSS JOIN (SELECT unnest([0, 1, 6]) AS lag) j
 JOIN thr t USING ({K}) JOIN (SELECT {K}, min(p) - 1 AS low FROM scores GROUP BY {K}) m USING ({K})
 LEFT JOIN scores o ON o.run = s.run AND o.type = s.type AND o.split = s.split AND o.object_id = s.object_id AND o.h = s.h - j.lag""",
)


@query(
    "lag_cost",
    "lagged seen",
    f"""SELECT {K}, lag, count(*) AS alarm_hours, count(*) FILTER (y = 0) AS false_hours,
 (SELECT count(DISTINCT (e.object_id, e.e)) FROM seen e JOIN lagged x USING ({K}, object_id) WHERE x.h BETWEEN e.e - 24 AND e.e - 1 AND x.p >= x.thr
   AND x.lag = l.lag AND e.run = l.run AND e.type = l.type AND e.split = l.split) AS caught
FROM lagged l WHERE p >= thr GROUP BY {K}, lag""",
)
def lag_cost(s: Site):
    late = A.lagged(s.scores, BY, [0, 1, 6])
    alarms = M.alarm_rows(late, s.thresholds(SHARE), BY)
    return M.measure(alarms, s.seen, BY, ["lag"]).select(*BY, "lag", "alarm_hours", "false_hours", "caught")


part(
    "frank",
    "scores",
    f"SELECT *, (row_number() OVER (PARTITION BY {K} ORDER BY p, object_id, h) - 1) / count(*) OVER (PARTITION BY {K}) AS rank FROM scores",
)


@query("fold_rank", "frank", f"SELECT {K}, object_id, h, round(rank, 6) AS rank FROM frank")
def fold_rank(s: Site):
    return A.fold_rank(s.scores, BY).select(*BY, "object_id", "h", *r6("rank"))


# ---- curves
SHARES = [0.05, 0.1, 0.2, 0.4]
part(
    "grid_thr",
    "scores",
    " UNION ALL ".join(f"SELECT {K}, {x} AS share, quantile_cont(p, {round(1 - x, 9)}) AS thr FROM scores GROUP BY {K}" for x in SHARES),
)
part("gal", "scores grid_thr", f"SELECT s.*, g.share FROM scores s JOIN grid_thr g USING ({K}) WHERE p >= thr")
KS = f"{K}, share"
part(
    "gruns",
    "gal",
    f"""SELECT *, sum(n) OVER (PARTITION BY {KS}, object_id ORDER BY h) AS run_id FROM (
 SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY {KS}, object_id ORDER BY h) = 1 THEN 0 ELSE 1 END AS n FROM gal)""",
)
part(
    "gcaught",
    "seen gruns",
    f"""SELECT {KS}, object_id, e, max(e - h) AS lead, max(e - h) + arg_min(h - a, h) AS standing FROM seen JOIN
 (SELECT *, min(h) OVER (PARTITION BY {KS}, object_id, run_id) AS a FROM gruns) r USING ({K}, object_id) WHERE h BETWEEN e - 24 AND e - 1 GROUP BY ALL""",
)
part(
    "fcurve",
    "gal gruns gcaught seen",
    f"""SELECT *, caught / nullif(episodes, 0) AS recall, alarm_hours / greatest(signals, 1) AS mean_length,
 false_signals >= coalesce(max(false_signals) OVER (PARTITION BY {K} ORDER BY share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS growing FROM (
 SELECT {KS}, alarm_hours, false_hours, signals, signals - hits AS false_signals, coalesce(caught, 0) AS caught, coalesce(fresh, 0) AS fresh, coalesce(episodes, 0) AS episodes FROM
 (SELECT {KS}, count(*) AS alarm_hours, count(*) FILTER (y = 0) AS false_hours FROM gal GROUP BY {KS})
 JOIN (SELECT {KS}, count(*) AS signals, sum(hit) AS hits FROM (SELECT {KS}, object_id, run_id, max(y) AS hit FROM gruns GROUP BY ALL) GROUP BY {KS}) USING ({KS})
 LEFT JOIN (SELECT {KS}, count(*) AS caught, count(*) FILTER (standing < 168) AS fresh FROM gcaught GROUP BY {KS}) USING ({KS})
 LEFT JOIN (SELECT {K}, count(*) AS episodes FROM seen GROUP BY {K}) USING ({K}))""",
)
CURVE_SQL = f"SELECT {K}, CAST(share AS DOUBLE) AS share, false_hours, CAST(false_signals AS BIGINT) AS false_signals, caught, fresh, {q6('recall', 'mean_length')}, growing FROM fcurve"


def curve(s: Site):
    from ..operators.settle import settle

    if not hasattr(s, "_curve"):
        s._curve = settle(A.false_hour_curve(s.scores, BY, SHARES))
    return s._curve


@query("false_hour_curve", "fcurve", CURVE_SQL)
def false_hour_curve(s: Site):
    c = A.false_hour_curve(s.scores, BY, SHARES)
    return c.select(*BY, "share", "false_hours", "false_signals", "caught", "fresh", *r6("recall", "mean_length"), "growing")


@query(
    "match_recall",
    "fcurve",
    f"SELECT {K}, level, min(false_hours) FILTER (caught >= level * episodes) AS false_hours FROM fcurve, (SELECT unnest([0.3, 0.6, 0.9])::DOUBLE AS level) GROUP BY {K}, level",
)
def match_recall(s: Site):
    return A.match_recall(curve(s), BY, [0.3, 0.6, 0.9], "false_hours")


@query(
    "at_equal_cost",
    "fcurve",
    f"""SELECT {K}, CAST(x AS DOUBLE) AS false_hours, round(CASE WHEN x <= (SELECT min(c.false_hours) FROM fcurve c WHERE c.run = q.run AND c.type = q.type AND c.split = q.split)
  THEN (SELECT arg_min(c.caught, c.share) FROM fcurve c WHERE c.run = q.run AND c.type = q.type AND c.split = q.split)
 ELSE (SELECT a.caught + coalesce((b.caught - a.caught) * (x - a.false_hours) / nullif(b.false_hours - a.false_hours, 0), 0) FROM fcurve a LEFT JOIN fcurve b
   ON b.run = a.run AND b.type = a.type AND b.split = a.split AND b.share = CASE a.share WHEN 0.05 THEN 0.1 WHEN 0.1 THEN 0.2 WHEN 0.2 THEN 0.4 END
   WHERE a.run = q.run AND a.type = q.type AND a.split = q.split AND a.false_hours <= x ORDER BY a.share DESC LIMIT 1) END, 6) AS caught
FROM (SELECT r.run, type, split, false_hours + 0.5 AS x FROM fcurve JOIN (SELECT unnest(['busy', 'recency']) AS run) r ON true
  WHERE fcurve.run = 'busy' AND share = 0.2) q""",
)
def at_equal_cost(s: Site):
    """Episodes both runs catch for the false hours the first one spends."""
    c = curve(s)
    target = c.where("run = 'busy' and share = 0.2").select("type", "split", (F.col("false_hours") + 0.5).alias("false_hours"))
    at = c.select("run", "type", "split").distinct().join(target, ["type", "split"])
    src = c.withColumn("false_hours", F.col("false_hours").cast("double")).withColumn("caught", F.col("caught").cast("double"))
    return A.interpolate(src, BY, "false_hours", ["caught"], at.select(*BY, "false_hours")).withColumn("caught", F.round("caught", 6))


@query(
    "equal_signals",
    "fcurve",
    f"""SELECT c.type, c.split, c.run, max(fresh) AS fresh, arg_max(caught, fresh * 100000 + caught) AS caught, CAST(arg_max(share, fresh * 1e9 + caught * 1000 - share) AS DOUBLE) AS share
FROM fcurve c JOIN (SELECT type, split, false_signals AS lim FROM fcurve WHERE run = 'busy' AND share = 0.2) r ON r.type = c.type AND r.split = c.split
WHERE false_signals <= lim GROUP BY ALL""",
)
def equal_signals(s: Site):
    c = curve(s)
    ref = c.where("run = 'busy' and share = 0.2").select("type", "split", "false_signals")
    ref = ref.join(c.select("run", "type", "split").distinct(), ["type", "split"])
    return A.equal_signals(c, ref, BY)


@query(
    "signal_cost_control",
    "fcurve spans",
    f"""SELECT {K}, wanted, b.share::DOUBLE AS share, CAST(b.signals AS BIGINT) AS signals, CAST(b.false_signals AS BIGINT) AS false_signals, b.caught FROM (
 SELECT {K}, max(wanted) AS wanted, min({{d: abs(signals - wanted), share: share, signals: signals, false_signals: false_signals, caught: caught}}) AS b
 FROM fcurve JOIN (SELECT {K}, count(*) AS wanted FROM spans WHERE hours > 2 GROUP BY {K}) USING ({K}) GROUP BY {K})""",
)
def signal_cost_control(s: Site):
    """The threshold that gives as many signals as dropping the short ones."""
    kept = M.signal_spans(s.alarms, BY, 0).where("hours > 2").groupBy(*BY).agg(F.count(F.lit(1)).alias("signals"))
    return A.signal_cost_control(curve(s), kept, BY)


@query(
    "choose_variant",
    "fcurve vcost",
    """SELECT v.type, v.run, t.cost AS test_cost, b.best AS best_cost, t.cost - b.best AS blind_price FROM
 (SELECT type, arg_min(run, {c: cost, r: run}) AS run FROM vcost WHERE split = 'val' AND cost IS NOT NULL GROUP BY type) v
JOIN vcost t ON t.type = v.type AND t.run = v.run AND t.split = 'test'
JOIN (SELECT type, min(cost) AS best FROM vcost WHERE split = 'test' GROUP BY type) b ON b.type = v.type""",
)
def choose_variant(s: Site):
    cost = A.match_recall(curve(s), BY, [0.5], "false_hours").withColumnRenamed("false_hours", "cost")
    val = cost.where("split = 'val' and cost is not null").unionByName(cost.where("split = 'test'"))
    return A.choose_variant(val, ["type"], "run", "cost")


part("vcost", "fcurve", "SELECT type, split, run, min(false_hours) FILTER (caught >= 0.5 * episodes) AS cost FROM fcurve GROUP BY ALL")
part("hpts", "fcurve", f"SELECT {K}, false_hours AS x, max(caught) AS y FROM fcurve GROUP BY ALL UNION SELECT DISTINCT {K}, 0, 0 FROM fcurve")
part("hbest", "hpts", f"SELECT {K}, x, max(y) AS y FROM hpts GROUP BY ALL")
part("hrise", "hbest", f"SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY {K} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hbest) WHERE before IS NULL OR y > before")
part(
    "hull",
    "hrise",
    f"""SELECT {K}, x AS false_hours, y AS caught FROM hrise b WHERE NOT EXISTS (SELECT 1 FROM hrise a JOIN hrise c USING ({K})
 WHERE a.run = b.run AND a.type = b.type AND a.split = b.split AND a.x < b.x AND c.x > b.x AND (b.y - a.y) * (c.x - a.x) <= (c.y - a.y) * (b.x - a.x))""",
)


@query("concave_envelope", "hull", f"SELECT {K}, false_hours, caught FROM hull")
def concave_envelope(s: Site):
    return A.concave_envelope(curve(s), BY)


part("steps", "hull", f"SELECT *, false_hours - lag(false_hours) OVER w AS dx, caught - lag(caught) OVER w AS dy FROM hull WINDOW w AS (PARTITION BY {K} ORDER BY false_hours)")


@query("budget_split")
def budget_split(s: Site):
    """Greedy over the hull steps, so checked by brute force in the tests."""
    return A.budget_split(A.concave_envelope(curve(s), BY), ["run", "split"], "type", 400.0, 0.2)


@query("chatter_table", "cgap", f"SELECT {K}, gap, signals, signals_true, signals - signals_true AS false_signals, caught, fresh FROM cgap")
def chatter_table(s: Site):
    return A.chatter_table(s.alarms, s.seen, BY, [0, 3, 12])


part("calx", "al", "SELECT al.*, g.gap FROM al CROSS JOIN (SELECT unnest([0, 3, 12]) AS gap) g")
part(
    "cruns",
    "calx",
    f"""SELECT *, min(h) OVER (PARTITION BY {K}, gap, object_id, run_id) AS a FROM (SELECT *, sum(n) OVER (PARTITION BY {K}, gap, object_id ORDER BY h) AS run_id FROM (
 SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY {K}, gap, object_id ORDER BY h) <= gap + 1 THEN 0 ELSE 1 END AS n FROM calx))""",
)
part(
    "cgap",
    "cruns seen",
    f"""SELECT *, coalesce(c, 0) AS caught, coalesce(f, 0) AS fresh FROM
 (SELECT {K}, gap, count(*) AS signals, CAST(sum(hit) AS BIGINT) AS signals_true FROM (SELECT {K}, gap, object_id, run_id, max(y) AS hit FROM cruns GROUP BY ALL) GROUP BY ALL)
 LEFT JOIN (SELECT {K}, gap, count(*) AS c, count(*) FILTER (a >= e - 24) AS f FROM (
   SELECT {K}, gap, object_id, e, min(a) AS a FROM seen JOIN cruns USING ({K}, object_id) WHERE h BETWEEN e - 24 AND e - 1 GROUP BY ALL) GROUP BY ALL) USING ({K}, gap)""",
)


@query(
    "watchlist_rule",
    "scores",
    f"""SELECT run, type, object_id, h FROM (SELECT *, quantile_cont(w, 0.8) OVER (PARTITION BY run, type) AS thr FROM (
 SELECT s.run, s.type, s.object_id, s.h, coalesce(r.rate, 0.01) + (s.h - min(s.h) OVER (PARTITION BY s.run, s.type)) * 1e-12 AS w
 FROM (SELECT * FROM scores WHERE split = 'test') s LEFT JOIN (SELECT run, type, object_id, (sum(y) + 0.5) / (count(*) + 50) AS rate FROM scores WHERE split = 'val' GROUP BY ALL) r
 USING (run, type, object_id))) WHERE w >= thr""",
)
def watchlist_rule(s: Site):
    return A.watchlist(s.scores, ["run", "type"], 0.2).select("run", "type", "object_id", "h")


# ---- moving thresholds
part(
    "roll",
    "scores days",
    f"""SELECT run, type, d.day, quantile_cont(s.p, 0.8) AS thr FROM scores s JOIN days d ON s.h // 24 BETWEEN d.day - 7 AND d.day - 1
GROUP BY ALL HAVING count(*) >= 100""",
)
part("days", "scores", "SELECT DISTINCT day FROM (SELECT unnest(range(min(h // 24), max(h // 24) + 1)) AS day FROM scores)")


@query("rolling_threshold", "roll", "SELECT run, type, day, round(thr, 6) AS thr FROM roll")
def rolling_threshold(s: Site):
    return A.rolling_threshold(s.scores, ["run", "type"], 7, 0.2).select("run", "type", "day", *r6("thr"))


part(
    "transfer",
    "scores roll",
    """SELECT run, type, avg(fixed) AS fixed, stddev_pop(fixed) AS fixed_spread, avg(rolling) AS rolling, stddev_pop(rolling) AS rolling_spread FROM (
 SELECT s.run, s.type, s.h // 24 AS day, count(*) FILTER (s.p >= f.thr) AS fixed, count(*) FILTER (s.p >= r.thr) AS rolling FROM scores s
 JOIN (SELECT run, type, quantile_cont(p, 0.8) AS thr FROM scores WHERE split = 'val' GROUP BY ALL) f USING (run, type)
 LEFT JOIN roll r ON r.run = s.run AND r.type = s.type AND r.day = s.h // 24 WHERE s.split = 'test' GROUP BY ALL) GROUP BY ALL""",
)


@query(
    "threshold_transfer",
    "transfer scores",
    f"""SELECT t.run, t.type, {q6('fixed', 'fixed_spread', 'rolling', 'rolling_spread')}, round(promised, 6) AS promised FROM transfer t JOIN
 (SELECT run, type, sum(n) / count(*) * 0.2 AS promised FROM (SELECT run, type, h // 24 AS d, count(*) AS n FROM scores WHERE split = 'val' GROUP BY ALL) GROUP BY ALL) USING (run, type)""",
)
def threshold_transfer(s: Site):
    t = A.threshold_transfer(s.scores, ["run", "type"], 0.2, 7)
    return t.select("run", "type", *r6("fixed", "fixed_spread", "rolling", "rolling_spread", "promised"))


part(
    "cal_thr",
    "scores days",
    """SELECT run, type, d.day, w.days, quantile_cont(s.p, 0.9) AS t1, quantile_cont(s.p, 0.7) AS t3 FROM scores s
 CROSS JOIN (SELECT unnest([7, 14]) AS days) w JOIN days d ON s.h // 24 BETWEEN d.day - w.days AND d.day - 1 GROUP BY run, type, d.day, w.days HAVING count(*) >= 100""",
)


@query(
    "calibration_windows",
    "scores cal_thr",
    """SELECT run, type, days, share, count(*) AS alarm_hours, count(*) FILTER (y = 0) AS false_hours FROM scores JOIN (
 SELECT run, type, day, days, 0.1::DOUBLE AS share, t1 AS thr FROM cal_thr UNION ALL SELECT run, type, day, days, 0.3::DOUBLE, t3 FROM cal_thr) r
 USING (run, type) WHERE r.day = h // 24 AND split = 'test' AND p >= r.thr GROUP BY run, type, days, share""",
)
def calibration_windows(s: Site):
    c = A.calibration_windows(s.scores, ["run", "type"], [7, 14], [0.1, 0.3])
    return c.select("run", "type", "days", "share", "alarm_hours", "false_hours")


# ---- the dispatcher's day
@query(
    "daily_snapshot",
    "scores thr",
    f"""SELECT {K}, days, alarms, hits, positives, round(alarms / days, 6) AS per_day, round(hits / greatest(alarms, 1), 6) AS precision, round(hits / greatest(positives, 1), 6) AS recall FROM (
 SELECT {K}, count(DISTINCT h) AS days, count(*) FILTER (p >= thr) AS alarms, count(*) FILTER (p >= thr AND y = 1) AS hits, CAST(sum(y) AS BIGINT) AS positives
 FROM scores JOIN thr USING ({K}) WHERE h % 24 = 6 GROUP BY {K})""",
)
def daily_snapshot(s: Site):
    d = A.daily_snapshot(s.scores, s.alarms, BY)
    return d.select(*BY, "days", "alarms", "hits", "positives", *r6("per_day", "precision", "recall"))


RS = "run, split"
part("cards", "scores al", f"SELECT {RS}, h, count(al.object_id) AS n FROM (SELECT DISTINCT {RS}, h FROM scores) LEFT JOIN al USING ({RS}, h) GROUP BY ALL")
part("cells", "al", f"SELECT {RS}, h, object_id, count(*) AS n FROM al GROUP BY ALL")
part(
    "byobj",
    "al",
    f"""SELECT *, row_number() OVER w AS i, coalesce(sum(n) OVER (PARTITION BY {RS} ORDER BY n DESC, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 sum(n) OVER (PARTITION BY {RS}) AS total FROM (SELECT {RS}, object_id, count(*) AS n, sum(y) AS hits FROM al GROUP BY ALL) WINDOW w AS (PARTITION BY {RS} ORDER BY n DESC, object_id)""",
)
part("dspan", "scores", f"SELECT {RS}, count(DISTINCT h) / 24 AS days FROM scores GROUP BY ALL")


@query(
    "dispatch_load",
    "cards cells byobj spans",
    f"""SELECT {RS}, {q6('mean', 'empty', 'p50', 'p90', 'p99')}, most, round(over_limit, 6) AS over, CAST(cards AS BIGINT) AS cards, object_hours, round(overlap, 6) AS overlap,
 CAST(cards - object_hours AS BIGINT) AS collapsible, objects, {q6('top_share')}, half_objects, {q6('half_hits')}, runs, {q6('run_p50', 'run_p90')}, longest, {q6('long_share')} FROM
 (SELECT {RS}, avg(n) AS mean, avg(CAST(n = 0 AS INT)) AS empty, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, max(n) AS most, avg(CAST(n > 10 AS INT)) AS over_limit FROM cards GROUP BY ALL)
 JOIN (SELECT {RS}, sum(n) AS cards, count(*) AS object_hours, avg(CAST(n > 1 AS INT)) AS overlap FROM cells GROUP BY ALL) USING ({RS})
 JOIN (SELECT {RS}, count(*) AS objects, sum(n) FILTER (i <= 5) / sum(n) AS top_share, count(*) FILTER (before < total / 2) AS half_objects,
   sum(hits) FILTER (before < total / 2) / greatest(sum(hits), 1) AS half_hits FROM byobj GROUP BY ALL) USING ({RS})
 JOIN (SELECT {RS}, count(*) AS runs, quantile_cont(hours, 0.5) AS run_p50, quantile_cont(hours, 0.9) AS run_p90, max(hours) AS longest,
   coalesce(sum(hours) FILTER (hours > 24), 0) / sum(hours) AS long_share FROM spans GROUP BY ALL) USING ({RS})""",
)
def dispatch_load(s: Site):
    by = ["run", "split"]
    hours = A.load_per_hour(s.scores, s.alarms, by)
    # runs live per type; fold their table over types
    from ..operators.runs import run_table

    r = run_table(s.alarms, [*BY, "object_id"], "h")
    life = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.percentile("hours", 0.5).alias("run_p50"), F.percentile("hours", 0.9).alias("run_p90"),
        F.max("hours").alias("longest"), (F.sum(F.when(F.col("hours") > 24, F.col("hours")).otherwise(0)) / F.sum("hours")).alias("long_share"),
    )
    out = hours.join(A.load_overlap(s.alarms, by), by).join(A.load_objects(s.alarms, by), by).join(life, by)
    floats = "mean empty p50 p90 p99 over overlap top_share half_hits run_p50 run_p90 long_share".split()
    return out.withColumns({c: F.round(c, 6) for c in floats})


@query(
    "dispatch_collectors",
    "al obj dspan",
    f"""SELECT {RS}, collector_id, count(al.h) AS n, round(count(al.h) / days, 6) AS per_day FROM dspan CROSS JOIN (SELECT DISTINCT collector_id FROM obj) c
 LEFT JOIN al USING ({RS}, collector_id) GROUP BY {RS}, collector_id, days""",
)
def dispatch_collectors(s: Site):
    days = s.scores.groupBy("run", "split").agg((F.count_distinct("h") / 24).alias("days"))
    collectors = s.objects.select("collector_id").distinct()
    n = s.alarms.groupBy("run", "split", "collector_id").agg(F.count(F.lit(1)).alias("n"))
    names = collectors.agg(F.collect_set("collector_id").alias("_c"))
    each = days.withColumn("_k", F.lit(1)).join(names.withColumn("_k", F.lit(1)), "_k").withColumn("collector_id", F.explode("_c"))
    out = each.join(n, ["run", "split", "collector_id"], "left").fillna(0, subset=["n"])
    return out.select("run", "split", "collector_id", "n", F.round(F.col("n") / F.col("days"), 6).alias("per_day"))


@query(
    "dispatch_by_hour",
    "al dspan",
    f"SELECT {RS}, (h + 1) % 24 AS hour, round(count(*) / max(days), 6) AS cards FROM al JOIN dspan USING ({RS}) GROUP BY {RS}, (h + 1) % 24",
)
def dispatch_by_hour(s: Site):
    days = s.scores.groupBy("run", "split").agg((F.count_distinct("h") / 24).alias("days"))
    n = s.alarms.groupBy("run", "split", ((F.col("h") + 1) % 24).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(days, ["run", "split"]).select("run", "split", "hour", F.round(F.col("n") / F.col("days"), 6).alias("cards"))


# ---- run caps, muting, own thresholds
part("pos6", "runs6", f"SELECT *, h - min(h) OVER (PARTITION BY {K}, object_id, run_id) AS position FROM runs6")


@query(
    "run_cap",
    "pos6 seen",
    f"""SELECT {K}, count(*) FILTER (position < 24) AS live_hours, count(*) FILTER (position < 24 AND y = 0) AS false_hours, count(*) FILTER (position >= 24) AS status_hours,
 (SELECT count(*) FROM seen e WHERE e.run = p.run AND e.type = p.type AND e.split = p.split
  AND EXISTS (SELECT 1 FROM pos6 x WHERE x.run = e.run AND x.type = e.type AND x.split = e.split AND x.object_id = e.object_id AND x.h BETWEEN e.e - 24 AND e.e - 1 AND x.position >= 24)
  AND NOT EXISTS (SELECT 1 FROM pos6 x WHERE x.run = e.run AND x.type = e.type AND x.split = e.split AND x.object_id = e.object_id AND x.h BETWEEN e.e - 24 AND e.e - 1 AND x.position < 24)) AS in_status
FROM pos6 p GROUP BY {K}""",
)
def run_cap(s: Site):
    r = A.run_cap(s.alarms, s.seen, BY, 24)
    return r.select(*BY, F.col("alarm_hours").alias("live_hours"), "false_hours", "status_hours", "in_status")


part("ostat", "spans", f"SELECT {K}, object_id, count(*) AS n, avg(CAST(hit AS INT)) AS good FROM spans GROUP BY ALL")


@query(
    "mute_noisy",
    "al ostat",
    """SELECT run, type, count(*) AS hours, count(*) FILTER (y = 0) AS false_hours FROM al WHERE split = 'test'
 AND (run, type, object_id) NOT IN (SELECT (run, type, object_id) FROM ostat WHERE split = 'val' AND n >= 2 AND good <= 0.5) GROUP BY ALL""",
)
def mute_noisy(s: Site):
    fit, test = s.alarms.where("split = 'val'"), s.alarms.where("split = 'test'")
    return A.mute_noisy(fit, test, ["run", "type"], 2, 0.5).groupBy("run", "type").agg(
        F.count(F.lit(1)).alias("hours"), F.count_if(F.col("y") == 0).alias("false_hours")
    )


part("bad_obj", "ostat", "SELECT * FROM ostat WHERE split = 'val' AND n >= 2 AND good < 0.7")
part(
    "own_rows",
    "runs bad_obj",
    f"SELECT r.*, max(y) OVER (PARTITION BY {K}, object_id, run_id) AS v FROM runs r WHERE split = 'val' AND (run, type, object_id) IN (SELECT (run, type, object_id) FROM bad_obj)",
)
part("own_grid", "own_rows", "SELECT run, type, object_id, quantile_cont(p, [" + ", ".join(str(0.98 * i / 9) for i in range(10)) + "]) AS g FROM own_rows GROUP BY ALL")
part(
    "own",
    "own_rows own_grid bad_obj",
    """SELECT b.run, b.type, b.object_id, min(thr) FILTER (reach >= 0.7) AS own FROM bad_obj b LEFT JOIN (SELECT o.run, o.type, o.object_id, t.thr, avg(v) AS reach FROM own_rows o JOIN
 (SELECT run, type, object_id, unnest(g) AS thr FROM own_grid) t ON t.run = o.run AND t.type = o.type AND t.object_id = o.object_id AND o.p >= t.thr GROUP BY ALL) USING (run, type, object_id) GROUP BY ALL""",
)


@query("own_threshold", "own", "SELECT run, type, object_id, round(own, 6) AS own FROM own")
def own_threshold(s: Site):
    return A.own_threshold(s.alarms.where("split = 'val'"), ["run", "type"], 2, 0.7, 10).withColumn("own", F.round("own", 6))


part(
    "work",
    "scores guard visit",
    f"""SELECT DISTINCT s.object_id, s.h, coalesce(NOT (SELECT arg_max(g.armed, g.us) FROM guard g WHERE g.object_id = s.object_id AND g.us <= s.t), false) AS disarmed,
 coalesce(s.t - (SELECT max(v.t0) FROM visit v WHERE v.collector_id = s.collector_id AND v.t0 <= s.t) < 12 * {HOUR}, false) AS visiting
FROM (SELECT DISTINCT object_id, collector_id, h, {ORIGIN_US} + h * {HOUR} AS t FROM scores) s""",
)


@query("at_work_flags", "work", "SELECT * FROM work")
def at_work_flags(s: Site):
    rows = s.mart.select("object_id", "collector_id", "h")
    return A.at_work_flags(rows, s.guard, s.visits, 12).select("object_id", "h", "disarmed", "visiting")


@query(
    "suppress_at_work",
    "runs work",
    f"""SELECT {K}, count(*) FILTER (left_hours > 0) AS shown, count(*) FILTER (left_hours > 0 AND NOT hit) AS shown_false, CAST(sum(hours - left_hours) AS BIGINT) AS muted_hours, CAST(sum(hours) AS BIGINT) AS alarm_hours
FROM (SELECT {K}, object_id, run_id, count(*) AS hours, count(*) FILTER (NOT disarmed) AS left_hours, max(y) = 1 AS hit FROM runs JOIN work USING (object_id, h) GROUP BY ALL) GROUP BY {K}""",
)
def suppress_at_work(s: Site):
    flags = A.at_work_flags(s.mart.select("object_id", "collector_id", "h"), s.guard, s.visits, 12)
    muted = s.alarms.join(flags.where("disarmed").select("object_id", "h"), ["object_id", "h"]).select(*BY, "object_id", "h")
    return A.shown_signals(s.alarms, muted, BY)


@query(
    "false_hours_shown",
    "runs6 work",
    f"""SELECT {K}, count(*) FILTER (left_hours > 0) AS shown, CAST(coalesce(sum(fh) FILTER (left_hours > 0 AND NOT hit), 0) AS BIGINT) AS false_hours
FROM (SELECT {K}, object_id, run_id, count(*) AS fh, count(*) FILTER (NOT visiting) AS left_hours, max(y) = 1 AS hit FROM runs6 JOIN work USING (object_id, h) GROUP BY ALL) GROUP BY {K}""",
)
def false_hours_shown(s: Site):
    """Hours of the shown signals that proved false, under visits."""
    from ..operators.runs import run_table

    flags = A.at_work_flags(s.mart.select("object_id", "collector_id", "h"), s.guard, s.visits, 12)
    rows = s.alarms.join(flags.select("object_id", "h", "visiting"), ["object_id", "h"])
    runs = run_table(rows, [*BY, "object_id"], "h", 6, {"hit": F.max("y") == 1, "seen": F.bool_or(~F.col("visiting"))})
    wrong = F.col("seen") & ~F.col("hit")
    return runs.groupBy(*BY).agg(
        F.count_if(F.col("seen")).alias("shown"), F.sum(F.when(wrong, F.col("hours")).otherwise(0)).alias("false_hours")
    )


@query(
    "staff_split",
    "scores inc visit",
    f"""SELECT {K}, CAST(sum(st) AS BIGINT) AS staff_rows, CAST(sum(ow) AS BIGINT) AS own_rows, round(avg(p) FILTER (st = 1), 6) AS staff_score, round(avg(p) FILTER (ow = 1), 6) AS own_score FROM (
 SELECT s.*, coalesce(max(CAST(staff AS INT)), 0) AS st, coalesce(max(CAST(NOT staff AS INT)), 0) AS ow FROM scores s LEFT JOIN
 (SELECT type, object_id, (t0 - {ORIGIN_US}) // {HOUR} AS e, coalesce(t0 - (SELECT max(v.t0) FROM visit v WHERE v.collector_id = i.collector_id AND v.t0 <= i.t0) < 12 * {HOUR}, false) AS staff
  FROM inc i WHERE noise IS NULL) x ON x.type = s.type AND x.object_id = s.object_id AND s.h BETWEEN x.e - 24 AND x.e - 1 GROUP BY ALL) GROUP BY {K}""",
)
def staff_split(s: Site):
    j = A.staff_split(s.scores, s.episodes, s.visits, BY, 12)
    return j.groupBy(*BY).agg(
        F.sum("y_staff").alias("staff_rows"), F.sum("y_own").alias("own_rows"),
        F.round(F.avg(F.when(F.col("y_staff") == 1, F.col("p"))), 6).alias("staff_score"),
        F.round(F.avg(F.when(F.col("y_own") == 1, F.col("p"))), 6).alias("own_score"),
    )


@query(
    "works_mute_eval",
    "al works",
    f"""SELECT {K}, count(*) AS alarm_hours, count(*) FILTER (y = 0) AS false_hours, count(*) FILTER (w) AS muted_hours, count(*) FILTER (y = 0 AND NOT w) AS false_left FROM (
 SELECT al.*, EXISTS (SELECT 1 FROM works k WHERE k.object_id = al.object_id AND list_contains(k.types, al.type)
  AND {ORIGIN_US} + al.h * {HOUR} >= epoch_us(k.s) AND {ORIGIN_US} + al.h * {HOUR} < epoch_us(k.e)) AS w FROM al) GROUP BY {K}""",
)
def works_mute_eval(s: Site):
    from ..functions.timebase import DAY, us_of
    from .q_labels import works

    w = works(s).select("object_id", "types", us_of("starts_at").alias("a"), us_of("ends_at").alias("b"))
    inside = A.in_windows(s.alarms.select(*BY, "object_id", "collector_id", "h"), w, DAY).withColumn("w", F.lit(1))
    j = s.alarms.join(inside.drop("collector_id"), [*BY, "object_id", "h"], "left")
    left = F.col("w").isNull()
    return j.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("alarm_hours"), F.count_if(F.col("y") == 0).alias("false_hours"),
        F.count_if(~left).alias("muted_hours"), F.count_if((F.col("y") == 0) & left).alias("false_left"),
    )


# ---- where catches and misses come from
part("quiet_h", "g", f"SELECT object_id, h, {since_sql('n_events > 0', 1000000)} AS since_row FROM g")
BUCKET = "CASE WHEN since_row < 1 THEN '0' WHEN since_row < 7 THEN '1-6' WHEN since_row < 25 THEN '7-24' WHEN since_row < 73 THEN '25-72' ELSE '73+' END"


@query(
    "silence_table",
    "scores thr quiet_h",
    f"""SELECT *, round(alarms / greatest(sum(alarms) OVER (PARTITION BY {K}), 1), 6) AS alarm_share, round(hits / greatest(alarms, 1), 6) AS precision FROM (
 SELECT {K}, {BUCKET} AS bucket, count(*) AS hours, count(*) FILTER (p >= thr) AS alarms, CAST(sum(y) AS BIGINT) AS ahead, count(*) FILTER (p >= thr AND y = 1) AS hits
 FROM scores JOIN thr USING ({K}) JOIN quiet_h USING (object_id, h) GROUP BY ALL)""",
)
def silence_table(s: Site):
    since = s.grid.select("object_id", "h", G.since_last(F.col("n_events") > 0, ["object_id"], 1000000).alias("since_row"))
    t = A.silence_table(s.scores, s.alarms, since, BY)
    return t.withColumns({c: F.round(c, 6) for c in ("alarm_share", "precision")})


@query(
    "silence_after_hole",
    "scores thr lim",
    f"""SELECT {K}, w AS first_hours, round(avg(CAST(p >= thr AS INT)), 6) AS alarm_share, round(count(*) FILTER (p >= thr AND y = 1) / greatest(count(*) FILTER (p >= thr), 1), 6) AS precision
FROM scores JOIN thr USING ({K}) JOIN (SELECT {K}, min(h) AS h0 FROM scores, lim WHERE h >= lo + 406 GROUP BY ALL) USING ({K}), (SELECT unnest([24, 72]) AS w)
WHERE h >= h0 AND h < h0 + w GROUP BY ALL""",
)
def silence_after_hole(s: Site):
    t = A.after_hole(s.scores, s.alarms, BY, s.holes[0][1], [24, 72])
    return t.withColumns({c: F.round(c, 6) for c in ("alarm_share", "precision")})


part(
    "depth",
    "seen caught frank",
    f"""SELECT {K}, object_id, e, (1 - max(rank)) / {SHARE} AS need FROM seen JOIN frank USING ({K}, object_id) WHERE h BETWEEN e - 24 AND e - 1
 AND ({K}, object_id, e) NOT IN (SELECT ({K}, object_id, e) FROM caught) GROUP BY ALL""",
)


@query(
    "miss_depth",
    "depth",
    f"""SELECT {K}, count(*) AS missed, round(avg(CAST(need <= 1.5 AS INT)), 6) AS le_1_5, round(avg(CAST(need <= 2 AS INT)), 6) AS le_2, round(avg(CAST(need <= 4 AS INT)), 6) AS le_4,
 round(avg(CAST(need > 10 AS INT)), 6) AS gt_10, round(quantile_cont(need, 0.5), 6) AS median FROM depth GROUP BY {K}""",
)
def miss_depth(s: Site):
    got = M.catches(s.alarms, s.seen, BY)
    d = A.miss_depth(s.scores, s.seen, got, A.fold_rank(s.scores, BY), BY, SHARE)
    return d.withColumns({c: F.round(c, 6) for c in ("le_1_5", "le_2", "le_4", "gt_10", "median")})


@query(
    "alarm_shape",
    "spans runs seen",
    f"""SELECT *  FROM (SELECT {K}, count(*) AS runs, round(avg(hours), 6) AS mean, round(quantile_cont(hours, 0.5), 6) AS median, round(coalesce(sum(hours) FILTER (hours > 48), 0) / sum(hours), 6) AS long_share FROM spans GROUP BY {K})
 LEFT JOIN (SELECT {K}, round(quantile_cont(r.h - r.a, 0.5), 6) AS stood_at_onset FROM seen e JOIN (SELECT *, min(h) OVER (PARTITION BY {K}, object_id, run_id) AS a FROM runs) r USING ({K}, object_id) WHERE r.h = e.e - 1 GROUP BY {K}) USING ({K})""",
)
def alarm_shape(s: Site):
    t = A.alarm_shape(s.alarms, s.seen, BY, 48)
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "median", "long_share", "stood_at_onset")})


RT = "run, type"
part("worst", "seen", f"SELECT {RT}, object_id FROM (SELECT *, row_number() OVER (PARTITION BY {RT} ORDER BY n DESC, object_id) AS r FROM (SELECT {RT}, object_id, count(*) AS n FROM seen WHERE split = 'val' GROUP BY ALL)) WHERE r <= 4")
part("epflag", "seen caught", f"SELECT s.*, c.lead IS NOT NULL AS got, coalesce(c.standing < 168, false) AS fresh FROM seen s LEFT JOIN caught c USING ({K}, object_id, e)")


@query(
    "chronic_objects",
    "al worst epflag",
    f"""SELECT * FROM (SELECT {RT}, round(avg(CAST(w.object_id IS NOT NULL AS INT)), 6) AS alarm_share, round(avg(CAST(w.object_id IS NOT NULL AS INT)) FILTER (y = 0), 6) AS false_share
  FROM al LEFT JOIN worst w USING ({RT}, object_id) WHERE split = 'test' GROUP BY ALL)
 LEFT JOIN (SELECT {RT}, count(*) FILTER (w.object_id IS NOT NULL AND got) AS caught_chronic, count(*) FILTER (w.object_id IS NULL AND got) AS caught_other,
  count(*) FILTER (w.object_id IS NOT NULL AND fresh) AS fresh_chronic, count(*) FILTER (w.object_id IS NULL AND fresh) AS fresh_other
  FROM epflag LEFT JOIN worst w USING ({RT}, object_id) WHERE split = 'test' GROUP BY ALL) USING ({RT})""",
)
def chronic_objects(s: Site):
    by = ["run", "type"]
    test = lambda d: d.where("split = 'test'")
    eps = test(s.seen)
    got = M.catches(test(s.alarms), eps, by)
    c = A.chronic_objects(test(s.alarms), eps, got, s.seen.where("split = 'val'"), by, 4)
    return c.withColumns({x: F.round(x, 6) for x in ("alarm_share", "false_share")})


part(
    "hist_t",
    "g",
    " UNION ALL ".join(f"SELECT '{t}' AS type, object_id, h, {since_sql(f'onset_{t} > 0')} AS since, CAST({past(f'sum(onset_{t})', 720)} AS BIGINT) AS past FROM g" for t in SCORED),
)


def history(s: Site):
    rows = []
    w = G.track(["object_id"])
    for t in SCORED:
        wide = G.trailing_sums(s.grid.select("object_id", "h", f"onset_{t}"), ["object_id"], {f"onset_{t}": [720]})
        rows.append(
            wide.select(
                F.lit(t).alias("type"), "object_id", "h",
                G.since_last(F.col(f"onset_{t}") > 0, ["object_id"], 2160).alias("since"),
                F.round(F.col(f"onset_{t}_720h")).cast("bigint").alias("past"),
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(
    "series_cost",
    "al epflag hist_t scores",
    f"""SELECT * FROM (SELECT {K}, round(avg(CAST(since < 48 AS INT)), 6) AS in_series FROM al JOIN hist_t USING (type, object_id, h) GROUP BY {K})
 LEFT JOIN (SELECT {K}, count(*) FILTER (f) AS first, count(*) FILTER (f AND got) AS first_caught, count(*) FILTER (NOT f) AS next, count(*) FILTER (NOT f AND got) AS next_caught FROM (
  SELECT e.*, coalesce(x.since >= 48, true) AS f FROM epflag e LEFT JOIN hist_t x ON x.type = e.type AND x.object_id = e.object_id AND x.h = e.e - 1) GROUP BY {K}) USING ({K})
 LEFT JOIN (SELECT {K}, round(sum(n * pow(m - g, 2)) / sum(n) / nullif(max(v), 0), 6) AS explained FROM (SELECT {K}, object_id, avg(p) AS m, count(*) AS n FROM scores GROUP BY ALL)
  JOIN (SELECT {K}, avg(p) AS g, var_pop(p) AS v FROM scores GROUP BY {K}) USING ({K}) GROUP BY {K}) USING ({K})""",
)
def series_cost(s: Site):
    got = M.catches(s.alarms, s.seen, BY)
    t = A.series_cost(s.scores, s.alarms, s.seen, got, history(s).drop("past"), BY, 48)
    return t.withColumns({c: F.round(c, 6) for c in ("in_series", "explained")})


@query(
    "catch_by_history",
    "epflag hist_t",
    f"""SELECT {K}, CASE WHEN n < 1 THEN '0' WHEN n < 3 THEN '1-2' WHEN n < 6 THEN '3-5' WHEN n < 12 THEN '6-11' ELSE '12+' END AS past,
 CASE WHEN q < 24 THEN '<24' WHEN q < 72 THEN '24-72' WHEN q < 168 THEN '72-168' ELSE '168+' END AS pause, count(*) AS episodes, count(*) FILTER (got) AS caught, count(*) FILTER (fresh) AS fresh
FROM (SELECT e.*, coalesce(x.past, 0) AS n, coalesce(x.since, 1073741824) AS q FROM epflag e LEFT JOIN hist_t x ON x.type = e.type AND x.object_id = e.object_id AND x.h = e.e - 1) GROUP BY ALL""",
)
def catch_by_history(s: Site):
    return A.catch_by_history(s.seen, M.catches(s.alarms, s.seen, BY), history(s), BY)


BANDS = [(0, 12), (12, 24), (24, 48), (48, 96), (96, 168)]


@query(
    "series_profile",
    "scores hist_t",
    "SELECT type, " + ", ".join(f"round(avg(y) FILTER (since >= {a} AND since < {b}), 6) AS h{a}_{b}" for a, b in BANDS)
    + """, round(avg(y) FILTER (since >= 168), 6) AS outside, round(avg(y) FILTER (since < 168) / nullif(avg(y) FILTER (since >= 168), 0), 6) AS ratio,
 round(coalesce(sum(y) FILTER (since < 168), 0) / nullif(sum(y), 0), 6) AS positives_in_series FROM scores JOIN hist_t USING (type, object_id, h) WHERE run = 'busy' GROUP BY type""",
)
def series_profile(s: Site):
    rows = s.scores.where("run = 'busy'").join(history(s), ["type", "object_id", "h"]).withColumn("y", M.positive())
    t = A.series_profile(rows, ["type"])
    return t.withColumns({c: F.round(c, 6) for c in t.columns if c != "type"})


# ---- ensembles
part(
    "blend",
    "frank",
    """SELECT a.type, a.split, a.object_id, a.h, a.y, w.weight, (1 - weight) * a.rank + weight * b.rank AS p FROM frank a JOIN frank b ON b.run = 'recency' AND b.type = a.type AND b.split = a.split
 AND b.object_id = a.object_id AND b.h = a.h CROSS JOIN (SELECT unnest([0, 0.5, 1]::DOUBLE[]) AS weight) w WHERE a.run = 'busy'""",
)


@query(
    "blend_sweep",
    "blend",
    f"SELECT {T}, weight, object_id, h, round(p, 6) AS p FROM blend",
)
def blend_sweep(s: Site):
    return A.blend_sweep(s.scores, ["type", "split"], [0.0, 0.5, 1.0], "busy", "recency").select("type", "split", "weight", "object_id", "h", *r6("p"))


@query(
    "mix_rank",
    "frank",
    f"SELECT {T}, object_id, h, next, round(sum(rank * CASE run WHEN 'busy' THEN 0.75 ELSE 0.25 END), 6) AS p FROM frank GROUP BY ALL",
)
def mix_rank(s: Site):
    spec = s.spark.createDataFrame([(t, r, w) for t in SCORED for r, w in (("busy", 0.75), ("recency", 0.25))], "type string, run string, weight double")
    return A.mix_rank(s.scores, ["type", "split"], spec).select("type", "split", "object_id", "h", "next", *r6("p"))


@query(
    "mix_reference_scale",
    "scores",
    """SELECT run, type, object_id, h, round((SELECT count(*) FROM scores r WHERE r.split = 'val' AND r.run = s.run AND r.type = s.type AND r.p <= s.p) /
 (SELECT count(*) FROM scores r WHERE r.split = 'val' AND r.run = s.run AND r.type = s.type), 6) AS scaled FROM scores s WHERE split = 'test'""",
)
def mix_reference_scale(s: Site):
    out = A.reference_scale(s.scores.where("split = 'test'"), s.scores.where("split = 'val'"), ["run", "type"])
    return out.select("run", "type", "object_id", "h", *r6("scaled"))


@query(
    "blend_families",
    "frank",
    f"""SELECT {T}, object_id, h, round(sum(m * w) / sum(w), 6) AS p FROM (SELECT {T}, object_id, h, fam, avg(rank) AS m, max(CASE fam WHEN 'x' THEN 0.6 ELSE 0.4 END) AS w FROM (
 SELECT *, CASE run WHEN 'busy' THEN 'x' ELSE 'y' END AS fam FROM frank) GROUP BY ALL) GROUP BY ALL""",
)
def blend_families(s: Site):
    fam = A.fold_rank(s.scores, BY).withColumn("family", F.when(F.col("run") == "busy", "x").otherwise("y")).drop("p").withColumnRenamed("rank", "p")
    weights = s.spark.createDataFrame([("x", 0.6), ("y", 0.4)], "family string, weight double")
    return A.blend_families(fam, ["type", "split"], weights).select("type", "split", "object_id", "h", *r6("p"))
