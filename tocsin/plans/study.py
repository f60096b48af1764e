"""Studies over scores and episodes: profiles of misses and false signals,
drift, confidence, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import HOUR, MINUTE, hour_of
from ..operators.binned import bin_counts, column_quantiles
from ..operators.interval import interval_join
from ..operators.ranks import ranked
from ..operators.runs import mark_runs, run_table
from ..operators.settle import settle
from . import metrics as M


def long_targets(mart: DataFrame, scores: DataFrame, kinds: dict[str, str], types) -> DataFrame:
    """Scores beside every kind of target (all, confirmed, primary)."""
    cells = [
        F.struct(F.lit(t).alias("type"), F.lit(k).alias("target"), F.col(f"next_{t}{suffix}").alias("next"))
        for t in types
        for k, suffix in kinds.items()
    ]
    long = mart.select("object_id", "h", F.explode(F.array(*cells)).alias("c")).select("object_id", "h", "c.*")
    return scores.drop("next").join(long, ["type", "object_id", "h"])


def eval_matrix(rows: DataFrame, thresholds: DataFrame, calibrated: DataFrame | None, by: list[str]) -> DataFrame:
    """The metric row of every split and target; raw and calibrated error."""
    out = M.evaluate(rows, thresholds, by).join(M.ece(rows, by).withColumnRenamed("ece", "ece_raw"), by, "left")
    if calibrated is not None:
        out = out.join(M.ece(calibrated, by).withColumnRenamed("ece", "ece_calibrated"), by, "left")
    return out


def operating_points(scores: DataFrame, by: list[str], precision: float, per_day: float, days: float, k: int) -> DataFrame:
    """Test metrics of rules chosen on validation: best F1, a precision, a
    budget, and the daily top k.  ``by`` has no split."""
    from .alarms import daily_topk

    val, test = scores.where("split = 'val'"), scores.where("split = 'test'")
    curve = M.pr_curve(val, by)
    rules = {
        "f1": M.best_f1_threshold(curve, by).select(*by, "thr"),
        "precision": M.threshold_for_precision(curve, by, precision, 20).where("thr is not null"),
        "budget": M.threshold_for_rate(val, by, per_day, days),
    }
    thr = None
    for name, t in rules.items():
        part = t.select(*by, F.lit(name).alias("rule"), "thr")
        thr = part if thr is None else thr.unionByName(part)
    alarms = M.alarm_rows(test, thr, by, "rule").select(*by, "rule", "object_id", "h", "y")
    top = daily_topk(test, by, k).withColumn("y", M.positive()).select(*by, F.lit("topk").alias("rule"), "object_id", "h", "y")
    eps = M.seen_episodes(test, by)
    m = M.measure(alarms.unionByName(top), eps, by, ["rule"], gap=0)
    total = eps.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"))
    return m.join(total, by, "left").withColumn("precision", F.col("signals_true") / F.col("signals"))


def dispatcher_summary(alarms: DataFrame, eps: DataFrame, by: list[str], days: float, gap: int = 6) -> DataFrame:
    """Per group: caught ahead, left to by-fact, signals, false a day, lead,
    durations, alarms standing for a week."""
    m = M.measure(alarms, eps, by, gap=gap)
    spans = M.signal_spans(alarms, by, gap).groupBy(*by).agg(
        F.percentile("length", 0.5).alias("duration_p50"), F.percentile("length", 0.9).alias("duration_p90")
    )
    total = eps.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"))
    return (
        m.join(spans, by)
        .join(total, by, "left")
        .withColumn("left_to_fact", F.col("episodes") - F.col("caught"))
        .withColumn("standing", F.col("caught") - F.col("fresh"))
        .withColumn("false_per_day", F.col("false_signals") / days)
    )


def episode_rows(eps: DataFrame, mart: DataFrame, cols: list[str]) -> DataFrame:
    """Mart columns of the hour before each episode."""
    return eps.withColumn("h", F.col("e") - 1).join(mart.select("object_id", "h", *cols), ["object_id", "h"], "left")


def miss_profile(eps: DataFrame, got: DataFrame, context: DataFrame, by: list[str]) -> DataFrame:
    """Missed against caught episodes by the hour before.  ``context``: type,
    object_id, h, primary, confirmed, quiet, since, trigger, collector, other,
    night."""
    flags = ["primary", "confirmed", "quiet", "trigger", "collector", "other", "night"]
    e = eps.join(got.select(*by, "object_id", "e", F.lit(1).alias("_got")), [*by, "object_id", "e"], "left").withColumn("h", F.col("e") - 1)
    j = e.join(context, ["type", "object_id", "h"], "left")
    missed = F.col("_got").isNull()
    cls = F.when(~F.col("primary"), "repeat").when(F.col("quiet"), "primary out of silence").otherwise("primary, journal not empty")
    return j.groupBy(*by, missed.alias("missed")).agg(
        F.count(F.lit(1)).alias("episodes"),
        *[F.avg(F.col(f).cast("int")).alias(f) for f in flags],
        F.percentile("since", 0.5).alias("since_median"),
        *[F.count_if(cls == c).alias(n) for n, c in (("repeats", "repeat"), ("silent", "primary out of silence"), ("noisy", "primary, journal not empty"))],
    )


def false_causes(alarms: DataFrame, context: DataFrame, by: list[str], gap: int = 6, horizon: int = 24) -> DataFrame:
    """The first cause that explains each signal.  ``context``: type,
    object_id, h, since, noise, other_next (hours to another type), next,
    visit; ``coll_later`` of the hour after the horizon."""
    runs = run_table(alarms, [*by, "object_id"], "h", gap, {"hit": F.max("y") == 1})
    at = lambda h, cols: context.select("type", "object_id", F.col("h").alias(h), *[F.col(c).alias(f"{h}_{c}") for c in cols])
    j = runs.withColumn("z", F.col("b") + horizon)
    j = j.join(at("a", ["since", "other_next"]), ["type", "object_id", "a"], "left")
    j = j.join(at("b", ["noise", "next", "visit"]), ["type", "object_id", "b"], "left")
    j = j.join(at("z", ["collector"]), ["type", "object_id", "z"], "left")
    length = F.col("b") - F.col("a") + 1
    cause = (
        F.when(F.col("a_since") < 168, "own tail")
        .when(F.col("b_noise"), "noise or trigger without an episode")
        .when(F.col("a_other_next") <= length + horizon, "another type on the object")
        .when((F.col("b_next") > horizon) & (F.col("b_next") <= 72), "own episode in 24-72 h")
        .when(F.col("z_collector"), "own type in the collector")
        .when(F.col("b_visit"), "visit to the collector")
        .otherwise("none")
    )
    return j.groupBy(*by, "hit", cause.alias("cause")).agg(F.count(F.lit(1)).alias("signals"), F.percentile(length, 0.5).alias("length_p50"))


def precursor_lift(marked: DataFrame, by: list[str], features: list[str], least: float = 0.10) -> DataFrame:
    """Features above zero more often before episodes than in control hours.
    ``marked``: by, grp (text), control (bool) and the features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) > 0).alias("on")) for f in features])).alias("f")
    long = marked.select(*by, "grp", pairs).select(*by, "grp", "f.*")
    share = long.groupBy(*by, "grp", "feature").agg(F.avg(F.col("on").cast("int")).alias("share"))
    control = share.where("grp = 'control'").select(*by, "feature", F.col("share").alias("background"))
    return (
        share.where("grp <> 'control'")
        .where(F.col("share") >= least)
        .join(control, [*by, "feature"])
        .withColumn("lift", F.col("share") / F.greatest("background", F.lit(1e-3)))
    )


def early_false(ends: DataFrame, background: DataFrame, by: list[str], horizon: int = 24) -> DataFrame:
    """Own episode 24-72 h after a false signal against background hours with
    the same mix of hours since the last episode.  Both: by, since, next."""
    band = lambda s: F.when(s < 24, 0).when(s < 72, 1).when(s < 168, 2).when(s < 720, 3).otherwise(4)
    early = ((F.col("next") > horizon) & (F.col("next") <= 72)).cast("double")
    got = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("false_signals"), F.avg(early).alias("early"))
    w = ends.groupBy(*by, band(F.col("since")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    b = background.groupBy(*by, band(F.col("since")).alias("band")).agg(F.avg(early).alias("rate"))
    base = w.join(b, [*by, "band"], "left").groupBy(*by).agg((F.sum(F.col("n") * F.coalesce("rate", F.lit(0.0))) / F.sum("n")).alias("background"))
    return got.join(base, by).withColumn("ratio", F.col("early") / F.greatest("background", F.lit(1e-3)))


def repeat_rhythm(rows: DataFrame, by: list[str], lo: int = 20, hi: int = 168) -> DataFrame:
    """Repeat intervals within an hour of a multiple of 24.  ``rows``: by,
    interval (hours since the previous episode)."""
    i = F.col("interval")
    near = F.abs(F.pmod(i + 12, F.lit(24)) - 12) <= 1
    return rows.where((i >= lo) & (i < hi)).groupBy(*by).agg(F.count(F.lit(1)).alias("repeats"), F.avg(near.cast("int")).alias("near_day"))


def walk_compare(curves: DataFrame, by: list[str], ref: str, run: str = "run", cost: str = "false_hours") -> DataFrame:
    """Caught and fresh of every run at the reference run's cost, by fold.
    ``curves``: run, by, share, cost, caught, fresh."""
    from .alarms import interpolate

    at = curves.where((F.col(run) == ref) & (F.col("share") == F.lit(0.2))).select(*by, cost)
    runs = curves.select(run, *by).distinct().join(at, by)
    c = curves.withColumns({x: F.col(x).cast("double") for x in (cost, "caught", "fresh")})
    return interpolate(c, [run, *by], cost, ["caught", "fresh"], runs.withColumn(cost, F.col(cost).cast("double")))


def seed_sweep(scores: DataFrame, by: list[str], counts: list[int]) -> DataFrame:
    """PR-AUC of the mean over the first n seeds, for several n.  ``scores``:
    by, seed (0..), object_id, h, next, p."""
    n = F.explode(F.array(*[F.lit(x) for x in counts])).alias("seeds")
    mean = scores.select("*", n).where(F.col("seed") < F.col("seeds")).groupBy(*by, "seeds", "object_id", "h", "next").agg(F.avg("p").alias("p"))
    return M.pr_auc(M.pr_curve(mean, [*by, "seeds"]), [*by, "seeds"]).select(*by, "seeds", "pr_auc")


# ---- drift ------------------------------------------------------------------------


DECILES = [i / 10 for i in range(11)]


def feature_drift(mart: DataFrame, features: list[str], ref_end: int, ref_hours: int, window: int, windows: int, eps: float = 1e-4) -> DataFrame:
    """PSI of every feature in successive windows against the reference, the
    ``ref_hours`` before hour ``ref_end``: ``feature, lag, psi``.

    Bins are the reference's deciles, outer bins open; a feature of few distinct
    deciles has a bin for each of its reference values, a constant one no index.
    All features share two scans, one for edges and one for counts.  The driver
    gets eleven numbers a feature.
    """
    h = F.col("h")
    ref = mart.where((h >= ref_end - ref_hours) & (h < ref_end))
    edges: dict[str, list[float]] = {}
    for r in column_quantiles(ref, features, DECILES).groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("e")).collect():
        if len(r.e) >= 3:
            edges[r.feature] = r.e[1:-1]
    lag = F.when(h < ref_end, 0).otherwise(F.floor((h - ref_end) / window) + 1)
    seen = mart.where((h >= ref_end - ref_hours) & (h < ref_end + window * windows))
    counts = settle(bin_counts(seen, features, lag, windows + 1, edges))
    # features of few deciles: a value's bin is the number of reference values at or below it, but one
    rare = counts.where("bin < 0")
    of = ranked(rare, ["feature"], "v", {"seen": F.max((F.col("grp") == 0).cast("int"))}).select("feature", "v", F.greatest(F.col("cum_seen") - 1, F.lit(0)).cast("bigint").alias("bin"))
    cells = counts.where("bin >= 0").unionByName(rare.drop("bin").join(of, ["feature", "v"]).select(*counts.columns))
    lags = [F.sum(F.when(F.col("grp") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in range(windows + 1)]
    bins = cells.groupBy("feature", "bin").agg(*lags)
    later = F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"_{k}").alias("b")) for k in range(1, windows + 1)]))
    long = bins.select("feature", "bin", F.col("_0").alias("a"), later)
    totals = long.groupBy("feature", "lag").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.count(F.lit(1)).alias("_bins")).where("_bins > 1 AND _a > 0")
    pa = F.greatest(F.col("a") / F.greatest("_a", F.lit(1)), F.lit(eps))
    pb = F.greatest(F.col("b") / F.greatest("_b", F.lit(1)), F.lit(eps))
    return long.join(totals, ["feature", "lag"]).groupBy("feature", "lag").agg(F.sum((pb - pa) * F.log(pb / pa)).alias("psi"))


def drift_fastest(psi: DataFrame, families: DataFrame, lag: int, top: int = 15) -> DataFrame:
    """The ``top`` features that moved most by window ``lag``, ties by name."""
    worst = psi.where(F.col("lag") == lag).orderBy(F.round("psi", 6).desc(), "feature").limit(top)
    return worst.join(families, "feature").select("feature", "family", "psi")


def drift_crossings(psi: DataFrame, moderate: float = 0.10, strong: float = 0.25) -> DataFrame:
    first = lambda x: F.min(F.when(F.col("psi") >= x, F.col("lag")))
    return psi.groupBy("feature").agg(first(moderate).alias("moderate"), first(strong).alias("strong"), F.max("psi").alias("worst"))


def family_drift(psi: DataFrame, families: DataFrame) -> DataFrame:
    return psi.join(families, "feature").groupBy("family", "lag").agg(F.percentile("psi", 0.5).alias("median_psi"), F.count(F.lit(1)).alias("features"))


def drift_weighted(psi: DataFrame, importances: DataFrame, families: DataFrame, calendar: str = "calendar") -> DataFrame:
    """PSI weighted by importance per type, with and without the calendar."""
    j = psi.join(importances, "feature").join(families, "feature", "left")
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("with_calendar")
    k = j.select("*", both).where(F.col("with_calendar") | (F.coalesce("family", F.lit("")) != calendar))
    total = F.sum("importance")
    return k.groupBy("type", "with_calendar", "lag").agg((F.sum(F.col("psi") * F.col("importance")) / total).alias("weighted_psi"))


def target_drift(rows: DataFrame, by: list[str], origin: int, window: int, horizon: int = 24) -> DataFrame:
    w = F.floor((F.col("h") - origin) / window)
    return rows.groupBy(*by, w.alias("window")).agg(F.count(F.lit(1)).alias("rows"), F.avg(M.positive(horizon)).alias("positive_rate"))


# ---- confidence -----------------------------------------------------------------------


def group_signals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hours, incident share, signals and false ones of grouped alarm hours."""
    hours = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("hours"), F.avg("y").alias("rate"))
    return hours.join(M.signals(rows, by), by).withColumn("false_signals", F.col("signals") - F.col("signals_true"))


def confidence_table(alarms: DataFrame, other: DataFrame, by: list[str], calibrated: DataFrame, standing: int = 6, sure: float = 0.2) -> DataFrame:
    """Alarms grouped by how many of four signs agree: calibrated probability,
    the second model, a standing alarm, neighbouring types."""
    key = ["type", "split", "object_id", "h"]
    m = mark_runs(alarms, [*by, "object_id"], "h", 0, "_r")
    pos = F.row_number().over(Window.partitionBy(*by, "object_id", "_r").orderBy("h"))
    m = m.withColumn("_held", pos > standing).drop("_r")
    near = alarms.groupBy("split", "object_id", "h").agg(F.count(F.lit(1)).alias("_types"))
    j = (
        m.join(other.select(*key, F.lit(1).alias("_o")), key, "left")
        .join(near, ["split", "object_id", "h"])
        .join(calibrated.select(*key, "confidence"), key, "left")
    )
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    signs = bit(F.col("confidence") >= sure) + bit(F.col("_o").isNotNull()) + bit(F.col("_held")) + bit(F.col("_types") > 1)
    return group_signals(j.withColumn("signs", signs), [*by, "signs"])


def visit_check(spans: DataFrame, rows: DataFrame, visits: DataFrame, objects: DataFrame, by: list[str], window: int = 24) -> DataFrame:
    """Visits after signals against the object's own background and the
    background of the same object, hour and kind of day.  ``spans``: by,
    object_id, b, hit; ``rows``: object_id, h."""
    v = visits.select("collector_id", hour_of("t0").alias("vh")).distinct().join(objects.select("object_id", "collector_id"), "collector_id")
    ahead = v.select("object_id", F.explode(F.sequence(F.col("vh") - window, F.col("vh") - 1)).alias("h")).distinct().withColumn("_v", F.lit(1))
    # the origin day of the hour count is a Tuesday
    weekend = F.pmod(F.floor(F.col("h") / 24) + 1, F.lit(7)) >= 5
    base = rows.select("object_id", "h").distinct().join(ahead, ["object_id", "h"], "left").withColumns({"got": F.coalesce("_v", F.lit(0)), "hod": F.col("h") % 24, "wknd": weekend})
    own = base.groupBy("object_id").agg(F.avg("got").alias("own"))
    cell = base.groupBy("object_id", "hod", "wknd").agg(F.avg("got").alias("cell"))
    overall = base.agg(F.avg("got").alias("a")).first()["a"]
    s = spans.withColumn("h", F.col("b")).withColumns({"hod": F.col("b") % 24})
    s = s.withColumn("wknd", F.pmod(F.floor(F.col("h") / 24) + 1, F.lit(7)) >= 5)
    j = s.join(ahead, ["object_id", "h"], "left").join(own, "object_id", "left").join(cell, ["object_id", "hod", "wknd"], "left")
    return j.groupBy(*by, "hit").agg(
        F.count(F.lit(1)).alias("signals"), F.avg(F.coalesce("_v", F.lit(0))).alias("visited"),
        F.avg(F.coalesce("own", F.lit(overall))).alias("object_background"), F.avg(F.coalesce("cell", F.lit(overall))).alias("hour_background"),
    )


def retro_daily(rows: DataFrame, by: list[str]) -> DataFrame:
    """One forecast a day replayed: alarms a day, precision, recall, lead."""
    a, y = F.col("alarm"), F.col("y") == 1
    return rows.groupBy(*by).agg(
        F.count_distinct("h").alias("days"), (F.count_if(a) / F.count_distinct("h")).alias("per_day"),
        (F.count_if(a & y) / F.greatest(F.count_if(a), F.lit(1))).alias("precision"),
        F.sum("y").alias("episodes"), F.count_if(a & y).alias("caught"),
        (F.count_if(a & y) / F.greatest(F.sum("y"), F.lit(1))).alias("recall"),
        F.percentile(F.when(a & y, F.col("next")), 0.5).alias("lead_median_h"),
    )


def month_pivot(rows: DataFrame, by: list[str], month: Column, months: list[int]) -> DataFrame:
    hit = F.count_if(F.col("alarm") & (F.col("y") == 1))
    pr = F.round(hit / F.greatest(F.count_if(F.col("alarm")), F.lit(1)), 2)
    return rows.withColumn("_m", month).groupBy(*by).pivot("_m", months).agg(pr)


# ---- notices by fact ---------------------------------------------------------------------


def notice_rules(eps: DataFrame, marked: DataFrame, wait: int = 10 * MINUTE) -> DataFrame:
    """When each rule would announce an episode: the first trigger, the second
    one, the second channel to fire, the same among clean triggers, and the
    first one if it is clean, after the wait in which noise is judged."""
    key = ["object_id", "type", "t0"]
    e = eps.select(*key, "t1", F.col("noise").isNull().alias("real"), "confirmed")
    t = marked.select("object_id", "type", "channel_id", "us", F.col("noise").isNull().alias("clean"))
    hit = interval_join(t, e, ["object_id", "type"], "us", "t0", "t1", width=HOUR, closed=True)
    order = lambda *p: Window.partitionBy(*key, *p).orderBy("us", "channel_id")
    hit = hit.withColumn("k", F.row_number().over(order())).withColumn("kc", F.row_number().over(order("clean")))
    first = hit.groupBy(*key, "channel_id").agg(F.min("us").alias("f"), F.min(F.when(F.col("clean"), F.col("us"))).alias("fc"))
    rank = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(F.col(c).asc_nulls_last(), "channel_id"))
    chans = first.withColumn("r", rank("f")).withColumn("rc", rank("fc")).groupBy(*key).agg(
        F.min(F.when(F.col("r") == 2, F.col("f"))).alias("t_nch2"), F.min(F.when(F.col("rc") == 2, F.col("fc"))).alias("t_cleanch2")
    )
    at = lambda cond: F.min(F.when(cond, F.col("us")))
    dirty = F.max(F.when(~F.col("clean") & (F.col("us") <= F.col("t0")), 1).otherwise(0))
    g = hit.groupBy(*key, "real", "confirmed").agg(
        at(F.col("k") == 1).alias("t_first"), at(F.col("k") == 2).alias("t_n2"),
        at(F.col("clean") & (F.col("kc") == 1)).alias("t_clean"), at(F.col("clean") & (F.col("kc") == 2)).alias("t_clean2"),
        F.when(dirty == 0, F.col("t0") + wait).alias("t_silent"),
    )
    return g.join(chans, key)


RULES = ("first", "n2", "nch2", "clean", "clean2", "cleanch2", "silent")


def long_notices(rules: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"t_{r}").alias("at")) for r in RULES])).alias("c")
    return rules.select("type", "object_id", "t0", "real", "confirmed", cells).select("type", "object_id", "t0", "real", "confirmed", "c.*")


def notice_table(rules: DataFrame) -> DataFrame:
    """Announced, false, missed real, delay and visits of every rule."""
    n = long_notices(rules)
    said = F.col("at").isNotNull()
    delay = F.when(said & F.col("real"), (F.col("at") - F.col("t0")) / MINUTE)
    return n.groupBy("type", "rule").agg(
        F.count_if(said).alias("announced"), F.count_if(said & ~F.col("real")).alias("false"), F.count_if(~said & F.col("real")).alias("missed"),
        F.percentile(delay, 0.5).alias("delay_p50"), F.percentile(delay, 0.9).alias("delay_p90"),
        F.avg(F.when(said, F.col("confirmed").cast("int"))).alias("visited"),
    )


def notice_tradeoff(table: DataFrame, totals: DataFrame, curve: DataFrame) -> DataFrame:
    """A higher forecast threshold, and what the by-fact channel then picks up.
    The rule of a type: no false notices first, more real ones next.
    ``totals``: type, real; ``curve``: type, share, caught, episodes,
    false_signals."""
    pick = table.where(F.col("rule").isin("first", "clean", "silent")).groupBy("type").agg(F.min(F.struct("false", "missed", "rule")).alias("b"))
    chosen = pick.select("type", F.col("b.rule").alias("rule"), F.col("b.false").alias("fact_false"), F.col("b.missed").alias("_m"))
    cover = chosen.join(totals, "type").withColumn("cover", (F.col("real") - F.col("_m")) / F.greatest("real", F.lit(1)))
    lost = F.col("episodes") - F.col("caught")
    return (
        curve.join(cover, "type")
        .withColumn("by_fact", F.round(lost * F.col("cover")).cast("bigint"))
        .withColumn("unannounced", lost - F.col("by_fact"))
        .select("type", "rule", "share", "caught", "false_signals", "by_fact", "unannounced", "fact_false")
    )
