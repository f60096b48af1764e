"""Alarm analytics: what thresholds, smoothing, rejection and muting cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import hour_start
from ..operators.interval import interval_join
from ..operators.ranks import exact_quantiles, ranked
from ..operators.sliding import sliding_quantiles
from ..operators.runs import mark_runs, run_table
from ..operators.scan import asof_join
from .metrics import HORIZON, RUN_CAP, alarm_rows, catches, measure, positive, seen_episodes, signals, threshold_for_share, windows_of

GAP = 6
SNAP_HOUR = 6  # the forecast of 07:00 is the row of hour 6


# ---- choosing which hours alarm ------------------------------------------------


def daily_topk(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k objects with the greatest score of the day alarm all day."""
    day = scores.withColumn("day", F.floor(F.col("h") / 24))
    best = day.groupBy(*by, "day", "object_id").agg(F.max("p").alias("p"))
    w = Window.partitionBy(*by, "day").orderBy(F.col("p").desc(), "object_id")
    top = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(*by, "day", "object_id")
    return day.join(top, [*by, "day", "object_id"], "left_semi")


def daily_share_top(scores: DataFrame, by: list[str], day: str, item: str, share: float, tie: Column | None = None) -> DataFrame:
    """The top ``ceil(share * n)`` items of every day; ties in hash order.

    Items per day are bounded by the fleet of sensors, so one (group, day) is
    one sort."""
    w = Window.partitionBy(*by, day)
    order = w.orderBy(F.col("p").desc_nulls_last(), tie if tie is not None else F.xxhash64(item, day), item)
    return (
        scores.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= F.ceil(F.col("_n") * share))
        .drop("_n", "_r")
    )


def smooth_mean(scores: DataFrame, by: list[str], hours: list[int]) -> DataFrame:
    """Mean of the scores present in the last ``m`` hours, for every ``m``, and
    the mean over the windows (``mean_all``) that needs no choice."""
    w = Window.partitionBy(*by, "object_id").orderBy("h")
    cols = [F.avg("p").over(w.rangeBetween(-(m - 1), 0)).alias(f"mean_{m}h") for m in hours]
    out = scores.select("*", *cols)
    total = sum((F.col(f"mean_{m}h") for m in hours[1:]), F.col(f"mean_{hours[0]}h"))
    return out.withColumn("mean_all", total / len(hours))


def k_consecutive(scores: DataFrame, thresholds: DataFrame, by: list[str], k: int) -> DataFrame:
    """Alarm only after ``k`` hours in a row at or above the threshold."""
    w = Window.partitionBy(*by, "object_id").orderBy("h").rangeBetween(-(k - 1), 0)
    held = (F.min("p").over(w) >= F.col("thr")) & (F.count(F.lit(1)).over(w) == k)
    return scores.join(thresholds.select(*by, "thr"), by).withColumn("_on", held).where("_on").drop("_on").withColumn("y", positive())


def _ema(half_life: int):
    """Exponential smoothing of one object's rows in hour order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = 1 - 0.5 ** (1 / half_life)
        pdf = pdf.sort_values("h")
        return pdf.assign(ema=pdf["p"].ewm(alpha=a, adjust=False).mean())

    return run


def smooth_variants(scores: DataFrame, by: list[str], k: int, half_life: int) -> DataFrame:
    """Row-window mean, minimum and maximum of ``k`` rows and an EMA per object.
    An object's rows in a group are at most one per hour of the period."""
    keys = [*by, "object_id"]
    w = Window.partitionBy(*keys).orderBy("h").rowsBetween(-(k - 1), 0)
    out = scores.select(
        *keys, "h", "next", "p",
        F.avg("p").over(w).alias("mean"), F.min("p").over(w).alias("low"), F.max("p").over(w).alias("high"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", ema double"
    return out.groupBy(*keys).applyInPandas(_ema(half_life), schema)


def detrend(scores: DataFrame, by: list[str], a: float, hours: int = 168) -> DataFrame:
    """Score minus ``a`` times the object's own mean over the past week."""
    w = Window.partitionBy(*by, "object_id").orderBy("h").rangeBetween(-hours, -1)
    return scores.withColumn("p", F.col("p") - F.lit(a) * F.coalesce(F.avg("p").over(w), F.lit(0.0)))


def lagged(scores: DataFrame, by: list[str], lags: list[int]) -> DataFrame:
    """Decide on the score of hour ``t - j``: a join on the hour, since rows
    may be missing.  Absent scores fall below every threshold."""
    keys = [*by, "object_id", "h"]
    want = scores.drop("p").withColumn("lag", F.explode(F.array(*[F.lit(j) for j in lags])))
    past = scores.select(*keys, "p").withColumn("lag", F.explode(F.array(*[F.lit(j) for j in lags])))
    past = past.withColumn("h", F.col("h") + F.col("lag"))
    low = scores.groupBy(*by).agg((F.min("p") - 1).alias("_low"))
    return (
        want.join(past, [*keys, "lag"], "left").join(low, by).withColumn("p", F.coalesce("p", "_low")).drop("_low")
    )


def fold_rank(scores: DataFrame, by: list[str]) -> DataFrame:
    """Percent rank inside each fold; ties by object and hour.

    Rank of a value comes from the distributed value ranks.  A value shared by
    a large part of the fold is ordered by object first, so the windows hold
    one value's objects, or one object's hours, never the whole tie.
    """
    r = ranked(scores, by, "p").select(*by, "p", (F.col("cum_n") - F.col("n")).alias("_below"))
    ties = scores.groupBy(*by, "p", "object_id").agg(F.count(F.lit(1)).alias("_o"))
    objects = Window.partitionBy(*by, "p").orderBy("object_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = ties.withColumn("_before", F.coalesce(F.sum("_o").over(objects), F.lit(0))).drop("_o").join(r, [*by, "p"])
    total = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hours = F.row_number().over(Window.partitionBy(*by, "p", "object_id").orderBy("h"))
    return (
        scores.join(offset, [*by, "p", "object_id"])
        .withColumn("_pos", F.col("_below") + F.col("_before") + hours - 1)
        .join(total, by)
        .withColumn("rank", F.col("_pos") / F.col("_n"))
        .select(*scores.columns, "rank")
    )


# ---- curves over many thresholds ----------------------------------------------


def false_hour_curve(scores: DataFrame, by: list[str], shares: list[float], gap: int = 0, horizon: int = HORIZON) -> DataFrame:
    """One row per (group, share of alarm hours): recall, false signals and
    hours, mean signal length, and whether the signal count still grows."""
    thr = threshold_for_share(scores, by, shares)
    alarms = alarm_rows(scores, thr, by, "share", horizon)
    eps = seen_episodes(scores, by, RUN_CAP, horizon)
    total = eps.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"))
    m = measure(alarms, eps, by, ["share"], gap, horizon).join(total, by, "left").fillna(0, subset=["episodes"])
    w = Window.partitionBy(*by).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max("false_signals").over(w), F.lit(-1))
    return m.withColumns(
        {
            "recall": F.col("caught") / F.nullif(F.col("episodes"), F.lit(0)),
            "mean_length": F.col("alarm_hours") / F.greatest("signals", F.lit(1)),
            "growing": F.col("false_signals") >= best,
        }
    )


def match_recall(curve: DataFrame, by: list[str], levels: list[float], cost: str) -> DataFrame:
    """The least cost at which each recall level is reached."""
    lv = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    need = F.col("caught") >= F.col("level") * F.col("episodes")
    return curve.select("*", lv).groupBy(*by, "level").agg(F.min(F.when(need, F.col(cost))).alias(cost))


def interpolate(curve: DataFrame, by: list[str], x: str, ys: list[str], at: DataFrame) -> DataFrame:
    """Linear interpolation of curve columns at ``at`` (``by, x``), clamped to
    the ends.  Curves are short: one row per threshold."""
    w = Window.partitionBy(*by).orderBy(x, *ys)
    seg = curve.select(*by, F.col(x).alias("_x0"), *ys, F.lead(x).over(w).alias("_x1"),
                       *[F.lead(y).over(w).alias(f"_n_{y}") for y in ys], F.row_number().over(w).alias("_i"))
    a = at.select(*by, F.col(x).alias("_at"))
    j = seg.join(a, by)
    # the segment that holds the point; the first and last rows extend outwards
    inside = (F.col("_at") >= F.col("_x0")) & (F.col("_x1").isNull() | (F.col("_at") < F.col("_x1")))
    before = (F.col("_i") == 1) & (F.col("_at") < F.col("_x0"))
    t = F.when(before | F.col("_x1").isNull() | (F.col("_x1") == F.col("_x0")), F.lit(0.0)).otherwise(
        (F.col("_at") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    )
    val = lambda y: F.col(y) + F.coalesce((F.col(f"_n_{y}") - F.col(y)) * t, F.lit(0.0))
    return j.where(inside | before).select(*by, F.col("_at").alias(x), *[val(y).alias(y) for y in ys])


def equal_signals(curve: DataFrame, ref: DataFrame, by: list[str], cost: str = "false_signals") -> DataFrame:
    """The best point that costs no more than the reference."""
    limit = ref.select(*by, F.col(cost).alias("_limit"))
    best = F.max(F.struct("fresh", "caught", (-F.col("share")).alias("m")))
    return (
        curve.join(limit, by)
        .where(F.col(cost) <= F.col("_limit"))
        .groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, F.col("_b.fresh").alias("fresh"), F.col("_b.caught").alias("caught"), (-F.col("_b.m")).alias("share"))
    )


def signal_cost_control(curve: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Reach about the same number of signals by the threshold alone."""
    j = curve.join(target.select(*by, F.col("signals").alias("wanted")), by)
    d = F.abs(F.col("signals") - F.col("wanted"))
    best = F.min(F.struct(d.alias("d"), F.col("share"), F.col("signals"), F.col("false_signals"), F.col("caught")))
    return j.groupBy(*by).agg(F.max("wanted").alias("wanted"), best.alias("_b")).select(
        *by, "wanted", "_b.share", "_b.signals", "_b.false_signals", "_b.caught"
    )


def choose_variant(results: DataFrame, by: list[str], variant: str, cost: str) -> DataFrame:
    """Choose on validation, read off test, and the price of choosing blind."""
    val = results.where("split = 'val'").groupBy(*by).agg(F.min(F.struct(cost, variant)).alias("_b"))
    chosen = val.select(*by, F.col(f"_b.{variant}").alias(variant))
    test = results.where("split = 'test'")
    best = test.groupBy(*by).agg(F.min(cost).alias("best_cost"))
    return (
        chosen.join(test.select(*by, variant, F.col(cost).alias("test_cost")), [*by, variant])
        .join(best, by)
        .withColumn("blind_price", F.col("test_cost") - F.col("best_cost"))
    )


def _hull(cost: str, caught: str):
    """Monotone, then concave upper hull of one short curve."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.groupby(cost, as_index=False)[caught].max().sort_values(cost)
        rise = best[best[caught] > best[caught].cummax().shift(fill_value=0)]
        keep = [(0, 0)]
        for x, y in rise[[cost, caught]].itertuples(index=False):
            while len(keep) > 1:
                (x1, y1), (x2, y2) = keep[-2:]
                # the middle point stays only above the chord over it
                if (y2 - y1) * (x - x1) > (y - y1) * (x2 - x1):
                    break
                keep.pop()
            if x == keep[-1][0]:
                keep[-1] = (x, max(y, keep[-1][1]))
            else:
                keep.append((x, y))
        hull = pd.DataFrame(keep, columns=[cost, caught])
        keys = [c for c in pdf.columns if c not in (cost, caught)]
        return hull.assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, cost, caught]]

    return run


def concave_envelope(curve: DataFrame, by: list[str], cost: str = "false_hours", caught: str = "caught") -> DataFrame:
    """Hull of each group's (cost, caught) points.  A curve has one point per
    threshold of the grid, so a group stays small at any data size."""
    src = curve.select(*by, F.col(cost).cast("bigint").alias(cost), F.col(caught).cast("bigint").alias(caught))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    return src.groupBy(*by).applyInPandas(_hull(cost, caught), schema)


def _spend(budget: float, floor: float, item: str, cost: str, caught: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = {t: g.sort_values(cost)[[cost, caught]].to_numpy(dtype=float) for t, g in pdf.groupby(item)}
        at = {t: int(np.argmax(g[:, 1] >= floor * g[-1, 1])) for t, g in lines.items()}
        spent = sum(g[at[t], 0] for t, g in lines.items())
        while True:
            steps = []
            for t, g in sorted(lines.items()):
                if at[t] + 1 < len(g):
                    dx, dy = g[at[t] + 1] - g[at[t]]
                    if dx > 0 and dy > 0 and spent + dx <= budget:
                        steps.append((dy / dx, t, dx))
            if not steps:
                break
            _, t, dx = max(steps, key=lambda s: s[0])
            at[t] += 1
            spent += dx
        keys = [c for c in pdf.columns if c not in (item, cost, caught)]
        rows = [{**{c: pdf[c].iloc[0] for c in keys}, item: t, cost: int(g[at[t], 0]), caught: int(g[at[t], 1])} for t, g in lines.items()]
        return pd.DataFrame(rows, columns=[*keys, item, cost, caught])

    return run


def budget_split(hulls: DataFrame, by: list[str], item: str, budget: float, floor: float = 0.0, cost="false_hours", caught="caught") -> DataFrame:
    """Spend a budget over the types step by step where an hour buys most,
    after each type's recall floor.  Input: a few hull points per type."""
    src = hulls.select(*by, item, cost, caught)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    return src.groupBy(*by).applyInPandas(_spend(budget, floor, item, cost, caught), schema)


def chatter_table(alarms: DataFrame, eps: DataFrame, by: list[str], gaps: list[int], horizon: int = HORIZON) -> DataFrame:
    """Merging pauses of up to g hours: signals, false ones, caught episodes
    and those caught by a signal that rose within the horizon."""
    g = F.explode(F.array(*[F.lit(x) for x in gaps])).alias("gap")
    rows = alarms.select("*", g)
    keys = [*by, "gap", "object_id"]
    marked = mark_runs(rows, keys, "h", F.col("gap"), "_run")
    sig = signals(rows, [*by, "gap"], F.col("gap"))
    first = F.min("h").over(Window.partitionBy(*keys, "_run"))
    hit = windows_of(eps, horizon).join(marked.select(*keys, "h", first.alias("_a")), [*by, "object_id", "h"])
    got = hit.groupBy(*by, "gap", "object_id", "e").agg(F.min("_a").alias("_a")).groupBy(*by, "gap").agg(
        F.count(F.lit(1)).alias("caught"), F.count_if(F.col("_a") >= F.col("e") - horizon).alias("fresh")
    )
    return (
        sig.join(got, [*by, "gap"], "left")
        .fillna(0, subset=["caught", "fresh"])
        .withColumn("false_signals", F.col("signals") - F.col("signals_true"))
    )


def watchlist(scores: DataFrame, by: list[str], share: float, horizon: int = HORIZON) -> DataFrame:
    """No model: the objects with the worst smoothed validation rate alarm all
    the time until the share of hours is spent."""
    y = positive(horizon)
    rate = (
        scores.where("split = 'val'")
        .groupBy(*by, "object_id")
        .agg(((F.sum(y) + 0.5) / (F.count(F.lit(1)) + 50)).alias("_rate"))
    )
    test = scores.where("split = 'test'").join(rate, [*by, "object_id"], "left")
    start = test.groupBy(*by).agg(F.min("h").alias("_h0"))
    # an object without history is drawn to the smoothed zero rate; hours
    # inside an object stay one block in time
    p = F.coalesce("_rate", F.lit(0.01)) + (F.col("h") - F.col("_h0")) * F.lit(1e-12)
    ranked_ = test.join(start, by).withColumn("p", p).drop("_rate", "_h0")
    thr = threshold_for_share(ranked_, by, [share])
    return alarm_rows(ranked_, thr, by, horizon=horizon)


# ---- thresholds that move ------------------------------------------------------


def rolling_thresholds(scores: DataFrame, by: list[str], days: list[int], shares: list[float], least: int = 100) -> DataFrame:
    """``by, day, days, share, thr``: each day's thresholds, the fleet's quantiles over the
    previous days, for all window lengths and shares in one pass; none under ``least`` scores."""
    daily = scores.select(*by, F.floor(F.col("h") / 24).alias("_d"), "p")
    period = daily.groupBy(*by).agg(F.min("_d").alias("_from"), F.max("_d").alias("_to"))
    windows = period.withColumn("day", F.explode(F.sequence("_from", "_to"))).withColumn("days", F.explode(F.array(*[F.lit(d) for d in days])))
    qs = F.array(*[F.lit(1.0 - s) for s in shares])
    windows = windows.select(*by, "day", "days", (F.col("day") - F.col("days")).alias("a"), F.col("day").alias("b"), qs.alias("qs"))
    out = sliding_quantiles(daily, by, "_d", "p", windows, ["day", "days"], max(days)).where(F.col("n") >= least)
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1)
    return out.select(*by, "day", "days", share.alias("share"), F.col("value").alias("thr"))


def rolling_threshold(scores: DataFrame, by: list[str], days: int, share: float, least: int = 100) -> DataFrame:
    """``by, day, thr`` for one window length and one share."""
    return rolling_thresholds(scores, by, [days], [share], least).select(*by, "day", "thr")


def threshold_transfer(scores: DataFrame, by: list[str], share: float, days: int, least: int = 100) -> DataFrame:
    """Promised against actual alarm hours a day on test: a fixed threshold
    from validation, and the rolling one."""
    val, test = scores.where("split = 'val'"), scores.where("split = 'test'")
    thr = threshold_for_share(val, by, [share]).select(*by, F.col("thr").alias("fixed"))
    roll = rolling_threshold(scores, by, days, share, least).select(*by, "day", F.col("thr").alias("rolling"))
    d = F.floor(F.col("h") / 24)
    n_val = val.groupBy(*by, d.alias("day")).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        (F.sum("n") / F.count(F.lit(1)) * share).alias("promised")
    )
    day = (
        test.withColumn("day", d)
        .join(thr, by)
        .join(roll, [*by, "day"], "left")
        .groupBy(*by, "day")
        .agg(
            F.count_if(F.col("p") >= F.col("fixed")).alias("fixed"),
            F.count_if(F.col("p") >= F.col("rolling")).alias("rolling"),
        )
    )
    out = day.groupBy(*by).agg(
        F.avg("fixed").alias("fixed"), F.stddev_pop("fixed").alias("fixed_spread"),
        F.avg("rolling").alias("rolling"), F.stddev_pop("rolling").alias("rolling_spread"),
    )
    return out.join(n_val, by)


def calibration_windows(scores: DataFrame, by: list[str], days: list[int], shares: list[float], least: int = 100) -> DataFrame:
    """Recall and cost of rolling thresholds over windows of several lengths."""
    roll = rolling_thresholds(scores, by, days, shares, least)
    test = scores.where("split = 'test'").withColumn("day", F.floor(F.col("h") / 24))
    alarms = test.join(roll, [*by, "day"]).where(F.col("p") >= F.col("thr")).withColumn("y", positive())
    eps = seen_episodes(scores.where("split = 'test'"), by)
    return measure(alarms, eps, by, ["days", "share"])


# ---- the dispatcher's day ------------------------------------------------------


def daily_snapshot(scores: DataFrame, alarms: DataFrame, by: list[str], hour: int = SNAP_HOUR) -> DataFrame:
    """One forecast a day: alarms a day, precision, caught and recall."""
    snap = scores.where(F.col("h") % 24 == hour).withColumn("y", positive())
    on = alarms.where(F.col("h") % 24 == hour).select(*by, "object_id", "h", F.lit(1).alias("_on"))
    j = snap.join(on, [*by, "object_id", "h"], "left")
    a, hit = F.col("_on").isNotNull(), F.col("_on").isNotNull() & (F.col("y") == 1)
    days = F.count_distinct("h")
    out = j.groupBy(*by).agg(
        days.alias("days"), F.count_if(a).alias("alarms"), F.count_if(hit).alias("hits"), F.sum("y").alias("positives")
    )
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return out.withColumns(
        {
            "per_day": F.col("alarms") / F.col("days"),
            "precision": F.col("hits") / one("alarms"),
            "recall": F.col("hits") / one("positives"),
        }
    )


def load_per_hour(scores: DataFrame, alarms: DataFrame, by: list[str], limit: int = 10) -> DataFrame:
    """Concurrent cards per hour of the whole period: spread and overflow."""
    hours = scores.select(*by, "h").distinct()
    n = alarms.groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    j = hours.join(n, [*by, "h"], "left").fillna(0, subset=["n"])
    q = lambda x: F.percentile("n", x)
    return j.groupBy(*by).agg(
        F.avg("n").alias("mean"), F.avg((F.col("n") == 0).cast("int")).alias("empty"),
        q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("n").alias("most"),
        F.avg((F.col("n") > limit).cast("int")).alias("over"),
    )


def load_overlap(alarms: DataFrame, by: list[str]) -> DataFrame:
    """Cards against object-hours: how often types overlap on one object."""
    cells = alarms.groupBy(*by, "h", "object_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(*by).agg(
        F.sum("n").alias("cards"), F.count(F.lit(1)).alias("object_hours"),
        F.avg((F.col("n") > 1).cast("int")).alias("overlap"), (F.sum("n") - F.count(F.lit(1))).alias("collapsible"),
    )


def load_objects(alarms: DataFrame, by: list[str], top: int = 5) -> DataFrame:
    """How concentrated the cards are: the top objects' share, the least number
    of objects holding half of the cards, and the catches they give."""
    n = alarms.groupBy(*by, "object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "object_id")
    r = n.withColumn("_i", F.row_number().over(w)).withColumn(
        "_before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    half = F.col("_before") < F.col("_all") / 2
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("objects"),
        (F.sum(F.when(F.col("_i") <= top, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_share"),
        F.count_if(half).alias("half_objects"),
        (F.sum(F.when(half, F.col("hits")).otherwise(0)) / F.greatest(F.sum("hits"), F.lit(1))).alias("half_hits"),
    )


def load_by_hour(alarms: DataFrame, by: list[str], days: float) -> DataFrame:
    """Mean cards by hour of the day, stamped by the end of the hour."""
    return alarms.groupBy(*by, ((F.col("h") + 1) % 24).alias("hour")).agg((F.count(F.lit(1)) / days).alias("cards"))


def run_life(alarms: DataFrame, by: list[str], long: int = 24) -> DataFrame:
    """How long one alarm lives and the share of hours in long ones."""
    r = run_table(alarms, [*by, "object_id"], "h")
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.percentile("hours", 0.5).alias("p50"), F.percentile("hours", 0.9).alias("p90"),
        F.max("hours").alias("longest"),
        (F.sum(F.when(F.col("hours") > long, F.col("hours")).otherwise(0)) / F.sum("hours")).alias("long_share"),
    )


# ---- run caps, muting, own thresholds ------------------------------------------


def with_run_position(alarms: DataFrame, by: list[str], gap: int = GAP) -> DataFrame:
    """Hours since the signal rose, pauses up to ``gap`` merged."""
    keys = [*by, "object_id"]
    m = mark_runs(alarms, keys, "h", gap, "_run")
    first = F.min("h").over(Window.partitionBy(*keys, "_run"))
    return m.withColumn("position", F.col("h") - first).drop("_run")


def run_cap(alarms: DataFrame, eps: DataFrame, by: list[str], cap: int, horizon: int = HORIZON) -> DataFrame:
    """Hours past ``cap`` of a signal become a status, measured apart."""
    pos = with_run_position(alarms, by)
    live = pos.where(F.col("position") < cap)
    status = pos.where(F.col("position") >= cap)
    m = measure(live, eps, by)
    got = catches(live, eps, by, horizon=horizon).select(*by, "object_id", "e")
    quiet = (
        windows_of(eps, horizon)
        .join(status.select(*by, "object_id", "h"), [*by, "object_id", "h"])
        .select(*by, "object_id", "e")
        .distinct()
        .join(got, [*by, "object_id", "e"], "left_anti")
    )
    return (
        m.join(status.groupBy(*by).agg(F.count(F.lit(1)).alias("status_hours")), by, "left")
        .join(quiet.groupBy(*by).agg(F.count(F.lit(1)).alias("in_status")), by, "left")
        .fillna(0, subset=["status_hours", "in_status"])
    )


def object_signal_stats(alarms: DataFrame, by: list[str]) -> DataFrame:
    """Signals and their true share per object."""
    runs = run_table(alarms, [*by, "object_id"], "h", 0, {"hit": F.max("y")})
    return runs.groupBy(*by, "object_id").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("good"))


def mute_noisy(fit: DataFrame, apply: DataFrame, by: list[str], least: int, good: float) -> DataFrame:
    """Silence the objects that were noisy on the fitting period."""
    noisy = object_signal_stats(fit, by).where((F.col("n") >= least) & (F.col("good") <= good))
    return apply.join(noisy.select(*by, "object_id"), [*by, "object_id"], "left_anti")


def own_threshold(fit: DataFrame, by: list[str], least: int, target: float, steps: int = 60) -> DataFrame:
    """Objects that miss the target precision get the lowest own threshold that
    reaches it (NULL: none does).  Hours carry the verdict of their signal."""
    keys = [*by, "object_id"]
    bad = object_signal_stats(fit, by).where((F.col("n") >= least) & (F.col("good") < target))
    m = mark_runs(fit, keys, "h", 0, "_run")
    verdict = F.max("y").over(Window.partitionBy(*keys, "_run"))
    rows = m.withColumn("v", verdict).join(bad.select(*keys), keys, "left_semi")
    qs = [0.98 * i / (steps - 1) for i in range(steps)]
    grid = exact_quantiles(rows, keys, "p", qs).withColumnRenamed("value", "thr")
    reach = alarm_rows(rows.drop("thr"), grid, keys, "q").groupBy(*keys, "q", "thr").agg(F.avg("v").alias("good"))
    found = reach.where(F.col("good") >= target).groupBy(*keys).agg(F.min("thr").alias("own"))
    return bad.select(*keys).join(found, keys, "left")


def apply_own_threshold(alarms: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "object_id"]
    marked = alarms.join(own.withColumn("_has", F.lit(True)), keys, "left")
    keep = F.col("_has").isNull() | F.coalesce(F.col("p") >= F.col("own"), F.lit(False))
    return marked.where(keep).drop("own", "_has")


def shown_signals(alarms: DataFrame, muted: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """A signal with any hour left is seen whole; fully muted ones vanish."""
    keys = [*by, "object_id", "h"]
    m = alarms.join(muted.select(*keys).distinct().withColumn("_m", F.lit(1)), keys, "left")
    runs = run_table(
        m, [*by, "object_id"], "h", gap, {"hit": F.max("y"), "seen": F.bool_or(F.col("_m").isNull()),
                                            "muted_hours": F.count("_m")},
    )
    return runs.groupBy(*by).agg(
        F.count_if(F.col("seen")).alias("shown"),
        F.count_if(F.col("seen") & (F.col("hit") == 0)).alias("shown_false"),
        F.sum("muted_hours").alias("muted_hours"),
        F.sum("hours").alias("alarm_hours"),
    )


def at_work_flags(rows: DataFrame, guard: DataFrame, visits: DataFrame, window_hours: int) -> DataFrame:
    """Is the object disarmed at the hour, did a visit start within the window."""
    from ..functions.timebase import HOUR

    at = rows.withColumn("_t", hour_start("h"))
    a = asof_join(at, guard, ["object_id"], "_t", "us", {"armed": "armed"}, how="left")
    v = asof_join(a, visits, ["collector_id"], "_t", "t0", {"t0": "_v"}, how="left")
    return v.withColumns(
        {
            "disarmed": F.coalesce(~F.col("armed"), F.lit(False)),
            "visiting": F.coalesce(F.col("_t") - F.col("_v") < window_hours * HOUR, F.lit(False)),
        }
    ).drop("_t", "_v", "armed")


def staff_split(scores: DataFrame, eps: DataFrame, visits: DataFrame, by: list[str], window_hours: int, horizon: int = HORIZON) -> DataFrame:
    """Positive rows by episodes with and without a visit shortly before."""
    from ..functions.timebase import HOUR, hour_of

    quiet = eps.where("noise is null")
    j = asof_join(quiet, visits, ["collector_id"], "t0", "t0", {"t0": "_v"}, how="left")
    at_visit = F.coalesce(F.col("t0") - F.col("_v") < window_hours * HOUR, F.lit(False))
    e = j.select("type", "object_id", hour_of("t0").alias("e"), at_visit.alias("staff")).distinct()
    w = windows_of(e, horizon).groupBy("type", "object_id", "h").agg(
        F.max(F.col("staff").cast("int")).alias("y_staff"), F.max((~F.col("staff")).cast("int")).alias("y_own")
    )
    return scores.join(w, ["type", "object_id", "h"], "left").fillna(0, subset=["y_staff", "y_own"])


def in_windows(rows: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Rows (type, object_id, collector_id, h) inside a work window of their
    object or collector that names their type.  ``windows``: object_id, types,
    a, b."""
    at = rows.withColumn("_t", hour_start("h"))
    places = at.withColumn("place", F.explode(F.array_distinct(F.array("object_id", "collector_id"))))
    hit = interval_join(places, windows.withColumnRenamed("object_id", "place"), ["place"], "_t", "a", "b", width)
    return hit.where(F.array_contains("types", F.col("type"))).select(*rows.columns).distinct()


# ---- where catches and misses come from ----------------------------------------


def silence_buckets(rows: DataFrame, since: DataFrame) -> DataFrame:
    """Bucket rows by hours since the object's last journal row."""
    s = F.col("since_row")
    b = F.when(s < 1, "0").when(s < 7, "1-6").when(s < 25, "7-24").when(s < 73, "25-72").otherwise("73+")
    return rows.join(since, ["object_id", "h"]).withColumn("bucket", b)


def silence_table(scores: DataFrame, alarms: DataFrame, since: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "object_id", "h"]
    on = alarms.select(*keys, F.lit(1).alias("_on"))
    j = silence_buckets(scores.withColumn("y", positive()).join(on, keys, "left"), since)
    a = F.col("_on").isNotNull()
    hit = a & (F.col("y") == 1)
    out = j.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("hours"), F.count_if(a).alias("alarms"), F.sum("y").alias("ahead"), F.count_if(hit).alias("hits")
    )
    total = F.sum("alarms").over(Window.partitionBy(*by))
    return out.withColumn("alarm_share", F.col("alarms") / F.greatest(total, F.lit(1))).withColumn(
        "precision", F.col("hits") / F.greatest("alarms", F.lit(1))
    )


def after_hole(scores: DataFrame, alarms: DataFrame, by: list[str], hole_end: int, hours: list[int]) -> DataFrame:
    """Alarm share and precision in the first hours the table is back."""
    back = scores.where(F.col("h") >= hole_end).groupBy(*by).agg(F.min("h").alias("_h0"))
    keys = [*by, "object_id", "h"]
    on = alarms.select(*keys, F.lit(1).alias("_on"))
    j = scores.withColumn("y", positive()).join(on, keys, "left").join(back, by)
    first = F.explode(F.array(*[F.lit(w) for w in hours])).alias("first_hours")
    j = j.select("*", first).where((F.col("h") >= F.col("_h0")) & (F.col("h") < F.col("_h0") + F.col("first_hours")))
    a = F.col("_on").isNotNull()
    return j.groupBy(*by, "first_hours").agg(
        F.avg(a.cast("int")).alias("alarm_share"),
        (F.count_if(a & (F.col("y") == 1)) / F.greatest(F.count_if(a), F.lit(1))).alias("precision"),
    )


def split_catches(eps: DataFrame, got: DataFrame, by: list[str]) -> DataFrame:
    """Episodes with caught and fresh flags."""
    j = eps.join(got, [*by, "object_id", "e"], "left")
    return j.withColumns(
        {"caught": F.col("lead").isNotNull(), "fresh": F.coalesce(F.col("standing") < RUN_CAP, F.lit(False))}
    )


def miss_depth(scores: DataFrame, eps: DataFrame, got: DataFrame, ranks: DataFrame, by: list[str], share: float, horizon: int = HORIZON) -> DataFrame:
    """By what factor the alarm share had to grow to catch each miss."""
    missed = eps.join(got, [*by, "object_id", "e"], "left_anti")
    best = (
        windows_of(missed, horizon)
        .join(ranks.select(*by, "object_id", "h", "rank"), [*by, "object_id", "h"])
        .groupBy(*by, "object_id", "e")
        .agg(F.max("rank").alias("best"))
        .withColumn("need", (1 - F.col("best")) / share)
    )
    le = lambda x: F.avg((F.col("need") <= x).cast("int"))
    return best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("missed"), le(1.5).alias("le_1_5"), le(2.0).alias("le_2"), le(4.0).alias("le_4"),
        F.avg((F.col("need") > 10).cast("int")).alias("gt_10"), F.percentile("need", 0.5).alias("median"),
    )


def alarm_shape(alarms: DataFrame, eps: DataFrame, by: list[str], long: int = RUN_CAP) -> DataFrame:
    """Runs: number, mean and median length, hours in long ones, and how long
    the alarm had stood in the hour before an episode."""
    r = run_table(alarms, [*by, "object_id"], "h")
    shape = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("hours").alias("mean"), F.percentile("hours", 0.5).alias("median"),
        (F.sum(F.when(F.col("hours") > long, F.col("hours")).otherwise(0)) / F.sum("hours")).alias("long_share"),
    )
    pos = with_run_position(alarms, by, 0).select(*by, "object_id", "h", "position")
    at = eps.withColumn("h", F.col("e") - 1).join(pos, [*by, "object_id", "h"])
    return shape.join(at.groupBy(*by).agg(F.percentile("position", 0.5).alias("stood_at_onset")), by, "left")


def chronic_objects(alarms: DataFrame, eps: DataFrame, got: DataFrame, history: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """Share of alarms and catches on the objects worst in the earlier period.
    ``history``: episodes (by, object_id, e) of that period."""
    n = history.groupBy(*by, "object_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "object_id")
    worst = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select(*by, "object_id", F.lit(1).alias("_w"))
    a = alarms.join(worst, [*by, "object_id"], "left")
    e = split_catches(eps, got, by).join(worst, [*by, "object_id"], "left")
    on = F.col("_w").isNotNull()
    hours = a.groupBy(*by).agg(
        F.avg(on.cast("int")).alias("alarm_share"), F.avg(F.when(F.col("y") == 0, on.cast("int"))).alias("false_share")
    )
    return hours.join(
        e.groupBy(*by).agg(
            F.count_if(on & F.col("caught")).alias("caught_chronic"), F.count_if(~on & F.col("caught")).alias("caught_other"),
            F.count_if(on & F.col("fresh")).alias("fresh_chronic"), F.count_if(~on & F.col("fresh")).alias("fresh_other"),
        ),
        by,
        "left",
    )


def series_cost(scores: DataFrame, alarms: DataFrame, eps: DataFrame, got: DataFrame, since: DataFrame, by: list[str], series: int = 168) -> DataFrame:
    """Alarm hours inside a series of episodes, first and continuing catches,
    and the variance of the score its object explains.  ``since``: by-type
    hours since the last episode per (type, object_id, h)."""
    a = alarms.join(since, ["type", "object_id", "h"]).groupBy(*by).agg(
        F.avg((F.col("since") < series).cast("int")).alias("in_series")
    )
    e = split_catches(eps, got, by).withColumn("h", F.col("e") - 1).join(since, ["type", "object_id", "h"], "left")
    first = F.coalesce(F.col("since") >= series, F.lit(True))
    ep = e.groupBy(*by).agg(
        F.count_if(first).alias("first"), F.count_if(first & F.col("caught")).alias("first_caught"),
        F.count_if(~first).alias("next"), F.count_if(~first & F.col("caught")).alias("next_caught"),
    )
    obj = scores.groupBy(*by, "object_id").agg(F.avg("p").alias("m"), F.count(F.lit(1)).alias("n"))
    grand = scores.groupBy(*by).agg(F.avg("p").alias("g"), F.var_pop("p").alias("v"))
    explained = obj.join(grand, by).groupBy(*by).agg(
        (F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)) / F.sum("n") / F.nullif(F.max("v"), F.lit(0.0))).alias("explained")
    )
    return a.join(ep, by, "left").join(explained, by, "left")


def catch_by_history(eps: DataFrame, got: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """Catches by the number of episodes in the past 720 h and by the pause.
    ``history``: (type, object_id, h) with ``past`` and ``since``."""
    e = split_catches(eps, got, by).withColumn("h", F.col("e") - 1).join(history, ["type", "object_id", "h"], "left")
    n = F.coalesce("past", F.lit(0))
    count = F.when(n < 1, "0").when(n < 3, "1-2").when(n < 6, "3-5").when(n < 12, "6-11").otherwise("12+")
    s = F.coalesce("since", F.lit(1 << 30))
    pause = F.when(s < 24, "<24").when(s < 72, "24-72").when(s < 168, "72-168").otherwise("168+")
    return e.groupBy(*by, count.alias("past"), pause.alias("pause")).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("caught")).alias("caught"), F.count_if(F.col("fresh")).alias("fresh")
    )


def series_profile(rows: DataFrame, by: list[str]) -> DataFrame:
    """Chance of an episode ahead by hours since the last one; in against out
    of a series.  ``rows``: by, since, y."""
    s = F.col("since")
    band = lambda a, b: F.avg(F.when((s >= a) & (s < b), F.col("y")))
    ins, out = F.avg(F.when(s < 168, F.col("y"))), F.avg(F.when(s >= 168, F.col("y")))
    return rows.groupBy(*by).agg(
        band(0, 12).alias("h0_12"), band(12, 24).alias("h12_24"), band(24, 48).alias("h24_48"),
        band(48, 96).alias("h48_96"), band(96, 168).alias("h96_168"), out.alias("outside"),
        (ins / F.nullif(out, F.lit(0.0))).alias("ratio"),
        (F.sum(F.when(s < 168, F.col("y")).otherwise(0)) / F.nullif(F.sum("y"), F.lit(0))).alias("positives_in_series"),
    )


# ---- ensembles -----------------------------------------------------------------


def blend_sweep(scores: DataFrame, by: list[str], weights: list[float], a: str, b: str) -> DataFrame:
    """Blend two runs' fold ranks with several weights, one long table."""
    ranks = fold_rank(scores, [*by, "run"])
    left = ranks.where(F.col("run") == a).select(*by, "object_id", "h", "next", F.col("rank").alias("_a"))
    right = ranks.where(F.col("run") == b).select(*by, "object_id", "h", F.col("rank").alias("_b"))
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("weight")
    return (
        left.join(right, [*by, "object_id", "h"])
        .select("*", w)
        .withColumn("p", (1 - F.col("weight")) * F.col("_a") + F.col("weight") * F.col("_b"))
        .drop("_a", "_b")
    )


def mix_rank(scores: DataFrame, by: list[str], spec: DataFrame) -> DataFrame:
    """Weighted sum of ordinal ranks of the runs a type's mix names.
    ``spec``: type, run, weight."""
    ranks = fold_rank(scores, [*by, "run"]).join(spec, ["type", "run"])
    return ranks.groupBy(*by, "object_id", "h", "next").agg(F.sum(F.col("rank") * F.col("weight")).alias("p"))


def reference_scale(scores: DataFrame, ref: DataFrame, by: list[str]) -> DataFrame:
    """A score as the share of its own reference scores at or below it."""
    both = ref.select(*by, "p", F.lit(1).alias("_ref")).unionByName(scores.select(*by, "p", F.lit(0).alias("_ref")))
    r = ranked(both, by, "p", {"refs": F.sum("_ref")})
    total = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ecdf = r.join(total, by).select(*by, "p", (F.col("cum_refs") / F.col("_n")).alias("scaled"))
    return scores.join(ecdf, [*by, "p"])


def blend_families(scores: DataFrame, by: list[str], weights: DataFrame) -> DataFrame:
    """Mean over the seeds of a family, then weighted over families.
    ``weights``: family, weight."""
    family = scores.groupBy(*by, "object_id", "h", "family").agg(F.avg("p").alias("p"))
    j = family.join(weights, "family")
    return j.groupBy(*by, "object_id", "h").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))
