"""By-fact detectors: abnormal temperature, intruder routes, blind objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import DAY, HOUR, MINUTE, floor_div, hour_of, hour_start, year_of
from ..operators.interval import interval_join
from ..operators.scan import asof_join, distinct_within, previous_row, running_total
from ..operators.settle import settle


@dataclass(frozen=True)
class TempParams:
    """Fixed values of the temperature detector."""

    base_rows: int = 48
    base_min: int = 24
    low: float = 3
    high: float = 40
    deviation: float = 10
    gap_hours: int = 1
    channels: int = 2
    readings: int = 2


def temp_anomaly(journal: DataFrame, reading: Column, p: TempParams) -> DataFrame:
    """Hourly median per channel against the median of its previous readings.
    ``direction`` is hot, cold or NULL.  A channel has one row an hour."""
    r = (
        journal.where(reading)
        .groupBy("object_id", "channel_id", hour_of("us").alias("h"))
        .agg(F.percentile("num", 0.5).alias("v"))
    )
    w = Window.partitionBy("channel_id").orderBy("h").rowsBetween(-p.base_rows, -1)
    b = r.withColumn("base", F.percentile("v", 0.5).over(w)).withColumn("nb", F.count("v").over(w))
    known = F.col("nb") >= p.base_min
    hot = known & (F.col("v") > p.high) & (F.col("v") - F.col("base") >= p.deviation)
    cold = known & (F.col("v") < p.low) & (F.col("base") - F.col("v") >= p.deviation)
    return b.withColumn("direction", F.when(hot, "hot").when(cold, "cold"))


def temp_runs(anomaly: DataFrame) -> DataFrame:
    """Anomalous readings in a row: position in the run and its bounds."""
    by_channel = Window.partitionBy("channel_id").orderBy("h")
    by_direction = Window.partitionBy("channel_id", "direction").orderBy("h")
    k = anomaly.withColumn("run", F.row_number().over(by_channel) - F.row_number().over(by_direction))
    k = k.where(F.col("direction").isNotNull())
    run = Window.partitionBy("channel_id", "direction", "run")
    return k.select(
        "object_id", "channel_id", "direction", "run", "h", "v", "base",
        F.row_number().over(run.orderBy("h")).alias("kth"), F.min("h").over(run).alias("r0"), F.max("h").over(run).alias("r1"),
    )


def temp_episodes(runs: DataFrame, p: TempParams) -> DataFrame:
    """Overlapping runs of an object merged; confirmed by a second channel or a
    second reading; the last reading of every channel."""
    on = ["object_id", "direction"]
    # runs that start in one hour merge anyway, so one row per hour is enough
    heads = runs.groupBy(*on, "r0").agg(F.max("r1").alias("r1"))
    w = Window.partitionBy(*on).orderBy("r0")
    reach = F.max("r1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("r0") > reach + p.gap_hours), 1).otherwise(0)
    numbered = heads.withColumn("_n", fresh).withColumn("ep", F.sum("_n").over(w)).select(*on, "r0", "ep")
    x = runs.join(numbered, [*on, "r0"])
    key = [*on, "ep"]
    per = x.groupBy(*key, "channel_id").agg(F.min("h").alias("first_h"), F.max(F.struct("h", "v", "base")).alias("l"))
    order = Window.partitionBy(*key).orderBy("first_h", "channel_id")
    nth = per.withColumn("_i", F.row_number().over(order))
    last = F.struct(
        F.col("channel_id").alias("sensor_id"), F.round("l.v", 1).alias("value"), F.round("l.base", 1).alias("baseline"), F.col("l.h").alias("at")
    )
    chans = nth.groupBy(*key).agg(
        F.min(F.when(F.col("_i") == p.channels, F.col("first_h"))).alias("h2"),
        F.sort_array(F.collect_list(last)).alias("channels"),
    )
    g = x.groupBy(*key).agg(
        F.min("h").alias("t0"), F.max("h").alias("t1"), F.min(F.when(F.col("kth") == p.readings, F.col("h"))).alias("hr")
    )
    return g.join(chans, key).select(*on, "t0", "t1", F.least("h2", "hr").alias("confirm_h"), "channels")


def intruder_route(eps: DataFrame, guard: DataFrame, journal: DataFrame, points: Column, tail: int = 30 * MINUTE, most: int = 50) -> DataFrame:
    """Sensor hits of an object from the episode start to the disarm of its
    collector, or a while after the last trigger; repeats collapsed, the
    freshest kept in order."""
    e = eps.select("object_id", "collector_id", "t0", "t1").distinct()
    off = guard.where("not armed").select("collector_id", "us").distinct()
    w = asof_join(e, off, ["collector_id"], "t0", "us", {"us": "_off"}, direction="forward", strict=True, how="left")
    end = F.col("t1") + tail
    spans = w.withColumn("te", F.least(F.coalesce("_off", end), end)).select("object_id", "t0", "te")
    hits = journal.where(points).select("object_id", "channel_id", "stype", "us")
    p = interval_join(hits, spans, ["object_id"], "us", "t0", "te", width=HOUR, closed=True)
    by = Window.partitionBy("object_id", "t0")
    q = p.withColumn("_prev", F.lag("channel_id").over(by.orderBy("us", "channel_id")))
    r = q.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("channel_id")))
    r = r.withColumn("_k", F.row_number().over(by.orderBy(F.col("us").desc(), F.col("channel_id").desc()))).where(F.col("_k") <= most)
    step = F.struct(F.col("us").alias("at"), F.col("channel_id").alias("sensor_id"), "stype")
    return r.groupBy("object_id", "t0").agg(F.sort_array(F.collect_list(step)).alias("route"))


@dataclass(frozen=True)
class BlindParams:
    """Fixed values of the blindness detector."""

    link_share: float = 0.8
    link_window: int = 10 * MINUTE
    power_share: float = 0.95
    power_before: int = 30 * MINUTE
    recover_share: float = 0.5
    confirm: int = 30 * MINUTE


def blind_link(journal: DataFrame, channels: DataFrame, undefined: list[str], skip: list[str], p: BlindParams) -> DataFrame:
    """Moments when the link of an object is lost (enough channels became
    undefined within the window) or back (enough channels work within one of
    two half-shifted buckets)."""
    n = channels.where(~F.col("stype").isin(*skip)).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    mine = journal.where(~F.col("stype").isin(*skip))
    lost = distinct_within(
        mine.where(F.col("state").isin(*undefined)), ["object_id"], "us", "channel_id", p.link_window, 0, "k"
    )
    lost = lost.join(n, "object_id").where(F.col("k") >= p.link_share * F.col("n"))
    works = mine.where((~F.col("state").isin(*undefined)) | (F.col("state").isNull() & F.col("num").isNotNull()))
    half = p.link_window // 2
    bucket = F.explode(
        F.array(*[F.struct(F.lit(o).alias("o"), floor_div(F.col("us") - o, p.link_window).alias("b")) for o in (0, half)])
    )
    # one row per channel and bucket before counting channels
    cells = works.select("object_id", "channel_id", "us", bucket.alias("c")).groupBy("object_id", "c", "channel_id").agg(F.max("us").alias("us"))
    back = cells.groupBy("object_id", "c").agg(F.max("us").alias("us"), F.count(F.lit(1)).alias("k"))
    back = back.join(n, "object_id").where(F.col("k") >= p.recover_share * F.col("n"))
    out = lambda d, flag: d.select("object_id", "us", F.lit(flag).alias("back"), (F.col("k") / F.col("n")).alias("share"), F.lit("link").alias("cause"))
    return out(lost, False).unionByName(out(back, True))


def blind_power(journal: DataFrame, phase: Column, off: Column, p: BlindParams) -> DataFrame:
    """Running count of de-energised phases per object, as moments of loss and
    return.  The count is a sum of changes."""
    ph = journal.where(phase).select("object_id", "channel_id", "us", "event_id", off.cast("int").alias("off"))
    n = ph.select("object_id", "channel_id").distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    turns = previous_row(ph, ["channel_id"], "us", ["event_id"], {"off": "was"})
    d = turns.withColumn("delta", F.col("off") - F.coalesce("was", F.lit(0)))
    s = running_total(d, ["object_id"], "us", ["channel_id", "event_id"], "delta", "k").join(n, "object_id")
    share = F.col("k") / F.col("n")
    hit = (F.col("k") >= p.power_share * F.col("n")) | (F.col("k") <= p.recover_share * F.col("n"))
    return s.where(hit).select("object_id", "us", (share <= p.recover_share).alias("back"), share.alias("share"), F.lit("power").alias("cause"))


def blind_episodes(points: DataFrame, objects: DataFrame, journal: DataFrame, power_lost: Column, p: BlindParams) -> DataFrame:
    """From the first loss after a return to the next return.  A lost link
    shortly after a power event of the collector was lost by power."""
    one = points.withColumn("_b", F.col("back").cast("int"))
    marked = previous_row(one, ["object_id", "cause"], "us", ["_b", "share"], {"back": "was"})
    starts = marked.where("not back and (was is null or was)").select("object_id", "cause", F.col("us").alias("t0"), "share")
    ends = points.where("back").select("object_id", "cause", F.col("us").alias("e"))
    e = asof_join(starts, ends, ["object_id", "cause"], "t0", "e", {"e": "t1"}, direction="forward", strict=True, how="left")
    e = e.join(objects.select("object_id", "collector_id"), "object_id")
    power = journal.where(power_lost).select("collector_id", "us")
    j = asof_join(e, power, ["collector_id"], "t0", "us", {"us": "_p"}, how="left")
    by_power = (F.col("cause") == "link") & (F.col("_p") >= F.col("t0") - p.power_before)
    return j.select(
        "object_id", "collector_id", F.when(by_power, "power").otherwise(F.col("cause")).alias("cause"),
        F.round("share", 2).alias("share"), "t0", "t1",
    )


def temp_year_table(eps: DataFrame) -> DataFrame:
    return eps.groupBy(year_of(hour_start("t0")).alias("year"), "direction").agg(
        F.count(F.lit(1)).alias("episodes"), F.count("confirm_h").alias("announced"), F.count_distinct("object_id").alias("objects")
    )


def blind_year_table(eps: DataFrame, p: BlindParams) -> DataFrame:
    long = F.col("t1").isNull() | (F.col("t1") - F.col("t0") >= p.confirm)
    return eps.groupBy(year_of("t0").alias("year"), "cause").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(long).alias("announced"), F.count_distinct("object_id").alias("objects"),
        F.round(F.percentile((F.col("t1") - F.col("t0")) / MINUTE, 0.5)).alias("median_min"),
    )


def route_sizes(routes: DataFrame) -> DataFrame:
    n = F.size(F.array_distinct(F.transform("route", lambda s: s["sensor_id"])))
    return routes.select(n.alias("n")).agg(
        F.count(F.lit(1)).alias("routes"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), F.max("n").alias("most")
    )


# ---- what is live at a moment -----------------------------------------------------


def live_facts(eps: DataFrame, triggers: DataFrame, at: int, temperature: str, works_code: str) -> DataFrame:
    """Clean and planned-work episodes alive in the last hour; ``new`` began in
    it.  Fires of temperature sensors alone are announced elsewhere."""
    since = at - HOUR
    live = eps.where((F.col("noise").isNull() | (F.col("noise") == works_code)) & (F.col("t1") >= since) & (F.col("t0") < at))
    fires = live.where("type = 'fire'").select("object_id", "t0", "t1")
    hits = triggers.where(F.col("type") == "fire").where(F.col("stype") != temperature).select("object_id", "us")
    real = interval_join(hits, fires, ["object_id"], "us", "t0", "t1", width=HOUR, closed=True).select("object_id", "t0").distinct()
    real = real.withColumn("type", F.lit("fire"))
    kept = live.where("type <> 'fire'").unionByName(live.join(real, ["object_id", "type", "t0"], "left_semi"))
    first = triggers.groupBy("object_id", "type", F.col("us").alias("t0")).agg(F.min("stype").alias("stype"))
    return kept.join(first, ["object_id", "type", "t0"], "left").select(
        "object_id", "collector_id", "type", "t0", "t1", "noise", "stype", (F.col("t0") >= since).alias("new")
    )


def silent_blindness(silent: DataFrame, channels: DataFrame, skip: list[str], at: int, p: BlindParams) -> DataFrame:
    """Objects whose channels the intake marked silent: blind since the moment
    the needed share fell silent (an order statistic)."""
    n = channels.where(~F.col("stype").isin(*skip)).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    s = silent.where(~F.col("stype").isin(*skip) & F.col("since").isNotNull())
    w = Window.partitionBy("object_id").orderBy("since", "channel_id")
    need = F.greatest(F.lit(1), F.ceil(p.link_share * F.col("n") - 1e-9))
    r = s.join(n, "object_id").withColumn("_i", F.row_number().over(w)).withColumn("_k", need)
    g = r.groupBy("object_id", "n", "_k").agg(F.count(F.lit(1)).alias("silent"), F.max(F.when(F.col("_i") == F.col("_k"), F.col("since"))).alias("t0"))
    return g.where((F.col("silent") >= F.col("_k")) & (at - F.col("t0") >= p.confirm)).select(
        "object_id", F.lit("link").alias("cause"), F.round(F.col("silent") / F.col("n"), 2).alias("share"), "t0", F.lit(None).cast("bigint").alias("t1")
    )


def live_blind(eps: DataFrame, silent: DataFrame, at: int, p: BlindParams) -> DataFrame:
    """One notice per object: the earliest start, the latest end (open if any
    is open), power over link."""
    since = at - HOUR
    known = eps.where(F.col("t0") < at).withColumn("t1", F.when(F.col("t1") < at, F.col("t1")))
    mine = known.where((F.col("t1").isNull() | (F.col("t1") >= since)) & (F.coalesce("t1", F.lit(at)) - F.col("t0") >= p.confirm))
    both = mine.select("object_id", "cause", "share", "t0", "t1").unionByName(silent)
    g = both.groupBy("object_id").agg(
        F.max(F.when(F.col("cause") == "power", 1).otherwise(0)).alias("_p"), F.max("share").alias("share"),
        F.min("t0").alias("t0"), F.when(F.count("t1") == F.count(F.lit(1)), F.max("t1")).alias("t1"),
    )
    return g.select(
        "object_id", F.when(F.col("_p") == 1, "power").otherwise("link").alias("cause"), "share", "t0",
        F.coalesce("t1", F.lit(at)).alias("t1"), (F.col("t0") + p.confirm >= since).alias("new"),
    )


def live_temperature(eps: DataFrame, at_hour: int) -> DataFrame:
    """Confirmed temperature episodes alive in the last hour."""
    live = eps.where(F.col("confirm_h").isNotNull() & (F.col("t1") >= at_hour - 1) & (F.col("confirm_h") < at_hour))
    return live.withColumn("new", F.col("confirm_h") >= at_hour - 1)


def hours_since_end(eps: DataFrame, at: int) -> DataFrame:
    return eps.where(F.col("t0") < at).groupBy("object_id", "type").agg(
        F.greatest(F.lit(0.0), (F.lit(at) - F.max("t1")) / HOUR).alias("hours")
    )


# fixed values: sensor families by a part of the sensor type, lower case, and
# the families each incident type stands on
FAMILY_WORDS = {
    "smoke": "дым",
    "heat": "теплов",
    "temp": "температур",
    "gas": "газов",
    "flood": "затоплен",
    "pump": "насос",
    "phase": "фаз",
    "ups": "ибп",
    "fan": "вентилятор",
    "door": "двер",
    "motion": "движени",
    "hatch": "люк",
}
TYPE_FAMILIES = {
    "fire": ("smoke", "heat", "temp"),
    "gas": ("gas",),
    "flood": ("flood", "pump"),
    "equipment": ("phase", "ups", "fan", "pump"),
    "sensor": ("smoke", "temp"),
    "intrusion": ("door", "motion", "hatch"),
}


def family_types(words: dict[str, str], families: dict[str, tuple[str, ...]]) -> Column:
    """Incident types a sensor type serves, as an array."""
    s = F.lower("stype")
    fams = F.array_compact(F.array(*[F.when(F.contains(s, F.lit(w)), F.lit(f)) for f, w in words.items()]))
    return F.array_compact(
        F.array(*[F.when(F.arrays_overlap(fams, F.array(*[F.lit(x) for x in fs])), F.lit(t)) for t, fs in families.items()])
    )


def freshness(journal: DataFrame, at: int, days: int = 30, words=FAMILY_WORDS, families=TYPE_FAMILIES) -> DataFrame:
    """Hours since the last event of each type's sensor families; the whole
    look-back where there was none."""
    recent = journal.where((F.col("us") < at) & (F.col("us") >= at - days * DAY))
    last = recent.groupBy("stype").agg(F.max("us").alias("last"))
    by_type = last.withColumn("type", F.explode(family_types(words, families))).groupBy("type").agg(F.max("last").alias("last"))
    spark = journal.sparkSession
    names = spark.createDataFrame([(t,) for t in families], "type string")
    return names.join(by_type, "type", "left").select(
        "type", F.coalesce((F.lit(at) - F.col("last")) / HOUR, F.lit(24.0 * days)).alias("hours")
    )


def silence_penalty(confidence: DataFrame, silent: DataFrame, cost: DataFrame) -> DataFrame:
    """Confidence times ``1 - cost`` for every silent family of the type.
    ``confidence``: object_id, type, c; ``silent``: object_id, family;
    ``cost``: type, family, cost."""
    keep = F.aggregate(F.collect_list(1 - F.col("cost")), F.lit(1.0), lambda a, x: a * x)
    loss = silent.distinct().join(cost, "family").groupBy("object_id", "type").agg(keep.alias("_k"))
    return confidence.join(loss, ["object_id", "type"], "left").withColumn("c", F.col("c") * F.coalesce("_k", F.lit(1.0))).drop("_k")


def observe_summary(history: DataFrame, alarms: DataFrame, fresh: DataFrame, stale_hours: float) -> DataFrame:
    """Per type: alarm share of the last hour, stability of the last day against
    what is older than a week, its grade, freshness and staleness.  A type with
    nothing to compare has neither index nor grade."""
    from .metrics import psi_table

    last = history.groupBy("type").agg(F.max("h").alias("_last"))
    j = settle(history.join(last, "type"))
    ref = j.where(F.col("h") <= F.col("_last") - 168)
    win = j.where(F.col("h") > F.col("_last") - 24)
    drift = settle(psi_table(ref, win, ["type"], "p", eps=1e-6))
    on = alarms.select("type", "object_id", "h", F.lit(1).alias("_on"))
    now = j.where(F.col("h") == F.col("_last")).join(on, ["type", "object_id", "h"], "left")
    share = now.groupBy("type").agg(F.avg(F.when(F.col("_on").isNotNull(), 1.0).otherwise(0.0)).alias("alarm_share"))
    size = history.groupBy("type").agg(F.count(F.lit(1)).alias("window_size"))
    grade = F.when(F.col("psi") < 0.10, 0).when(F.col("psi") < 0.25, 1).when(F.col("psi").isNotNull(), 2)
    return (
        size.join(share, "type", "left")
        .join(drift, "type", "left")
        .join(fresh, "type", "left")
        .withColumn("grade", grade)
        .withColumn("stale", F.coalesce(F.col("hours") >= stale_hours, F.lit(True)))
    )
