"""From journal rows to triggers, noise marks, visits and incident episodes.

Journal columns: object_id, collector_id, channel_id, us, stype, state, num.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import Vocabulary, any_sign, first_match
from ..functions.timebase import DAY, HOUR, MINUTE, SECOND, year_of
from ..operators.interval import interval_join
from ..operators.scan import asof_join, distinct_within, sessions
from ..operators.settle import settle


@dataclass(frozen=True)
class LabelParams:
    """Fixed values of the labelling; times in microseconds."""

    gap: int = HOUR
    mass_channels: int = 10
    mass_span: int = 10 * MINUTE
    power_before_flood: int = 60 * SECOND
    visit_step: int = 30 * MINUTE
    intrusion_step: int = 10 * MINUTE
    arrival: int = 15 * MINUTE
    confirm: int = 2 * HOUR
    primary: int = 7 * DAY
    restart: int = 10 * MINUTE
    works_pad: int = 7 * DAY
    mass_code: str = "Н8"
    power_code: str = "Н7"
    works_code: str = "Н10"
    break_in: str = "Не замкнут под охраной"


def journal_triggers(journal: DataFrame, voc: Vocabulary) -> DataFrame:
    """Rows that mean an incident of one of the types."""
    return (
        journal.select(
            "object_id",
            "collector_id",
            "channel_id",
            "us",
            "stype",
            F.coalesce("state", F.col("num").cast("string")).alias("what"),
            first_match(voc.triggers).alias("type"),
        )
        .where(F.col("type").isNotNull())
    )


def guard_timeline(journal: DataFrame, voc: Vocabulary) -> DataFrame:
    """Arm and disarm moments.  An object with both states at one moment
    blinked: that moment is dropped."""
    armed = F.when(voc.armed.column(), True).when(voc.disarmed.column(), False)
    moment = Window.partitionBy("object_id", "us")
    return (
        journal.select("object_id", "collector_id", "us", armed.alias("armed"))
        .where(F.col("armed").isNotNull())
        .withColumn("_all", F.bool_and("armed").over(moment))
        .withColumn("_any", F.bool_or("armed").over(moment))
        .where(F.col("_all") == F.col("_any"))
        .drop("_all", "_any")
    )


def armed_openings(journal: DataFrame, guard: DataFrame, voc: Vocabulary) -> DataFrame:
    """Openings whose last guard state at or before them is armed."""
    openings = journal.where(any_sign(voc.openings)).select("object_id", "collector_id", "channel_id", "us", "stype")
    return (
        asof_join(openings, guard, ["object_id"], "us", "us", {"armed": "armed"})
        .where("armed")
        .drop("armed")
    )


def opening_then_motion(openings: DataFrame, journal: DataFrame, voc: Vocabulary, p: LabelParams) -> DataFrame:
    """Openings followed by motion strictly later, within the step."""
    motion = journal.where(any_sign(voc.motion)).select("object_id", "us")
    return asof_join(
        openings, motion, ["object_id"], "us", "us", {"us": "motion_us"}, direction="forward", strict=True
    ).where(F.col("motion_us") <= F.col("us") + p.intrusion_step)


def with_arrival(moved: DataFrame, guard: DataFrame, p: LabelParams) -> DataFrame:
    """``arrival``: the collector was disarmed soon enough; NULL if it never was."""
    disarmed = guard.where("not armed").select("collector_id", "us")
    return asof_join(
        moved, disarmed, ["collector_id"], "us", "us", {"us": "disarm_us"}, direction="forward", how="left"
    ).withColumn("arrival", F.col("disarm_us") - F.col("us") <= p.arrival)


def intrusion_triggers(openings: DataFrame, p: LabelParams) -> DataFrame:
    return openings.where("arrival is not true").select(
        "object_id",
        "collector_id",
        "channel_id",
        "us",
        "stype",
        F.lit(p.break_in).alias("what"),
        F.lit("intrusion").alias("type"),
    )


def mass_counts(triggers: DataFrame, voc: Vocabulary, p: LabelParams) -> tuple[DataFrame, DataFrame]:
    """Distinct channels of the object around every mass-prone fire trigger."""
    smoke = triggers.where(F.col("stype").isin(*voc.mass.stypes)).where("type = 'fire'")
    return smoke, distinct_within(smoke, ["object_id"], "us", "channel_id", p.mass_span, p.mass_span, "n")


def noise_mass(triggers: DataFrame, voc: Vocabulary, p: LabelParams) -> DataFrame:
    smoke, n = mass_counts(triggers, voc, p)
    return (
        smoke.join(n.where(F.col("n") >= p.mass_channels), ["object_id", "us"])
        .select("object_id", "channel_id", "us", "type", F.lit(p.mass_code).alias("noise"))
        .distinct()
    )


def flooded_triggers(triggers: DataFrame, voc: Vocabulary) -> DataFrame:
    return triggers.where(F.col("what").isin(*voc.flooded.states) & F.col("type").isNotNull())


def power_gap(triggers: DataFrame, voc: Vocabulary, how: str = "inner") -> DataFrame:
    """Time since the collector's last equipment trigger, for each "flooded" row."""
    f = flooded_triggers(triggers, voc)
    if voc.flooded.stypes:
        f = f.where(F.col("stype").isin(*voc.flooded.stypes))
    power = triggers.where("type = 'equipment'").select("collector_id", "us")
    return asof_join(f, power, ["collector_id"], "us", "us", {"us": "power_us"}, how=how).withColumn(
        "gap", F.col("us") - F.col("power_us")
    )


def noise_power_flood(triggers: DataFrame, voc: Vocabulary, p: LabelParams) -> DataFrame:
    return (
        power_gap(triggers, voc)
        .where(F.col("gap") <= p.power_before_flood)
        .select("object_id", "channel_id", "us", "type", F.lit(p.power_code).alias("noise"))
        .distinct()
    )


def visits(journal: DataFrame, guard: DataFrame, voc: Vocabulary, p: LabelParams) -> DataFrame:
    """Disarm, then a door, then motion in the collector, both soon after the disarm."""
    disarmed = guard.where("not armed").select("collector_id", "us")
    doors = journal.where(any_sign(voc.doors)).select("collector_id", "us")
    motion = journal.where(any_sign(voc.visit_motion)).select("collector_id", "us")
    on, fwd = ["collector_id"], {"direction": "forward", "strict": True}
    with_door = asof_join(disarmed, doors, on, "us", "us", {"us": "door_us"}, **fwd)
    with_motion = asof_join(with_door, motion, on, "us", "us", {"us": "motion_us"}, **fwd)
    latest = F.greatest("door_us", "motion_us")
    return with_motion.where(latest <= F.col("us") + p.visit_step).select("collector_id", F.col("us").alias("t0"))


def mark_noise(triggers: DataFrame, noise: DataFrame) -> DataFrame:
    """Attach one noise code per trigger; several codes at one row collapse."""
    key = ["object_id", "channel_id", "us", "type"]
    return triggers.join(noise.groupBy(*key).agg(F.min("noise").alias("noise")), key, "left")


def raw_episodes(marked: DataFrame, p: LabelParams) -> DataFrame:
    """Sessions per (object, type, noisy or not)."""
    rows = marked.withColumn("noisy", F.col("noise").isNotNull())
    return sessions(
        rows,
        ["object_id", "collector_id", "type", "noisy"],
        "us",
        p.gap,
        item="channel_id",
        extra={"noise": F.max("noise")},
    ).withColumnRenamed("items", "channels")


def with_primary(eps: DataFrame, p: LabelParams) -> DataFrame:
    w = Window.partitionBy("object_id", "type", "noisy").orderBy("t0")
    since = F.col("t0") - F.lag("t1").over(w)
    return eps.withColumn("primary", F.coalesce(since > p.primary, F.lit(True)))


def with_confirmed(eps: DataFrame, visit: DataFrame, p: LabelParams) -> DataFrame:
    joined = asof_join(
        eps, visit, ["collector_id"], "t0", "t0", {"t0": "visit_us"}, direction="forward", strict=True, how="left"
    )
    return joined.withColumn(
        "confirmed", F.coalesce(F.col("visit_us") <= F.col("t0") + p.confirm, F.lit(False))
    ).drop("visit_us")


def episodes(marked: DataFrame, visit: DataFrame, p: LabelParams) -> DataFrame:
    return with_confirmed(with_primary(raw_episodes(marked, p), p), visit, p).select(
        "object_id", "collector_id", "type", "t0", "t1", "rows", "channels", "noise", "confirmed", "primary"
    )


def works_windows(works: DataFrame, years: list[int], p: LabelParams) -> DataFrame:
    """Windows of the work schedule.  A year with no row of an (object, kind)
    borrows the rows of its nearest year, moved by whole years and padded;
    of two equally near years the earlier one lends."""
    w = works.where(F.col("object_id").isNotNull()).withColumn("wy", F.year("starts_at"))
    known = w.groupBy("object_id", "work_kind").agg(F.collect_set("wy").alias("have"))
    asked = known.withColumn("y", F.explode(F.array(*[F.lit(y) for y in years])))
    distance = F.transform("have", lambda v: F.struct(F.abs(v - F.col("y")).alias("d"), v.alias("wy")))
    lend = (
        asked.where(~F.array_contains("have", F.col("y")))
        .select("object_id", "work_kind", "y", F.array_min(distance)["wy"].alias("wy"))
    )
    own = w.select(
        "object_id", "types", "removed_sensor", F.col("starts_at").alias("a"), F.col("ends_at").alias("b")
    )
    months = ((F.col("y") - F.col("wy")) * 12).cast("int")
    pad = F.expr(f"make_dt_interval({p.works_pad // DAY})")
    shift = lambda c: (F.col(c) + F.make_ym_interval(F.lit(0), months)).cast("timestamp_ntz")
    moved = w.join(lend, ["object_id", "work_kind", "wy"]).select(
        "object_id",
        "types",
        "removed_sensor",
        (shift("starts_at") - pad).alias("a"),
        (shift("ends_at") + pad).alias("b"),
    )
    return own.unionByName(moved)


def noise_works(eps: DataFrame, windows: DataFrame, triggers: DataFrame, p: LabelParams) -> DataFrame:
    """Quiet episodes that start inside a work window of their object or
    collector get the planned-work mark.  ``windows``: object_id, types,
    removed_sensor, a, b in microseconds."""
    ids = ["object_id", "collector_id", "type", "t0"]
    quiet = eps.where("noise is null").select(*ids)
    places = quiet.withColumn("place", F.explode(F.array_distinct(F.array("object_id", "collector_id"))))
    hit = interval_join(
        places, windows.withColumnRenamed("object_id", "place"), ["place"], "t0", "a", "b", width=DAY
    )
    listed = hit.where(F.array_contains("types", F.col("type"))).select(*ids)
    faults = triggers.where("type = 'sensor'").select(
        "object_id", F.col("us").alias("t0"), F.col("stype").alias("removed_sensor")
    )
    removed = hit.where("type = 'sensor'").join(
        faults, ["object_id", "t0", "removed_sensor"], "left_semi"
    ).select(*ids)
    marks = listed.unionByName(removed).distinct().withColumn("_planned", F.lit(p.works_code))
    return (
        eps.join(marks, ids, "left")
        .withColumn("noise", F.coalesce("noise", "_planned"))
        .drop("_planned")
    )


def label_year_table(eps: DataFrame) -> DataFrame:
    quiet = F.col("noise").isNull()
    share = lambda c: F.round(F.avg(F.when(quiet, F.col(c).cast("int"))), 3)
    return eps.groupBy("type", year_of("t0").alias("year")).agg(
        F.count_if(quiet).alias("episodes"),
        F.count_if(~quiet).alias("noisy"),
        share("confirmed").alias("confirmed_rate"),
        share("primary").alias("primary_rate"),
    )


def arrival_year_table(openings: DataFrame, visit: DataFrame) -> DataFrame:
    o = openings.groupBy(year_of("us").alias("year")).agg(
        F.count(F.lit(1)).alias("openings"),
        F.count_if(F.col("arrival")).alias("staff"),
        F.round(F.avg(F.col("arrival").cast("int")), 3).alias("staff_share"),
    )
    v = visit.groupBy(year_of("t0").alias("year")).agg(F.count(F.lit(1)).alias("visits"))
    return o.join(v, "year", "full").fillna(0, subset=["openings", "staff", "visits"])


def restart_flags(eps: DataFrame, journal: DataFrame, voc: Vocabulary, p: LabelParams) -> DataFrame:
    """Quiet episodes that began soon after power came back on their object."""
    power = journal.where(any_sign(voc.power_back)).select("object_id", "us")
    quiet = eps.where("noise is null")
    whole_seconds = lambda c: F.floor(F.col(c) / SECOND)
    return (
        asof_join(quiet, power, ["object_id"], "t0", "us", {"us": "power_us"}, how="left")
        .withColumn(
            "restart",
            F.coalesce(whole_seconds("t0") - whole_seconds("power_us") <= p.restart // SECOND, F.lit(False)),
        )
        .drop("power_us")
    )


def restart_stats(flags: DataFrame) -> DataFrame:
    return flags.groupBy("type", year_of("t0").alias("year")).agg(
        F.count(F.lit(1)).alias("episodes"), F.round(F.avg(F.col("restart").cast("int")), 3).alias("restart_share")
    )


def visit_lift(eps: DataFrame, visit: DataFrame, windows: dict[str, int], shift: int = 7 * DAY) -> DataFrame:
    """Share of quiet episodes followed by a visit, against the same moments
    a week earlier and later."""
    at = F.explode(
        F.array(
            F.struct(F.lit("episode").alias("kind"), F.col("t0").alias("t")),
            F.struct(F.lit("background").alias("kind"), (F.col("t0") + shift).alias("t")),
            F.struct(F.lit("background").alias("kind"), (F.col("t0") - shift).alias("t")),
        )
    )
    moments = eps.where("noise is null").select("type", "collector_id", at.alias("m")).select(
        "type", "collector_id", "m.kind", "m.t"
    )
    d = asof_join(
        moments, visit, ["collector_id"], "t", "t0", {"t0": "v"}, direction="forward", strict=True, how="left"
    ).withColumn("gap", F.col("v") - F.col("t"))
    ep, bg = F.col("kind") == "episode", F.col("kind") == "background"
    cols = []
    for name, w in windows.items():
        within = (F.col("gap") <= w).cast("int")
        own, back = F.avg(F.when(ep, within)), F.avg(F.when(bg, within))
        cols += [F.round(own, 3).alias(f"share_{name}"), F.round(own / F.nullif(back, F.lit(0.0)), 2).alias(f"lift_{name}")]
    return d.groupBy("type").agg(F.count_if(ep).alias("episodes"), *cols)


def noise_power_share(triggers: DataFrame, voc: Vocabulary, p: LabelParams) -> DataFrame:
    j = power_gap(triggers, voc, how="left")
    same = F.col("gap") == 0
    near = F.col("gap") <= p.power_before_flood
    return j.groupBy(year_of("us").alias("year")).agg(
        F.count(F.lit(1)).alias("flooded"),
        F.round(F.avg(same.cast("int")), 3).alias("same_moment"),
        F.round(F.avg(near.cast("int")), 3).alias("soon_after"),
    )


def noise_year_table(eps: DataFrame, p: LabelParams) -> DataFrame:
    return eps.groupBy(year_of("t0").alias("year")).agg(
        F.count_if((F.col("type") == "fire") & F.col("noise").isNull()).alias("fire_episodes"),
        F.count_if(F.col("noise") == p.mass_code).alias("mass"),
        F.count_if(F.col("noise") == p.power_code).alias("power"),
    )


def review_sample(eps: DataFrame, triggers: DataFrame, visit: DataFrame, n: int, order: Column | None = None) -> DataFrame:
    """``n`` confirmed quiet episodes per type in hash order, with the first
    trigger and minutes to the visit."""
    pick = eps.where("noise is null and confirmed").withColumn(
        "_o", order if order is not None else F.xxhash64("object_id", "t0")
    )
    w = Window.partitionBy("type").orderBy("_o", "object_id", "t0")
    chosen = pick.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_o", "_r")
    first = triggers.groupBy("object_id", "type", F.col("us").alias("t0")).agg(
        F.min(F.concat_ws(": ", "stype", "what")).alias("first_trigger")
    )
    full = chosen.join(first, ["object_id", "type", "t0"])
    return asof_join(
        full, visit, ["collector_id"], "t0", "t0", {"t0": "v"}, direction="forward", strict=True
    ).select(
        "type",
        "object_id",
        "t0",
        F.round((F.col("t1") - F.col("t0")) / MINUTE).cast("bigint").alias("minutes"),
        "rows",
        "channels",
        "first_trigger",
        F.round((F.col("v") - F.col("t0")) / MINUTE).cast("bigint").alias("visit_after_min"),
    )


def fire_temp_only(eps: DataFrame, triggers: DataFrame, temperature_stype: str) -> DataFrame:
    """Fire episodes all of whose triggers are temperature sensors."""
    fires = eps.where("type = 'fire'").select("object_id", "t0", "t1")
    hits = triggers.where("type = 'fire'").select("object_id", "us", "stype")
    return (
        interval_join(hits, fires, ["object_id"], "us", "t0", "t1", width=HOUR, closed=True)
        .groupBy("object_id", "t0")
        .agg(F.bool_and(F.col("stype") == temperature_stype).alias("_all"))
        .where("_all")
        .select("object_id", "t0")
    )


def service_sessions(guard: DataFrame, limit: int = DAY, width: int = HOUR) -> DataFrame:
    """Pair disarm and arm of an object into sessions no longer than ``limit``.
    A repeated disarm does not move the start unless the open session is
    already older than the limit.

    The disarms between two arms form a block, found by a backward as-of to
    the last arm; the block ends at the next arm.  In a block longer than the
    limit every disarm points at the first one more than the limit later (an
    as-of join in cells of ``width``), and pointers are followed by doubling:
    as many joins as the longest block has binary digits of limits, a row per
    disarm, and no block in one row or task.
    """
    arms = guard.where("armed").select("object_id", F.col("us").alias("arm_us"))
    offs = guard.where("not armed").select("object_id", "collector_id", "us").distinct()
    ended = asof_join(offs, arms, ["object_id"], "us", "arm_us", {"arm_us": "t1"}, direction="forward", strict=True, width=width)
    block = ["object_id", "collector_id", "t1"]
    blocks = ended.groupBy(*block).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    # no start is later than the last disarm
    blocks = settle(blocks.where(F.col("t1") - F.col("last") <= limit))
    short = blocks.where(F.col("last") - F.col("first") <= limit).select(
        "object_id", "collector_id", F.col("first").alias("t0"), "t1"
    )
    long = blocks.where(F.col("last") - F.col("first") > limit)
    most = long.agg(F.max(F.floor((F.col("last") - F.col("first")) / limit))).first()[0]
    if most is None:
        return short.where(F.col("t1") - F.col("t0") <= limit)
    nodes = ended.join(long.select(*block), block, "left_semi").select(*block, "us")
    later = nodes.select(*block, F.col("us").alias("_n"))
    due = nodes.withColumn("_due", F.col("us") + limit)
    step = asof_join(due, later, block, "_due", "_n", {"_n": "to"}, direction="forward", strict=True, width=width).select(*block, "us", "to")
    # the last disarms of a block, without a successor, have no row: pointers stop there
    step = settle(step)
    at = long.select(*block, F.col("first").alias("us"))
    jumps = [step]
    while 2 ** len(jumps) <= most:
        far = jumps[-1].select(*block, F.col("us").alias("to"), F.col("to").alias("_z"))
        jumps.append(settle(jumps[-1].join(far, [*block, "to"]).select(*block, "us", F.col("_z").alias("to"))))
    for jump in reversed(jumps):
        at = at.join(jump, [*block, "us"], "left").select(*block, F.coalesce("to", "us").alias("us"))
    walked = at.select("object_id", "collector_id", F.col("us").alias("t0"), "t1")
    return short.unionByName(walked).where(F.col("t1") - F.col("t0") <= limit)
