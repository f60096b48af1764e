"""Maintenance recommendations for episodes and forecasts.

Everything a rule needs is gathered per episode by joins over the whole set at
once; the rule book is a small table.  An episode is named by (object_id, type,
t0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import DAY, HOUR, MINUTE, SECOND, floor_div, ts_of
from ..operators.interval import interval_join
from ..operators.scan import asof_join

# fixed values of the recommendation rules
SHARE = 0.2  # share of an episode's triggers from which a state is a sign
BURST = 2 * MINUTE
CO = 60 * MINUTE
LINE = 30 * MINUTE
RESTART_MIN = 10
FLASH = 40
OPERATIVE = {"fact": 4, "forecast": 24}
STANDING = 168
SUSTAIN_MIN = 5
CREW = {"none": 0, "specialist": 1, "link": 3, "brigade": 4}
RULE_SCHEMA = (
    "seq int, rule_id string, kind string, type string, sign string, stage string, variant string, mode string, measure string, "
    "work string, due_h int, performer string, crew string, rationale string, source string, checked string"
)
EP = ["object_id", "type", "t0"]


def episode_hits(eps: DataFrame, triggers: DataFrame, upto: int | None = None) -> DataFrame:
    """Triggers of every episode, up to ``upto`` after its start when the
    decision is taken while it lasts."""
    end = F.col("t1") if upto is None else F.least("t1", F.col("t0") + upto)
    e = eps.select(*EP, end.alias("_te"))
    t = triggers.select("object_id", "type", "channel_id", "us", "stype", "what")
    return interval_join(t, e, ["object_id", "type"], "us", "t0", "_te", width=HOUR, closed=True).drop("_te")


def dominant(hits: DataFrame) -> DataFrame:
    """The most frequent (channel, sensor type, state), the earliest on ties."""
    n = hits.groupBy(*EP, "channel_id", "stype", "what").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("f"))
    best = F.max(F.struct(F.col("n"), (-F.col("f")).alias("f"), (-F.col("channel_id")).alias("c"), "stype", "what"))
    return n.groupBy(*EP).agg(best.alias("b")).select(*EP, (-F.col("b.c")).alias("channel_id"), "b.stype", "b.what")


def history(eps: DataFrame, dom: DataFrame, days: int = 30) -> DataFrame:
    """Episodes of the type in the past 30 days, the previous and the next one
    with their dominant channels."""
    j = eps.join(dom, EP, "left")
    w = Window.partitionBy("object_id", "type").orderBy("t0")
    return j.withColumns(
        {
            "k30": F.count(F.lit(1)).over(w.rangeBetween(-days * DAY, -1)),
            "prev_t0": F.lag("t0").over(w),
            "prev_confirmed": F.lag("confirmed").over(w),
            "prev_channel": F.lag("channel_id").over(w),
            "next_t0": F.lead("t0").over(w),
            "next_channel": F.lead("channel_id").over(w),
        }
    )


def pattern_stats(hits: DataFrame) -> DataFrame:
    """Channels, triggers, most per minute, first channel, spread, duration,
    burst, and the states with a fifth of the triggers or more."""
    minute = floor_div(F.col("us"), MINUTE).alias("m")
    cells = hits.groupBy(*EP, "channel_id", "stype", "what", minute).agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("f"), F.max("us").alias("l")
    )
    by_channel = cells.groupBy(*EP, "channel_id").agg(
        F.sum("n").alias("n"), F.min("f").alias("f"), F.max("l").alias("l"), F.max("n").alias("mx")
    )
    start = F.min("f").over(Window.partitionBy(*EP))
    by_channel = by_channel.withColumn("f0", start)
    sec = lambda c: floor_div(c, SECOND)
    shape = by_channel.groupBy(*EP).agg(
        F.count(F.lit(1)).alias("nch"),
        F.sum("n").alias("ntr"),
        F.max("mx").alias("mx"),
        F.min(F.struct("f", "channel_id"))["channel_id"].alias("first_channel"),
        ((sec(F.max("f")) - sec(F.min("f"))) / 60.0).alias("spread_min"),
        ((sec(F.max("l")) - sec(F.min("f"))) / 60.0).alias("dur_min"),
        F.count_if(F.col("f") <= F.col("f0") + BURST).alias("burst"),
    )
    states = cells.groupBy(*EP, "stype", "what").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*EP))
    seen = states.withColumn("_s", share).where(F.col("_s") >= SHARE)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "stype", "what")))
    signs = seen.groupBy(*EP).agg(F.transform(ordered, lambda x: F.struct(x["stype"].alias("stype"), x["what"].alias("what"))).alias("trgs"))
    return shape.join(signs, EP, "left")


def co_types(eps: DataFrame, span: int = CO, upto: int | None = None) -> DataFrame:
    """Other incident types on the object around the start."""
    after = span if upto is None else min(span, upto)
    spans = eps.select(*EP, (F.col("t0") - span).alias("_a"), (F.col("t0") + after).alias("_b"))
    other = eps.select("object_id", F.col("type").alias("_type"), F.col("t0").alias("_t"))
    hit = interval_join(other, spans, ["object_id"], "_t", "_a", "_b", width=span, closed=True)
    return hit.where(F.col("_type") != F.col("type")).groupBy(*EP).agg(F.sort_array(F.collect_set("_type")).alias("co_types"))


def line_count(eps: DataFrame, span: int = LINE, upto: int | None = None) -> DataFrame:
    """Other objects of the collector with the same type around the start."""
    after = span if upto is None else min(span, upto)
    spans = eps.select(*EP, "collector_id", (F.col("t0") - span).alias("_a"), (F.col("t0") + after).alias("_b"))
    other = eps.select(F.col("object_id").alias("_o"), "collector_id", "type", F.col("t0").alias("_t"))
    hit = interval_join(other, spans, ["collector_id", "type"], "_t", "_a", "_b", width=span, closed=True)
    return hit.where(F.col("_o") != F.col("object_id")).groupBy(*EP).agg(F.count_distinct("_o").alias("line_n"))


def day_before(eps: DataFrame, hours: DataFrame, out: Column, name: str) -> DataFrame:
    """Aggregate hourly rows (object_id, us) of the 24 hours before the start."""
    spans = eps.select(*EP, (F.col("t0") - DAY).alias("_a"), F.col("t0").alias("_b"))
    hit = interval_join(hours, spans, ["object_id"], "us", "_a", "_b", width=DAY, closed=True)
    return hit.groupBy(*EP).agg(out.alias(name))


def context(
    eps: DataFrame, triggers: DataFrame, journal: DataFrame, guard: DataFrame, switches: Column, cold: Column, power: Column,
    upto: int | None = None,
) -> DataFrame:
    """Everything the rules look at, for every quiet episode."""
    quiet = eps.where("noise is null")
    hits = episode_hits(quiet, triggers, upto)
    h = history(quiet, dominant(hits))
    hour_us = (floor_div(F.col("us"), HOUR) * F.lit(HOUR)).alias("us")
    pump = journal.where(switches).groupBy("object_id", hour_us).agg(F.count(F.lit(1)).alias("n"))
    low = journal.where(cold).groupBy("object_id", hour_us).agg(F.lit(1).alias("n"))
    j = (
        h.join(pattern_stats(hits), EP, "left")
        .join(co_types(quiet, upto=upto), EP, "left")
        .join(line_count(quiet, upto=upto), EP, "left")
        .join(day_before(quiet, pump, F.max("n"), "flash_n"), EP, "left")
        .join(day_before(quiet, low, F.count(F.lit(1)), "_cold"), EP, "left")
        .withColumn("cold", F.coalesce(F.col("_cold") > 0, F.lit(False)))
        .drop("_cold")
        .fillna(0, subset=["line_n"])
    )
    j = asof_join(j, guard, ["object_id"], "t0", "us", {"us": "guard_us", "armed": "armed"}, how="left")
    j = asof_join(j, journal.where(power).select("object_id", "us"), ["object_id"], "t0", "us", {"us": "power_us"}, how="left")
    minutes = lambda c: floor_div(F.col("t0"), MINUTE) - floor_div(F.col(c), MINUTE)
    return j.withColumn("guard_min", minutes("guard_us")).withColumn("restart", minutes("power_us") <= RESTART_MIN).drop("guard_us", "power_us")


def flags(ctx: DataFrame, disconnected: str) -> DataFrame:
    """The twelve conditions as columns and as a sorted array ``on``."""
    tp, c = F.col("type"), F.col
    recent = c("prev_t0").isNotNull() & (c("t0") - c("prev_t0") < 30 * DAY)
    off, t = c("armed") == False, ts_of("t0")  # noqa: E712
    work = (F.weekday(t) < 5) & F.hour(t).between(8, 16)
    tests = {
        "same_channel": recent & (c("channel_id") == c("prev_channel")),
        "other_channel": recent & (c("channel_id") != c("prev_channel")),
        "after_visit": recent & c("prev_confirmed"),
        "line_wide": (tp == "equipment") & (c("line_n") >= 1),
        "pump_flasher": (tp == "equipment") & (c("flash_n") >= FLASH),
        "spring": (tp == "flood") & F.month(t).isin(4, 5, 6),
        "cold": tp.isin("fire", "sensor", "flood") & c("cold"),
        "restart": tp.isin("gas", "equipment", "flood") & c("restart"),
        "disconnected": c("what") == disconnected,
        "planned_check": (tp == "gas") & off & work,
        "guard_on": (tp == "gas") & c("armed"),
        "staff_on_site": ~tp.isin("intrusion", "gas") & off,
    }
    safe = {f"f_{k}": F.coalesce(v, F.lit(False)) for k, v in tests.items()}
    names = F.array_compact(F.array(*[F.when(v, F.lit(k[2:])) for k, v in safe.items()]))
    return ctx.select("*", *[v.alias(k) for k, v in safe.items()], F.sort_array(names).alias("on"))


def stage(k30: Column, after_visit: Column) -> Column:
    return F.when(k30 >= 10, "R3").when((k30 >= 3) | ((k30 >= 1) & after_visit), "R2").when(k30 >= 1, "R1").otherwise("R0")


def pattern(since: Column) -> Column:
    """How the episode behaved; the first description that fits."""
    c = F.col
    return (
        F.when(F.coalesce(since, F.lit(0)) >= STANDING, "standing")
        .when(c("nch").isNull(), None)
        .when((c("nch") >= 3) & (c("burst") >= 3), "mass")
        .when((c("nch") >= 2) & (c("spread_min") >= 5), "spreading")
        .when(c("mx") >= 3, "chatter")
        .when((c("dur_min") < 1) & (c("nch") == 1) & (c("ntr") <= 2), "fleeting")
        .when(c("dur_min") >= SUSTAIN_MIN, "sustained")
        .otherwise("short")
    )


def signs(ctx: DataFrame, by_state: DataFrame, by_type: DataFrame) -> DataFrame:
    """Signs of every episode in order: (sensor type, state) to a sign, else by
    (incident type, sensor type), else a default.  Episodes without triggers
    use the reasons of the forecast.  ``by_state``: stype, what, sign;
    ``by_type``: type, stype, sign."""
    x = ctx.select(*EP, F.posexplode("trgs").alias("i", "x")).select(*EP, "i", "x.stype", "x.what")
    j = x.join(by_state.withColumnRenamed("sign", "_a"), ["stype", "what"], "left").join(
        by_type.withColumnRenamed("sign", "_b"), ["type", "stype"], "left"
    )
    other = F.when(F.col("type") == "sensor", "other_fault").otherwise("forecast")
    one = j.withColumn("sign", F.coalesce("_a", "_b", other)).groupBy(*EP, "sign").agg(F.min("i").alias("i"))
    got = one.groupBy(*EP).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "sign"))), lambda s: s["sign"]).alias("signs"))
    return ctx.join(got, EP, "left").withColumn("signs", F.coalesce("signs", F.array(F.lit("forecast"))))


def reason_signs(wanted: DataFrame, reasons: DataFrame, rules: DataFrame) -> DataFrame:
    """Reasons of a forecast as signs the type has measures for, in the
    model's order.  ``wanted``: object_id, type, reasons (array of feature
    names, ``type:name`` for one type only); ``reasons``: base, sign."""
    r = wanted.select("object_id", "type", F.posexplode("reasons").alias("i", "f"))
    own = F.regexp_extract("f", "^([a-z]+):", 1)
    r = r.where((own == "") | (own == F.col("type"))).withColumn("base", F.regexp_replace(F.regexp_replace("f", "^[a-z]+:", ""), "_[0-9]+h$", ""))
    have = rules.where("kind = 'measure'").select("type", "sign").distinct()
    j = r.join(reasons, "base").join(have, ["type", "sign"], "left_semi")
    one = j.groupBy("object_id", "type", "sign").agg(F.min("i").alias("i"))
    return one.groupBy("object_id", "type").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "sign"))), lambda s: s["sign"]).alias("signs")
    )


def match(ctx: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (episode, matching rule) with its place in the order.

    ``ctx`` has EP, mode, signs, on, stage, pattern, co_types.  Hypotheses
    (adjustments, patterns, combinations of variant A) come first, then
    measures against repeats, then the measures of the signs: all variants of
    the first sign that has measures, variant A of the others.
    """
    c = ctx.select(*EP, "mode", "signs", "on", "stage", "pattern", F.coalesce("co_types", F.array().cast("array<string>")).alias("co"))
    fits = F.col("r.mode").isin("both") | (F.col("r.mode") == F.col("e.mode"))
    mine = (F.col("r.type") == F.col("e.type")) | (F.col("r.type") == "*")
    cols = [F.col(f"r.{x}").alias(x) for x in rules.columns if x not in ("type", "stage", "mode")]
    keys = [F.col(f"e.{k}").alias(k) for k in EP] + [F.col("e.mode").alias("mode")]

    # the rule book is small and has no growing side: rules meet episodes by
    # kind and type through an equi join on the type they apply to
    book = rules.withColumn("_for", F.when(F.col("type") == "*", F.array(*[F.lit(t) for t in TYPES])).otherwise(F.array("type")))
    book = book.withColumn("_t", F.explode("_for")).drop("_for")
    e, r = c.alias("e"), book.alias("r")
    j = e.join(r, (F.col("e.type") == F.col("r._t")) & fits & mine)

    kind, sign, variant = F.col("r.kind"), F.col("r.sign"), F.col("r.variant")
    rank = F.array_position("e.signs", sign)
    hypo = (
        F.when((kind == "adjust") & F.array_contains("e.on", sign), 1)
        .when((kind == "pattern") & (sign == F.col("e.pattern")), 2)
        .when((kind == "combo") & F.array_contains("e.co", sign) & (F.col("r.type") != "*"), 3)
    )
    repeat = (kind == "repeat") & ((F.col("r.stage") == "*") | (F.col("r.stage") == F.col("e.stage"))) & (
        (sign == "*") | F.array_contains("e.on", sign)
    )
    measure = (kind == "measure") & (F.col("r.type") != "*")
    m = j.select(
        *keys, *cols, F.col("r.type").alias("rule_type"), F.col("r.stage").alias("rule_stage"),
        F.when(hypo.isNotNull(), hypo).when(repeat, F.when(variant == "A", 4).otherwise(5)).when(measure & (rank > 0), 6)
        .when(measure & (sign == "forecast"), 7).alias("grp"),
        rank.alias("rank"),
    ).where(F.col("grp").isNotNull())

    # a rule of the type displaces the general one with the same sign and stage
    own = F.max((F.col("rule_type") != "*").cast("int")).over(Window.partitionBy(*EP, "kind", "sign", "rule_stage"))
    m = m.withColumn("_own", own).where((F.col("kind") != "repeat") | (F.col("rule_type") != "*") | (F.col("_own") == 0)).drop("_own")
    # the first sign with measures gives all variants, the others variant A;
    # forecast measures serve only episodes whose signs have none
    ep = Window.partitionBy(*EP)
    main = F.min(F.when(F.col("grp") == 6, F.col("rank"))).over(ep)
    m = m.withColumn("_main", main)
    keep = (
        F.when(F.col("grp") == 6, (F.col("rank") == F.col("_main")) | (F.col("variant") == "A"))
        .when(F.col("grp") == 7, F.col("_main").isNull())
        .otherwise(F.lit(True))
    )
    note = (F.col("variant") == "+") & (F.col("grp") < 6)
    useful = (F.col("grp") <= 3) & (F.col("variant") == "A") | (F.col("grp").isin(4, 5) & (F.col("variant") != "+")) | (F.col("grp") >= 6)
    place = F.struct("grp", F.coalesce("rank", F.lit(0)).alias("rank"), F.when(F.col("grp") == 6, F.col("variant")).otherwise("").alias("v"), "seq")
    return m.where(keep).select("*", note.alias("note"), useful.alias("useful"), place.alias("place")).drop("_main")


TYPES = ("fire", "gas", "flood", "equipment", "sensor", "intrusion")


def with_crew(matched: DataFrame) -> DataFrame:
    """People a measure takes; while gas burns any descent is gas work, so a
    link becomes a brigade."""
    crew = F.when((F.col("type") == "gas") & (F.col("mode") == "fact") & (F.col("crew") == "link"), "brigade").otherwise(F.col("crew"))
    people = F.lit(None).cast("int")
    for k, n in CREW.items():
        people = F.when(F.col("crew") == k, F.lit(n)).otherwise(people)
    m = matched.withColumn("crew", crew)
    limit = F.when(F.col("mode") == "fact", OPERATIVE["fact"]).otherwise(OPERATIVE["forecast"])
    return m.withColumn("people", people).withColumn("operative", F.col("due_h") <= limit)


def assemble(matched: DataFrame) -> DataFrame:
    """Operative and maintenance blocks as ordered arrays, notes apart."""
    m = with_crew(matched)
    item = F.struct("rule_id", "variant", "sign", "measure", "due_h", "performer", "crew", "people")
    early = F.struct(F.col("due_h").alias("d"), F.col("place").alias("p"), item.alias("x"))
    order = F.struct(F.lit(0).alias("d"), F.col("place").alias("p"), item.alias("x"))
    pick = lambda cond, key: F.transform(F.sort_array(F.collect_list(F.when(cond, key))), lambda s: s["x"])
    use = F.col("useful")
    return m.groupBy(*EP, "mode").agg(
        pick(use & F.col("operative"), early).alias("now"),
        pick(use & ~F.col("operative"), order).alias("maintenance"),
        pick(F.col("note") & F.col("due_h").isNotNull(), order).alias("notes"),
    )


def visit(recs: DataFrame) -> DataFrame:
    """One visit for the main operative measures: the largest crew, the
    earliest hour, all performers; ``after_check`` when something without a
    visit may clear the alarm first."""
    go = F.filter("now", lambda m: (m["people"] > 0) & (m["variant"] == "A"))
    r = recs.withColumn("_go", go)
    first = F.array_min(F.transform("_go", lambda m: m["due_h"]))
    most = F.array_max(F.transform("_go", lambda m: m["people"]))
    big = F.try_element_at(F.filter("_go", lambda m: m["people"] == F.col("_most")), F.lit(1))
    r = r.withColumn("_first", first).withColumn("_most", most)
    check = F.exists("now", lambda m: (m["people"] == 0) & (m["variant"] == "A") & (m["due_h"] < F.col("_first")))
    out = F.struct(
        big["crew"].alias("crew"), F.col("_most").alias("people"), F.col("_first").alias("due_h"),
        F.sort_array(F.array_distinct(F.transform("_go", lambda m: m["performer"]))).alias("performers"),
        F.transform("_go", lambda m: m["rule_id"]).alias("measures"), check.alias("after_check"),
    )
    return r.withColumn("visit", F.when(F.size("_go") > 0, out)).drop("_go", "_first", "_most")


def compose(recs: DataFrame) -> DataFrame:
    """Recommendations of several types of one object as one: measures once by
    (rule, measure), operative ones by hour."""
    def flat(block: str) -> DataFrame:
        x = recs.select("object_id", "type", F.posexplode(block).alias("i", "m")).select("object_id", "type", "i", "m.*")
        w = Window.partitionBy("object_id", "rule_id", "measure").orderBy("type", "i")
        return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def gather(block: str, by: list[str]) -> DataFrame:
        item = F.struct("type", "rule_id", "variant", "sign", "measure", "due_h", "performer", "crew", "people")
        s = F.sort_array(F.collect_list(F.struct(*by, item.alias("x"))))
        return flat(block).groupBy("object_id").agg(F.transform(s, lambda v: v["x"]).alias(block))

    types = recs.groupBy("object_id").agg(F.sort_array(F.collect_set("type")).alias("types"))
    both = types.join(gather("now", ["due_h", "type", "i"]), "object_id", "left").join(gather("maintenance", ["type", "i"]), "object_id", "left")
    return visit(both)


def recurrence_stats(h: DataFrame) -> DataFrame:
    """Repeats within 7 and 30 days and the median pause by type and stage."""
    k = F.col("k30")
    st = F.when(k == 0, "R0").when(k <= 2, "R1").when(k <= 9, "R2").otherwise("R3")
    within = lambda d: F.avg((F.col("next_t0") <= F.col("t0") + d * DAY).cast("int"))
    pause = (floor_div(F.col("next_t0"), MINUTE) - floor_div(F.col("t0"), MINUTE)) / 1440.0
    return h.groupBy("type", st.alias("stage")).agg(
        F.count(F.lit(1)).alias("episodes"), within(7).alias("p7"), within(30).alias("p30"), F.percentile(pause, 0.5).alias("median_days")
    )


def retro_first(recs: DataFrame) -> DataFrame:
    """Which rule leads each block, by type."""
    first = lambda b: F.coalesce(F.try_element_at(F.col(b), F.lit(1))["rule_id"], F.lit("-"))
    one = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), first(b).alias("rule")) for b in ("now", "maintenance")])).alias("f")
    return recs.select("type", one).select("type", "f.*").groupBy("type", "block", "rule").agg(F.count(F.lit(1)).alias("episodes"))


def retro_outcome(ctx: DataFrame, by: list[str]) -> DataFrame:
    """Visits and repeats that followed, by any grouping of the episodes."""
    repeat = F.coalesce(F.col("next_t0") - F.col("t0") < 7 * DAY, F.lit(False))
    same = F.coalesce((F.col("next_t0") - F.col("t0") < 30 * DAY) & (F.col("next_channel") == F.col("channel_id")), F.lit(False))
    return ctx.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(F.col("confirmed").cast("int")).alias("visited"),
        F.avg(repeat.cast("int")).alias("repeat_7d"), F.avg(same.cast("int")).alias("same_channel_next"),
    )


def retro_sizes(recs: DataFrame, ctx: DataFrame) -> DataFrame:
    """Mean signs and measures per recommendation, by type."""
    j = recs.join(ctx.select(*EP, "signs"), EP)
    return j.groupBy("type").agg(
        F.avg(F.size("signs")).alias("signs"), F.avg(F.size("now")).alias("now"), F.avg(F.size("maintenance")).alias("maintenance"),
        F.avg((F.size("signs") >= 2).cast("int")).alias("many_signs"),
    )
