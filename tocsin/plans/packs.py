"""Feature packs beside the mart: sensor pairs, spread, weather, fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import Sign, first_match
from ..functions.timebase import hour_of
from ..operators import grid as G

PAIR_HOURS = 6
PAIR_PICKETS = 5


def active_hours(journal: DataFrame, pickets: DataFrame, families: list[tuple[str, Sign]]) -> DataFrame:
    """Distinct (object, channel, picket, family, hour) of activations."""
    return (
        journal.where(F.col("state").isNotNull())
        .select("object_id", "channel_id", hour_of("us").alias("h"), first_match(families).alias("fam"))
        .where(F.col("fam").isNotNull())
        .distinct()
        .join(pickets.select("channel_id", "pk"), "channel_id")
    )


def pair_name(pair: tuple[str, str, str]) -> str:
    return "_".join(pair)


def channel_states(act: DataFrame, families: list[str], hours: int = PAIR_HOURS) -> DataFrame:
    """One row per (object, hour, channel) that fired in the hour or the ``hours``
    before it: bit i of ``now`` and of ``recent`` says that family i did."""
    bit = F.lit(None).cast("bigint")
    for i, f in enumerate(families):
        bit = F.when(F.col("fam") == f, F.lit(1 << i).cast("bigint")).otherwise(bit)
    own = act.where(F.col("fam").isin(*families)).groupBy("object_id", "pk", "channel_id", "h").agg(F.bit_or(bit).alias("_m"))
    later = F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("_o")
    now = F.when(F.col("_o") == 0, F.col("_m")).otherwise(F.lit(0).cast("bigint"))
    spread = own.select("object_id", "pk", "channel_id", "_m", "h", later).select("object_id", "pk", "channel_id", (F.col("h") + F.col("_o")).alias("h"), "_m", now.alias("_n"))
    return spread.groupBy("object_id", "h", "pk", "channel_id").agg(F.bit_or("_n").alias("now"), F.bit_or("_m").alias("recent"))


def pair_counters(act: DataFrame, pairs: list[tuple[str, str, str]], hours: int = PAIR_HOURS, near: int = PAIR_PICKETS) -> DataFrame:
    """All pair counters in one pass: ``object_id``, ``h`` and for every pair
    (type, a, b) the number of distinct channel pairs of which one fired as a,
    the other as b, at most ``near`` pickets and ``hours`` apart; known at the
    later hour.  Rows where a counter is above 0.

    Pairs are counted, neither listed nor joined.  With R "fired recently" and S
    "recently, but not now", channels x and y make a pair read one way if
    ``Ra(x) Rb(y) - Sa(x) Sb(y)`` is 1, and a pair read both ways is one pair.
    Both are sums of products of something about x and something about y, so
    counts per picket, their sums over the neighbouring pickets and one product
    a picket give every counter.  A channel of both families makes no pair with
    itself.  An (object, hour) is one row per picket, whatever its channels.
    """
    families = list(dict.fromkeys(f for _, *two in pairs for f in two))
    states = channel_states(act, families, hours)
    at = {f: 1 << i for i, f in enumerate(families)}
    recent = lambda f: F.col("recent").bitwiseAND(F.lit(at[f])) > 0
    stale = lambda f: recent(f) & (F.col("now").bitwiseAND(F.lit(at[f])) == 0)
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    sums = {}
    for f in families:
        sums[f"R_{f}"], sums[f"S_{f}"] = count(recent(f)), count(stale(f))
    for a, b in dict.fromkeys((a, b) for _, a, b in pairs if a != b):
        sums[f"RR_{a}_{b}"] = count(recent(a) & recent(b))
        sums[f"RS_{a}_{b}"] = count(recent(a) & stale(b))
        sums[f"SR_{a}_{b}"] = count(stale(a) & recent(b))
        sums[f"SS_{a}_{b}"] = count(stale(a) & stale(b))
    pickets = states.groupBy("object_id", "h", "pk").agg(*[c.alias(n) for n, c in sums.items()])
    around = Window.partitionBy("object_id", "h").orderBy("pk").rangeBetween(-near, near)
    met = lambda mine, others: F.col(mine) * F.sum(others).over(around)

    def counted(a: str, b: str) -> Column:
        one_way = met(f"R_{a}", f"R_{b}") - met(f"S_{a}", f"S_{b}")
        if a == b:
            return (one_way - F.col(f"R_{a}") + F.col(f"S_{a}")) / 2
        rr, rs, sr, ss = (f"{x}_{a}_{b}" for x in ("RR", "RS", "SR", "SS"))
        alone = F.col(rr) - F.col(ss)
        both = met(rr, rr) - 2 * met(rs, sr) + met(ss, ss)
        return one_way - alone - (both - alone) / 2

    names = [pair_name(p) for p in pairs]
    each = pickets.select("object_id", "h", *[counted(a, b).alias(n) for n, (_, a, b) in zip(names, pairs)])
    # a half may belong to each of two pickets: whole numbers come after the sum
    whole = each.groupBy("object_id", "h").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
    return whole.where(F.greatest(*names, F.lit(0)) > 0)


def pair_hours(act: DataFrame, pairs: list[tuple[str, str, str]], hours: int = PAIR_HOURS, near: int = PAIR_PICKETS) -> DataFrame:
    """The counters of ``pair_counters`` as rows ``object_id, h, pair, n`` with
    n above 0."""
    wide = pair_counters(act, pairs, hours, near)
    cells = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(n).alias("n")) for n in map(pair_name, pairs)])
    return wide.select("object_id", "h", F.inline(cells)).where("n > 0")


def pair_features(act: DataFrame, pairs: list[tuple[str, str, str]], objects: DataFrame, lo: int, hi: int, windows=(6, 24, 168)) -> DataFrame:
    """Trailing sums of every pair counter; rows only where some window is not
    empty."""
    names = [pair_name(p) for p in pairs]
    hours = F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi - 1).cast("bigint")))
    grid = objects.select("object_id").withColumn("h", hours).join(pair_counters(act, pairs), ["object_id", "h"], "left").fillna(0, subset=names)
    sums = G.trailing_sums(grid, ["object_id"], {n: list(windows) for n in names}, name="co_{c}_{w}h").drop(*names)
    longest = [F.col(f"co_{n}_{max(windows)}h") for n in names]
    return sums.where(F.greatest(*longest, F.lit(0.0)) > 0)


def spread_features(act: DataFrame, fam: str, hours: int) -> DataFrame:
    """Distinct channels of a family in the trailing hours and the pickets they
    span.  A channel collapses to one row per (object, hour) before counting."""
    f = act.where(F.col("fam") == fam).select("object_id", "channel_id", "pk", "h")
    seen = f.withColumn("h", F.explode(F.sequence(F.col("h"), F.col("h") + hours - 1))).distinct()
    return seen.groupBy("object_id", "h").agg(
        F.count(F.lit(1)).alias(f"sp_{fam}_nch_{hours}h"), (F.max("pk") - F.min("pk")).alias(f"sp_{fam}_span_{hours}h")
    )


def pair_rule_scores(mart: DataFrame, pairs: DataFrame, single: str, families: list[tuple[str, str]], near: list[str]) -> DataFrame:
    """Three rules as scores: the single trigger, two families anywhere on the
    object, and a pair close by."""
    joined = mart.join(pairs, ["object_id", "h"], "left").fillna(0, subset=near)
    zero = F.lit(0.0)
    two = F.greatest(*[F.least(F.col(x), F.col(y)).cast("double") for x, y in families], zero)
    close = F.greatest(*[F.col(c).cast("double") for c in near], zero)
    rules = F.explode(
        F.array(
            F.struct(F.lit("single").alias("rule"), F.col(single).cast("double").alias("p")),
            F.struct(F.lit("two families").alias("rule"), two.alias("p")),
            F.struct(F.lit("near pair").alias("rule"), close.alias("p")),
        )
    )
    return joined.select("object_id", "h", "next", rules.alias("r")).select("object_id", "h", "next", "r.*")


# ---- weather: one series per place, one row per hour ------------------------------


def weather_series(raw: DataFrame, fields: list[str]) -> DataFrame:
    """Documents ``{place, hourly: {h: [...], <field>: [...]}}`` to rows, gaps
    filled with the value before."""
    zipped = F.explode(F.arrays_zip(F.col("hourly.h").alias("h"), *[F.col(f"hourly.{f}").alias(f) for f in fields])).alias("z")
    rows = raw.select("place", zipped).select("place", F.col("z.h").alias("h"), *[F.col(f"z.{f}").cast("double").alias(f) for f in fields])
    one = rows.groupBy("place", "h").agg(*[F.max(f).alias(f) for f in fields])
    return one.select("place", "h", *[G.last_known(f, ["place"]).alias(f) for f in fields])


def day_off(years: DataFrame, start_h: Column) -> DataFrame:
    """Year strings of 0/1 days to rows per hour.  ``years``: place, start_h
    (first hour of the year), days (text)."""
    d = years.select("place", start_h.alias("_s"), F.posexplode(F.split("days", "")).alias("d", "c")).where(F.col("c") != "")
    hour = F.explode(F.sequence(F.lit(0), F.lit(23)))
    return d.select("place", "_s", "d", "c", hour.alias("o")).select(
        "place", (F.col("_s") + F.col("d") * 24 + F.col("o")).cast("bigint").alias("h"), (F.col("c") == "1").cast("double").alias("dayoff")
    )


def river_lag(days: DataFrame) -> DataFrame:
    """Daily flow to hours, a day late: today's is not known yet.  ``days``:
    place, day (index), flow."""
    hour = F.explode(F.sequence(F.lit(0), F.lit(23)))
    return days.select("place", "flow", ((F.col("day") + 1) * 24).alias("_h"), hour.alias("o")).select(
        "place", (F.col("_h") + F.col("o")).cast("bigint").alias("h"), F.col("flow").cast("double").alias("river")
    )


PLACE = ["place"]


def ago(c: str, hours: int) -> Column:
    return F.lag(c, hours).over(G.track(PLACE))


def ext(fn, c: str, hours: int) -> Column:
    return G.trailing_extreme(fn, c, hours, PLACE)


def weather_base(s: DataFrame, rain: float = 0.1) -> DataFrame:
    """Temperature, precipitation and pressure features of a dense series."""
    sign = F.signum("temp")
    s = s.withColumns(
        {
            "cross": F.coalesce((sign != F.lag(sign).over(G.track(PLACE))).cast("double"), F.lit(0.0)),
            "warm": F.greatest(F.col("temp"), F.lit(0.0)),
            "cold": F.greatest(-F.col("temp"), F.lit(0.0)),
        }
    )
    plan = {"temp": [24, 168], "cross": [72], "warm": [72], "cold": [168], "prec": [6, 24, 72, 168, 720]}
    w = G.trailing_sums(s, PLACE, plan, name="_{c}_{w}")
    return w.select(
        "place",
        "h",
        F.col("temp").alias("wx_temp"),
        F.col("press").alias("wx_press"),
        F.col("prec").alias("wx_prec_1h"),
        *[(F.col(f"_temp_{x}") / x).alias(f"wx_temp_mean_{x}h") for x in (24, 168)],
        ext(F.min, "temp", 24).alias("wx_temp_min_24h"),
        ext(F.max, "temp", 24).alias("wx_temp_max_24h"),
        (F.col("temp") - ago("temp", 24)).alias("wx_temp_delta_24h"),
        F.col("_cross_72").alias("wx_cross0_72h"),
        F.col("_warm_72").alias("wx_thaw_72h"),
        F.col("_cold_168").alias("wx_frost_168h"),
        *[F.col(f"_prec_{x}").alias(f"wx_prec_{x}h") for x in (6, 24, 72, 168, 720)],
        ext(F.max, "prec", 24).alias("wx_prec_max1h_24h"),
        G.since_last(F.col("prec") >= rain, PLACE, 2160).alias("wx_since_rain"),
        *[(F.col("press") - ago("press", d)).alias(f"wx_press_delta_{d}h") for d in (3, 24)],
        ext(F.min, "press", 24).alias("wx_press_min_24h"),
    )


def weather_ext(s: DataFrame) -> DataFrame:
    """Snow, soil, gusts, river, heating season."""
    warm = F.greatest(F.col("temp"), F.lit(0.0))
    w = G.trailing_sums(s.withColumn("warm", warm), PLACE, {"temp": [120], "warm": [72]}, name="_{c}_{w}")
    w = w.withColumn("heat", (F.col("_temp_120") / 120 < 8).cast("double"))
    w = w.withColumn("turn", F.coalesce((F.col("heat") != ago("heat", 1)).cast("double"), F.lit(0.0)))
    w = G.trailing_sums(w, PLACE, {"turn": [720]}, name="_{c}_{w}")
    delta = lambda c, d: F.col(c) - ago(c, d)
    return w.select(
        "place",
        "h",
        *[F.col(c).alias(f"wx_{c}") for c in ("snow", "soil0", "soil28", "gust", "river")],
        ext(F.max, "snow", 168).alias("wx_snow_max_168h"),
        *[F.greatest(-delta("snow", d), F.lit(0.0)).alias(f"wx_snow_melt_{d}h") for d in (24, 72)],
        delta("soil0", 24).alias("wx_soil0_delta_24h"),
        delta("soil28", 168).alias("wx_soil28_delta_168h"),
        ext(F.max, "soil0", 168).alias("wx_soil0_max_168h"),
        *[ext(F.max, "gust", x).alias(f"wx_gust_max_{x}h") for x in (24, 72)],
        *[delta("river", d).alias(f"wx_river_delta_{d}h") for d in (24, 168)],
        ext(F.max, "river", 720).alias("wx_river_max_720h"),
        F.col("heat").alias("wx_heating"),
        F.col("_turn_720").alias("wx_heating_switch_720h"),
        (F.least("snow", F.lit(0.5)) * F.col("_warm_72")).alias("wx_melt_index"),
    )


def weather_hum(s: DataFrame) -> DataFrame:
    """Condensation on walls that keep the month's mean, humidity, days off."""
    w = G.trailing_sums(s, PLACE, {"temp": [720]}, name="_{c}_{w}")
    w = w.withColumn("wall", F.col("_temp_720") / 720).withColumn("cond", F.col("dew") - F.col("wall"))
    w = w.withColumn("wet", (F.col("cond") > 0).cast("double"))
    back = (F.col("dayoff") == 0) & (ago("dayoff", 24) == 1)
    w = w.withColumn("back", F.coalesce(back.cast("double"), F.lit(0.0)))
    w = G.trailing_sums(w, PLACE, {"wet": [24, 72, 168], "rh": [24], "vpd": [24], "rad": [24], "dayoff": [72], "back": [24]}, name="_{c}_{w}")
    return w.select(
        "place",
        "h",
        *[F.col(c).alias(f"wx_{c}") for c in ("rh", "dew", "rad", "vpd", "cond", "wall")],
        *[F.col(f"_wet_{x}").alias(f"wx_cond_hours_{x}h") for x in (24, 72, 168)],
        ext(F.max, "cond", 24).alias("wx_cond_max_24h"),
        (F.col("_rh_24") / 24).alias("wx_rh_mean_24h"),
        ext(F.max, "rh", 24).alias("wx_rh_max_24h"),
        (F.col("_vpd_24") / 24).alias("wx_vpd_mean_24h"),
        ext(F.max, "vpd", 72).alias("wx_vpd_max_72h"),
        F.col("_rad_24").alias("wx_rad_24h"),
        F.col("dayoff").alias("wx_dayoff"),
        F.col("_dayoff_72").alias("wx_dayoff_run"),
        F.col("_back_24").alias("wx_back_to_work"),
    )


POLLUTANTS = ("co", "no2", "so2", "pm10", "pm25")
STAGNANT = ("co", "no2", "so2", "pm10")


def weather_air(s: DataFrame) -> DataFrame:
    """Excess of each pollutant over its own weekly base, agreement of four,
    share of fine dust."""
    w = G.trailing_sums(s, PLACE, {k: [168] for k in POLLUTANTS}, name="_{c}_{w}")
    w = w.withColumns({f"{k}_base": F.col(f"_{k}_168") / 168 for k in POLLUTANTS})
    over = lambda k: F.when(F.col(f"{k}_base") > 0, F.col(k) / F.col(f"{k}_base")).otherwise(F.lit(1.0)) - 1
    w = w.withColumns({f"{k}_over": over(k) for k in POLLUTANTS})
    w = w.withColumns({f"{k}_high": (F.col(f"{k}_over") > 0.25).cast("double") for k in POLLUTANTS})
    w = G.trailing_sums(w, PLACE, {f"{k}_high": [24, 72] for k in POLLUTANTS}, name="{c}_{w}h")
    mean = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    out = [F.col("place"), F.col("h")]
    for k in POLLUTANTS:
        out += [F.col(k).alias(f"aq_{k}"), F.col(f"{k}_base").alias(f"aq_{k}_base"), F.col(f"{k}_over").alias(f"aq_{k}_over")]
        out += [ext(F.max, f"{k}_over", 24).alias(f"aq_{k}_over_max_24h")]
        out += [F.col(f"{k}_high_{x}h").alias(f"aq_{k}_high_{x}h") for x in (24, 72)]
    return w.select(
        *out,
        mean([f"{k}_over" for k in STAGNANT]).alias("aq_all_over"),
        mean([f"{k}_high_24h" for k in STAGNANT]).alias("aq_all_high_24h"),
        F.when(F.col("pm10") > 0, F.col("pm25") / F.col("pm10")).otherwise(0.0).alias("aq_fine_share"),
    )


# ---- fleet: one series over all objects ---------------------------------------------


def fleet_series(grid: DataFrame, types) -> DataFrame:
    """Episodes and objects with episodes over the whole fleet, and the excess
    of a day over the week's daily mean.  One row per hour of the period."""
    on = lambda t: F.col(f"onset_{t}")
    total = grid.groupBy("h").agg(
        *[F.sum(on(t)).alias(f"n_{t}") for t in types],
        *[F.count_if(on(t) > 0).alias(f"o_{t}") for t in types],
        F.sum("n_events").alias("events"),
    )
    total = total.withColumn("n_any", sum((F.col(f"n_{t}") for t in types), F.lit(0)))
    total = total.withColumn("o_any", sum((F.col(f"o_{t}") for t in types), F.lit(0))).withColumn("fleet", F.lit(0))
    plan = {f"n_{t}": [6, 24] for t in types} | {f"o_{t}": [24] for t in types}
    plan |= {"n_any": [24, 168], "o_any": [24], "events": [24]}
    w = G.trailing_sums(total, ["fleet"], plan, name="_{c}_{w}")
    return w.select(
        "h",
        *[F.col(f"_n_{t}_{x}").alias(f"fl_{t}_{x}h") for t in types for x in (6, 24)],
        *[F.col(f"_o_{t}_24").alias(f"fl_obj_{t}_24h") for t in types],
        *[F.col(f"_n_any_{x}").alias(f"fl_any_{x}h") for x in (24, 168)],
        F.col("_o_any_24").alias("fl_obj_any_24h"),
        F.col("_events_24").alias("fl_events_24h"),
        (F.col("_n_any_24") - F.col("_n_any_168") / 7).alias("fl_burst_24h"),
    )


def widest_hours(fleet: DataFrame, n: int = 3) -> DataFrame:
    return fleet.orderBy(F.col("fl_obj_any_24h").desc(), "h").limit(n)


# ---- places and pickets in names ----------------------------------------------------

# fixed values: how a picket, a branch and a side are written in sensor names
PICKET = r"(?<![А-Яа-яЁёA-Za-z])(?:(Г)\s*(\d)\s*)?[Пп][Кк]\s*(\d+)(?:\s*\+\s*(\d+(?:[.,]\d+)?))?"


def picket_parse(names: DataFrame, name: str = "name") -> DataFrame:
    """Branch origin, branch number, picket, offset and side of a sensor name.
    A second mention close after the first one is a branch from its picket."""
    n = F.col(name)
    grab = lambda g: F.regexp_extract_all(n, F.lit(PICKET), F.lit(g))
    whole = F.regexp_extract_all(n, F.lit(PICKET), F.lit(0))
    at = lambda arr, i: F.try_element_at(arr, F.lit(i))
    d = names.select("*", grab(1).alias("_b"), grab(2).alias("_bn"), grab(3).alias("_pk"), grab(4).alias("_off"), whole.alias("_w"))
    first_end = F.instr(n, at(F.col("_w"), 1)) + F.length(at(F.col("_w"), 1)) - 1
    second_start = F.instr(n, at(F.col("_w"), 2))
    d = d.withColumn("_gap", second_start - first_end - 1)
    num = lambda c: F.when(c != "", c.cast("int"))
    off = lambda c: F.coalesce(F.when(c != "", F.regexp_replace(c, ",", ".").cast("double")), F.lit(0.0))
    own = at(F.col("_b"), 1) == "Г"
    two = ~own & (F.size("_w") > 1) & (at(F.col("_b"), 2) == "Г") & (F.col("_gap") <= 2)
    pick = lambda c, i: num(at(F.col(c), i))
    some = F.size("_w") > 0
    low = F.lower(F.coalesce(n, F.lit("")))
    return d.select(
        *names.columns,
        F.when(some & two, pick("_pk", 1)).alias("branch_from"),
        F.when(some & own, pick("_bn", 1)).when(some & two, pick("_bn", 2)).alias("branch"),
        F.when(some & two, pick("_pk", 2)).when(some, pick("_pk", 1)).alias("picket"),
        F.when(some & two, off(at(F.col("_off"), 2))).when(some, off(at(F.col("_off"), 1))).alias("offset_m"),
        F.when(F.contains(low, F.lit("лев")), "L").when(F.contains(low, F.lit("прав")), "R").otherwise("").alias("side"),
    )


def object_role(objects: DataFrame) -> DataFrame:
    """Role and letter of an object by its level, kind and name."""
    low = F.lower("name")
    role = (
        F.when(F.col("level") == 1, "district")
        .when(F.col("level") == 2, "collector")
        .when(F.contains(low, F.lit("шкаф")) | F.contains(low, F.lit("щит")), "cabinet")
        .when(F.col("name").rlike("(?<![А-Яа-яЁё])ДП(?![А-Яа-яЁё])"), "base")
        .when(F.col("kind") == "guardObject", "trace_guard")
        .otherwise("control")
    )
    letter = F.regexp_extract("name", r"объект\s+([А-ЯЁ][а-яё]+)", 1)
    return objects.withColumn("role", role).withColumn("letter", F.when(letter != "", letter))


def place_mask(texts: DataFrame, column: str, places: list[str], left: str, token: str = "место") -> DataFrame:
    """Place names replaced by numbered tokens, spaces tidied; ``leaks`` tells
    whether a trace of a place remains.  The dictionary is a short fixed list,
    applied as a chain of replacements in the generated code."""
    s = F.coalesce(F.col(column), F.lit(""))
    mark = "\u0001"
    for i, p in enumerate(places, 1):
        s = F.regexp_replace(s, rf"(?<![А-Яа-яЁёA-Za-z])(?:{p})", f"{token} {i}{mark}")
    # a token keeps a blank before a letter or a digit that followed the name
    s = F.regexp_replace(s, rf"{mark}(?=[\p{{L}}\p{{N}}])", " ")
    s = F.regexp_replace(s, mark, "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return texts.withColumn("masked", s).withColumn("leak", F.col("masked").rlike(left))


def route_extent(sensors: DataFrame) -> DataFrame:
    """Every picket of every route with its code, place in order and sensors.
    ``sensors``: collector_id, trace, branch_from, branch, picket.  The main
    line runs over the whole range it and the branch origins take; a branch
    starts at 0; a branch without origin joins the only one of its number."""
    key = ["collector_id", "trace"]
    known = sensors.where("branch is not null and branch_from is not null").groupBy(*key, "branch").agg(
        F.count_distinct("branch_from").alias("_n"), F.min("branch_from").alias("_only")
    )
    s = sensors.join(known, [*key, "branch"], "left").withColumn(
        "branch_from", F.coalesce("branch_from", F.when(F.col("_n") == 1, F.col("_only")))
    )
    main = F.when(F.col("branch").isNull(), F.col("picket"))
    span = s.groupBy(*key).agg(
        F.coalesce(F.least(F.min(main), F.min("branch_from")), F.lit(0)).alias("lo"),
        F.coalesce(F.greatest(F.max(main), F.max("branch_from")), F.lit(0)).alias("hi"),
    )
    nul = F.lit(None).cast("int")
    line = span.select(*key, nul.alias("branch_from"), nul.alias("branch"), F.explode(F.sequence("lo", "hi")).alias("picket"))
    br = s.where("branch is not null").groupBy(*key, "branch_from", "branch").agg(F.max("picket").alias("_m"))
    arms = br.select(*key, "branch_from", "branch", F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("picket"))
    n = s.groupBy(*key, "branch_from", "branch", "picket").agg(F.count(F.lit(1)).alias("sensors"))
    full = [*key, "branch_from", "branch", "picket"]
    # optional branch columns join null-safely
    all_ = line.unionByName(arms).alias("p")
    cond = None
    for c in full:
        e = F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}"))
        cond = e if cond is None else cond & e
    j = all_.join(n.alias("n"), cond, "left").select(*[F.col(f"p.{c}") for c in full], F.coalesce("n.sensors", F.lit(0)).alias("sensors"))
    multi = span.groupBy("collector_id").agg((F.count(F.lit(1)) > 1).alias("_multi"))
    # pickets of a collector are a few hundred: one small window each
    order = Window.partitionBy("collector_id").orderBy(
        "trace", F.col("branch").isNotNull(), F.col("branch_from").isNull(), "branch_from", "branch", "picket"
    )
    code = F.concat(
        F.when(F.col("_multi"), F.concat("trace", F.lit(" "))).otherwise(""),
        F.when(F.col("branch").isNull(), F.concat(F.lit("ПК"), F.col("picket")))
        .otherwise(F.concat(F.coalesce(F.concat(F.lit("ПК"), F.col("branch_from"), F.lit(" ")), F.lit("")), F.lit("Г"), F.col("branch"), F.lit(" ПК"), F.col("picket"))),
    )
    return j.join(multi, "collector_id").withColumn("ordinal", F.row_number().over(order)).withColumn("code", code).drop("_multi")
