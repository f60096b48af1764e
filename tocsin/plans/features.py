"""Hourly series and the object-hour feature mart, without looking ahead.

A row of hour ``h`` sees hours up to ``h``.  Events enter features at the hour
they become known (start plus the labelling delay); targets count from the
true start.  The journal is read once per pre-aggregated part; from there on
tables hold at most one row per (object, hour).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import Vocabulary, first_match
from ..functions.timebase import HOUR, MINUTE, hour_of, hour_start, ts_of
from ..operators import grid as G

# hours; fixed values of the mart
WINDOWS = (1, 6, 24, 168)
SINCE_CAP = 2160
NEXT_CAP = 721
FUTURE = 72
WARMUP = 168
# how long after its start an event becomes known
KNOWN = {
    "fire": 10 * MINUTE,
    "intrusion": 15 * MINUTE,
    "noise_mass": 10 * MINUTE,
    "arrival": 15 * MINUTE,
    "visit": 30 * MINUTE,
}
HOLIDAYS = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4)]
LONG_HOLIDAYS = [((1, 1), (1, 10)), ((5, 1), (5, 11))]
HOLIDAY_CAP = 60

OBJ = ["object_id"]


def state_counters(journal: DataFrame, voc: Vocabulary) -> DataFrame:
    """Rows per object-hour and state key; the first matching key counts."""
    k = F.col("_k")
    return (
        journal.where(F.col("state").isNotNull())
        .select("object_id", hour_of("us").alias("h"), first_match(voc.counters).alias("_k"))
        .where(k.isNotNull())
        .groupBy("object_id", "h")
        .agg(*[F.count_if(k == name).alias(name) for name in dict.fromkeys(n for n, _ in voc.counters)])
    )


def readings_hourly(journal: DataFrame, voc: Vocabulary) -> DataFrame:
    """Events, distinct channels and gas and temperature readings by hour.
    Rows collapse per channel first, so the distinct count is a plain count."""
    gas = F.when(voc.gas.column(), F.col("num"))
    temp = F.when(voc.temperature.column(), F.col("num"))
    by_channel = journal.groupBy("object_id", hour_of("us").alias("h"), "channel_id").agg(
        F.count(F.lit(1)).alias("e"),
        F.max(gas).alias("gx"),
        F.sum(gas).alias("gs"),
        F.count(gas).alias("gn"),
        F.sum(temp).alias("ts"),
        F.count(temp).alias("tn"),
        F.max(temp).alias("tx"),
        F.min(temp).alias("tm"),
    )
    zero = F.lit(0.0)
    return by_channel.groupBy("object_id", "h").agg(
        F.sum("e").alias("n_events"),
        F.count(F.lit(1)).alias("n_channels"),
        F.max("gx").alias("gas_max"),
        F.coalesce(F.sum("gs"), zero).alias("gas_sum"),
        F.sum("gn").alias("gas_n"),
        F.coalesce(F.sum("ts"), zero).alias("temp_sum"),
        F.sum("tn").alias("temp_n"),
        F.max("tx").alias("temp_max"),
        F.min("tm").alias("temp_min"),
    )


def guard_last(guard: DataFrame) -> DataFrame:
    return guard.groupBy("object_id", hour_of("us").alias("h")).agg(
        F.max_by(F.col("armed").cast("int"), F.col("us")).alias("guard_last")
    )


def typed_counts(df: DataFrame, t: str, prefix: str, types, delays: dict[str, int]) -> DataFrame:
    """Rows per object-hour and type, each at the hour it became known."""
    delay = F.lit(0).cast("bigint")
    for name, d in delays.items():
        delay = F.when(F.col("type") == name, F.lit(d).cast("bigint")).otherwise(delay)
    return (
        df.select("object_id", "type", (F.col(t) + delay).alias("_t"))
        .groupBy("object_id", hour_of("_t").alias("h"))
        .agg(*[F.count_if(F.col("type") == tp).alias(f"{prefix}_{tp}") for tp in types])
    )


def onset_counts(eps: DataFrame, types, delays=KNOWN) -> DataFrame:
    own = {k: v for k, v in delays.items() if k in types}
    return typed_counts(eps.where("noise is null"), "t0", "onset", types, own)


def trig_counts(triggers: DataFrame, types, delays=KNOWN) -> DataFrame:
    own = {k: v for k, v in delays.items() if k in types}
    return typed_counts(triggers, "us", "trig", types, own)


def noise_counts(eps: DataFrame, mass_code: str, power_code: str, delay: int = KNOWN["noise_mass"]) -> DataFrame:
    code = F.col("noise")
    t = F.when(code == mass_code, F.col("t0") + delay).otherwise(F.col("t0"))
    return (
        eps.where(code.isin(mass_code, power_code))
        .groupBy("object_id", hour_of(t).alias("h"))
        .agg(F.count_if(code == mass_code).alias("noise_fire"), F.count_if(code == power_code).alias("noise_flood"))
    )


def arrival_visit_counts(openings: DataFrame, visits: DataFrame, objects: DataFrame) -> DataFrame:
    """Staff arrivals of the object; visits of a collector reach all its objects."""
    a = (
        openings.where("arrival")
        .groupBy("object_id", hour_of("us", KNOWN["arrival"]).alias("h"))
        .agg(F.count(F.lit(1)).alias("arrival"))
    )
    v = (
        visits.groupBy("collector_id", hour_of("t0", KNOWN["visit"]).alias("h"))
        .agg(F.count(F.lit(1)).alias("visit"))
        .join(objects.select("object_id", "collector_id"), "collector_id")
        .select("object_id", "h", "visit")
    )
    return merge_hours([a, v]).fillna(0, subset=["arrival", "visit"])


def merge_hours(parts: list[DataFrame]) -> DataFrame:
    """Pre-aggregated (object, hour) parts side by side with one shuffle: each
    part fills its own columns, so ``max`` just picks the value present."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in ("object_id", "h")]
    return out.groupBy("object_id", "h").agg(*[F.max(c).alias(c) for c in cols])


READINGS_NULL = ("gas_max", "temp_max", "temp_min", "guard_last")


@dataclass(frozen=True)
class Stages:
    journal: DataFrame
    objects: DataFrame
    guard: DataFrame
    openings: DataFrame
    triggers: DataFrame
    visits: DataFrame
    episodes: DataFrame


def hour_bounds(journal: DataFrame) -> tuple[int, int]:
    row = journal.agg(F.min(hour_of("us")).alias("a"), F.max(hour_of("us")).alias("b")).first()
    return row["a"], row["b"] + 1


def hour_grid(s: Stages, voc: Vocabulary, p, lo: int, hi: int) -> DataFrame:
    """Dense object x hour grid: counters 0, readings NULL where nothing came."""
    sparse = merge_hours(
        [
            state_counters(s.journal, voc),
            readings_hourly(s.journal, voc),
            guard_last(s.guard),
            onset_counts(s.episodes, voc.types),
            trig_counts(s.triggers, voc.types),
            noise_counts(s.episodes, p.mass_code, p.power_code),
            arrival_visit_counts(s.openings, s.visits, s.objects),
        ]
    )
    zeros = [c for c in sparse.columns if c not in ("object_id", "h", *READINGS_NULL)]
    hours = F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi - 1).cast("bigint")))
    grid = s.objects.select("object_id", "collector_id").withColumn("h", hours)
    return grid.join(sparse, ["object_id", "h"], "left").fillna(0, subset=zeros)


def calendar(hours: DataFrame) -> DataFrame:
    """Calendar columns for a table with one row per hour ``h``.  Days to the
    next holiday need no window: the answer is the least distance to the
    holidays of this and the next year."""
    ts = ts_of(hour_start("h"))
    day = ts.cast("date")
    md = F.month(day) * 100 + F.dayofmonth(day)
    doy = F.dayofyear(day) * (2 * math.pi / 365.25)
    nexts = []
    for shift in (0, 1):
        for m, d in HOLIDAYS:
            when = F.make_date(F.year(day) + shift, F.lit(m), F.lit(d))
            nexts.append(F.when(when >= day, F.datediff(when, day)))
    number = lambda c: c.cast("double")
    is_in = lambda a, b: (md >= a[0] * 100 + a[1]) & (md <= b[0] * 100 + b[1])
    long_ = F.lit(False)
    for a, b in LONG_HOLIDAYS:
        long_ = long_ | is_in(a, b)
    return hours.select(
        "*",
        number(F.hour(ts)).alias("hour"),
        number(F.weekday(day)).alias("dow"),
        number(F.month(day)).alias("month"),
        F.sin(doy).alias("doy_sin"),
        F.cos(doy).alias("doy_cos"),
        number(md.isin(*[m * 100 + d for m, d in HOLIDAYS])).alias("holiday"),
        number(long_).alias("long_holiday"),
        number(md == 509).alias("may9"),
        number(F.least(*nexts, F.lit(HOLIDAY_CAP))).alias("days_to_holiday"),
    )


def window_plan(voc: Vocabulary) -> dict[str, list[int]]:
    """Which base series is summed over which trailing windows."""
    keys = list(dict.fromkeys(n for n, _ in voc.counters))
    plan = {k: list(WINDOWS) for k in keys}
    plan |= {"n_events": list(WINDOWS), "n_channels": list(WINDOWS)}
    plan |= {c: [1, 24, 168] for c in ("gas_sum", "gas_n", "temp_sum", "temp_n")}
    plan |= {k: [24, 168, 720, SINCE_CAP] for k in onset_names(voc)}
    plan |= {f"trig_{t}": [1, 6, 24] for t in voc.types}
    plan |= {"arrival": [24, 168], "visit": [24, 168]}
    return plan


def onset_names(voc: Vocabulary) -> list[str]:
    return [f"onset_{t}" for t in voc.types] + ["noise_fire", "noise_flood"]


def object_features(grid: DataFrame, voc: Vocabulary) -> DataFrame:
    """All windowed features of an object, sharing one partitioning and order."""
    wide = G.trailing_sums(grid, OBJ, window_plan(voc), name="w_{c}_{w}")
    s = lambda c, w: F.col(f"w_{c}_{w}")
    out: list[Column] = [F.col("object_id"), F.col("collector_id"), F.col("h")]
    for k in dict.fromkeys(n for n, _ in voc.counters):
        out += [s(k, w).alias(f"{k}_{w}h") for w in WINDOWS]
    for w in WINDOWS:
        out.append(s("n_events", w).alias(f"events_{w}h"))
        out.append((s("n_channels", w) / w).alias(f"channels_{w}h"))
        out.append(G.trailing_extreme(F.max, "gas_max", w, OBJ).alias(f"gas_max_{w}h"))
    for w in (1, 24, 168):
        for k in ("gas", "temp"):
            out.append(G.trailing_mean(s(f"{k}_sum", w), s(f"{k}_n", w)).alias(f"{k}_mean_{w}h"))
    for w in (24, 168):
        out.append(G.trailing_extreme(F.max, "temp_max", w, OBJ).alias(f"temp_max_{w}h"))
        out.append(G.trailing_extreme(F.min, "temp_min", w, OBJ).alias(f"temp_min_{w}h"))
    since = lambda cond, name: G.since_last(cond, OBJ, SINCE_CAP).alias(name)
    out += [
        since(F.col("n_events") > 0, "since_event"),
        # a gas type's own since_gas counts from episodes and takes this name
        *([] if "gas" in voc.types else [since(F.col("gas_n") > 0, "since_gas")]),
        since(F.col("temp_n") > 0, "since_temp"),
        since(F.col("arm") + F.col("disarm") > 0, "since_guard"),
        since(F.col("visit") > 0, "since_visit"),
        G.last_known("guard_last", OBJ).alias("armed"),
    ]
    out += [since(F.col(f"onset_{t}") > 0, f"since_{t}") for t in voc.types]
    for k in onset_names(voc):
        out += [s(k, w).alias(f"{k}_{w}h") for w in (24, 168, 720, SINCE_CAP)]
    for t in voc.types:
        out += [s(f"trig_{t}", w).alias(f"trig_{t}_{w}h") for w in (1, 6, 24)]
    for k in ("arrival", "visit"):
        out += [s(k, w).alias(f"{k}_{w}h") for w in (24, 168)]
    feats = wide.select(*out)
    return feats.withColumns(
        {
            "temp_trend": F.col("temp_mean_24h") - F.col("temp_mean_168h"),
            "gas_trend": F.col("gas_mean_24h") - F.col("gas_mean_168h"),
        }
    )


def collector_features(grid: DataFrame, voc: Vocabulary) -> DataFrame:
    """Onset and trigger series of the whole collector, per collector-hour."""
    cols = onset_names(voc) + [f"trig_{t}" for t in voc.types]
    total = grid.groupBy("collector_id", "h").agg(*[F.sum(c).alias(c) for c in cols])
    wide = G.trailing_sums(total, ["collector_id"], {c: [24, 168] for c in cols}, name="coll_{c}_{w}h")
    return wide.drop(*cols)


def composition(channels: DataFrame, stypes: list[str]) -> DataFrame:
    """Channels of each sensor type per object."""
    return channels.groupBy("object_id").agg(
        *[F.count_if(F.col("stype") == s).alias(f"comp_{i}") for i, s in enumerate(stypes)]
    )


TARGETS = {"": "true", "_conf": "confirmed", "_prim": "`primary`"}


def onset_flags(eps: DataFrame, types, kinds: dict[str, str] = TARGETS) -> DataFrame:
    """0/1 per object-hour: an episode of the type (and kind) truly starts."""
    quiet = eps.where("noise is null")
    flags = [
        F.max(F.when((F.col("type") == t) & F.expr(cond), 1).otherwise(0)).alias(f"_on_{t}{kind}")
        for t in types
        for kind, cond in kinds.items()
    ]
    return quiet.groupBy("object_id", hour_of("t0").alias("h")).agg(*flags)


def targets(keys: DataFrame, eps: DataFrame, types, kinds: dict[str, str] = TARGETS) -> DataFrame:
    """Hours to the next episode strictly after each grid hour, capped."""
    flags = onset_flags(eps, types, kinds)
    names = [f"{t}{kind}" for t in types for kind in kinds]
    g = keys.select("object_id", "h").join(flags, ["object_id", "h"], "left")
    return g.select(
        "object_id",
        "h",
        *[G.hours_to_next(F.col(f"_on_{n}") > 0, OBJ, NEXT_CAP).alias(f"next_{n}") for n in names],
    )


def valid_hours(grid: DataFrame, holes: list[tuple[int, int]], hi: int, future: int = FUTURE, warmup: int = WARMUP) -> DataFrame:
    """Hours whose look-back and look-ahead avoid the holes (hour ranges) and
    the start of the object's data."""
    first = F.min(F.when(F.col("n_events") > 0, F.col("h"))).over(Window.partitionBy("object_id"))
    ok = (F.col("h") + future < hi) & (F.col("h") >= first + warmup)
    for a, b in holes:
        ok = ok & ~((F.col("h") + future >= a) & (F.col("h") - warmup < b))
    return grid.withColumn("_ok", ok).where("_ok").select("object_id", "h")


def mart_assemble(
    grid: DataFrame, eps: DataFrame, channels: DataFrame, stypes: list[str], voc: Vocabulary, holes, hi: int
) -> DataFrame:
    """Keys, calendar, composition, windows and targets of the valid rows.
    ``ts`` is the moment of the forecast: the end of the hour."""
    feats = object_features(grid, voc).where(F.col("events_168h") > 0)
    keep = valid_hours(grid, holes, hi)
    hours = calendar(grid.select("h").distinct())
    # the hour calendar and the collector table grow with the period and the
    # fleet, so the join strategy is left to the planner and its size check
    return (
        feats.join(keep, ["object_id", "h"])
        .join(collector_features(grid, voc), ["collector_id", "h"])
        .join(targets(grid, eps, voc.types), ["object_id", "h"])
        .join(hours, "h")
        .join(composition(channels, stypes), "object_id")
        .withColumn("ts", ts_of(hour_start("h") + F.lit(HOUR)))
        .withColumn("year", F.year("ts").cast("int"))
    )


def targets_no_restart(keys: DataFrame, flagged: DataFrame, types) -> DataFrame:
    """Hours to the next episode that is not a restart after power loss."""
    return targets(keys, flagged.where("not restart"), types, {"_nopw": "true"})


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def series_log1p(grid: DataFrame, cols: list[str], back: int) -> DataFrame:
    """Signed log1p of the series, the collector mean beside each, and the
    last ``back`` hours of both as one ordered array per row."""
    logged = grid.select(
        "object_id", "collector_id", "h", *[F.coalesce(signed_log(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in cols]
    )
    mean = logged.groupBy("collector_id", "h").agg(*[F.avg(c).alias(f"coll_{c}") for c in cols])
    both = logged.join(mean, ["collector_id", "h"])
    names = cols + [f"coll_{c}" for c in cols]
    w = Window.partitionBy("object_id").orderBy("h").rowsBetween(-(back - 1), 0)
    return both.withColumn("steps", F.collect_list(F.struct("h", *names)).over(w))


def join_hourly_pack(mart: DataFrame, by_hour: DataFrame, by_object_hour: DataFrame) -> DataFrame:
    """Attach an hour-keyed pack and a sparse (object, hour) pack, whose
    missing rows are zeros."""
    fill = [c for c in by_object_hour.columns if c not in ("object_id", "h")]
    return mart.join(by_hour, "h", "left").join(by_object_hour, ["object_id", "h"], "left").fillna(0, subset=fill)


def full_join_packs(packs: list[DataFrame]) -> DataFrame:
    out = packs[0]
    for p in packs[1:]:
        out = out.join(p, ["object_id", "h"], "full")
    return out.fillna(0)


def thin_rows(mart: DataFrame, step: int, h: str = "h") -> DataFrame:
    return mart.where(F.col(h) % step == 0)


def thin_negatives(df: DataFrame, target: str, horizon: int, day: str, step: int) -> DataFrame:
    """All positive rows and every ``step``-th day of the others, weighted."""
    pos = F.col(target) <= horizon
    return df.where(pos | (F.col(day) % step == 0)).withColumn("weight", F.when(pos, 1.0).otherwise(float(step)))


def feature_groups(names: list[str], types) -> dict[str, list[str]]:
    """Feature families by name, each name in its first matching family."""
    import re

    cal = {"hour", "dow", "month", "doy_sin", "doy_cos", "holiday", "long_holiday", "may9", "days_to_holiday"}
    tests = [
        ("calendar", lambda n: n in cal),
        ("composition", lambda n: n.startswith("comp_") or n == "guard_object"),
        ("collector", lambda n: n.startswith("coll_")),
        ("history", lambda n: n.startswith(("onset_", "noise_")) or n in {f"since_{t}" for t in types}),
        ("triggers", lambda n: n.startswith("trig_")),
        ("readings", lambda n: re.match(r"(gas|temp)_(max|min|mean|trend)", n) is not None or n in ("since_gas", "since_temp")),
        ("guard", lambda n: n.startswith(("armed", "since_guard", "arrival", "visit", "since_visit"))),
    ]
    out: dict[str, list[str]] = {k: [] for k, _ in tests} | {"counters": []}
    for n in names:
        out[next((k for k, t in tests if t(n)), "counters")].append(n)
    return out


def drop_features(mart: DataFrame, group: list[str]) -> DataFrame:
    return mart.drop(*group)


def ablate_group(mart: DataFrame, group: list[str], readings: list[str]) -> DataFrame:
    """The group as if its sensors were silent: counters 0, readings NULL."""
    null = lambda c: F.lit(None).cast(dict(mart.dtypes)[c])
    zero = lambda c: F.lit(0).cast(dict(mart.dtypes)[c])
    return mart.withColumns({c: null(c) if c in readings else zero(c) for c in group})
