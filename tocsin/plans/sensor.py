"""Channel-day mart: daily aggregates, windows, peers, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import DAY, ORIGIN_US, floor_div
from ..operators import grid as G
from ..operators.scan import previous_row

# days; fixed values of the channel-day mart
FUTURE = 7
NEXT_CAP = 91
CAP = 730
HEALTHY = 7
MASS = 3
WARM = 30


def day_of(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return floor_div(us - ORIGIN_US, DAY)


def sensor_daily(journal: DataFrame, triggers: DataFrame, reading: Column, undefined: Column, off: Column, fault_states: list[str]) -> DataFrame:
    """Channel-day aggregates, sparse: events, undefined, off, readings (count,
    sum, squares, bounds, zeros), state flips, alarms and faults."""
    v = F.when(reading, F.col("num"))
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    agg = journal.groupBy("channel_id", "object_id", "collector_id", day_of("us").alias("d")).agg(
        F.count(F.lit(1)).alias("ev"), one(undefined).alias("undef"), one(off).alias("off"), F.count(v).alias("nv"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sv"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("sv2"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("minv"), F.coalesce(F.max(v), F.lit(0.0)).alias("maxv"), one(v == 0).alias("zero"),
    )
    states = journal.where(F.col("state").isNotNull()).select("channel_id", "us", "event_id", "state")
    turned = previous_row(states, ["channel_id"], "us", ["event_id"], {"state": "was"}, width=DAY)
    flips = turned.where(F.col("state") != F.col("was")).groupBy("channel_id", day_of("us").alias("d")).agg(F.count(F.lit(1)).alias("flips"))
    fault = F.col("type") == "sensor"
    tr = triggers.groupBy("channel_id", day_of("us").alias("d")).agg(
        F.count_if(~fault).alias("alarm"), F.max(fault.cast("int")).alias("fault"),
        F.max((fault & F.col("what").isin(*fault_states)).cast("int")).alias("fault_state"), F.count_if(fault).alias("fault_rows"),
    )
    key = ["channel_id", "d"]
    out = agg.join(flips, key, "left").join(tr, key, "left")
    return out.fillna(0, subset=["flips", "alarm", "fault", "fault_state", "fault_rows"])


def sensor_valid_days(spark, lo: int, hi: int, bad: list[tuple[int, int]], warm: int = WARM, future: int = FUTURE) -> DataFrame:
    """Days outside holes, fresh enough and with the days ahead in sight, with
    the days since the start or the last hole.  One row per day."""
    days = spark.range(lo, hi).select(F.col("id").alias("d"))
    in_hole = F.lit(False)
    for a, b in bad:
        in_hole = in_hole | ((F.col("d") >= a) & (F.col("d") < b))
    w = Window.partitionBy(F.lit(0)).orderBy("d")
    m = days.withColumn("bad", in_hole)
    m = m.withColumn("_last", F.max(F.when(F.col("bad"), F.col("d") + 1)).over(w))
    m = m.withColumn("fresh", F.col("d") - F.coalesce("_last", F.lit(lo)))
    ahead = F.coalesce(F.max(F.col("bad").cast("int")).over(w.rowsBetween(1, future)), F.lit(0))
    ok = ~F.col("bad") & (F.col("fresh") >= warm) & (ahead == 0) & (F.col("d") + future < hi)
    return m.withColumn("ok", ok).select("d", "fresh", "ok")


CH = ["channel_id"]
DAILY = ["ev", "undef", "off", "nv", "sv", "sv2", "zero", "flips", "alarm", "fault", "fault_state", "fault_rows"]


def dense_days(daily: DataFrame, lo: int, hi: int) -> DataFrame:
    """Every channel at every day of its life."""
    first = daily.groupBy("channel_id", "object_id", "collector_id").agg(F.min("d").alias("first"))
    grid = first.withColumn("d", F.explode(F.sequence(F.col("first"), F.lit(hi - 1).cast("bigint"))))
    return grid.join(daily.drop("object_id", "collector_id"), ["channel_id", "d"], "left").fillna(0, subset=DAILY)


def place_sums(dense: DataFrame, place: str, mass: int = MASS) -> DataFrame:
    """Faults of a place (object or collector) by day, mass days marked."""
    day = dense.groupBy(place, "d").agg(F.sum("fault").alias("n"))
    return day.withColumn("mass", (F.col("n") >= mass).cast("int"))


def sensor_features(dense: DataFrame, triggers: DataFrame, valid: DataFrame, stypes: DataFrame, names: list[str], hi: int, mass: int = MASS) -> DataFrame:
    """Window features of every channel-day, peers without the channel itself,
    single against mass faults."""
    objects = place_sums(dense, "object_id", mass)
    d = dense.join(objects.select("object_id", "d", "mass"), ["object_id", "d"])
    d = d.withColumn("single", F.when(F.col("mass") == 0, F.col("fault")).otherwise(0))
    plan = {c: [1, 7, 30] for c in ("ev", "flips", "undef", "nv", "sv")}
    plan |= {"off": [7, 30], "alarm": [7, 30], "sv2": [1, 7], "zero": [7], "fault": [7, 30, 90, 365]}
    plan |= {"fault_state": [365], "fault_rows": [365], "single": [365]}
    plan["ev"] = [1, 7, 30, 365]
    w = G.trailing_sums(d, CH, plan, h="d", name="{c}_{w}")
    track = G.track(CH, "d")
    since = lambda cond, cap: G.since_last(cond, CH, cap, "d")
    mean = lambda n: F.when(F.col(f"nv_{n}") > 0.5, F.col(f"sv_{n}") / F.col(f"nv_{n}"))
    std = lambda n: F.when(
        F.col(f"nv_{n}") > 0.5, F.sqrt(F.greatest(F.col(f"sv2_{n}") / F.col(f"nv_{n}") - F.pow(mean(n), 2), F.lit(0.0)))
    )
    has = F.col("nv") > 0
    ext = lambda f, c: f(F.when(has, F.col(c))).over(track.rowsBetween(-6, 0))
    w = w.withColumns(
        {
            "ev_change": F.col("ev_7") / (F.col("ev_30") * 7 / 30 + 1),
            "silent": since(F.col("ev") > 0, 365),
            "since_alarm": since(F.col("alarm") > 0, 365),
            **{f"mean_{n}": mean(n) for n in (1, 7, 30)},
            **{f"std_{n}": std(n) for n in (1, 7)},
            "zero_share_7": F.when(F.col("nv_7") > 0.5, F.col("zero_7") / F.col("nv_7")),
            "trend": mean(1) - mean(30),
            "readings_change": F.col("nv_1") / (F.col("nv_30") / 30 + 1),
            "min_7": ext(F.min, "minv"),
            "max_7": ext(F.max, "maxv"),
            "fault_rows_365": F.log1p("fault_rows_365"),
            "since_fault": since(F.col("fault") > 0, CAP),
            "since_single": since(F.col("single") > 0, CAP),
            "age": F.least(F.col("d") - F.col("first"), F.lit(CAP)),
        }
    )
    obj = G.trailing_sums(objects, ["object_id"], {"n": [7, 30, 365], "mass": [7, 30, 365]}, h="d", name="o_{c}_{w}").drop("n", "mass")
    coll = G.trailing_sums(place_sums(dense, "collector_id", mass), ["collector_id"], {"n": [7, 30]}, h="d", name="c_{c}_{w}").drop("n", "mass")
    equip = triggers.where("type = 'equipment'").groupBy("object_id", day_of("us").alias("d")).agg(F.count(F.lit(1)).alias("e"))
    eday = objects.select("object_id", "d").join(equip, ["object_id", "d"], "left").fillna(0, subset=["e"])
    eday = G.trailing_sums(eday, ["object_id"], {"e": [1, 7]}, h="d", name="obj_equip_{w}").drop("e")
    n = dense.select("object_id", "channel_id").distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("obj_sensors"))
    j = (
        w.join(obj, ["object_id", "d"]).join(coll, ["collector_id", "d"]).join(eday, ["object_id", "d"]).join(n, "object_id").join(valid, "d").join(stypes, "channel_id")
    )
    others = F.greatest(F.col("obj_sensors") - 1, F.lit(1))
    j = j.withColumns(
        {
            "history": F.least(F.col("age"), F.col("fresh")),
            "obj_fault_7": F.col("o_n_7") - F.col("fault_7"),
            "obj_fault_30": F.col("o_n_30") - F.col("fault_30"),
            "obj_fault_rate_365": (F.col("o_n_365") - F.col("fault_365")) / others,
            "coll_fault_7": F.col("c_n_7") - F.col("fault_7"),
            "coll_fault_30": F.col("c_n_30") - F.col("fault_30"),
            **{f"obj_mass_{x}": F.col(f"o_mass_{x}") for x in (7, 30, 365)},
            **{f"st_{i}": (F.col("stype") == s).cast("double") for i, s in enumerate(names)},
        }
    )
    return j.drop(*[c for c in j.columns if c.startswith(("o_n_", "o_mass_", "c_n_"))])


def sensor_targets(dense: DataFrame, mass: int = MASS) -> DataFrame:
    """Days to the next fault, single fault and state fault, capped."""
    objects = place_sums(dense, "object_id", mass)
    d = dense.join(objects.select("object_id", "d", "mass"), ["object_id", "d"])
    nxt = lambda c: G.hours_to_next(c, CH, NEXT_CAP, "d")
    return d.select(
        "channel_id", "d",
        nxt(F.col("fault") > 0).alias("next_fault"),
        nxt((F.col("fault") > 0) & (F.col("mass") == 0)).alias("next_single"),
        nxt(F.col("fault_state") > 0).alias("next_fault_state"),
    )


def sensor_mart(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Valid days of healthy channels that spoke within a year."""
    keep = F.col("ok") & (F.round("fault_7") == 0) & (F.round("ev_365") > 0)
    return features.where(keep).join(targets, ["channel_id", "d"])


def sensor_baselines(train: DataFrame, rows: DataFrame, target: str, horizon: int) -> DataFrame:
    """Three scores without a model: fault history, recency and the weighted
    fault rate of the sensor type."""
    y = (F.col(target) <= horizon).cast("double")
    rate = train.groupBy("stype").agg((F.sum(y * F.col("weight")) / F.sum("weight")).alias("stype_rate"))
    return rows.join(rate, "stype", "left").withColumns(
        {
            "history_score": F.col("single_365") + F.col("fault_365") * 1e-3,
            "recency_score": (-F.col("since_single")).cast("double"),
            "stype_rate": F.coalesce("stype_rate", F.lit(0.0)),
        }
    )
