"""Hourly series and mart queries."""


from pyspark.sql import functions as F

from ..functions.timebase import HOUR, ORIGIN_US, literal_us
from ..operators import grid as G
from ..plans import features as X
from .registry import PARTS, part, query
from .site import PARAMS, STYPES, VOC, Site

TYPES = VOC.types
KEYS = [n for n, _ in VOC.counters]


def hour_sql(us: str, delay: int = 0) -> str:
    return f"(({us} + {delay} - {ORIGIN_US}) // {HOUR})"


KEY_SQL = """CASE WHEN stype = 'smoke' AND state = 'smoke_detected' THEN 'smoke' WHEN stype = 'pump' AND state = 'faulted' THEN 'pump_fault'
 WHEN stype = 'temperature' AND state = 'faulted' THEN 'temp_fault' WHEN stype = 'door' AND state = 'open' THEN 'door'
 WHEN stype = 'motion' AND state = 'detected' THEN 'motion' WHEN stype = 'guard' AND state = 'armed' THEN 'arm'
 WHEN stype = 'guard' AND state = 'disarmed' THEN 'disarm' END"""
part("ck", "j", f"SELECT object_id, {hour_sql('us')} AS h, {KEY_SQL} AS k FROM j WHERE state IS NOT NULL")
part("counters", "ck", "SELECT object_id, h, " + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in KEYS) + " FROM ck WHERE k IS NOT NULL GROUP BY 1, 2")
GAS, TEMP = "stype = 'gas' AND num >= 0 AND num <= 15", "stype = 'temperature' AND num BETWEEN -40 AND 80"
part(
    "readings",
    "j",
    f"""SELECT object_id, {hour_sql('us')} AS h, count(*) AS n_events, count(DISTINCT channel_id) AS n_channels,
 max(num) FILTER ({GAS}) AS gas_max, coalesce(sum(num) FILTER ({GAS}), 0) AS gas_sum, count(num) FILTER ({GAS}) AS gas_n,
 coalesce(sum(num) FILTER ({TEMP}), 0) AS temp_sum, count(num) FILTER ({TEMP}) AS temp_n,
 max(num) FILTER ({TEMP}) AS temp_max, min(num) FILTER ({TEMP}) AS temp_min FROM j GROUP BY 1, 2""",
)
part("guard_h", "guard", f"SELECT object_id, {hour_sql('us')} AS h, arg_max(CAST(armed AS INT), us) AS guard_last FROM guard GROUP BY 1, 2")
DELAY = "CASE type WHEN 'fire' THEN 600000000 WHEN 'intrusion' THEN 900000000 ELSE 0 END"


def typed(prefix):
    return ", ".join(f"count(*) FILTER (type = '{t}') AS {prefix}_{t}" for t in TYPES)


part("onsets_h", "inc", f"SELECT object_id, {hour_sql('t0 + ' + DELAY)} AS h, {typed('onset')} FROM inc WHERE noise IS NULL GROUP BY 1, 2")
part("trigs_h", "trig", f"SELECT object_id, {hour_sql('us + ' + DELAY)} AS h, {typed('trig')} FROM trig GROUP BY 1, 2")
part(
    "noise_h",
    "inc",
    f"""SELECT object_id, CASE noise WHEN 'mass' THEN {hour_sql('t0', 600000000)} ELSE {hour_sql('t0')} END AS h,
 count(*) FILTER (noise = 'mass') AS noise_fire, count(*) FILTER (noise = 'power') AS noise_flood FROM inc WHERE noise IS NOT NULL GROUP BY 1, 2""",
)
part("arrive_h", "openings", f"SELECT object_id, {hour_sql('us', 900000000)} AS h, count(*) AS arrival FROM openings WHERE arrival GROUP BY 1, 2")
part("visit_h", "visit obj", f"SELECT o.object_id, {hour_sql('v.t0', 1800000000)} AS h, count(*) AS visit FROM visit v JOIN obj o USING (collector_id) GROUP BY 1, 2")
part("lim", "j", f"SELECT min({hour_sql('us')}) AS lo, max({hour_sql('us')}) + 1 AS hi FROM j")
ZEROS = KEYS + ["n_events", "n_channels", "gas_sum", "gas_n", "temp_sum", "temp_n"] + [f"onset_{t}" for t in TYPES] + [f"trig_{t}" for t in TYPES] + ["noise_fire", "noise_flood", "arrival", "visit"]
part(
    "g",
    "obj lim counters readings guard_h onsets_h trigs_h noise_h arrive_h visit_h",
    "SELECT o.object_id, o.collector_id, t.h, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ZEROS)
    + ", gas_max, temp_max, temp_min, guard_last FROM obj o CROSS JOIN (SELECT unnest(range(lo, hi)) AS h FROM lim) t "
    + " ".join(f"LEFT JOIN {p} USING (object_id, h)" for p in "counters readings guard_h onsets_h trigs_h noise_h arrive_h visit_h".split()),
)


def past(expr, w, key="object_id"):
    return f"{expr} OVER (PARTITION BY {key} ORDER BY h ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def since_sql(cond, cap=2160, key="object_id"):
    return f"least(coalesce(h - max(CASE WHEN {cond} THEN h END) OVER (PARTITION BY {key} ORDER BY h), {cap}), {cap})"


def next_sql(cond, cap=721, key="object_id"):
    return f"least(coalesce(min(CASE WHEN {cond} THEN h END) OVER (PARTITION BY {key} ORDER BY h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - h, {cap}), {cap})"


@query("state_counters", "counters", "SELECT * FROM counters")
def state_counters(s: Site):
    return X.state_counters(s.journal, VOC)


READ = "gas_max gas_sum temp_sum temp_max temp_min".split()


@query("readings_hourly", "readings", "SELECT object_id, h, n_events, n_channels, gas_n, temp_n, " + ", ".join(f"round({c}, 6) AS {c}" for c in READ) + " FROM readings")
def readings_hourly(s: Site):
    return X.readings_hourly(s.journal, VOC).withColumns({c: F.round(c, 6) for c in READ})


@query("guard_last", "guard_h", "SELECT * FROM guard_h")
def guard_last(s: Site):
    return X.guard_last(s.guard)


@query("onset_counts", "onsets_h", "SELECT * FROM onsets_h")
def onset_counts(s: Site):
    return X.onset_counts(s.episodes, TYPES)


@query("trig_counts", "trigs_h", "SELECT * FROM trigs_h")
def trig_counts(s: Site):
    return X.trig_counts(s.triggers, TYPES)


@query("noise_counts", "noise_h", "SELECT * FROM noise_h")
def noise_counts(s: Site):
    return X.noise_counts(s.episodes, PARAMS.mass_code, PARAMS.power_code)


@query(
    "arrival_visit_counts",
    "arrive_h visit_h",
    "SELECT object_id, h, coalesce(arrival, 0) AS arrival, coalesce(visit, 0) AS visit FROM arrive_h FULL JOIN visit_h USING (object_id, h)",
)
def arrival_visit_counts(s: Site):
    return X.arrival_visit_counts(s.openings, s.visits, s.objects)


@query("hour_grid", "g", "SELECT object_id, collector_id, h, " + ", ".join(ZEROS[:9]) + ", guard_last, round(temp_max, 6) AS temp_max FROM g")
def hour_grid(s: Site):
    g = X.hour_grid(s.stages, VOC, PARAMS, *s.bounds)
    return g.select("object_id", "collector_id", "h", *ZEROS[:9], "guard_last", F.round("temp_max", 6).alias("temp_max"))


SUMS = {"n_events": [1, 6, 24, 168], "smoke": [24, 720]}


@query(
    "window_sum",
    "g",
    "SELECT object_id, h, " + ", ".join(f"CAST({past(f'sum({c})', w)} AS DOUBLE) AS {c}_{w}h" for c, ws in SUMS.items() for w in ws) + " FROM g",
)
def window_sum(s: Site):
    wide = G.trailing_sums(s.grid.select("object_id", "h", *SUMS), ["object_id"], SUMS)
    return wide.drop(*SUMS)


@query(
    "window_mean",
    "g",
    "SELECT object_id, h, " + ", ".join(f"round({past('sum(temp_sum)', w)} / nullif({past('sum(temp_n)', w)}, 0) + 1e-9, 6) AS temp_mean_{w}h" for w in (1, 24, 168)) + " FROM g",
)
def window_mean(s: Site):
    wide = G.trailing_sums(s.grid.select("object_id", "h", "temp_sum", "temp_n"), ["object_id"], {"temp_sum": [1, 24, 168], "temp_n": [1, 24, 168]})
    return wide.select("object_id", "h", *[nudged(G.trailing_mean(F.col(f"temp_sum_{w}h"), F.col(f"temp_n_{w}h"))).alias(f"temp_mean_{w}h") for w in (1, 24, 168)])


@query(
    "window_extreme",
    "g",
    "SELECT object_id, h, " + ", ".join(f"round({past(f'{f}({c})', w)}, 6) AS {c}_{w}h" for f, c in (("max", "gas_max"), ("min", "temp_min")) for w in (24, 168)) + " FROM g",
)
def window_extreme(s: Site):
    return s.grid.select(
        "object_id", "h",
        *[F.round(G.trailing_extreme(f, c, w, ["object_id"]), 6).alias(f"{c}_{w}h") for f, c in ((F.max, "gas_max"), (F.min, "temp_min")) for w in (24, 168)],
    )


@query("trend", "g", f"SELECT object_id, h, round({past('sum(temp_sum)', 24)} / nullif({past('sum(temp_n)', 24)}, 0) - {past('sum(temp_sum)', 168)} / nullif({past('sum(temp_n)', 168)}, 0) + 1e-9, 6) AS temp_trend FROM g")
def trend(s: Site):
    wide = G.trailing_sums(s.grid.select("object_id", "h", "temp_sum", "temp_n"), ["object_id"], {"temp_sum": [24, 168], "temp_n": [24, 168]})
    m = lambda w: G.trailing_mean(F.col(f"temp_sum_{w}h"), F.col(f"temp_n_{w}h"))
    return wide.select("object_id", "h", nudged(m(24) - m(168)).alias("temp_trend"))


@query("since_last", "g", f"SELECT object_id, h, {since_sql('smoke > 0')} AS since_smoke, {since_sql('onset_fire > 0', 100)} AS since_fire FROM g")
def since_last(s: Site):
    o = ["object_id"]
    return s.grid.select("object_id", "h", G.since_last(F.col("smoke") > 0, o, 2160).alias("since_smoke"), G.since_last(F.col("onset_fire") > 0, o, 100).alias("since_fire"))


@query(
    "forward_fill",
    "g",
    "SELECT object_id, h, last_value(guard_last IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY h) AS armed FROM g",
)
def forward_fill(s: Site):
    return s.grid.select("object_id", "h", G.last_known("guard_last", ["object_id"]).alias("armed"))


@query("hours_to_next", "g", f"SELECT object_id, h, {next_sql('onset_fire > 0')} AS next_onset, {next_sql('smoke > 0', 48)} AS next_smoke FROM g")
def hours_to_next(s: Site):
    o = ["object_id"]
    return s.grid.select("object_id", "h", G.hours_to_next(F.col("onset_fire") > 0, o, 721).alias("next_onset"), G.hours_to_next(F.col("smoke") > 0, o, 48).alias("next_smoke"))


MD = "(month(d) * 100 + day(d))"
HOL = ", ".join(str(m * 100 + d) for m, d in X.HOLIDAYS)
part(
    "cal",
    "lim",
    f"""SELECT h, CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(d) - 1 AS DOUBLE) AS dow, CAST(month(d) AS DOUBLE) AS month,
 sin(2 * pi() * dayofyear(d) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(d) / 365.25) AS doy_cos,
 CAST({MD} IN ({HOL}) AS DOUBLE) AS holiday, CAST({MD} BETWEEN 101 AND 110 OR {MD} BETWEEN 501 AND 511 AS DOUBLE) AS long_holiday,
 CAST({MD} = 509 AS DOUBLE) AS may9,
 CAST(least(60, (SELECT min(date_diff('day', d, x)) FROM (SELECT unnest(range(d, d + 400, INTERVAL 1 DAY)) AS x)
   WHERE month(x) * 100 + day(x) IN ({HOL}))) AS DOUBLE) AS days_to_holiday
FROM (SELECT h, TIMESTAMP '2019-01-01' + to_hours(h) AS ts, CAST(TIMESTAMP '2019-01-01' + to_hours(h) AS DATE) AS d
 FROM (SELECT unnest(range(lo, hi)) AS h FROM lim))""",
)
CAL = "hour dow month doy_sin doy_cos holiday long_holiday may9 days_to_holiday".split()


@query("calendar", "cal", "SELECT h, " + ", ".join(f"round({c}, 6) AS {c}" for c in CAL) + " FROM cal")
def calendar(s: Site):
    return X.calendar(s.grid.select("h").distinct()).withColumns({c: F.round(c, 6) for c in CAL})


FEATS = {
    "smoke_6h": past("sum(smoke)", 6),
    "events_168h": past("sum(n_events)", 168),
    "channels_24h": past("sum(n_channels)", 24) + " / 24",
    "gas_max_24h": past("max(gas_max)", 24),
    "gas_mean_24h": f"{past('sum(gas_sum)', 24)} / nullif({past('sum(gas_n)', 24)}, 0)",
    "temp_mean_168h": f"{past('sum(temp_sum)', 168)} / nullif({past('sum(temp_n)', 168)}, 0)",
    "temp_min_24h": past("min(temp_min)", 24),
    "since_gas": since_sql("onset_gas > 0"),
    "since_guard": since_sql("arm + disarm > 0"),
    "since_equipment": since_sql("onset_equipment > 0"),
    "onset_fire_720h": past("sum(onset_fire)", 720),
    "noise_fire_2160h": past("sum(noise_fire)", 2160),
    "trig_sensor_6h": past("sum(trig_sensor)", 6),
    "visit_168h": past("sum(visit)", 168),
}
part("feat", "g", "SELECT object_id, collector_id, h, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATS.items()) + " FROM g")
FEAT_OUT = ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in FEATS)


def rounded(cols):
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]


# Means of readings with two decimals fall on exact halves of the sixth place;
# which side a sum lands on depends on its order, so both sides are nudged.
NUDGE = 1e-9


def nudged(c):
    return F.round(c + F.lit(NUDGE), 6)


@query("object_features", "feat", f"SELECT object_id, h, {FEAT_OUT} FROM feat")
def object_features(s: Site):
    return X.object_features(s.grid, VOC).select("object_id", "h", *[nudged(F.col(c).cast("double")).alias(c) for c in FEATS])


part(
    "collf",
    "g",
    "SELECT collector_id, h, " + ", ".join(f"CAST({past(f'sum({c})', w, 'collector_id')} AS DOUBLE) AS coll_{c}_{w}h" for c in ("onset_fire", "trig_sensor") for w in (24, 168))
    + " FROM (SELECT collector_id, h, sum(onset_fire) AS onset_fire, sum(trig_sensor) AS trig_sensor FROM g GROUP BY 1, 2)",
)


@query("collector_features", "collf", "SELECT * FROM collf")
def collector_features(s: Site):
    return X.collector_features(s.grid, VOC).select("collector_id", "h", *[f"coll_{c}_{w}h" for c in ("onset_fire", "trig_sensor") for w in (24, 168)])


part("comp", "ch", "SELECT object_id, " + ", ".join(f"count(*) FILTER (stype = '{t}') AS comp_{i}" for i, t in enumerate(STYPES)) + " FROM ch GROUP BY 1")


@query("composition", "comp", "SELECT * FROM comp")
def composition(s: Site):
    return X.composition(s.channels, STYPES)


KIND = {"": "", "_conf": " AND confirmed", "_prim": ' AND "primary"'}
part(
    "starts_h",
    "inc",
    f"SELECT object_id, {hour_sql('t0')} AS h, " + ", ".join(f"count(*) FILTER (type = '{t}'{c}) AS s_{t}{k}" for t in TYPES for k, c in KIND.items()) + " FROM inc WHERE noise IS NULL GROUP BY 1, 2",
)
part("tg", "g starts_h", "SELECT object_id, h, " + ", ".join(f"{next_sql(f's_{t}{k} > 0')} AS next_{t}{k}" for t in TYPES for k in KIND) + " FROM g LEFT JOIN starts_h USING (object_id, h)")


@query("targets", "tg", "SELECT * FROM tg")
def targets(s: Site):
    return X.targets(s.grid, s.episodes, TYPES)


part(
    "nopw",
    "g restarts",
    f"SELECT object_id, h, {next_sql('n_fire > 0')} AS next_fire_nopw, {next_sql('n_equipment > 0')} AS next_equipment_nopw FROM g LEFT JOIN "
    f"(SELECT object_id, {hour_sql('t0')} AS h, count(*) FILTER (type = 'fire') AS n_fire, count(*) FILTER (type = 'equipment') AS n_equipment FROM restarts WHERE NOT restart GROUP BY 1, 2) USING (object_id, h)",
)


@query("targets_no_restart", "nopw", "SELECT * FROM nopw")
def targets_no_restart(s: Site):
    from ..plans import labels as L

    flags = L.restart_flags(s.episodes, s.journal, VOC, PARAMS)
    return X.targets_no_restart(s.grid, flags, ("fire", "equipment"))


part(
    "valid",
    "g lim",
    """SELECT object_id, h FROM (SELECT object_id, h, min(CASE WHEN n_events > 0 THEN h END) OVER (PARTITION BY object_id) AS f FROM g), lim
WHERE h + 72 < hi AND h >= f + 168 AND NOT (h + 72 >= lo + 400 AND h - 168 < lo + 406)""",
)


@query("valid_hours", "valid", "SELECT * FROM valid")
def valid_hours(s: Site):
    return X.valid_hours(s.grid, s.holes, s.bounds[1])


part("mart", "feat valid collf comp tg cal", "SELECT * FROM feat JOIN valid USING (object_id, h) JOIN collf USING (collector_id, h) JOIN tg USING (object_id, h) JOIN cal USING (h) JOIN comp USING (object_id) WHERE events_168h > 0")
MART_COLS = ["events_168h", "gas_mean_24h", "since_equipment", "coll_onset_fire_24h", "days_to_holiday", "doy_sin"]


@query(
    "mart_assemble",
    "mart",
    "SELECT object_id, collector_id, h, TIMESTAMP '2019-01-01' + to_hours(h + 1) AS ts, comp_1, next_fire, next_gas_conf, " + ", ".join(f"round({c}, 6) AS {c}" for c in MART_COLS) + " FROM mart",
)
def mart_assemble(s: Site):
    m = X.mart_assemble(s.grid, s.episodes, s.channels, STYPES, VOC, s.holes, s.bounds[1])
    return m.select("object_id", "collector_id", "h", "ts", "comp_1", "next_fire", "next_gas_conf", *rounded(MART_COLS))


@query(
    "mart_write_year",
    "mart",
    "SELECT CAST(year(TIMESTAMP '2019-01-01' + to_hours(h + 1)) AS INTEGER) AS year, count(*) AS rows, CAST(round(sum(events_168h)) AS BIGINT) AS events FROM mart GROUP BY 1",
)
def mart_write_year(s: Site):
    from ..sources.sinks import scratch, write_mart

    path = write_mart(s.mart, scratch(s.spark, "mart"))
    back = s.spark.read.parquet(path)
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("events_168h")).cast("bigint").alias("events"))


part("lg", "g", "SELECT object_id, collector_id, h, ln(1 + n_events) AS n_events, sign(coalesce(temp_min, 0)) * ln(1 + abs(coalesce(temp_min, 0))) AS temp_min FROM g")


@query(
    "series_log1p",
    "lg",
    f"""SELECT object_id, h, round(n_events, 6) AS n_events, round(temp_min, 6) AS temp_min, round(coll_n_events, 6) AS coll_n_events,
 {past('count(*)', 24)} AS steps, round({past('sum(temp_min)', 24)}, 6) AS window_total
FROM lg JOIN (SELECT collector_id, h, avg(n_events) AS coll_n_events FROM lg GROUP BY 1, 2) USING (collector_id, h)""",
)
def series_log1p(s: Site):
    x = X.series_log1p(s.grid, ["n_events", "temp_min"], 24)
    total = F.aggregate("steps", F.lit(0.0), lambda a, v: a + v["temp_min"])
    return x.select(
        "object_id", "h", F.round("n_events", 6).alias("n_events"), F.round("temp_min", 6).alias("temp_min"),
        F.round("coll_n_events", 6).alias("coll_n_events"), F.size("steps").cast("bigint").alias("steps"), F.round(total, 6).alias("window_total"),
    )


@query(
    "thin_rows",
    "mart",
    "SELECT object_id, h, next_fire, CAST(CASE WHEN next_fire <= 24 THEN 1 ELSE 3 END AS DOUBLE) AS weight FROM mart WHERE h % 2 = 0 AND (next_fire <= 24 OR (h // 24) % 3 = 0)",
)
def thin_rows(s: Site):
    day = s.mart.withColumn("_d", F.floor(F.col("h") / 24))
    thin = X.thin_negatives(X.thin_rows(day, 2), "next_fire", 24, "_d", 3)
    return thin.select("object_id", "h", "next_fire", "weight")


@query(
    "ablate_group",
    "mart",
    "SELECT object_id, h, 0.0::DOUBLE AS smoke_6h, CAST(NULL AS DOUBLE) AS temp_min_24h, round(events_168h, 6) AS events_168h FROM mart",
)
def ablate_group(s: Site):
    return X.ablate_group(s.mart, ["smoke_6h", "temp_min_24h"], ["temp_min_24h"]).select("object_id", "h", *rounded(["smoke_6h", "temp_min_24h", "events_168h"]))


@query(
    "feature_families",
    "",
    None,
)
def feature_families(s: Site):
    """Rows, mean and share of non-zero values of every feature family."""
    skip = {"object_id", "collector_id", "h", "ts", "year"}
    names = [c for c in s.mart.columns if c not in skip and not c.startswith("next_")]
    groups = X.feature_groups(names, TYPES)
    per = [
        F.struct(F.lit(g).alias("family"), F.lit(len(cols)).cast("bigint").alias("features"),
                 sum((F.coalesce((F.col(c) > 0).cast("bigint"), F.lit(0)) for c in cols), F.lit(0).cast("bigint")).alias("busy"))
        for g, cols in groups.items() if cols
    ]
    return s.mart.select(F.explode(F.array(*per)).alias("f")).select("f.*").groupBy("family", "features").agg(F.sum("busy").alias("busy_values"), F.count(F.lit(1)).alias("rows"))


@query(
    "drop_features",
    "mart",
    "SELECT object_id, h, round(events_168h, 6) AS events_168h, round(channels_24h, 6) AS channels_24h FROM mart",
)
def drop_features(s: Site):
    keep = ["object_id", "h", "events_168h", "channels_24h", "onset_fire_720h", "since_fire"]
    groups = X.feature_groups(keep[2:], TYPES)
    return X.drop_features(s.mart.select(*keep), groups["history"]).withColumns({c: F.round(c, 6) for c in ("events_168h", "channels_24h")})


@query(
    "join_hourly_pack",
    "mart g",
    """SELECT m.object_id, m.h, round(m.events_168h, 6) AS events_168h, f.fleet_events, coalesce(d.door_pack, 0) AS door_pack FROM mart m
 LEFT JOIN (SELECT h, CAST(sum(n_events) AS BIGINT) AS fleet_events FROM g GROUP BY 1) f USING (h)
 LEFT JOIN (SELECT object_id, h, door AS door_pack FROM g WHERE door > 0) d USING (object_id, h)""",
)
def join_hourly_pack(s: Site):
    fleet = s.grid.groupBy("h").agg(F.sum("n_events").alias("fleet_events"))
    door = s.grid.where("door > 0").select("object_id", "h", F.col("door").alias("door_pack"))
    m = s.mart.select("object_id", "h", F.round("events_168h", 6).alias("events_168h"))
    return X.join_hourly_pack(m, fleet, door)


part(
    "check9",
    "mart j trig inc",
    f"""SELECT m.object_id, m.h,
 (SELECT count(*) FROM j WHERE j.object_id = m.object_id AND us >= e - 6 * {HOUR} AND us < e AND state = 'smoke_detected') AS smoke_6h,
 (SELECT count(*) FROM j WHERE j.object_id = m.object_id AND us >= e - 168 * {HOUR} AND us < e) AS events_168h,
 (SELECT max(num) FROM j WHERE j.object_id = m.object_id AND us >= e - 24 * {HOUR} AND us < e AND {GAS}) AS gas_max_24h,
 (SELECT count(*) FROM trig t WHERE t.object_id = m.object_id AND type = 'fire' AND us + 600000000 >= e - 24 * {HOUR} AND us + 600000000 < e) AS trig_fire_24h,
 (SELECT count(*) FROM inc i WHERE i.object_id = m.object_id AND type = 'equipment' AND noise IS NULL AND t0 >= e - 168 * {HOUR} AND t0 < e) AS onset_equipment_168h,
 least(721, coalesce({hour_sql("(SELECT min(t0) FROM inc i WHERE i.object_id = m.object_id AND type = 'fire' AND noise IS NULL AND t0 >= e)")} - m.h, 721)) AS next_fire
FROM (SELECT object_id, h, {ORIGIN_US} + (h + 1) * {HOUR} AS e FROM mart WHERE h % 29 = 0) m""",
)


@query("mart_check", "check9", "SELECT object_id, h, CAST(smoke_6h AS DOUBLE) AS smoke_6h, CAST(events_168h AS DOUBLE) AS events_168h, round(gas_max_24h, 6) AS gas_max_24h, CAST(trig_fire_24h AS DOUBLE) AS trig_fire_24h, CAST(onset_equipment_168h AS DOUBLE) AS onset_equipment_168h, next_fire FROM check9")
def mart_check(s: Site):
    """Every 29th hour of the mart, beside direct counts over the journal."""
    from ..plans.replay import direct_counts

    rows = s.mart.where("h % 29 = 0").select("object_id", "h")
    return direct_counts(rows, s.journal, s.triggers, s.episodes, VOC)


def cut(s: Site) -> int:
    """A moment three quarters into the data, on an hour."""
    lo, hi = s.bounds
    return ORIGIN_US + (lo + (hi - lo) * 3 // 4) * HOUR


IGNORED = (300, 310)


@query(
    "asof_view",
    "j lim",
    f"""SELECT event_id, object_id, us, stype FROM j, (SELECT {ORIGIN_US} + (lo + (hi - lo) * 3 // 4) * {HOUR} AS t, {ORIGIN_US} + lo * {HOUR} AS z FROM lim)
WHERE us < t AND (us >= t - 10 * 86400000000 OR stype = 'guard') AND (stype = 'guard' OR NOT (us >= z + 300 * {HOUR} AND us < z + 310 * {HOUR}))""",
)
def asof_view(s: Site):
    from ..plans.replay import asof_view as view

    z = ORIGIN_US + s.bounds[0] * HOUR
    gaps = s.spark.createDataFrame([(z + IGNORED[0] * HOUR, z + IGNORED[1] * HOUR)], "a long, b long")
    return view(s.journal, cut(s), F.col("stype") == "guard", gaps, 10).select("event_id", "object_id", "us", "stype")


SNAP = ["smoke_6h", "events_168h", "gas_max_24h", "temp_mean_168h", "since_gas", "since_equipment", "onset_fire_720h", "trig_sensor_6h", "coll_onset_fire_24h"]
SNAP_AT = "2024-01-23 12:00:00"
SNAP_H = (literal_us(SNAP_AT) - ORIGIN_US) // HOUR
part("gs", "obj lim counters readings guard_h onsets_h trigs_h noise_h arrive_h visit_h", PARTS["g"][1].replace("range(lo, hi)", f"range({SNAP_H} - 960, {SNAP_H})"))


@query(
    "snapshot_at",
    "gs",
    f"""SELECT object_id, h, round(smoke_6h, 6) AS smoke_6h, round(events_168h, 6) AS events_168h, round(gas_max_24h, 6) AS gas_max_24h, round(temp_mean_168h + 1e-9, 6) AS temp_mean_168h, CAST(since_gas AS BIGINT) AS since_gas, CAST(since_equipment AS BIGINT) AS since_equipment,
 round(onset_fire_720h, 6) AS onset_fire_720h, round(trig_sensor_6h, 6) AS trig_sensor_6h, CAST(coll_onset_fire_24h AS DOUBLE) AS coll_onset_fire_24h, armed FROM (SELECT collector_id, object_id, h, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATS.items() if n in SNAP)},
 last_value(guard_last IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY h) AS armed FROM gs) JOIN (SELECT collector_id, h, {past('sum(onset_fire)', 24, 'collector_id')} AS coll_onset_fire_24h FROM (SELECT collector_id, h, sum(onset_fire) AS onset_fire FROM gs GROUP BY 1, 2)) USING (collector_id, h)
WHERE h = {SNAP_H - 1}""",
    before=SNAP_AT,
)
def snapshot_at(s: Site):
    """Rebuilt from the journal before the moment; its SQL reads the events
    before it only."""
    from ..plans.replay import snapshot_at as snap

    out = snap(s.journal, s.objects, literal_us(SNAP_AT), VOC, PARAMS, days=40)
    rest = [c for c in SNAP if not c.startswith("since_") and c != "temp_mean_168h"]
    return out.select("object_id", "h", "since_gas", "since_equipment", "armed", nudged(F.col("temp_mean_168h")).alias("temp_mean_168h"), *rounded(rest))


@query("snapshot_diff")
def snapshot_diff(s: Site):
    """Features of one moment rebuilt without the future, against the mart."""
    from ..plans.replay import snapshot_at as snap, snapshot_diff as diff

    rows = snap(s.journal, s.objects, cut(s), VOC, PARAMS, days=40)
    full = X.object_features(s.grid, VOC).join(X.collector_features(s.grid, VOC), ["collector_id", "h"])
    return diff(rows, full, [*SNAP, "armed"])
