"""Sources, sinks, cleaning and ingest queries."""

from pyspark.sql import functions as F

from ..functions.timebase import HOUR, ORIGIN_US, hour_of, us_of, year_of
from ..sources import journal as J
from ..sources import packets as P
from ..sources import sinks
from .registry import part, query
from .site import Site

# a dirty raw log written out of the events: bad channels and dates, doubled
# rows, masked guard dates
part(
    "rawlog",
    "",
    """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS chan,
 CASE WHEN event_id % 89 = 0 THEN '2024-13-45' ELSE strftime(ts, '%Y-%m-%d') END AS d, strftime(ts, '%H:%M:%S') AS t,
 CASE WHEN event_id % 83 = 0 THEN '##.##.####' WHEN event_type = 'view' THEN CAST(CAST(round(value * 4) AS BIGINT) AS VARCHAR) || '.5'
  WHEN event_id % 7 = 0 THEN 'say "' || event_type || '", ok' ELSE event_type END AS v FROM events
 UNION ALL SELECT event_id, CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'), event_type FROM events WHERE event_id % 10 = 3 AND event_type <> 'view'""",
)
part(
    "rawrows",
    "rawlog",
    "SELECT TRY_CAST(chan AS INTEGER) AS channel_id, TRY_CAST(d || ' ' || t AS TIMESTAMP) AS ts, v FROM rawlog",
)


def raw(s: Site):
    e = s.table("events")
    user, i, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    v = (
        F.when(i % 83 == 0, "##.##.####")
        .when(kind == "view", F.concat(F.round(F.col("value") * 4).cast("bigint").cast("string"), F.lit(".5")))
        .when(i % 7 == 0, F.concat(F.lit('say "'), kind, F.lit('", ok')))
        .otherwise(kind)
    )
    names = J.RAW_COLUMNS
    one = e.select(
        i.cast("string").alias(names[0]),
        F.when(i % 97 == 0, F.concat(F.lit("x"), user)).otherwise(user.cast("string")).alias(names[1]),
        F.when(i % 89 == 0, "2024-13-45").otherwise(day).alias(names[2]),
        clock.alias(names[3]),
        F.lit("f").alias(names[4]),
        v.alias(names[5]),
    )
    again = e.where((i % 10 == 3) & (kind != "view")).select(
        i.cast("string").alias(names[0]), user.cast("string").alias(names[1]), day.alias(names[2]), clock.alias(names[3]), F.lit("t").alias(names[4]), kind.alias(names[5])
    )
    return one.unionByName(again)


@query("src_journal_csv", "rawrows", "SELECT channel_id, ts, v FROM rawrows")
def src_journal_csv(s: Site):
    path = sinks.scratch(s.spark, "journal")
    raw(s).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return J.read_journal_csv(s.spark, path)


@query("src_dictionaries", "ch", "SELECT CAST(channel_id AS INTEGER) AS channel_id, 'sys' AS system, stype, 'tag' AS tag, 'sensor PK ' || channel_id AS name, CAST(object_id AS INTEGER) AS object_id FROM ch")
def src_dictionaries(s: Site):
    path = sinks.scratch(s.spark, "channels")
    back = {n: c for c, n in J.CHANNEL_COLUMNS.items()}
    s.channels.select(
        F.col("channel_id").alias(back["channel_id"]), F.lit("sys").alias(back["system"]), F.col("stype").alias(back["stype"]),
        F.lit("tag").alias(back["tag"]), F.concat(F.lit("sensor PK "), F.col("channel_id")).alias(back["name"]), F.col("object_id").alias(back["object_id"]),
    ).write.option("header", True).csv(path)
    return J.read_dictionary(s.spark, path, J.CHANNEL_COLUMNS, ("channel_id", "object_id"))


@query("clean_dedup", "rawrows", "SELECT DISTINCT channel_id, ts, v FROM rawrows")
def clean_dedup(s: Site):
    return J.dedup(J.tolerant(raw(s)))


@query("clean_period", "rawrows", "SELECT channel_id, ts, v FROM rawrows WHERE ts >= '2024-01-05' AND ts < '2024-01-20' AND year(ts) <> 2021")
def clean_period(s: Site):
    return J.in_period(J.tolerant(raw(s)), "2024-01-05", "2024-01-20", 2021)


part("chmap", "", "SELECT DISTINCT user_id AS channel_id, CASE WHEN user_id % 5 = 0 THEN 'guard' ELSE 'other' END AS stype, user_id % 12 AS object_id FROM events WHERE user_id % 11 <> 0")


def channel_map(s: Site):
    u = F.col("user_id")
    return s.table("events").where(u % 11 != 0).select(
        u.alias("channel_id"), F.when(u % 5 == 0, "guard").otherwise("other").alias("stype"), (u % 12).alias("object_id")
    ).distinct()


@query("clean_attach_channel", "rawrows chmap", "SELECT CAST(channel_id AS BIGINT) AS channel_id, ts, v, stype, object_id FROM rawrows JOIN chmap USING (channel_id)")
def clean_attach_channel(s: Site):
    return J.attach_channel(J.tolerant(raw(s)), channel_map(s)).withColumn("channel_id", F.col("channel_id").cast("bigint"))


@query(
    "clean_guard_dates",
    "rawrows chmap",
    "SELECT CAST(channel_id AS BIGINT) AS channel_id, ts, v, stype FROM rawrows JOIN chmap USING (channel_id) WHERE NOT (stype = 'guard' AND regexp_matches(v, '^[0-9#]{2}\\.[0-9#]{2}\\.'))",
)
def clean_guard_dates(s: Site):
    rows = J.drop_guard_dates(J.attach_channel(J.tolerant(raw(s)), channel_map(s)), "guard")
    return rows.select(F.col("channel_id").cast("bigint").alias("channel_id"), "ts", "v", "stype")


@query(
    "clean_value_split",
    "rawrows",
    "SELECT channel_id, ts, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS state, TRY_CAST(v AS DOUBLE) AS num FROM rawrows",
)
def clean_value_split(s: Site):
    return J.split_value(J.tolerant(raw(s))).select("channel_id", "ts", "state", "num")


# words in which every kind of value occurs
part(
    "words",
    "",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%d.%m.%Y') WHEN 1 THEN strftime(ts, '%d.%m.%Y %H:%M:%S') WHEN 2 THEN CAST(event_id AS VARCHAR)
 WHEN 3 THEN 'Дв' WHEN 4 THEN ' ' || event_type || ' ' WHEN 5 THEN 'Неопределен' WHEN 6 THEN '' ELSE event_type END AS v FROM events""",
)


def words(s: Site):
    i, k = F.col("event_id"), F.col("event_type")
    v = (
        F.when(i % 8 == 0, F.date_format("ts", "dd.MM.yyyy")).when(i % 8 == 1, F.date_format("ts", "dd.MM.yyyy HH:mm:ss"))
        .when(i % 8 == 2, i.cast("string")).when(i % 8 == 3, "Дв").when(i % 8 == 4, F.concat(F.lit(" "), k, F.lit(" ")))
        .when(i % 8 == 5, "Неопределен").when(i % 8 == 6, "").otherwise(k)
    )
    return s.table("events").select("event_id", v.alias("v"))


@query(
    "value_kind",
    "words",
    r"""SELECT event_id, v, k AS kind, CASE WHEN k = 'numeric' THEN TRY_CAST(v AS DOUBLE) END AS number, CASE WHEN k = 'status' THEN v END AS status,
 CASE WHEN w NOT IN ('Неопределен', 'Не определено', 'nan', 'None', '') THEN w END AS normal FROM (SELECT *, CASE WHEN regexp_full_match(v, '\d{2}\.\d{2}\.\d{4}( \d{2}:\d{2}:\d{2})?') THEN 'date_artifact'
  WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'status' END AS k, CASE trim(v) WHEN 'Дв' THEN 'Да' ELSE trim(v) END AS w FROM words)""",
)
def value_kind(s: Site):
    return J.value_kind(words(s))


@query(
    "journal_year_stats",
    "j",
    "SELECT CAST(year(make_timestamp(us)) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT channel_id) AS channels, count(DISTINCT object_id) AS objects FROM j GROUP BY 1",
)
def journal_year_stats(s: Site):
    return J.year_stats(s.journal, year_of("us"))


# ---- packets: 25 events each, some fields spoiled by the event number
def spoiled(s: Site):
    i = F.col("event_id")
    e = s.table("events")
    num = F.round(F.col("value") * 4).cast("bigint")
    fields = [
        F.concat(F.lit(f'"{P.EVENT_ID}": '), F.when(i % 71 == 0, '"no"').otherwise(i.cast("string"))),
        F.when(i % 31 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit(f'"{P.CHANNEL}": '), F.when(i % 37 == 0, "-4").when(i % 3 == 0, F.concat(F.lit('" '), F.col("user_id"), F.lit('"'))).otherwise(F.col("user_id").cast("string")))
        ),
        F.concat(F.lit(f'"{P.DATE}": "'), F.when(i % 41 == 0, "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd")), F.lit('"')),
        F.when(i % 43 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(f'"{P.TIME}": "'), F.date_format("ts", "HH:mm:ss"), F.lit('"'))),
        F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(f'"{P.ALARM}": '), F.when(i % 47 == 0, '"maybe"').when(i % 2 == 0, '"T"').otherwise("false"))),
        F.concat(F.lit(f'"{P.VALUE}": '), F.when(i % 53 == 0, '"  "').when(i % 59 == 0, "null").when(F.col("event_type") == "view", num.cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))),
    ]
    item = F.when(i % 101 == 0, "17").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    return e.select("event_id", F.floor(i / 25).alias("packet"), item.alias("item"))


def packets(s: Site):
    body = F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]))
    g = spoiled(s).groupBy("packet").agg(body.alias("list"))
    k = F.col("packet") % 4
    return g.select(
        "packet",
        F.when(k == 0, F.concat(F.lit('{"events": ['), "list", F.lit("]}")))
        .when(k == 1, F.concat(F.lit("["), "list", F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"события": ['), "list", F.lit("]}")))
        .otherwise(F.when(F.col("packet") % 20 == 3, '{"rows": []}').otherwise(F.concat(F.lit("["), "list", F.lit("]"))))
        .alias("body"),
    )


part("pk", "", "SELECT *, event_id // 25 AS packet, event_id % 25 AS pos FROM events WHERE event_id // 25 % 20 <> 3")
part(
    "pev",
    "pk",
    f"""SELECT event_id, packet, pos, user_id, event_type, value, ts, CASE WHEN event_id % 101 = 0 THEN '{P.NOT_OBJECT}' WHEN event_id % 31 = 0 THEN '{P.NO_CHANNEL}'
 WHEN event_id % 37 = 0 THEN '{P.BAD_CHANNEL}' WHEN user_id = 0 THEN '{P.BAD_CHANNEL}' WHEN event_id % 43 = 0 THEN '{P.NO_TIME}' WHEN event_id % 41 = 0 THEN '{P.BAD_TIME}'
 WHEN event_id % 5 <> 0 AND event_id % 47 = 0 THEN '{P.BAD_ALARM}' WHEN event_id % 53 <> 0 AND event_id % 59 = 0 THEN '{P.NO_VALUE}'
 WHEN event_id % 53 = 0 THEN '{P.BAD_VALUE}' WHEN event_id % 71 = 0 THEN '{P.BAD_ID}' END AS reason,
 event_id % 5 <> 0 AND event_id % 2 = 0 AS alarm, CASE WHEN event_type = 'view' THEN CAST(CAST(round(value * 4) AS BIGINT) AS VARCHAR) ELSE event_type END AS v FROM pk""",
)


@query("ingest_packets", "pk", "SELECT packet, CAST(pos AS INTEGER) AS pos FROM pk")
def ingest_packets(s: Site):
    return P.unpack(packets(s))[0].select("packet", "pos")


@query(
    "ingest_normalize",
    "pev",
    "SELECT packet, CAST(pos AS INTEGER) AS pos, reason, CASE WHEN reason IS NULL THEN user_id END AS channel_id, CASE WHEN reason IS NULL THEN date_trunc('second', ts) END AS ts, CASE WHEN reason IS NULL THEN alarm END AS alarm, CASE WHEN reason IS NULL THEN v END AS value, CASE WHEN reason IS NULL THEN event_id END AS event_id FROM pev",
)
def ingest_normalize(s: Site):
    n = P.normalize(P.unpack(packets(s))[0])
    ok = F.col("reason").isNull()
    return n.select("packet", "pos", "reason", *[F.when(ok, F.col(c)).alias(c) for c in ("channel_id", "ts", "alarm", "value", "event_id")])


part(
    "texts",
    "",
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN '1_0' WHEN 2 THEN '_1' WHEN 3 THEN '0x1F' WHEN 4 THEN '1e400' WHEN 5 THEN '-' || event_id || '.5e1'
 WHEN 6 THEN event_type WHEN 7 THEN '1_' ELSE 'nan' END AS v FROM events""",
)


@query("ingest_numeric_text", "texts", "SELECT event_id, v, event_id % 9 IN (0, 1, 5) AS numeric FROM texts")
def ingest_numeric_text(s: Site):
    i = F.col("event_id")
    v = (
        F.when(i % 9 == 0, F.concat(F.lit(" "), i, F.lit(" "))).when(i % 9 == 1, "1_0").when(i % 9 == 2, "_1").when(i % 9 == 3, "0x1F").when(i % 9 == 4, "1e400")
        .when(i % 9 == 5, F.concat(F.lit("-"), i, F.lit(".5e1"))).when(i % 9 == 6, F.col("event_type")).when(i % 9 == 7, "1_").otherwise("nan")
    )
    return s.table("events").select("event_id", v.alias("v")).withColumn("numeric", P.numeric_text(F.col("v")))


@query("ingest_route", "pev", f"SELECT event_id, CASE WHEN alarm OR event_type <> 'view' THEN '{P.JOURNAL}' ELSE '{P.READINGS}' END AS topic FROM pev WHERE reason IS NULL")
def ingest_route(s: Site):
    n = P.normalize(P.unpack(packets(s))[0]).where("reason is null")
    return n.select("event_id", P.topic(F.col("alarm"), F.col("value")).alias("topic"))


@query(
    "ingest_rejects",
    "pev",
    "SELECT packet, count(*) AS events, count(reason) AS rejected, array_to_string(list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL)))[1:5], '; ') AS reasons FROM pev GROUP BY packet HAVING count(reason) > 0",
)
def ingest_rejects(s: Site):
    r = P.reject_report(P.normalize(P.unpack(packets(s))[0]), "packet")
    return r.withColumn("reasons", F.concat_ws("; ", "reasons"))


@query(
    "ingest_counters",
    "pev",
    "SELECT count(DISTINCT packet) AS packets, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected, max(date_trunc('second', ts)) FILTER (reason IS NULL) AS last_accepted FROM pev",
)
def ingest_counters(s: Site):
    return P.counters(P.normalize(P.unpack(packets(s))[0]), "packet", F.col("ts"))


def messages(s: Site):
    i = F.col("event_id")
    stamp, day, clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    native = F.concat(F.lit(f'{{"{P.CHANNEL}": '), F.col("user_id"), F.lit(f', "{P.DATE}": "'), day, F.lit(f'", "{P.TIME}": "'), clock, F.lit(f'", "{P.VALUE}": "'), F.col("event_type"), F.lit('"}'))
    short = F.concat(F.lit('{"channel_id": '), F.col("user_id"), F.lit(', "ts": "'), stamp, F.lit('", "value": "'), F.col("event_type"), F.lit('"}'))
    body = F.when(i % 19 == 0, "{broken").when(i % 23 == 0, '{"channel_id": "z"}').when(i % 2 == 0, native).otherwise(short)
    return s.table("events").select("event_id", body.alias("body"))


@query(
    "message_parse_two_shapes",
    "",
    "SELECT event_id, CASE WHEN ok THEN user_id END AS channel_id, CASE WHEN ok THEN date_trunc('second', ts) END AS ts, CASE WHEN ok THEN event_type END AS value, CASE WHEN NOT ok THEN 'unreadable' END AS reason FROM (SELECT *, event_id % 19 <> 0 AND event_id % 23 <> 0 AS ok FROM events)",
)
def message_parse_two_shapes(s: Site):
    return P.two_shapes(messages(s))


@query(
    "replay_reader",
    "rawrows",
    "SELECT channel_id, ts, v FROM rawrows WHERE ts >= '2024-01-03' AND ts < '2024-01-10' AND channel_id IS NOT NULL",
)
def replay_reader(s: Site):
    rows = J.in_period(J.tolerant(raw(s)), "2024-01-03", "2024-01-10")
    return rows.where("channel_id is not null").orderBy("ts", "channel_id", "v")


KEY = ["channel_id", "ts", "v"]


@query(
    "idempotent_append",
    "rawrows",
    "SELECT DISTINCT channel_id, ts, v FROM rawrows r WHERE ts >= '2024-01-10' AND ts < '2024-01-20' AND NOT EXISTS (SELECT 1 FROM rawrows h WHERE h.ts < '2024-01-15' AND h.channel_id = r.channel_id AND h.ts = r.ts AND h.v = r.v)",
)
def idempotent_append(s: Site):
    rows = J.tolerant(raw(s))
    hot = J.in_period(rows, "2019-01-01", "2024-01-15")
    batch = J.in_period(rows, "2024-01-10", "2024-01-20")
    return J.idempotent_append(hot, batch, KEY).select(*KEY)


@query(
    "bulk_import_window",
    "rawrows chmap",
    "SELECT CAST(channel_id AS BIGINT) AS channel_id, ts, v, stype FROM rawrows JOIN chmap USING (channel_id) WHERE ts < '2024-01-25' AND (ts >= '2024-01-20' OR stype = 'guard')",
)
def bulk_import_window(s: Site):
    rows = J.attach_channel(J.tolerant(raw(s)), channel_map(s))
    lit = lambda d: F.lit(d).cast("timestamp_ntz")
    out = J.import_window(rows, lit("2024-01-20"), lit("2024-01-25"), F.col("stype") == "guard")
    return out.select(F.col("channel_id").cast("bigint").alias("channel_id"), "ts", "v", "stype")


@query("retention_sweep", "j", "SELECT event_id, us, stype FROM j WHERE us >= epoch_us(TIMESTAMP '2024-01-20') OR stype = 'guard'")
def retention_sweep(s: Site):
    from ..functions.timebase import literal_us

    rows = s.journal.withColumn("ts", F.col("us"))
    return J.retention_keep(rows, F.lit(literal_us("2024-01-20")), F.col("stype") == "guard").select("event_id", "us", "stype")


part(
    "refmsg",
    "",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'channel.status' WHEN 1 THEN 'object' WHEN 2 THEN 'channel' WHEN 3 THEN 'channel.status' ELSE 'other' END AS kind,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS key, CASE event_id % 6 WHEN 0 THEN CASE WHEN value > 50 THEN 'silent' ELSE 'ok' END WHEN 3 THEN 'lost' END AS status, epoch_us(ts) AS seen_at FROM events""",
)


def reference_messages(s: Site):
    i = F.col("event_id")
    k = i % 6
    return s.table("events").select(
        "event_id",
        F.when(k == 0, "channel.status").when(k == 1, "object").when(k == 2, "channel").when(k == 3, "channel.status").otherwise("other").alias("kind"),
        F.when(i % 17 != 0, F.col("user_id")).alias("key"),
        F.when(k == 0, F.when(F.col("value") > 50, "silent").otherwise("ok")).when(k == 3, "lost").alias("status"),
        us_of("ts").alias("seen_at"),
    )


@query(
    "reference_upsert",
    "refmsg",
    """SELECT kind, key, arg_max(event_id, seen_at) AS event_id, arg_max(coalesce(status, '-'), seen_at) AS status, max(seen_at) AS seen_at FROM refmsg
 WHERE key IS NOT NULL AND kind <> 'other' AND (kind <> 'channel.status' OR status IN ('silent', 'ok')) GROUP BY kind, key""",
)
def reference_upsert(s: Site):
    good, _ = J.reference_split(reference_messages(s))
    empty = good.limit(0)
    out = J.latest_per_key(empty, good, ["kind", "key"], ["seen_at", "event_id"])
    return out.withColumn("status", F.coalesce("status", F.lit("-")))


@query(
    "silent_channels",
    "refmsg ch",
    """SELECT object_id, channel_id, stype, since FROM (SELECT key AS channel_id, arg_max(status, seen_at) AS status, max(seen_at) AS since FROM refmsg WHERE kind = 'channel.status' AND key IS NOT NULL AND status IN ('silent', 'ok') GROUP BY 1)
 JOIN ch USING (channel_id) WHERE status = 'silent'""",
)
def silent_channels(s: Site):
    good, _ = J.reference_split(reference_messages(s))
    st = good.where("kind = 'channel.status'").select(F.col("key").alias("channel_id"), "status", F.col("seen_at").alias("since"))
    return J.silent_channels(J.latest_per_key(st.limit(0), st, ["channel_id"], ["since"]), s.channels)


@query("last_message", "scores", "SELECT type, object_id, max(h) AS h, arg_max(round(p, 6), h) AS p FROM scores WHERE run = 'busy' GROUP BY 1, 2")
def last_message(s: Site):
    m = s.scores.where("run = 'busy'").select("type", "object_id", "h", F.round("p", 6).alias("p"))
    return J.last_message(m, ["type", "object_id"], "h")


@query(
    "evidence",
    "j",
    """SELECT object_id, channel_id, us, stype, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY us DESC, channel_id) AS r FROM (
 SELECT object_id, channel_id, max(us) AS us, arg_max(stype, us) AS stype FROM j WHERE us < epoch_us(TIMESTAMP '2024-01-20') AND us >= epoch_us(TIMESTAMP '2024-01-19') AND stype <> 'guard' GROUP BY 1, 2)) WHERE r <= 5""",
)
def evidence(s: Site):
    from ..functions.timebase import literal_us

    e = J.evidence(s.journal, "us", literal_us("2024-01-20"), 24, "guard", 5)
    return e.select("object_id", "channel_id", "us", "stype", F.col("place").cast("bigint").alias("place"))


# ---- archive and forecast log
def archived(s: Site):
    ts = F.col("ts")
    return s.table("events").select(
        "event_id", F.col("user_id").alias("channel_id"), "event_type", us_of("ts").alias("us"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"), F.hour(ts).alias("hour"),
    )


@query("archive_write", "", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def archive_write(s: Site):
    path = sinks.write_hours(archived(s), sinks.scratch(s.spark, "archive"))
    back = s.spark.read.schema("event_id bigint, day string, hour bigint").json(path)
    return back.groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query(
    "archive_compact",
    "",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-25' GROUP BY 1",
)
def archive_compact(s: Site):
    src = sinks.write_hours(archived(s), sinks.scratch(s.spark, "archive"))
    out = sinks.compact(s.spark, src, sinks.scratch(s.spark, "compact"), "2024-01-25", "2024-01-10")
    back = s.spark.read.parquet(out)
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("channel_id").alias("users"))


@query(
    "archive_read",
    "",
    f"""SELECT event_id, channel_id, us, count(*) OVER () > 50 OR EXISTS (SELECT 1 FROM events WHERE user_id IN (1, 2, 3, 8) AND ts >= '2024-01-10' AND ts < '2024-01-16 12:00:00') AS more FROM (SELECT event_id, user_id AS channel_id, epoch_us(ts) AS us FROM events
 WHERE user_id IN (1, 2, 3, 8) AND ts >= '2024-01-16 12:00:00' AND ts < '2024-01-20' ORDER BY us DESC, event_id DESC LIMIT 51) ORDER BY us DESC, event_id DESC LIMIT 50""",
)
def archive_read(s: Site):
    rows = archived(s).withColumn("h", hour_of("us"))
    lo = (1704067200 * 1_000_000 - ORIGIN_US) // HOUR  # 2024-01-01
    out = sinks.archive_read(rows, [1, 2, 3, 8], lo + 24 * 9, lo + 24 * 19, 50, 84)
    return out.select("event_id", "channel_id", "us", "more")


@query(
    "forecast_log_write",
    "scores",
    "SELECT h, type, count(*) AS n, round(sum(CASE WHEN h % 7 = 0 THEN p * 2 ELSE p END), 6) AS total FROM scores WHERE run = 'busy' AND split = 'test' GROUP BY 1, 2",
)
def forecast_log_write(s: Site):
    """Every hour is written, then every seventh hour is written over."""
    rows = s.scores.where("run = 'busy' and split = 'test'").select("h", "type", "object_id", "p")
    path = sinks.overwrite_hours(rows, sinks.scratch(s.spark, "fclog"), ["h"])
    sinks.overwrite_hours(rows.where("h % 7 = 0").withColumn("p", F.col("p") * 2), path, ["h"])
    back = s.spark.read.parquet(path).withColumn("h", F.col("h").cast("bigint"))
    return back.groupBy("h", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("total"))


@query(
    "forecast_history",
    "scores thr",
    """SELECT h, round(p, 6) AS p, thr, CASE WHEN p >= thr THEN 'ALARM' END AS status FROM scores JOIN thr USING (run, type, split) WHERE run = 'busy' AND type = 'fire' AND object_id = 3 AND h >= 44000 AND h < 44500""",
)
def forecast_history(s: Site):
    from ..plans.state import forecast_history as history

    sc = s.scores.where("run = 'busy'")
    status = s.alarms.where("run = 'busy'").select("type", "object_id", "h", F.lit("ALARM").alias("status"))
    thr = s.thresholds(0.2).where("run = 'busy'").select("type", "split", "thr")
    return history(sc, thr, status, "fire", 3, 44000, 44500).select("h", F.round("p", 6).alias("p"), "thr", "status")


@query(
    "forecast_log_sweep",
    "scores",
    "SELECT type, count(*) AS n, min(h) AS oldest, max(h) AS newest FROM scores WHERE run = 'busy' AND h > (SELECT max(h) - 72 FROM scores) GROUP BY type",
)
def forecast_log_sweep(s: Site):
    from ..plans.state import log_sweep

    kept = log_sweep(s.scores.where("run = 'busy'"), "h", 72)
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("oldest"), F.max("h").alias("newest"))
