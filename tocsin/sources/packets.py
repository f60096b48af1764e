"""Telemetry packets: unpacking, validation, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MAX_EVENTS = 10_000
MAX_VALUE = 255
JOURNAL, READINGS = "tf.ingest.journal", "tf.ingest.readings"
# fixed values: field names of an event and the refusal texts
EVENT_ID, CHANNEL, DATE, TIME, ALARM, VALUE = (
    "ид_события",
    "ид_канала_данных",
    "дата",
    "время",
    "тревожное",
    "значение_датчика",
)
NOT_OBJECT = "событие не объект"
NO_CHANNEL = "нет ид_канала_данных"
BAD_CHANNEL = "ид_канала_данных не число"
NO_TIME = "нет даты или времени"
BAD_TIME = "дата или время не в формате ГГГГ-ММ-ДД ЧЧ:ММ:СС"
BAD_ALARM = "тревожное не true/false"
NO_VALUE = "нет значения датчика"
BAD_VALUE = f"значение датчика пустое или длиннее {MAX_VALUE}"
BAD_ID = "ид_события не число"
BAD_PACKET = "пакет — список событий в поле events"
BIG_PACKET = f"в пакете больше {MAX_EVENTS} событий"

DIGITS = r"[0-9]+(_[0-9]+)*"
NUMBER = rf"^[+-]?({DIGITS}(\.({DIGITS})?)?|\.{DIGITS})([eE][+-]?{DIGITS})?$"


def part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), BOOLEAN, OBJECT<..>, ARRAY<..>, VOID."""
    return F.schema_of_variant(v)


def is_number(kind_: Column) -> Column:
    return kind_.rlike("^(BIGINT|DECIMAL|DOUBLE)")


def once(*cols: Column) -> list[Column]:
    """The columns as one generated row: filters and projections that read them
    several times are not moved below, so each is computed once a row."""
    return [F.inline(F.array(F.struct(*cols)))]


def unpack(packets: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Events of the packets with their position, and refused packets.  A
    packet is ``{"events": [..]}``, a bare list or ``{"события": [..]}``."""
    v = F.col("_v")
    p = packets.select("*", *once(F.try_parse_json(F.col(body)).alias("_v")))
    as_list = lambda c: F.try_variant_get(c, "$", "array<variant>")
    listed = F.coalesce(as_list(v), as_list(F.coalesce(part(v, "events"), part(v, "события"))))
    p = p.select(*packets.columns, *once(listed.alias("_i")))
    reason = F.when(F.col("_i").isNull(), BAD_PACKET).when(F.size("_i") > MAX_EVENTS, BIG_PACKET)
    p = p.withColumn("reason", reason)
    bad = p.where("reason is not null").drop("_i")
    good = p.where("reason is null")
    keep = [c for c in packets.columns if c != body]
    events = good.select(*keep, F.posexplode("_i").alias("pos", "event"))
    return events, bad


def as_integer(v: Column, kind_: Column) -> Column:
    """A number with its fraction dropped, or a string of digits; ``kind_`` is the value's kind."""
    text = F.when(kind_ == "STRING", F.trim(F.try_variant_get(v, "$", "string")))
    number = F.when(is_number(kind_), F.try_variant_get(v, "$", "double"))
    whole = F.when(F.abs(number) < 9.2e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return F.coalesce(F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")), whole.cast("bigint"))


def normalize(events: DataFrame) -> DataFrame:
    """Typed fields and ``reason``: the first rule an event breaks, else NULL.
    The reason never carries the sensor value.  Fields, their kinds and the typed
    values are each taken out of the event once."""
    e = F.col("event")
    names = (EVENT_ID, CHANNEL, DATE, TIME, ALARM, VALUE)
    at = {n: f"_f{i}" for i, n in enumerate(names)}
    parts = events.select("*", *once(*[part(e, n).alias(at[n]) for n in names]))
    kinds = parts.select("*", *once(kind(e).startswith("OBJECT").alias("_ko"), *[kind(F.col(at[n])).alias(f"_k{at[n]}") for n in names]))
    f = {n: F.col(at[n]) for n in names}
    k = {n: F.col(f"_k{at[n]}") for n in names}
    has = lambda n: f[n].isNotNull() & (k[n] != "VOID")
    text = lambda n: F.when(k[n] == "STRING", F.try_variant_get(f[n], "$", "string"))
    texts = kinds.select("*", *once(F.concat_ws(" ", text(DATE), text(TIME)).alias("_stamp"), F.lower(F.trim(text(ALARM))).alias("_flag")))
    stamp, flag_text = F.col("_stamp"), F.col("_flag")
    shape = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
    ts = F.when(stamp.rlike(shape), stamp.try_cast("timestamp_ntz"))
    flag = (
        F.when(f[ALARM].isNull(), F.lit(False))
        .when(k[ALARM] == "BOOLEAN", F.try_variant_get(f[ALARM], "$", "boolean"))
        .when(flag_text.isin("true", "t", "1"), F.lit(True))
        .when(flag_text.isin("false", "f", "0"), F.lit(False))
    )
    value = F.coalesce(text(VALUE), F.when(is_number(k[VALUE]), F.try_variant_get(f[VALUE], "$", "string")))
    typed = texts.select(
        *events.columns,
        *once(
            F.when(F.col("_ko"), 1).alias("_obj"),
            F.when(f[CHANNEL].isNotNull(), 1).alias("_chan"),
            as_integer(f[CHANNEL], k[CHANNEL]).alias("channel_id"),
            F.when(has(DATE) & has(TIME), 1).alias("_time"),
            ts.alias("ts"),
            flag.alias("alarm"),
            value.alias("value"),
            as_integer(f[EVENT_ID], k[EVENT_ID]).alias("event_id"),
            F.when(has(EVENT_ID), 1).alias("_id"),
        ),
    )
    c = F.col
    reason = (
        F.when(c("_obj").isNull(), NOT_OBJECT)
        .when(c("_chan").isNull(), NO_CHANNEL)
        .when(c("channel_id").isNull() | (c("channel_id") <= 0), BAD_CHANNEL)
        .when(c("_time").isNull(), NO_TIME)
        .when(c("ts").isNull(), BAD_TIME)
        .when(c("alarm").isNull(), BAD_ALARM)
        .when(c("value").isNull(), NO_VALUE)
        .when((F.trim("value") == "") | (F.length("value") > MAX_VALUE), BAD_VALUE)
        .when(c("_id").isNotNull() & c("event_id").isNull(), BAD_ID)
    )
    return typed.withColumn("reason", reason).drop("_obj", "_chan", "_time", "_id", "event")


def numeric_text(v: Column) -> Column:
    """Is the text a finite number; "_" only between digits, no hex."""
    s = F.trim(v)
    plain = F.regexp_replace(s, "_", "").try_cast("double")
    finite = plain.isNotNull() & (F.abs(plain) < F.lit(float("inf")))
    return F.coalesce(s.rlike(NUMBER) & finite, F.lit(False))


def topic(alarm: Column, value: Column) -> Column:
    """Alarms and words go to the journal, numbers to the readings."""
    return F.when(alarm | ~numeric_text(value), JOURNAL).otherwise(READINGS)


def reject_report(events: DataFrame, packet: str, most: int = 5) -> DataFrame:
    """Per packet: events, refusals and the first distinct reasons in order."""
    return events.groupBy(packet).agg(
        F.count(F.lit(1)).alias("events"),
        F.count("reason").alias("rejected"),
        F.slice(F.sort_array(F.collect_set("reason")), 1, most).alias("reasons"),
    ).where("rejected > 0")


def counters(events: DataFrame, packets: str, accepted_at: Column) -> DataFrame:
    good = F.col("reason").isNull()
    per = events.groupBy(packets).agg(
        F.count_if(good).alias("a"), F.count_if(~good).alias("r"), F.max(F.when(good, accepted_at)).alias("t")
    )
    return per.agg(
        F.count(F.lit(1)).alias("packets"), F.sum("a").alias("accepted"), F.sum("r").alias("rejected"),
        F.max("t").alias("last_accepted"),
    )


def two_shapes(messages: DataFrame, body: str = "body") -> DataFrame:
    """Accept native messages and ``{channel_id, ts, value}``; a message of
    neither shape has ``reason``."""
    native = F.from_json(F.col(body), f"`{CHANNEL}` string, `{DATE}` string, `{TIME}` string, `{VALUE}` string")
    short = F.from_json(F.col(body), "channel_id string, ts string, value string")
    m = messages.withColumn("_n", native).withColumn("_s", short)
    whole = reduce(lambda a, b: a & b, [F.col(f"_n.{c}").isNotNull() for c in (CHANNEL, DATE, TIME, VALUE)])
    stamp = F.concat_ws(" ", f"_n.{DATE}", f"_n.{TIME}").try_cast("timestamp_ntz")
    out = m.select(
        *[c for c in messages.columns if c != body],
        F.when(whole, F.col(f"_n.{CHANNEL}")).otherwise(F.col("_s.channel_id")).try_cast("bigint").alias("channel_id"),
        F.when(whole, stamp).otherwise(F.col("_s.ts").try_cast("timestamp_ntz")).alias("ts"),
        F.when(whole, F.col(f"_n.{VALUE}")).otherwise(F.col("_s.value")).alias("value"),
    )
    bad = F.col("channel_id").isNull() | F.col("ts").isNull() | F.col("value").isNull()
    return out.withColumn("reason", F.when(bad, "unreadable"))
