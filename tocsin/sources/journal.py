"""Journal and dictionary sources, cleaning, and keeping the hot journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.site_words import GUARD_DATE, GUARD_STYPE

# fixed values: column names of the journal and dictionary files
RAW_COLUMNS = ["ид_события", "ид_канала_данных", "дата", "время", "тревожное", "значение_датчика"]
RAW_SCHEMA = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
OBJECT_COLUMNS = {
    "ид_объект": "object_id",
    "иерархия_уровень": "level",
    "родитель": "parent_id",
    "вид_объекта": "kind",
    "диспетчерское_название_объекта": "name",
}
CHANNEL_COLUMNS = {
    "ид_канала_данных": "channel_id",
    "тип_инж_системы": "system",
    "тип_датчика": "stype",
    "тег_инженерной_системы": "tag",
    "название_датчика": "name",
    "ид_объект": "object_id",
}


def read_journal_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Yearly logs, every column text, tolerant casts: channel_id, ts, v."""
    raw = spark.read.schema(RAW_SCHEMA).option("header", True).option("quote", '"').option("escape", '"').csv(paths)
    return tolerant(raw)


def tolerant(raw: DataFrame) -> DataFrame:
    stamp = F.concat_ws(" ", "дата", "время")
    return raw.select(
        F.col("ид_канала_данных").try_cast("int").alias("channel_id"),
        stamp.try_cast("timestamp_ntz").alias("ts"),
        F.col("значение_датчика").alias("v"),
    )


def read_dictionary(spark: SparkSession, path: str, columns: dict[str, str], integers: tuple[str, ...]) -> DataFrame:
    d = spark.read.option("header", True).csv(path)
    cast = lambda c, n: F.col(c).try_cast("int") if n in integers else F.col(c)
    return d.select(*[cast(c, n).alias(n) for c, n in columns.items()])


def dedup(raw: DataFrame) -> DataFrame:
    """One row per (channel, time, value); the alarm flag plays no part."""
    return raw.select("channel_id", "ts", "v").dropDuplicates(["channel_id", "ts", "v"])


def in_period(raw: DataFrame, start: str, end: str, skip_year: int | None = None) -> DataFrame:
    t = F.col("ts")
    keep = (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))
    if skip_year is not None:
        # bounds instead of year(ts) <> y, so that partitions and row groups prune
        a, b = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (skip_year, skip_year + 1))
        keep = keep & ((t < a) | (t >= b))
    return raw.where(keep)


def attach_channel(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows of known channels with the sensor type and object.  The planner
    broadcasts the dictionary when its size allows."""
    return rows.join(channels.select("channel_id", "stype", "object_id"), "channel_id")


def drop_guard_dates(rows: DataFrame, guard_stype: str = GUARD_STYPE) -> DataFrame:
    return rows.where(~((F.col("stype") == guard_stype) & F.col("v").rlike(GUARD_DATE)))


def split_value(rows: DataFrame) -> DataFrame:
    """Numbers to ``num``, everything else to ``state``."""
    num = F.col("v").try_cast("double")
    return rows.withColumn("state", F.when(num.isNull(), F.col("v"))).withColumn("num", num)


def clean(raw: DataFrame, channels: DataFrame, start: str, end: str, skip_year: int | None, guard_stype: str = GUARD_STYPE) -> DataFrame:
    rows = attach_channel(dedup(in_period(raw, start, end, skip_year)), channels)
    return split_value(drop_guard_dates(rows, guard_stype)).drop("v")


# fixed values of the value classifier
DATE_VALUE = r"^\d{2}\.\d{2}\.\d{4}( \d{2}:\d{2}:\d{2})?$"
SPELLING = {"Дв": "Да"}
UNDEFINED = ("Неопределен", "Не определено", "nan", "None", "")


def value_kind(rows: DataFrame, value: str = "v") -> DataFrame:
    """Date artifact, number or status; the normalised spelling, NULL where the
    word means nothing."""
    v = F.col(value)
    is_date = v.rlike(DATE_VALUE)
    num = v.try_cast("double")
    kind = F.when(is_date, "date_artifact").when(num.isNotNull(), "numeric").otherwise("status")
    word = F.trim(v)
    for wrong, right in SPELLING.items():
        word = F.when(word == wrong, right).otherwise(word)
    return rows.select(
        "*",
        kind.alias("kind"),
        F.when(~is_date, num).alias("number"),
        F.when(kind == "status", v).alias("status"),
        F.when(~word.isin(*UNDEFINED), word).alias("normal"),
    )


def year_stats(journal: DataFrame, year: Column) -> DataFrame:
    """Rows, channels and objects per year, from one pre-aggregated pass."""
    cells = journal.groupBy(year.alias("year"), "channel_id", "object_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("year").agg(
        F.sum("n").alias("rows"),
        F.count_distinct("channel_id").alias("channels"),
        F.count_distinct("object_id").alias("objects"),
    )


# ---- the hot journal


def idempotent_append(hot: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch the journal does not hold yet, each once."""
    return batch.dropDuplicates(key).join(hot.select(*key), key, "left_anti")


def import_window(rows: DataFrame, since: Column, until: Column, guard: Column) -> DataFrame:
    """The trailing window and the whole guard history before its end."""
    return rows.where((F.col("ts") < until) & ((F.col("ts") >= since) | guard))


def retention_keep(hot: DataFrame, cut: Column, guard: Column) -> DataFrame:
    return hot.where((F.col("ts") >= cut) | guard)


REFERENCE_KINDS = ("channel.status", "object", "channel")


def reference_split(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and refused dictionary messages; a refused one names its reason."""
    status_ok = (F.col("kind") != "channel.status") | F.col("status").isin("silent", "ok")
    reason = (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin(*REFERENCE_KINDS), "unknown kind")
        .when(F.col("key").isNull(), "no key")
        .when(~F.coalesce(status_ok, F.lit(False)), "bad status")
    )
    marked = messages.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def latest_per_key(current: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of every key over both tables.  ``max_by`` combines on the
    map side, so a key with many changes is no hot spot."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def silent_channels(status: DataFrame, channels: DataFrame) -> DataFrame:
    return status.where("status = 'silent'").join(channels, "channel_id").select(
        "object_id", "channel_id", "stype", "since"
    )


def last_message(messages: DataFrame, key: list[str], at: str) -> DataFrame:
    rest = [c for c in messages.columns if c not in key]
    return messages.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(*key, "_r.*")


def evidence(journal: DataFrame, t: str, until: int, hours: int, skip_stype: str, per_object: int) -> DataFrame:
    """The last event of each channel in the trailing hours, the newest few
    per object."""
    from ..functions.timebase import HOUR

    recent = journal.where((F.col(t) < until) & (F.col(t) >= until - hours * HOUR) & (F.col("stype") != skip_stype))
    rest = [c for c in journal.columns if c not in ("object_id", "channel_id")]
    last = (
        recent.groupBy("object_id", "channel_id")
        .agg(F.max_by(F.struct(*rest), F.struct(t, "event_id")).alias("_r"))
        .select("object_id", "channel_id", "_r.*")
    )
    w = Window.partitionBy("object_id").orderBy(F.col(t).desc(), "channel_id")
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_object)
