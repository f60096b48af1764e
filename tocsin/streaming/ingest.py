"""Journal intake: parse, clean, append, dead letters, counters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import journal as J
from ..sources.packets import two_shapes
from .common import drop_folder, put, run_available


KEY = ["channel_id", "ts", "v"]
SEEN, MARK = "channel_id bigint, ts timestamp_ntz, v string", "newest timestamp_ntz, horizon timestamp_ntz"


def of_days(spark: SparkSession, journal: str, days: list[str]) -> DataFrame | None:
    """The journal's rows of the given days; only their folders are listed and read."""
    if not days:
        return None
    try:
        return spark.read.option("basePath", journal).parquet(f"{journal}/day={{{','.join(days)}}}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None  # no row of these days yet


def of_batch(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """What a table holds of one batch, without a look at the others."""
    return spark.read.schema(schema).parquet(f"{path}/batch={number}")


def unseen(batch: DataFrame, paths: dict[str, str], number: int) -> DataFrame:
    """The rows of the batch, each once, that the journal does not hold.

    Rows from the horizon on meet the remembered keys of the batch before, which are
    all the journal's keys from there on.  Older rows meet the journal of their own
    days.  Neither grows with the journal."""
    spark, rows = batch.sparkSession, batch.dropDuplicates(KEY)
    if not number:
        return rows
    horizon = F.lit(of_batch(spark, paths["marks"], number - 1, MARK).first()["horizon"]).cast("timestamp_ntz")
    recent = rows.where(F.col("ts") >= horizon).join(of_batch(spark, paths["seen"], number - 1, SEEN), KEY, "left_anti")
    older = rows.where(F.col("ts") < horizon)
    days = [str(r["day"]) for r in older.select("day").distinct().collect()]  # days that late rows are of
    held = of_days(spark, paths["journal"], days)
    if held is not None:
        older = older.join(held.where(F.col("batch") < number).select(*KEY), KEY, "left_anti")
    return recent.unionByName(older)


def remember(fresh: DataFrame, paths: dict[str, str], number: int, late: str) -> None:
    """Keep the newest moment's horizon, and the keys from it on, for the next batch."""
    spark, keys, newest = fresh.sparkSession, fresh.select(*KEY), fresh.select(F.col("ts").alias("newest"))
    if number:
        keys = keys.unionByName(of_batch(spark, paths["seen"], number - 1, SEEN))
        newest = newest.unionByName(of_batch(spark, paths["marks"], number - 1, MARK).select("newest"))
    none = F.lit("9999-12-31").cast("timestamp_ntz")  # nothing seen yet: all rows are looked up in their days
    newest = newest.agg(F.max("newest").alias("newest")).withColumn("horizon", F.coalesce(F.expr(f"newest - INTERVAL {late}"), none))
    newest.write.mode("overwrite").parquet(f"{paths['marks']}/batch={number}")
    horizon = F.lit(of_batch(spark, paths["marks"], number, MARK).first()["horizon"]).cast("timestamp_ntz")
    keys.where(F.col("ts") >= horizon).write.mode("overwrite").parquet(f"{paths['seen']}/batch={number}")
    if number > 1:
        for name in ("seen", "marks"):
            drop_folder(spark, f"{paths[name]}/batch={number - 2}")


def intake(messages: DataFrame, channels: DataFrame, base: str, checkpoint: str, guard_stype: str, late: str = "1 day") -> dict[str, str]:
    """Consume ``messages`` (with ``body``) into tables under ``base``: ``journal`` (by
    day and batch), ``dead`` and ``counters``; ``seen`` and ``marks`` are what the next
    batch has to remember.

    Good rows are appended once per (channel, time, value), however late a repeat
    comes: keys no older than ``late`` before the newest row are remembered from batch to
    batch, older rows are looked up in the journal of their days.  A batch replayed
    reads the same memory and replaces its own rows.
    """
    paths = {n: f"{base}/{n}" for n in ("journal", "dead", "counters", "seen", "marks")}

    def each(batch: DataFrame, number: int) -> None:
        parsed = two_shapes(batch).persist()
        try:
            good = parsed.where("reason is null").select("channel_id", "ts", F.col("value").alias("v"))
            clean = J.split_value(J.drop_guard_dates(J.attach_channel(good, channels), guard_stype))
            fresh = unseen(clean.withColumn("day", F.to_date("ts")), paths, number).persist()
            put(fresh, paths["journal"], number, ("day",))
            remember(fresh, paths, number, late)
            fresh.unpersist()
            put(parsed.where("reason is not null"), paths["dead"], number)
            kept = clean.agg(F.count(F.lit(1)).alias("accepted")).withColumn("_k", F.lit(1))
            seen = parsed.agg(F.count(F.lit(1)).alias("received"), F.count("reason").alias("dead")).withColumn("_k", F.lit(1))
            n = seen.join(kept, "_k").drop("_k").withColumn("dropped", F.col("received") - F.col("dead") - F.col("accepted"))
            put(n, paths["counters"], number)
        finally:
            parsed.unpersist()

    run_available(messages, each, checkpoint)
    return paths


def deduplicated(stream: DataFrame, at: str, key: list[str], late: str) -> DataFrame:
    """The same append for an unbounded stream: state lasts one watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def hourly_counts(stream: DataFrame, at: str, by: list[str], late: str) -> DataFrame:
    """Late data policy: an hour is computed on what arrived and updated while
    the watermark lets late rows in."""
    w = F.window(at, "1 hour")
    return stream.withWatermark(at, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("rows"), F.max(at).alias("last"))


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Episodes of an unbounded stream: the twin of the batch sessions."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(w, *by).agg(
        F.min(at).alias("t0"), F.max(at).alias("t1"), F.count(F.lit(1)).alias("rows")
    )


def stale(last: DataFrame, now, hours: float, by: list[str]) -> DataFrame:
    """Is the newest row of a group older than the limit."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.max("last").cast("double")) / 3600.0
    return last.groupBy(*by).agg(age.alias("hours")).withColumn("stale", F.col("hours") >= hours)
