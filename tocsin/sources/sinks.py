"""Table sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.settle import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, in the storage all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_mart(mart: DataFrame, path: str) -> str:
    """Mart by year, zstd.  Rows of one object stay together inside a year, so
    readers of few objects skip row groups."""
    (
        mart.hint("rebalance", "year", "object_id")
        .sortWithinPartitions("year", "object_id", "h")
        .write.mode("overwrite")
        .partitionBy("year")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def write_hours(rows, path: str, day: str = "day", hour: str = "hour") -> str:
    """Archive by reception day and hour.  Rebalancing gathers an hour into few
    files and splits a hot one over several tasks."""
    rows.hint("rebalance", day, hour).write.mode("append").partitionBy(day, hour).option("maxRecordsPerFile", 5_000_000).json(path)
    return path


def compact(spark: SparkSession, source: str, target: str, before_day: str, keep_from: str) -> str:
    """Rewrite closed days as zstd Parquet and leave out days past keeping."""
    from pyspark.sql import functions as F

    closed = spark.read.json(source).where((F.col("day") < before_day) & (F.col("day") >= keep_from))
    (
        closed.hint("rebalance", "day", "hour")
        .write.mode("overwrite")
        .partitionBy("day", "hour")
        .option("compression", "zstd")
        .parquet(target)
    )
    return target


def archive_read(archive, channels: list[int], a, b, limit: int, most_hours: int):
    """Newest-first rows of the channels in ``[a, b)``: at most ``limit`` of
    the last ``most_hours`` hours, and ``more`` when rows remain, be it beyond
    the limit or before those hours."""
    from pyspark.sql import Window, functions as F

    hours = archive.where((F.col("h") >= a) & (F.col("h") < b))
    newest = F.lit(b - most_hours)
    mine = hours.where(F.col("channel_id").isin(*channels))
    got = mine.where(F.col("h") >= newest).orderBy(F.col("us").desc(), F.col("event_id").desc()).limit(limit + 1)
    # at most limit + 1 rows: one small window
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    r = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("us").desc(), F.col("event_id").desc()))
    older = bool(mine.where(F.col("h") < newest).take(1))
    return got.select("*", ((n > limit) | F.lit(older)).alias("more"), r.alias("_r")).where(F.col("_r") <= limit).drop("_r")


def overwrite_hours(rows, path: str, keys: list[str]) -> str:
    """Replace only the partitions present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return path
