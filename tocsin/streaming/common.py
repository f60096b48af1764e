"""Shared pieces of the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, folder: str, glob: str, per_trigger: int | None = None) -> DataFrame:
    """A file source over a folder; the schema is that of the files there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Messages of the topics as text; needs the Kafka connector on the
    cluster."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return r.load().selectExpr("CAST(value AS STRING) AS body", "topic", "timestamp AS received")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there and stop; offsets commit only after ``each``."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def put(rows: DataFrame, path: str, batch: int, by: tuple[str, ...] = ()) -> None:
    """Write one micro-batch under its own number: a batch replayed after a
    failure replaces itself instead of doubling."""
    from pyspark.sql import functions as F

    out = rows.withColumn("batch", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
