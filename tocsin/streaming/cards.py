"""Cards of continuous alarm hours as keyed state, and how many are open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timebase import HOUR, ORIGIN_US
from .common import drop_folder, put, run_available

OUT = "type string, object_id bigint, event string, start bigint, last bigint, h bigint"


def moment_ms(h: int) -> int:
    return (h * HOUR + ORIGIN_US) // 1000


class Cards(StatefulProcessor):
    """The hours of a pair wait until the watermark is past them and are then taken in
    order, so late ones fall into place.  An alarm hour that does not follow on the
    newest card opens one; an hour without alarm closes all that are open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "h bigint", "alarm boolean")
        self.open = handle.getMapState("open", "start bigint", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for h, alarm in zip(part["h"], part["alarm"]):
                self.waiting.updateValue((int(h),), (bool(alarm),))
                self.handle.registerTimer(moment_ms(int(h)) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for h in sorted(k[0] for k in self.waiting.keys() if moment_ms(k[0]) < now):
            (alarm,) = self.waiting.getValue((h,))
            self.waiting.removeKey((h,))
            cards = {k[0]: v[0] for k, v in self.open.iterator()}
            newest = max(cards, default=None)
            if not alarm:
                out += [(key[0], key[1], "close", start, last, h) for start, last in cards.items()]
                for start in cards:
                    self.open.removeKey((start,))
            elif newest is not None and cards[newest] == h - 1:
                self.open.updateValue((newest,), (h,))
            else:
                self.open.updateValue((h,), (h,))
                out.append((key[0], key[1], "open", h, h, h))
        if out:
            yield pd.DataFrame(out, columns=["type", "object_id", "event", "start", "last", "h"])

    def close(self) -> None:
        pass


def card_events(rows: DataFrame, late: str) -> DataFrame:
    """Openings and closings from a stream of type, object_id, h, alarm and ``at``, the
    moment of the hour.  The session must use the RocksDB state store."""
    keyed = rows.select("type", "object_id", "h", "alarm", "at").withWatermark("at", late).groupBy("type", "object_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Cards(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def card_lifecycle(rows: DataFrame, base: str, checkpoint: str, late: str) -> dict[str, str]:
    """Run the stream into tables under ``base``: ``events``, and ``counts``, the cards of each
    type that are open after a batch, kept from batch to batch."""
    paths = {n: f"{base}/{n}" for n in ("events", "counts")}

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put(batch, paths["events"], number)
        # the batch's events as they were written
        step = F.when(F.col("event") == "open", 1).otherwise(-1)
        now = spark.read.schema(f"{OUT}, batch int").parquet(paths["events"]).where(F.col("batch") == number).select("type", step.cast("long").alias("cards"))
        if number:
            now = now.unionByName(spark.read.schema("type string, cards bigint").parquet(f"{paths['counts']}/at={number - 1}"))
        now.groupBy("type").agg(F.sum("cards").alias("cards")).coalesce(1).write.mode("overwrite").parquet(f"{paths['counts']}/at={number}")
        if number > 1:
            drop_folder(spark, f"{paths['counts']}/at={number - 2}")

    run_available(card_events(rows, late), each, checkpoint)
    return paths


def cards_of(spark, paths: dict[str, str]) -> DataFrame:
    """``type, object_id, start, last, closed, open`` out of the events; ``last`` is known of closed cards."""
    e = spark.read.schema(f"{OUT}, batch int").parquet(paths["events"])
    shut = F.col("event") == "close"
    out = e.groupBy("type", "object_id", "start").agg(F.max(F.when(shut, F.col("last"))).alias("last"), F.max(F.when(shut, F.col("h"))).alias("closed"))
    return out.withColumn("open", F.col("closed").isNull())
