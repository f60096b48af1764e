"""Alarm rules, decisions and the hourly job as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import state as S
from .common import put, run_available


def _play(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rules = S.PairRules(*(state.get if state.exists else ()))
    rows = pd.concat(list(parts), ignore_index=True)
    out = S.play(rules, rows)
    state.update(rules.dump())
    if out:
        yield pd.DataFrame(out, columns=S.OUT_COLUMNS).astype({"since": "Int64", "alarm": "boolean"})


def alarm_rules(feed: DataFrame) -> DataFrame:
    """The same machine as the batch job, its memory kept per pair between
    micro-batches.  A pair has one tick an hour, so a batch holds few rows of
    it."""
    return feed.groupBy("object_id", "type").applyInPandasWithState(
        _play,
        S.RULE_OUTPUT,
        "start bigint, last_on bigint, rejected bigint, muted_until bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def once(commands: DataFrame, at: str, late: str) -> DataFrame:
    """Commands exactly once by their id within the watermark."""
    return commands.withWatermark(at, late).dropDuplicatesWithinWatermark(["command_id"])


def hourly_job(
    scores: DataFrame, facts: DataFrame, decisions: DataFrame, works: DataFrame, share: float, base: str, checkpoint: str,
    version: str = "v1", window: int = S.THRESHOLD_HOURS,
) -> dict[str, str]:
    """Each micro-batch of scores is an hour or more of the fleet: a threshold
    for each of its hours from the ``window`` hours up to it, rules, work
    windows, statuses, messages, and all of it written under the batch's number.

    ``scores`` is a stream of type, object_id, collector_id, h, p, its hours in
    order; the others are tables.  A threshold once written stays.  The rules
    go on from the memory that the batch before left, and read the facts and
    decisions since its last hour, so a batch reads one window of scores and
    no other history; replayed, it starts from the same memory.
    """
    paths = {n: f"{base}/{n}" for n in ("scores", "thresholds", "memory", "status", "messages")}

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put(batch, paths["scores"], number)
        stored = spark.read.parquet(paths["scores"])
        batch = stored.where(F.col("batch") == number).drop("batch")
        lo, hi = batch.agg(F.min("h"), F.max("h")).first()
        if hi is None:
            lo = hi = -1
        near = stored.where((F.col("batch") <= number) & (F.col("h") > lo - window) & (F.col("h") <= hi))
        asks = batch.select("type", "h").distinct()
        shares = asks.select("type").distinct().withColumn("share", F.lit(share))
        put(S.threshold_90d(near, asks, shares, window=window), paths["thresholds"], number)
        thr = spark.read.schema("type string, h bigint, thr double, batch int").parquet(paths["thresholds"])
        now = batch.join(thr.where(F.col("batch") == number).drop("batch"), ["type", "h"])
        ticks = now.select(
            "object_id", "type", "h", F.col("p").alias("score"), "thr", F.lit(float("inf")).alias("strict"), F.lit(True).alias("rejectable")
        )
        if number:
            memory = spark.read.schema(f"{S.MEMORY}, batch int").parquet(paths["memory"]).where(F.col("batch") == number - 1)
            before = thr.where(F.col("batch") < number).agg(F.max("h")).first()[0]
        else:
            memory, before = spark.createDataFrame([], S.MEMORY), None
        new = F.col("h") <= hi if before is None else (F.col("h") > before) & (F.col("h") <= hi)
        moved = S.advance(S.rule_inputs(ticks, facts.where(new), decisions.where(new)), memory).persist()
        put(moved.where("of = 'memory'").select(*[f.split(" ")[0] for f in S.MEMORY.split(", ")]), paths["memory"], number)
        played = moved.where("of = 'rule' AND alarm IS NOT NULL").select("object_id", "type", "h", "alarm", "since", "status")
        hours = now.select("object_id", "type", "h", (F.col("p") >= F.col("thr")).alias("raw"))
        rows = played.join(hours, ["object_id", "type", "h"]).select(
            "object_id", "type", "h", "raw", "alarm", "since",
            F.when(F.col("status") != "ALARM", F.col("status")).alias("decided"), F.lit(None).cast("string").alias("command_id"),
        ).persist()
        try:
            muted = S.works_mute(batch.select("object_id", "collector_id", "type", "h"), works)
            put(S.status_table(rows, muted), paths["status"], number)
            blocks = now.join(rows.select("object_id", "type", "h", "alarm", "since"), ["object_id", "type", "h"]).select(
                "object_id", "h", "type", F.col("p").alias("score"), F.col("thr").alias("threshold"), "alarm", "since",
                F.lit(None).cast("array<string>").alias("reasons"), F.lit(None).cast("array<bigint>").alias("evidence"),
            )
            put(S.forecast_message(blocks, version), paths["messages"], number)
        finally:
            rows.unpersist()
            moved.unpersist()

    run_available(scores, each, checkpoint)
    return paths
