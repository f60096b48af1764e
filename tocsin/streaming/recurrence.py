"""Rejected or muted pairs that had an episode after all, as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.state import HORIZON, REJECT_HOURS

MUTING = ("REJECT", "MUTE")


def recurred(onsets: DataFrame, decisions: DataFrame, late: str, reach: int = REJECT_HOURS, horizon: int = HORIZON) -> DataFrame:
    """``object_id, type, h, decided, hours_after_decision, within_horizon``: for each onset
    the last rejecting or muting decision before it, at most ``reach`` hours back.

    ``onsets`` (object_id, type, h, at) and ``decisions`` (object_id, type, h, action, at)
    are streams; ``at`` is the moment of the hour.  Both have watermarks, and a decision
    meets the onsets of the next ``reach`` hours only, so both sides' state is bounded.
    Rows up to ``late`` late are joined; an onset is answered once the watermark is past it.
    """
    facts = onsets.select("object_id", "type", "h", "at").withWatermark("at", late)
    muting = decisions.where(F.col("action").isin(*MUTING)).select(
        F.col("object_id").alias("_object"), F.col("type").alias("_type"), F.col("h").alias("_h"), F.col("at").alias("_at")
    ).withWatermark("_at", late)
    same = (F.col("object_id") == F.col("_object")) & (F.col("type") == F.col("_type"))
    before = (F.col("_at") < F.col("at")) & (F.col("_at") >= F.col("at") - F.expr(f"INTERVAL {reach} HOURS"))
    last = facts.join(muting, same & before).groupBy("object_id", "type", "h", "at").agg(F.max("_h").alias("decided"))
    back = F.col("h") - F.col("decided")
    return last.select("object_id", "type", "h", "decided", back.alias("hours_after_decision"), (back <= horizon).alias("within_horizon"))
