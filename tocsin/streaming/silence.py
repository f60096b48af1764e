"""Channel silence as keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.quality import KEEP, LEAST_EVENTS, LIMIT_FACTOR, TAKE

OUT = "channel_id bigint, since bigint, silent_at bigint, back_at bigint"


class ChannelSilence(StatefulProcessor):
    """Remembers a channel's last moment, smoothed interval and count.  A row
    after too long a pause reports the spell with its end; a timer reports a
    channel that has not spoken since."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("channel", "last bigint, gap double, seen bigint, told boolean")

    def bound(self, gap: float | None) -> int:
        return int(max(float(self.limit), LIMIT_FACTOR * (gap or 0.0)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, gap, seen, told = self.state.get() if self.state.exists() else (None, None, 0, False)
        # a micro-batch arrives unordered; its rows of one channel are sorted
        # here, so the trigger size bounds what a task holds
        moments = sorted(int(t) for part in rows for t in part["us"])
        out = []
        for t in moments:
            if last is not None and t > last:
                pause = t - last
                if seen >= LEAST_EVENTS and pause > max(float(self.limit), LIMIT_FACTOR * (gap or 0.0)):
                    out.append((key[0], last, last + self.bound(gap), t))
                else:
                    gap = float(pause) if gap is None else KEEP * gap + TAKE * pause
            last = t if last is None else max(last, t)
            seen += 1
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.state.update((last, gap, seen, False))
        if seen >= LEAST_EVENTS:
            self.handle.registerTimer((last + self.bound(gap)) // 1000)
        if out:
            yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, gap, seen, told = self.state.get()
        if not told:
            self.state.update((last, gap, seen, True))
            yield frame([(key[0], last, last + self.bound(gap), None)])

    def close(self) -> None:
        pass


def frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["channel_id", "since", "silent_at", "back_at"]).astype({"back_at": "Int64"})


def channel_silence(stream: DataFrame, limit: int, late: str) -> DataFrame:
    """``stream``: channel_id, us, at (timestamp).  The session must use the
    RocksDB state store."""
    return (
        stream.withWatermark("at", late)
        .groupBy("channel_id")
        .transformWithStateInPandas(
            statefulProcessor=ChannelSilence(limit), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
        )
    )
