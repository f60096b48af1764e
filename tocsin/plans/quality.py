"""Data quality of channels: outliers, flapping, silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timebase import DAY, HOUR, floor_div
from ..operators.interval import interval_join
from ..operators.settle import settle

# fixed values
MIN_HISTORY = 30
STEP = 30 * DAY
SIGMAS = 3.0
FLAP_STATES = 12
FLAP_CHANGES = 6
KEY_FLAGS = {
    "Обнаружен дым": "smoke",
    "Обнаружен газ": "gas",
    "Затоплен": "flood",
    "Неисправен": "fault",
    "Батарея разряжена": "battery_low",
    "Батарея неисправна": "battery_fault",
    "Обесточен": "power_off",
    "Рычаг сдернут": "lever_alarm",
    "Не замкнут": "contact_open",
}

#: Parts of a channel's values in which the median is looked for.
PARTS = 64


def history_slices(rows: DataFrame, t: str, span: int) -> DataFrame:
    """Every row in its own slice of ``span`` and, as history, in the next one.
    Any look-back up to ``span`` then stays inside one ``(key, slice)``, so a
    busy channel spreads over its slices."""
    home = floor_div(F.col(t), span)
    return rows.select("*", F.explode(F.array(F.struct(home.alias("slice"), F.lit(True).alias("own")), F.struct((home + 1).alias("slice"), F.lit(False).alias("own")))).alias("_s")).select(
        *rows.columns, "_s.slice", "_s.own"
    )


def dense_moments(readings: DataFrame) -> DataFrame:
    """``channel_id, us, dense``: whether more than MIN_HISTORY readings of the
    last 30 days precede a moment.  Each moment holds a reading, so the moments
    just before it decide."""
    times = readings.groupBy("channel_id", "us").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("channel_id", "slice").orderBy("us").rowsBetween(-(MIN_HISTORY + 1), -1)
    sl = history_slices(times, "us", STEP).withColumn("_back", F.collect_list(F.struct("us", "_n")).over(w))
    recent = F.filter("_back", lambda x: x["us"] >= F.col("us") - STEP)
    near = F.aggregate(recent, F.lit(0).cast("bigint"), lambda a, x: a + x["_n"])
    return sl.where("own").select("channel_id", "us", (near > MIN_HISTORY).alias("dense"))


def spike_flag(readings: DataFrame, cell: int = DAY) -> DataFrame:
    """Readings further than three deviations from the median of their history.

    History is the previous readings up to 30 of them; with more, the shortest
    multiple of 30 days that holds over 30.  Columns: channel_id, us, event_id,
    num.  Every reading is kept: without history, median and std are NULL and
    history is 0; with one reading of history std is not defined.  Where 30
    days suffice, cells of ``cell`` (a divisor of 30 days) hold the history;
    elsewhere it is short and a time join fetches it.
    """
    rows = settle(readings.join(dense_moments(readings), ["channel_id", "us"]))
    a = _dense_history(rows.where("dense").drop("dense"), readings, cell)
    b = _sparse_history(rows.where("not dense").drop("dense"), readings)
    both = a.unionByName(b.select(*a.columns))
    far = (F.col("std") > 0) & (F.abs(F.col("num") - F.col("median")) / F.col("std") > SIGMAS)
    return both.withColumn("spike", F.coalesce(far & (F.col("history") >= 2), F.lit(False)))


def _levels(counts: DataFrame, key: list[str], span: int) -> DataFrame:
    """Per key how many readings the ``span - 1`` whole cells before a cell hold:
    one row per change, holding for the cells ``_from <= c < _to``.  A level above
    zero ends at most one span after it began."""
    moves = counts.select(*key, F.explode(F.array(F.struct((F.col("c") + 1).alias("c"), F.col("n")), F.struct((F.col("c") + span).alias("c"), (-F.col("n")).alias("n")))).alias("_m"))
    moves = moves.groupBy(*key, F.col("_m.c").alias("_from")).agg(F.sum("_m.n").alias("n"))
    track = Window.partitionBy(*key).orderBy("_from")
    held = moves.withColumn("n", F.sum("n").over(track.rowsBetween(Window.unboundedPreceding, 0)))
    return held.withColumn("_to", F.lead("_from").over(track)).where("n > 0")


def _dense_history(rows: DataFrame, readings: DataFrame, cell: int) -> DataFrame:
    """History of rows with more than 30 readings in 30 days, cell by cell.

    Between the cell of ``t - STEP`` and the cell of ``t`` lie whole cells; the
    two edge cells enter as rows.  The median of a window can leave the median of
    the whole cells by no more ranks than the edges have rows, so of the whole
    cells only the values around their median are needed: counts per part of the
    channel's values show which parts those are, and how many readings lie below.
    Sums and extremes of the whole cells give the deviation.
    """
    span = STEP // cell
    all_ = readings.join(rows.select("channel_id").distinct(), "channel_id", "left_semi").withColumn("c", floor_div(F.col("us"), cell))
    asked = settle(rows.select("channel_id", floor_div(F.col("us"), cell).alias("c")).distinct())
    shape = all_.groupBy("channel_id").agg(F.percentile_approx("num", [k / PARTS for k in range(1, PARTS)], 2_000).alias("_cuts"), F.avg("num").alias("mid"))
    values = all_.groupBy("channel_id", "num", "c").agg(F.count(F.lit(1)).alias("n")).join(shape, "channel_id")
    values = settle(values.withColumn("b", F.size(F.filter("_cuts", lambda x: x < F.col("num")))).drop("_cuts"))

    off = F.col("num") - F.col("mid")
    sums = values.groupBy("channel_id", "c").agg(
        F.first("mid").alias("mid"), F.sum("n").alias("m"), F.sum(F.col("n") * off).alias("s1"), F.sum(F.col("n") * off * off).alias("s2"), F.min("num").alias("least"), F.max("num").alias("most")
    )
    whole = Window.partitionBy("channel_id").orderBy("c").rangeBetween(-(span - 1), -1)
    gone = Window.partitionBy("channel_id").orderBy("c").rangeBetween(-span, -span)
    held = sums.select(
        "channel_id", "c", "mid", *[F.coalesce(F.sum(x).over(whole), F.lit(0)).alias(x) for x in ("m", "s1", "s2")], F.min("least").over(whole).alias("least"), F.max("most").over(whole).alias("most"),
        (F.col("m") + F.coalesce(F.sum("m").over(gone), F.lit(0))).alias("edge"),
    ).join(asked, ["channel_id", "c"])

    parts = _levels(values.groupBy("channel_id", "b", "c").agg(F.sum("n").alias("n")), ["channel_id", "b"], span)
    shown = interval_join(held.select("channel_id", "c", "m", "edge"), parts, ["channel_id"], "c", "_from", "_to", span)
    upto = Window.partitionBy("channel_id", "c").orderBy("b")
    shown = shown.withColumn("_upto", F.sum("n").over(upto))
    low = F.greatest(F.lit(0), F.floor((F.col("m") - 1) / 2) - F.col("edge"))
    high = F.least(F.col("m") - 1, F.floor((F.col("m") + F.col("edge")) / 2))
    near = settle(shown.where((F.col("_upto") > low) & (F.col("_upto") - F.col("n") <= high)).select("channel_id", "c", "b", (F.col("_upto") - F.col("n")).alias("under")))
    under = near.groupBy("channel_id", "c").agg(F.min("under").alias("under"))
    info = held.drop("edge").join(under, ["channel_id", "c"], "left").withColumn("under", F.coalesce("under", F.lit(0))).withColumnsRenamed({"channel_id": "_channel", "c": "_c"})

    none = F.lit(None).cast("bigint")
    kept = interval_join(near, _levels(values, ["channel_id", "b", "num"], span), ["channel_id", "b"], "c", "_from", "_to", span)
    middle = kept.select("channel_id", "c", F.lit(0).alias("kind"), none.alias("us"), none.alias("event_id"), "num", "n")
    edges = all_.select("channel_id", F.explode(F.array(F.struct((F.col("c") + span).alias("c"), F.lit(1).alias("kind")), F.struct(F.col("c"), F.lit(2).alias("kind")))).alias("_e"), "us", "event_id", "num")
    edges = edges.select("channel_id", "_e.c", "_e.kind", "us", "event_id", "num", F.lit(1).cast("bigint").alias("n")).join(asked, ["channel_id", "c"], "left_semi")
    schema = "channel_id bigint, us bigint, event_id bigint, num double, median double, std double, history double"
    key = ["channel_id", "c"]
    out = middle.unionByName(edges).groupBy(*key).cogroup(info.groupBy("_channel", "_c")).applyInPandas(_cell_history, schema)
    return out.join(rows.select("channel_id", "us", "event_id"), ["channel_id", "us", "event_id"], "left_semi")


class Counts:
    """Counted values in order, with sums of blocks: a change or a look-up by
    rank costs about the root of the number of values."""

    def __init__(self, counts: np.ndarray):
        self.side = max(16, int(len(counts) ** 0.5))
        self.blocks = np.zeros((-(-len(counts) // self.side), self.side), np.int64)
        self.blocks.flat[: len(counts)] = counts
        self.sums = self.blocks.sum(axis=1)

    def add(self, at: int, n: int) -> None:
        self.blocks.flat[at] += n
        self.sums[at // self.side] += n

    def ranked(self, k: int) -> int:
        upto = np.cumsum(self.sums)
        block = int(np.searchsorted(upto, k, side="right"))
        rest = k - (upto[block - 1] if block else 0)
        return block * self.side + int(np.searchsorted(np.cumsum(self.blocks[block]), rest, side="right"))


def _cell_history(pdf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """Rows of one cell (kind 2) against the values around the median of the
    whole cells (0) and the leaving cell (1)."""
    middle = pdf[pdf["kind"] == 0]
    leaving, own = (pdf[pdf["kind"] == k].sort_values("us", kind="stable") for k in (1, 2))
    if not len(own) or not len(info):
        return own[["channel_id", "us", "event_id", "num"]].head(0).assign(median=0.0, std=0.0, history=0.0)
    cell = info.iloc[0]
    num = lambda part: part["num"].to_numpy(dtype=float)
    values = np.unique(num(pdf))
    start = np.zeros(len(values), np.int64)
    np.add.at(start, np.searchsorted(values, num(middle)), middle["n"].to_numpy(dtype=np.int64))
    lt, ot = leaving["us"].to_numpy(dtype=np.int64), own["us"].to_numpy(dtype=np.int64)
    lv, ov = np.searchsorted(values, num(leaving)), np.searchsorted(values, num(own))
    np.add.at(start, lv, 1)
    gone, came = np.searchsorted(lt, ot - STEP), np.searchsorted(ot, ot)
    n = int(cell["m"]) + len(lt) - gone + came

    held, under = Counts(start), int(cell["under"])
    median = np.full(len(ot), np.nan)
    left = put = 0
    for i in range(len(ot)):
        while left < gone[i]:
            held.add(lv[left], -1)
            left += 1
        while put < came[i]:
            held.add(ov[put], 1)
            put += 1
        if n[i]:
            median[i] = (values[held.ranked((n[i] - 1) // 2 - under)] + values[held.ranked(n[i] // 2 - under)]) / 2

    # sums from the first own row, and to the last leaving one
    a, b = num(leaving) - cell["mid"], num(own) - cell["mid"]
    ahead = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])[gone]
    past = lambda x: np.concatenate([[0.0], np.cumsum(x)])[came]
    s1, s2 = cell["s1"] + ahead(a) + past(b), cell["s2"] + ahead(a * a) + past(b * b)
    outer = lambda f, rest, whole: f(f(np.concatenate([f.accumulate(num(leaving)[::-1])[::-1], [rest]])[gone], np.concatenate([[rest], f.accumulate(num(own))])[came]), rest if pd.isna(whole) else whole)
    same = outer(np.minimum, np.inf, cell["least"]) == outer(np.maximum, -np.inf, cell["most"])
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.sqrt(np.maximum((s2 - s1 * s1 / n) / (n - 1), 0))
    std = np.where(n < 2, np.nan, np.where(same, 0.0, std))
    return own[["channel_id", "us", "event_id", "num"]].assign(median=median, std=std, history=n.astype(float)).astype({"us": "int64", "event_id": "int64"})


def _sparse_history(sparse: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows with at most 30 readings in the past 30 days: fetch 30-day steps
    back until more than 30 readings are held or none remain."""
    keyed = sparse.select("channel_id", "us", "event_id", "num")
    first = readings.groupBy("channel_id").agg(F.min("us").alias("_first"))
    cells = readings.groupBy("channel_id", floor_div(F.col("us"), DAY).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # the latest day from which more than 30 readings certainly precede: each
    # day cell holds a reading, so the last 31 cells are enough to look at
    over = Window.partitionBy("channel_id").orderBy("d").rowsBetween(-(MIN_HISTORY + 1), -1)
    none = F.lit(None).cast("bigint")
    fold = F.aggregate(
        F.reverse(F.collect_list(F.struct("d", "n")).over(over)),
        F.struct(F.lit(0).cast("bigint").alias("c"), none.alias("f")),
        lambda a, x: F.struct(
            (a["c"] + x["n"]).alias("c"),
            F.when(a["f"].isNull() & (a["c"] + x["n"] > MIN_HISTORY), x["d"]).otherwise(a["f"]).alias("f"),
        ),
    )
    safe = cells.withColumn("_from", fold["f"]).select("channel_id", "d", "_from")
    asked = keyed.withColumn("d", floor_div(F.col("us"), DAY))
    spans = (
        asked.join(safe, ["channel_id", "d"], "left")
        .join(first, "channel_id")
        .withColumn("_lo", F.coalesce(F.col("_from") * F.lit(DAY), F.col("_first")))
        .withColumn("_k", F.greatest(F.lit(1), F.ceil((F.col("us") - F.col("_lo")) / STEP)))
        .withColumn("_a", F.greatest(F.col("_first"), F.col("us") - F.col("_k") * STEP))
        .select("channel_id", F.col("us").alias("at"), F.col("event_id").alias("id"), F.col("num").alias("x"), "_a", F.col("us").alias("_b"), "_k")
    )
    hit = interval_join(readings.select("channel_id", "us", "num"), spans, ["channel_id"], "us", "_a", "_b", width=STEP)
    # count per step back, find the first step that suffices, keep its rows
    step = F.greatest(F.lit(1), F.ceil((F.col("at") - F.col("us")) / STEP)).cast("bigint")
    key = ["channel_id", "at", "id", "x"]
    per = hit.withColumn("step", step).groupBy(*key, "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("channel_id", "at", "id").orderBy("step")
    enough = per.withColumn("_c", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy("channel_id", "at", "id")))
    pick = enough.groupBy(*key).agg(
        F.when(F.max("_all") <= MIN_HISTORY, F.max("step")).otherwise(F.min(F.when(F.col("_c") > MIN_HISTORY, F.col("step")))).alias("_pick")
    )
    kept = hit.withColumn("step", step).join(pick, key).where(F.col("step") <= F.coalesce("_pick", F.col("step")))
    got = kept.groupBy(*key).agg(
        F.percentile("num", 0.5).alias("median"), F.stddev_samp("num").alias("std"), F.count(F.lit(1)).cast("double").alias("history")
    )
    found = got.select("channel_id", F.col("at").alias("us"), F.col("id").alias("event_id"), F.col("x").alias("num"), "median", "std", "history")
    return keyed.join(found.drop("num"), ["channel_id", "us", "event_id"], "left").withColumn("history", F.coalesce("history", F.lit(0.0)))


def flapping_flag(rows: DataFrame, days: int = 30, width: int = HOUR) -> DataFrame:
    """Six or more changes among the last twelve values of the past 30 days.
    Columns: channel_id, us, event_id, value (text).

    Only twelve values matter, so a cell of a channel needs no more than the
    last twelve moments before it: every cell keeps its last twelve, and a
    window over those hands them on.
    """
    states = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    # of one moment, too, the last twelve values are enough
    last = F.slice(states, F.greatest(F.size(states) - FLAP_STATES + 1, F.lit(1)), FLAP_STATES)
    m = rows.groupBy("channel_id", "us").agg(last.alias("v")).withColumn("c", floor_div(F.col("us"), width))
    inside = Window.partitionBy("channel_id", "c")
    ends = m.withColumn("_i", F.row_number().over(inside.orderBy(F.col("us").desc()))).where(F.col("_i") <= FLAP_STATES)
    track = Window.partitionBy("channel_id").orderBy("us")
    before = F.collect_list(F.struct("us", "v")).over(track.rowsBetween(-FLAP_STATES, -1))
    first = F.row_number().over(inside.orderBy("us")) == 1
    carry = ends.select("channel_id", "c", before.alias("_carry"), first.alias("_f")).where("_f").drop("_f")
    here = F.collect_list(F.struct("us", "v")).over(inside.orderBy("us").rowsBetween(-FLAP_STATES, -1))
    h = m.withColumn("_here", here).join(carry, ["channel_id", "c"])
    past = F.filter(F.concat("_carry", "_here"), lambda x: x["us"] >= F.col("us") - days * DAY)
    seq = F.flatten(F.transform(past, lambda x: x["v"]))
    h = h.withColumn("_seq", seq)
    h = h.withColumn("_seq", F.slice("_seq", F.greatest(F.size("_seq") - FLAP_STATES + 1, F.lit(1)), FLAP_STATES))
    pairs = F.zip_with(F.slice("_seq", 1, FLAP_STATES - 1), F.slice("_seq", 2, FLAP_STATES - 1), lambda a, b: F.when(a != b, 1).otherwise(0))
    changes = F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
    flags = h.select("channel_id", "us", ((F.size("_seq") >= FLAP_STATES) & (changes >= FLAP_CHANGES)).alias("flapping"))
    return rows.join(flags, ["channel_id", "us"])


def key_state_flag(rows: DataFrame, flags: dict[str, str] = KEY_FLAGS, state: str = "state") -> DataFrame:
    """Alarm states to flags; they come before statistical ones."""
    out = F.lit(None).cast("string")
    for word, flag in flags.items():
        out = F.when(F.col(state) == word, F.lit(flag)).otherwise(out)
    return rows.withColumn("flag", out)


# ---- silence -----------------------------------------------------------------------

KEEP, TAKE, LIMIT_FACTOR, LEAST_EVENTS = 0.8, 0.2, 4, 3


def channel_cells(rows: DataFrame, limit: int) -> DataFrame:
    """One row per (channel, cell of the limit): first and last moment, rows,
    and the smoothed interval's change over the cell as ``g -> a * g + b``
    (``b0`` when no interval was known before).

    No pause inside a cell exceeds the limit, so silence can only start
    between cells and a busy channel shrinks to its cells.
    """
    c = rows.groupBy("channel_id", "us").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", floor_div(F.col("us"), limit))
    w = Window.partitionBy("channel_id", "cell").orderBy("us")
    m = c.withColumn("d", F.col("us") - F.lag("us").over(w)).withColumn("i", F.row_number().over(w))
    m = m.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("channel_id", "cell")))
    left = F.pow(F.lit(KEEP), F.col("size") - F.col("i"))
    weight = F.when(F.col("d").isNotNull(), left * TAKE * F.col("d"))
    first = F.when(F.col("i") == 2, left * F.col("d")).when(F.col("i") > 2, left * TAKE * F.col("d"))
    return m.groupBy("channel_id", "cell").agg(
        F.min("us").alias("t0"), F.max("us").alias("t1"), F.sum("n").alias("n"),
        F.pow(F.lit(KEEP), F.max("size") - 1).alias("a"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("b"), F.sum(first).alias("b0"),
    )


SPELL = "channel_id bigint, since bigint, silent_at bigint, back_at bigint"


def _silence(limit: int):
    """Cells of whole channels, each channel's in order, to its silent spells.  One
    walk over a task's rows; what it holds is the state of one channel and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n.split(" ")[0], pa.int64()) for n in SPELL.split(", ")])
        none = object()
        channel, gap, last, count = none, None, None, 0

        def bound() -> float:
            return max(float(limit), LIMIT_FACTOR * (gap or 0.0))

        def still() -> list[tuple]:
            return [(channel, last, last + int(bound()), None)] if channel is not none and count >= LEAST_EVENTS else []

        for batch in batches:
            out = []
            for c, t0, t1, n, a, b, b0 in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if c != channel:
                    out += still()
                    channel, gap, last, count = c, None, None, 0
                if last is not None:
                    pause = t0 - last
                    if count >= LEAST_EVENTS and pause > bound():
                        out.append((c, last, last + int(bound()), t0))
                    elif pause > 0:
                        gap = pause if gap is None else KEEP * gap + TAKE * pause
                # the interval inside the cell
                gap = b0 if gap is None else a * gap + b
                last, count = t1, count + n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        if out := still():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return run


def channel_silence(rows: DataFrame, limit: int, now: int) -> DataFrame:
    """Silent spells of channels: since when, when noticed, when they spoke
    again (NULL: silent still at ``now``)."""
    cells = channel_cells(rows.where(F.col("us") <= now), limit).select("channel_id", "cell", "t0", "t1", "n", "a", "b", "b0")
    lines = cells.repartition("channel_id").sortWithinPartitions("channel_id", "cell").drop("cell")
    spells = lines.mapInArrow(_silence(limit), SPELL)
    return spells.where(F.col("back_at").isNotNull() | (F.col("silent_at") < now))


def source_silence(rows: DataFrame, limit: int, now: int) -> DataFrame:
    """Pauses of the whole source longer than the limit.  Cells of the limit's
    width hold no such pause, so only their ends are compared."""
    cells = rows.where(F.col("us") <= now).groupBy(floor_div(F.col("us"), limit).alias("cell")).agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    cells = cells.withColumn("source", F.lit("all"))
    nxt = F.lead("t0").over(Window.partitionBy("source").orderBy("cell"))
    return cells.withColumn("back_at", nxt).where(F.coalesce("back_at", F.lit(now)) - F.col("t1") > limit).select(
        F.col("t1").alias("since"), "back_at"
    )


def silence_snapshot(spells: DataFrame, limit: int) -> DataFrame:
    """Channels silent now, the oldest first, with the total."""
    now = settle(spells.where("back_at is null"))  # read for the total and for the oldest
    total = now.agg(F.count(F.lit(1)).alias("silent"))
    top = now.orderBy("since", "channel_id").limit(limit).select("channel_id", "since").withColumn("_k", F.lit(1))
    return top.join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
