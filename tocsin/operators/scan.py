"""Ordered scans that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a hot key to one task.
The scans here cut each key's timeline into cells of fixed width.  A row-level
window runs inside one ``(key, cell)``; what happened before the cell arrives
as one carried row, computed from per-cell summaries that are pre-aggregated on
the map side.  The only window over a whole key reads one row per cell, so its
size is bounded by the length of the period and not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import HOUR, floor_div

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    lt: str,
    rt: str,
    take: dict[str, str],
    direction: str = "backward",
    strict: bool = False,
    how: str = "inner",
    width: int = HOUR,
) -> DataFrame:
    """Attach to each left row the nearest right row of the same key.

    ``direction`` is "backward" (right time at or before the left time) or
    "forward" (at or after); ``strict`` excludes equal times.  ``take`` maps
    right columns to output names.  Among right rows at one time the greatest
    ``take`` tuple wins, so results do not depend on row order.
    """
    sign = 1 if direction == "backward" else -1
    payload = F.struct(*[F.col(c).alias(n) for c, n in take.items()])

    def line(df: DataFrame, t: str, tag: int) -> DataFrame:
        order = F.col(t).cast("bigint") * F.lit(sign).cast("bigint")
        return df.where(F.col(t).isNotNull()).withColumn("_o", order).withColumn("_tag", F.lit(tag))

    right_tag, left_tag = (2, 1) if strict else (1, 2)
    r = line(right, rt, right_tag).select(*on, "_o", "_tag", payload.alias("_p"))
    lcols = left.columns
    lrow = F.struct(*[F.col(c) for c in lcols]).alias("_l")
    l = line(left, lt, left_tag).select(*on, "_o", "_tag", lrow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_c", floor_div(F.col("_o"), width))

    # what each cell leaves behind, and what the cells before hand over
    seen = F.max(F.when(F.col("_p").isNotNull(), F.struct("_o", "_p"))).alias("_m")
    # the whole key's window reads one row per cell
    over_cells = Window.partitionBy(*on).orderBy("_c").rowsBetween(*BEFORE)
    carried = (
        both.groupBy(*on, "_c")
        .agg(seen)
        .withColumn("_m", F.last("_m", ignorenulls=True).over(over_cells))
        .where(F.col("_m").isNotNull())
        .select(*on, "_c", (F.col("_c") * F.lit(width)).alias("_o"), F.lit(0).alias("_tag"), F.col("_m._p").alias("_p"))
    )
    inside = Window.partitionBy(*on, "_c").orderBy("_o", "_tag", "_p").rowsBetween(*SO_FAR)
    out = (
        both.unionByName(carried, allowMissingColumns=True)
        .withColumn("_got", F.last("_p", ignorenulls=True).over(inside))
        .where(F.col("_l").isNotNull())
    )
    if how == "inner":
        out = out.where(F.col("_got").isNotNull())
    return out.select("_l.*", *[F.col(f"_got.{n}").alias(n) for n in take.values()])


def running_total(
    df: DataFrame,
    on: list[str],
    t: str,
    order: list[str],
    value: str,
    out: str,
    width: int = HOUR,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the order ``(t, *order)``."""
    cut = df.withColumn("_c", floor_div(F.col(t), width))
    inside = Window.partitionBy(*on, "_c").orderBy(t, *order).rowsBetween(*SO_FAR)
    over_cells = Window.partitionBy(*on).orderBy("_c").rowsBetween(*BEFORE)
    base = (
        cut.groupBy(*on, "_c")
        .agg(F.sum(value).alias("_s"))
        .withColumn("_s", F.coalesce(F.sum("_s").over(over_cells), F.lit(0)))
    )
    return (
        cut.withColumn(out, F.sum(value).over(inside))
        .join(base, [*on, "_c"])
        .withColumn(out, F.col(out) + F.col("_s"))
        .drop("_c", "_s")
    )


def previous_row(
    df: DataFrame, on: list[str], t: str, order: list[str], take: dict[str, str], width: int = HOUR
) -> DataFrame:
    """``lag`` over ``(t, *order)`` of each key, one cell at a time."""
    packed = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    cut = df.withColumn("_c", floor_div(F.col(t), width)).withColumn("_k", packed)
    inside = Window.partitionBy(*on, "_c").orderBy(t, *order)
    over_cells = Window.partitionBy(*on).orderBy("_c")
    base = (
        cut.groupBy(*on, "_c")
        .agg(F.max_by("_k", F.struct(t, *order)).alias("_k"))
        .withColumn("_prev", F.lag("_k").over(over_cells))
        .drop("_k")
    )
    first = F.row_number().over(inside) == 1
    return (
        cut.withColumn("_lag", F.lag("_k").over(inside))
        .withColumn("_first", first)
        .join(base, [*on, "_c"])
        .withColumn("_got", F.when(F.col("_first"), F.col("_prev")).otherwise(F.col("_lag")))
        .select(*df.columns, *[F.col(f"_got.{n}").alias(n) for n in take.values()])
    )


def sessions(
    df: DataFrame,
    on: list[str],
    t: str,
    gap: int,
    item: str | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Merge rows of a key into sessions: a pause longer than ``gap`` starts a
    new one.  Returns ``on, t0, t1, rows`` and, with ``item``, ``items`` (its
    distinct count); ``extra`` adds aggregates that combine by ``max``.

    Two rows of one gap-wide cell are never further apart than the gap, so a
    cell never holds a session border.  Rows collapse to one per cell (and
    item) before the shuffle; only cells are ordered.
    """
    extra = extra or {}
    cells, mapped = session_cells(df, on, t, gap, item, extra)
    got = mapped.groupBy(*on, "session").agg(
        F.min("_a").alias("t0"),
        F.max("_b").alias("t1"),
        F.sum("_n").alias("rows"),
        *([F.count_distinct(item).alias("items")] if item else []),
        *[F.max(n).alias(n) for n in extra],
    )
    return got.drop("session")


def session_cells(df, on, t, gap, item=None, extra=None):
    """Cells of a session scan: ``(cell -> session)`` and the pre-aggregated
    rows with their session number."""
    extra = extra or {}
    keys = [*on, "_c", *([item] if item else [])]
    small = (
        df.withColumn("_c", floor_div(F.col(t), gap))
        .groupBy(*keys)
        .agg(
            F.min(t).alias("_a"),
            F.max(t).alias("_b"),
            F.count(F.lit(1)).alias("_n"),
            *[c.alias(n) for n, c in extra.items()],
        )
    )
    w = Window.partitionBy(*on).orderBy("_c")
    cells = (
        small.groupBy(*on, "_c")
        .agg(F.min("_a").alias("_ca"), F.max("_b").alias("_cb"))
        .withColumn("_p", F.lag("_cb").over(w))
        .withColumn("_new", F.when(F.col("_p").isNull() | (F.col("_ca") - F.col("_p") > gap), 1).otherwise(0))
        .withColumn("session", F.sum("_new").over(w.rowsBetween(*SO_FAR)))
        .select(*on, "_c", "session")
    )
    mapped = small.join(cells, [*on, "_c"])
    return cells, mapped


def distinct_within(
    df: DataFrame, on: list[str], t: str, item: str, before: int, after: int, out: str, width: int = HOUR
) -> DataFrame:
    """Distinct ``item`` among the key's rows in ``[t - before, t + after]``,
    one row per ``(key, t)``.

    An item seen at ``s`` is inside the frame of every centre in
    ``[s - after, s + before]``.  Those covers merge into disjoint intervals
    per item, and the answer at a centre is opened minus closed intervals: a
    running sum, linear in the rows, with no set per row.
    """
    span = max(before + after, 1)
    merged = sessions(df, [*on, item], t, span)
    opens = merged.select(*on, (F.col("t0") - after).alias("_t"), F.lit(0).alias("_g"), F.lit(1).alias("_v"))
    closes = merged.select(*on, (F.col("t1") + before).alias("_t"), F.lit(2).alias("_g"), F.lit(-1).alias("_v"))
    centres = df.select(*on, F.col(t).alias("_t")).distinct().select("*", F.lit(1).alias("_g"), F.lit(0).alias("_v"))
    moves = (
        opens.unionByName(closes)
        .groupBy(*on, "_t", "_g")
        .agg(F.sum("_v").alias("_v"))
        .unionByName(centres.withColumn("_v", F.lit(0).cast("bigint")))
    )
    return (
        running_total(moves, on, "_t", ["_g"], "_v", out, width)
        .where(F.col("_g") == 1)
        .select(*on, F.col("_t").alias(t), F.col(out).cast("bigint").alias(out))
    )
