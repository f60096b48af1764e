"""Point-in-interval joins through time cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timebase import floor_div


def cells_of(a: Column, b: Column, width: int) -> Column:
    """All cells an interval touches, as an array."""
    return F.sequence(floor_div(a, width), floor_div(b, width))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    t: str,
    a: str,
    b: str,
    width: int,
    closed: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Join points to the intervals of the same key holding them:
    ``a <= t < b`` (``<= b`` when closed).

    Intervals are copied to the cells they touch; the join itself is an equi
    join on ``(key, cell)``, so it spreads a key over its cells.  Choose the
    width near the usual interval length.  A point sits in exactly one cell, so
    no pair appears twice.
    """
    inter = intervals.where(F.col(b) >= F.col(a)).withColumn("_c", F.explode(cells_of(F.col(a), F.col(b), width)))
    pts = points.withColumn("_c", floor_div(F.col(t), width))
    inside = (F.col(t) >= F.col(a)) & ((F.col(t) <= F.col(b)) if closed else (F.col(t) < F.col(b)))
    if how in ("left_semi", "left_anti"):
        cond = pts["_c"] == inter["_c"]
        for k in on:
            cond = cond & (pts[k] == inter[k])
        return pts.join(inter, cond & inside, how).drop("_c")
    return pts.join(inter, [*on, "_c"], "inner").where(inside).drop("_c")
