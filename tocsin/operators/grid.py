"""Dense hourly grids and trailing windows over them.

Spark re-aggregates a sliding frame for every row, so trailing sums are
differences of one running sum on the dense grid, and lookups to the future
run on descending order.  Sliding frames remain for extremes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense(df: DataFrame, on: list[str], h: str, lo: int, hi: int, zeros: list[str]) -> DataFrame:
    """Every key at every hour of ``[lo, hi)``; ``zeros`` are filled with 0,
    other columns stay NULL."""
    keys = df.select(*on).distinct()
    grid = keys.withColumn(h, F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi - 1).cast("bigint"))))
    return grid.join(df, [*on, h], "left").fillna(0, subset=zeros)


def track(on: list[str], h: str = "h"):
    return Window.partitionBy(*on).orderBy(h)


def trailing_sums(df: DataFrame, on: list[str], cols: dict[str, list[int]], h: str = "h", name="{c}_{w}h") -> DataFrame:
    """Sum over the last ``w`` hours, the current one included, for every
    ``(column, w)``.  The grid must be dense."""
    w = track(on, h)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cum = df.select("*", *[F.sum(F.col(c).cast("double")).over(upto).alias(f"_cs_{c}") for c in cols])
    out = [
        (F.col(f"_cs_{c}") - F.coalesce(F.lag(f"_cs_{c}", n).over(w), F.lit(0.0))).alias(name.format(c=c, w=n))
        for c, ns in cols.items()
        for n in ns
    ]
    return cum.select("*", *out).drop(*[f"_cs_{c}" for c in cols])


def trailing_mean(total: Column, n: Column) -> Column:
    """Mean over a window from its sum and count; NULL when nothing was read."""
    return F.when(n > 0, total / n)


def trailing_extreme(fn, col: str, hours: int, on: list[str], h: str = "h") -> Column:
    return fn(col).over(track(on, h).rowsBetween(-(hours - 1), 0))


def since_last(x: Column, on: list[str], cap: int, h: str = "h") -> Column:
    """Hours since the last hour where ``x`` holds (0 in that hour), capped."""
    seen = F.last(F.when(x, F.col(h)), ignorenulls=True).over(track(on, h).rowsBetween(Window.unboundedPreceding, 0))
    return F.least(F.coalesce(F.col(h) - seen, F.lit(cap)), F.lit(cap)).cast("bigint")


def last_known(col: str, on: list[str], h: str = "h") -> Column:
    return F.last(col, ignorenulls=True).over(track(on, h).rowsBetween(Window.unboundedPreceding, 0))


def hours_to_next(x: Column, on: list[str], cap: int, h: str = "h") -> Column:
    """Hours to the next hour strictly after this one where ``x`` holds."""
    back = Window.partitionBy(*on).orderBy(F.col(h).desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(x, F.col(h)), ignorenulls=True).over(back)
    return F.least(F.coalesce(nxt - F.col(h), F.lit(cap)), F.lit(cap)).cast("bigint")
