"""Counts over many windows as differences of running counts, without copying points to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timebase import floor_div


def totals_before(points: DataFrame, on: list[str], t: str, values: dict[str, Column], asks: DataFrame, at: str, width: int) -> DataFrame:
    """``asks`` (``on, at``, other columns) with each of ``values`` summed over the points
    of its key with ``t < at``.

    Points and asks lie on one timeline, cut into cells of ``width``: a window runs
    inside a cell, and what came before it is one row a cell.  A point is one row
    however many windows hold it."""
    rows = points.groupBy(*on, F.col(t).alias("_t")).agg(*[F.sum(c.cast("long")).alias(n) for n, c in values.items()])
    asked = asks.select(*on, F.col(at).alias("_t"), F.struct(*[c for c in asks.columns if c not in on]).alias("_ask"), *[F.lit(0).cast("long").alias(n) for n in values])
    line = rows.withColumn("_ask", F.lit(None)).select(*on, "_t", "_ask", *values).unionByName(asked.select(*on, "_t", "_ask", *values)).withColumn("_c", floor_div(F.col("_t"), width))
    # asks of a moment come before its points
    inside = Window.partitionBy(*on, "_c").orderBy("_t", F.col("_ask").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    cells = Window.partitionBy(*on).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = line.groupBy(*on, "_c").agg(*[F.sum(n).alias(f"_b_{n}") for n in values])
    base = base.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_b_{n}").over(cells), F.lit(0)) for n in values})
    run = line.withColumns({f"_s_{n}": F.sum(n).over(inside) for n in values}).where(F.col("_ask").isNotNull())
    return run.join(base, [*on, "_c"]).select(*on, "_ask.*", *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def counts_within(points: DataFrame, on: list[str], t: str, values: dict[str, Column], rows: DataFrame, key: list[str], windows: dict[str, tuple[Column, Column]], width: int) -> DataFrame:
    """``key`` and, for each window ``[a, b)`` of ``rows`` and each value, ``{window}_{value}``.
    ``key`` names rows and holds ``on``; an edge that windows share is asked once."""
    edges = {str(c): c for pair in windows.values() for c in pair}
    name = {text: k for k, text in enumerate(edges)}
    moments = F.array(*[F.struct(F.lit(name[text]).alias("_edge"), c.cast("long").alias("_at")) for text, c in edges.items()])
    asks = rows.select(*key, F.explode(moments).alias("_m")).select(*key, "_m.*")
    got = totals_before(points, on, t, values, asks, "_at", width)
    at = lambda c, n: F.max(F.when(F.col("_edge") == name[str(c)], F.col(n)))
    return got.groupBy(*key).agg(*[(at(b, n) - at(a, n)).alias(f"{w}_{n}") for w, (a, b) in windows.items() for n in values])
