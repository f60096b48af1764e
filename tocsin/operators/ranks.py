"""Exact ranks, quantiles and curves without one global window.

Equal values collapse first (on the map side).  Distinct values are then cut
into slices at approximate quantiles, so slices hold about equally many; a
window runs inside a slice and the sums of the slices before it are added from
a small per-slice table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 64


def ranked(
    df: DataFrame,
    by: list[str],
    value: str,
    sums: dict[str, Column] | None = None,
    descending: bool = False,
    slices: int = SLICES,
    weight: str | None = None,
) -> DataFrame:
    """One row per distinct value: ``n`` and ``sums`` of the value, and their
    running totals ``cum_*`` up to and including it.  Rows count once, or
    ``weight`` times when they are counts already."""
    sums = sums or {}
    keys = by or ["_all"]
    src = df.where(F.col(value).isNotNull())
    if not by:
        src = src.withColumn("_all", F.lit(0))
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = src.groupBy(*keys, value).agg(rows.alias("n"), *[c.alias(n) for n, c in sums.items()])
    marks = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    edges = counts.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), marks, F.lit(2000)).alias("_e"))
    cell = F.size(F.filter("_e", lambda e: e < F.col(value).cast("double")))
    cut = counts.join(edges, keys).withColumn("_c", cell).drop("_e")
    order = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    inside = Window.partitionBy(*keys, "_c").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*keys).orderBy(order("_c")).rowsBetween(Window.unboundedPreceding, -1)
    names = ["n", *sums]
    base = (
        cut.groupBy(*keys, "_c")
        .agg(*[F.sum(c).alias(f"_b_{c}") for c in names])
        .withColumns({f"_b_{c}": F.coalesce(F.sum(f"_b_{c}").over(over), F.lit(0)) for c in names})
    )
    out = (
        cut.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in names})
        .join(base, [*keys, "_c"])
        .select(*by, value, *names, *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in names])
    )
    return out


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, qs: DataFrame | list[float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles: ``by, q, value``.  ``qs`` is a list, or
    a table ``by, q`` with its own quantiles per group."""
    r = ranked(df, by, value, weight=weight).select(*by, F.col(value).alias("_v"), "n", "cum_n")
    keys = by or ["_all"]
    if not by:
        r = r.withColumn("_all", F.lit(0))
    totals = r.groupBy(*keys).agg(F.sum("n").alias("_t"))
    if isinstance(qs, list):
        asked = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    else:
        asked = totals.join(qs, keys)
    asked = asked.withColumn("_pos", F.col("q") * (F.col("_t") - 1))
    # the list of asked positions is short: a row keeps those its ranks cover
    lists = asked.groupBy(*keys).agg(F.collect_list(F.struct("q", "_pos")).alias("_qs"))
    lo, hi = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    hit = lambda x: ((F.floor(x["_pos"]) >= lo) & (F.floor(x["_pos"]) <= hi)) | (
        (F.ceil(x["_pos"]) >= lo) & (F.ceil(x["_pos"]) <= hi)
    )
    near = (
        r.join(lists, keys)
        .withColumn("_qs", F.filter("_qs", hit))
        .where(F.size("_qs") > 0)
        .withColumn("_x", F.explode("_qs"))
        .select(*keys, F.col("_x.q").alias("q"), F.col("_x._pos").alias("_pos"), "_v", lo.alias("_lo"), hi.alias("_hi"))
    )
    covers = lambda p: (p >= F.col("_lo")) & (p <= F.col("_hi"))
    a = F.max(F.when(covers(F.floor("_pos")), F.col("_v").cast("double")))
    b = F.max(F.when(covers(F.ceil("_pos")), F.col("_v").cast("double")))
    out = near.groupBy(*keys, "q", "_pos").agg(a.alias("_a"), b.alias("_b"))
    frac = F.col("_pos") - F.floor("_pos")
    return out.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("value"))
