"""Exact quantiles of many overlapping windows, without copying rows to the windows.

Every distinct value has its rank among all rows of its group, and the ranks are cut
into ``FAN`` coarse bins of ``FAN`` fine ones.  How many rows of a window are in a bin is
the difference of two running counts per bin, at the window's end and start.  The
coarse bin that holds an asked rank is found first, then the fine one in it, and only
the rows of that fine bin meet the windows that ask for it: about one row in
``FAN * FAN`` of each window.  Running counts have a row for each cell with data and two
for each window, so they are bounded by the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .interval import interval_join
from .ranks import ranked
from .settle import settle

FAN = 64


def counts_within(counts: DataFrame, asked: DataFrame, by: list[str], bin_: str) -> DataFrame:
    """``by, w, bin_, n``: the rows of each asked (window, bin) with cells in ``[a, b)``."""
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))
    ends = asked.withColumn("_e", F.explode(F.array(edge("a", -1), edge("b", 1)))).select(*by, bin_, "_e.at", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("n"), "w", "_e.sign")
    data = counts.withColumns({"_kind": F.lit(1), "w": F.lit(None), "sign": F.lit(None)}).withColumnRenamed("cell", "at")
    before = Window.partitionBy(*by, bin_).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    run = ends.unionByName(data.select(*by, bin_, "at", "_kind", "n", "w", "sign")).withColumn("_s", F.sum("n").over(before))
    return run.where(F.col("sign").isNotNull()).groupBy(*by, "w", bin_).agg(F.sum(F.col("sign") * F.col("_s")).alias("n")).where("n > 0")


def holding(bins: DataFrame, within: list[str], order: str) -> DataFrame:
    """``lo, hi`` of each bin: the first rank in it and the first one after it, among those of ``within``."""
    hi = F.sum("n").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("n")).drop("n")


def sliding_quantiles(rows: DataFrame, by: list[str], cell: str, value: str, windows: DataFrame, ids: list[str], width: int) -> DataFrame:
    """``by, ids, i, q, n, value``: for each window (``by, ids, a, b, qs``) and each entry of its
    array ``qs`` the interpolated quantile of the values with ``a <= cell < b``, and their
    number.  Windows without values give no row; null values take no part.  ``width`` is
    the usual length of a window."""
    src = rows.where(F.col(value).isNotNull()).select(*by, F.col(cell).cast("long").alias("cell"), F.col(value).alias("v"))
    daily = src.groupBy(*by, "cell", "v").agg(F.count(F.lit(1)).alias("n"))
    ranks = ranked(daily, by, "v", weight="n").select(*by, "v", (F.col("cum_n") - F.col("n")).alias("_below"))
    ranks = ranks.join(daily.groupBy(*by).agg(F.sum("n").alias("_all")), by).withColumn("fine", F.expr(f"_below * {FAN * FAN} div _all"))
    counted = settle(daily.join(ranks.select(*by, "v", "fine"), [*by, "v"]).withColumn("coarse", F.expr(f"fine div {FAN}")))
    spans = windows.select(*by, F.struct(*ids).alias("w"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "qs")

    each = spans.drop("qs").withColumn("coarse", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long"))))
    first = counts_within(counted.groupBy(*by, "coarse", "cell").agg(F.sum("n").alias("n")), each, by, "coarse")
    total = F.sum("n").over(Window.partitionBy(*by, "w")).alias("t")
    first = holding(first.select("*", total), [*by, "w"], "coarse").join(spans.select(*by, "w", "qs"), [*by, "w"])
    asked = first.select("*", F.posexplode("qs").alias("i", "q")).withColumn("pos", F.col("q") * (F.col("t") - 1))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos"))))).where("rank >= lo and rank < hi")
    asked = settle(asked.select(*by, "w", "i", "q", "t", "pos", "rank", "coarse", (F.col("rank") - F.col("lo")).alias("left")))

    each = asked.select(*by, "w", "coarse").distinct().join(spans.drop("qs"), [*by, "w"])
    each = each.withColumn("fine", F.explode(F.sequence(F.col("coarse") * FAN, F.col("coarse") * FAN + (FAN - 1)))).drop("coarse")
    second = counts_within(counted.groupBy(*by, "fine", "cell").agg(F.sum("n").alias("n")), each, by, "fine")
    second = holding(second.withColumn("coarse", F.expr(f"fine div {FAN}")), [*by, "w", "coarse"], "fine")
    asked = asked.join(second, [*by, "w", "coarse"]).where("left >= lo and left < hi").withColumn("left", F.col("left") - F.col("lo"))
    asked = settle(asked.drop("coarse", "lo", "hi"))

    each = asked.select(*by, "w", "fine").distinct().join(spans.drop("qs"), [*by, "w"])
    hit = interval_join(counted.drop("coarse"), each, [*by, "fine"], "cell", "a", "b", width)
    values = holding(hit.groupBy(*by, "w", "fine", "v").agg(F.sum("n").alias("n")), [*by, "w", "fine"], "v")
    got = asked.join(values, [*by, "w", "fine"]).where("left >= lo and left < hi").withColumn("v", F.col("v").cast("double"))
    at = lambda f: F.max(F.when(F.col("rank") == f("pos"), F.col("v")))
    out = got.groupBy(*by, "w", "i", "q", "t", "pos").agg(at(F.floor).alias("_a"), at(F.ceil).alias("_b"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("pos") - F.floor("pos"))
    return out.select(*by, "w.*", "i", "q", F.col("t").alias("n"), between.alias("value"))
