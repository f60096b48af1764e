"""Isotonic regression of many groups at once, fitted in slices that are merged in order.

Pooling adjacent violators may be done in parts: blocks pooled within a slice of
scores stay together in the whole fit.  So each slice is pooled by itself, then the
blocks of neighbouring slices together, until a group is one slice.  Totals are
whole numbers and means are compared by products, so blocks do not depend on how
the scores were cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import ranked

#: Distinct scores of a slice, and slices that are merged at a time.
SLICE, MERGED = 20_000, 16


def pool(rows: pd.DataFrame) -> list[list]:
    """``lo, hi, total, n`` of the pooled blocks; equal means are one block."""
    done: list[list] = []
    for lo, hi, total, n in zip(*(rows[c].tolist() for c in ("lo", "hi", "total", "n"))):
        done.append([lo, hi, total, n])
        while len(done) > 1 and done[-2][2] * done[-1][3] >= done[-1][2] * done[-2][3]:
            lo2, hi2, total2, n2 = done.pop()
            done[-1] = [done[-1][0], hi2, done[-1][2] + total2, done[-1][3] + n2]
    return done


def isotonic(rows: DataFrame, by: list[str], x: str, label: Column, slice_rows: int = SLICE, merged: int = MERGED) -> DataFrame:
    """``by, lo, hi, n, value``: the blocks of the rising step function of ``x`` nearest to
    ``label`` (a whole number); null ``x`` or ``label`` take no part."""
    src = rows.select(*by, F.col(x).cast("double").alias("_x"), label.cast("long").alias("_y")).where("_x is not null and _y is not null")
    points = src.groupBy(*by, "_x").agg(F.sum("_y").alias("total"), F.count(F.lit(1)).alias("n"))
    place = ranked(points.select(*by, "_x"), by, "_x").select(*by, "_x", F.expr(f"(cum_n - 1) div {slice_rows}").alias("_part"))
    blocks = points.join(place, [*by, "_x"]).select(*by, "_part", F.col("_x").alias("lo"), F.col("_x").alias("hi"), "total", "n")
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}, _part long, lo double, hi double, total long, n long"

    def pooled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(pool(pdf.sort_values("lo")), columns=["lo", "hi", "total", "n"])
        for c, v in zip([*by, "_part"], key):
            out[c] = v
        return out[[*by, "_part", "lo", "hi", "total", "n"]]

    most = points.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // slice_rows)
    blocks = blocks.groupBy(*by, "_part").applyInPandas(pooled, schema)
    while parts > 1:
        blocks = blocks.withColumn("_part", F.expr(f"_part div {merged}")).groupBy(*by, "_part").applyInPandas(pooled, schema)
        parts = -(-parts // merged)
    return blocks.select(*by, "lo", "hi", "n", (F.col("total") / F.col("n")).alias("value"))


def along(blocks: DataFrame, rows: DataFrame, by: list[str], x: str, out: str, cells: int = 64) -> DataFrame:
    """``rows`` with ``out``: the step function at ``x``, linear between blocks and level
    beyond the first and last.  Segments are copied to the cells of scores they touch."""
    knots = blocks.select(*by, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_x0"), F.col("value").alias("_v0"))
    order = Window.partitionBy(*by).orderBy("_x0")  # two rows a block
    far = F.lit(float("inf"))
    seg = knots.select(*by, "_x0", "_v0", F.lead("_x0").over(order).alias("_x1"), F.lead("_v0").over(order).alias("_v1"))
    first = knots.groupBy(*by).agg(F.min_by("_v0", "_x0").alias("_v0"), F.min("_x0").alias("_x1")).select(*by, (-far).alias("_x0"), "_v0", "_x1", F.col("_v0").alias("_v1"))
    seg = seg.withColumns({"_x1": F.coalesce("_x1", far), "_v1": F.coalesce("_v1", "_v0")}).unionByName(first)
    marks = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    edges = rows.groupBy(*by).agg(F.percentile_approx(F.col(x).cast("double"), marks, F.lit(2000)).alias("_e"))
    cell = lambda c: F.size(F.filter("_e", lambda e: e < F.col(c)))
    seg = seg.join(edges, by).withColumn("_c", F.explode(F.sequence(cell("_x0"), cell("_x1")))).drop("_e")
    at = rows.join(edges, by).withColumn("_c", cell(x)).drop("_e")
    inside = (F.col(x) >= F.col("_x0")) & (F.col(x) < F.col("_x1"))
    share = F.when(F.col("_x0").isin(float("-inf")) | (F.col("_x1") == far), F.lit(0.0)).otherwise((F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    value = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    return at.join(seg, [*by, "_c"]).where(inside).select(*rows.columns, value.alias(out))
