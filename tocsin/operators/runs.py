"""Runs on hourly tables.

Hourly tables hold at most one row per (key, hour), so a window over a key is
bounded by the length of the period however large the journal is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def mark_runs(df: DataFrame, on: list[str], h: str, gap: int | Column = 0, out: str = "run") -> DataFrame:
    """Number the runs of consecutive hours; a pause of up to ``gap`` hours
    does not break one."""
    w = Window.partitionBy(*on).orderBy(h)
    step = F.col(h) - F.lag(h).over(w)
    return (
        df.withColumn("_n", F.when(step.isNull() | (step > gap + 1), 1).otherwise(0))
        .withColumn(out, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_n")
    )


def run_table(df: DataFrame, on: list[str], h: str, gap: int | Column = 0, aggs: dict[str, Column] | None = None) -> DataFrame:
    """One row per run: ``a`` first hour, ``b`` last hour, ``hours`` rows."""
    return (
        mark_runs(df, on, h, gap, "_island")
        .groupBy(*on, "_island")
        .agg(
            F.min(h).alias("a"),
            F.max(h).alias("b"),
            F.count(F.lit(1)).alias("hours"),
            *[c.alias(n) for n, c in (aggs or {}).items()],
        )
        .drop("_island")
    )
