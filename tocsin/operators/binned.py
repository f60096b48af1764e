"""Exact quantiles and bin counts of many columns in one scan.

A wide row is never turned into a row per column.  Vectorised steps read whole
batches and keep counts per column; what leaves a task is a bounded table of
counts and, of each column, only distinct values that decide an exact result.
Nulls and values that are not finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ranks import exact_quantiles

#: Share of rows on each side of a quantile that are read as values, far above the sketch's error.
SLACK, ACCURACY = 0.002, 10_000


def numbers(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)


def doubles(df: DataFrame, cols: list[str], *more: Column) -> DataFrame:
    return df.select(*more, *[F.col(c).cast("double").alias(c) for c in cols])


def brackets(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, np.ndarray]:
    """Disjoint closed ranges of each column that hold its quantiles ``qs``, from
    one pass of sketches; the driver gets two numbers a quantile and column."""
    marks = sorted({min(1.0, max(0.0, q + d)) for q in qs for d in (-SLACK, SLACK)})
    near = [(marks.index(max(0.0, q - SLACK)), marks.index(min(1.0, q + SLACK))) for q in qs]
    shares = ", ".join(f"{m!r}D" for m in marks)
    asked = lambda c: f"percentile_approx(CASE WHEN abs({c}) < double('inf') THEN {c} END, array({shares}), {ACCURACY})"
    row = df.agg(*[F.expr(asked(f"`{c}`")).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        spans: list[list[float]] = []
        for a, b in near if row[c] else []:
            lo, hi = row[c][a], row[c][b]
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        out[c] = np.array(spans).reshape(-1, 2)
    return out


def column_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of every column: ``feature, q, value``.

    Values inside a bracket leave their task as distinct values with counts; the
    rest between two brackets as its least, its greatest and their number, which
    is all that ranks in the brackets and right beside them depend on.
    """
    src = doubles(df, cols)
    spans = brackets(src, cols, qs)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(name, gap, lo, hi, n):
            columns = [pa.array([name] * len(n)), pa.array(np.full(len(n), gap, np.int64)), pa.array(lo), pa.array(hi), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["feature", "gap", "lo", "hi", "n"])

        rest: dict[tuple[str, int], tuple[float, float, int]] = {}
        for batch in batches:
            for i, c in enumerate(cols):
                v = numbers(batch, i)
                v = v[np.isfinite(v)]
                if not len(v):
                    continue
                # ranges at or below a value; inside the last of them or in the gap after it
                k = np.searchsorted(spans[c][:, 0], v, side="right")
                inside = (k > 0) & (v <= spans[c][k - 1, 1])
                held, n = np.unique(v[inside], return_counts=True)
                if len(held):
                    yield rows(c, -1, held, held, n)
                for g in np.unique(k[~inside]):
                    w = v[~inside & (k == g)]
                    lo, hi, m = rest.get((c, int(g)), (np.inf, -np.inf, 0))
                    rest[c, int(g)] = (min(lo, w.min()), max(hi, w.max()), m + len(w))
        for (c, g), (lo, hi, m) in rest.items():
            yield rows(c, g, np.array([lo]), np.array([hi]), np.array([m]))

    got = src.mapInArrow(collapse, "feature string, gap long, lo double, hi double, n long")
    held = got.where("gap < 0").groupBy("feature", F.col("lo").alias("v")).agg(F.sum("n").alias("n"))
    gaps = got.where("gap >= 0").groupBy("feature", "gap").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    ends = F.array(F.struct(F.col("lo").alias("v"), F.lit(1).cast("bigint").alias("n")), F.struct(F.col("hi").alias("v"), (F.col("n") - 1).alias("n")))
    marks = gaps.select("feature", F.inline(ends)).where("n > 0")
    return exact_quantiles(held.unionByName(marks), ["feature"], "v", qs, weight="n")


def bin_counts(df: DataFrame, cols: list[str], group: Column, groups: int, edges: dict[str, list[float]]) -> DataFrame:
    """Rows of every column by ``group`` (0 to ``groups`` - 1) and bin: ``feature,
    grp, bin, v, n``.  A bin is the number of the column's ``edges`` at or below
    a value.  Columns without edges count each distinct value ``v`` (bin -1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(name, grp, bins, v, n):
            columns = [pa.array([name] * len(n)), pa.array(grp, pa.int64()), pa.array(bins, pa.int64()), pa.array(v, pa.float64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["feature", "grp", "bin", "v", "n"])

        sums = {c: np.zeros((groups, len(e) + 1), np.int64) for c, e in edges.items()}
        for batch in batches:
            grp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, c in enumerate(cols, 1):
                v = numbers(batch, i)
                ok = np.isfinite(v)
                g, v = grp[ok], v[ok]
                if c in edges:
                    wide = len(edges[c]) + 1
                    at = g * wide + np.searchsorted(edges[c], v, side="right")
                    sums[c] += np.bincount(at, minlength=groups * wide).reshape(groups, wide)
                else:
                    for k in np.unique(g):
                        held, n = np.unique(v[g == k], return_counts=True)
                        yield rows(c, np.full(len(n), k), np.full(len(n), -1), held, n)
        for c, s in sums.items():
            grp, bins = np.nonzero(s)
            if len(grp):
                yield rows(c, grp, bins, np.zeros(len(grp)), s[grp, bins])

    got = doubles(df, cols, group.cast("bigint").alias("_g")).where(F.col("_g").between(0, groups - 1))
    cells = got.mapInArrow(count, "feature string, grp long, bin long, v double, n long")
    return cells.groupBy("feature", "grp", "bin", "v").agg(F.sum("n").alias("n"))
