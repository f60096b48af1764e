"""Hard negatives: rows of another label that score close to, but below, an anchor's positives.

Scores are exact integer inner products of quantised vectors, found by
Kronecker-packed products.  In a block of candidates the i-th components are biased
to be non-negative and set side by side, one field each, in one wide integer.  An
anchor's biased i-th component then multiplies that integer once for the whole
block, the products of all components are added, and each field of the sum holds one
candidate's biased product, from which four known terms give the score.  Fields are
as wide as the block's largest possible sum needs, so no field runs into the next.

First an anchor meets the rows of its own label, which gives its positives, then all
rows, of which each positive's range of scores keeps the first ones.  Anchors and
candidates are dealt into blocks of bounded size and each pair of blocks is one
group, so a hot label is never one task; a group returns its first rows only.

Rows without id, label or vector, or with a null or non-finite component, take no
part.  Rows with one id count once, with the least label and vector.  Vectors of
different lengths have no product, empty ones have the product 0.  Ties go to the
smaller id.  An empty table gives no rows; other columns are not read.  A score
beyond 64 bits is an error, as an overflow is in ANSI SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows of a block of candidates and of anchors, and candidates packed into one integer.
CANDIDATES, ANCHORS, FIELDS = 2_048, 16_384, 512


def points(df: DataFrame, scale: int, id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, size, q`` (array of longs) of the rows that take part."""
    src = df.select(df[id].alias("vec_id"), df[label].cast("long").alias("label"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    too_large = F.raise_error(F.lit("a component has no 64-bit quantised value"))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale)).otherwise(too_large)
    src = src.select("vec_id", F.struct("label", F.transform("v", whole).alias("q")).alias("row"))
    one = src.groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", F.size("row.q").alias("size"), "row.q")


def packed(block: np.ndarray, low: int, width: int) -> list[int]:
    """For each component one integer that holds the rows' biased components in fields of ``width`` bytes."""
    if width in (4, 8):
        return [int.from_bytes(np.ascontiguousarray(c - low).astype(f"<u{width}").tobytes(), "little") for c in block.T]
    return [int.from_bytes(b"".join((int(x) - low).to_bytes(width, "little") for x in c), "little") for c in block.T]


def products(anchors: np.ndarray, block: np.ndarray) -> Iterator[np.ndarray]:
    """For each anchor (a row of longs) its inner products with all rows of ``block``."""
    (n, d), rows = block.shape, len(anchors)
    if not rows or not n or not d:
        yield from (np.zeros(n, np.int64) for _ in range(rows))
        return
    low_a, low_c, high_a, high_c = int(anchors.min()), int(block.min()), int(anchors.max()), int(block.max())
    largest = d * max(abs(low_a), abs(high_a)) * max(abs(low_c), abs(high_c))
    sums = d * (high_a - low_a) * (high_c - low_c)  # what a field has to hold
    plain = largest < 1 << 61
    width = 4 if plain and sums < 1 << 32 else 8 if plain else sums.bit_length() // 8 + 1
    parts = [(k, min(n, k + FIELDS)) for k in range(0, n, FIELDS)]
    words = [packed(block[a:b], low_c, width) for a, b in parts]
    exact = block if plain else block.astype(object)
    of_block = (exact - low_c).sum(axis=1) * low_a + d * low_a * low_c
    for anchor in anchors:
        up = [int(x) - low_a for x in anchor]
        fields = []
        for (a, b), word in zip(parts, words, strict=True):
            raw = sum([x * w for x, w in zip(up, word, strict=True)]).to_bytes((b - a) * width, "little")
            fields.append(np.frombuffer(raw, f"<u{width}").astype(np.int64) if plain else np.array([int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width)], object))
        score = np.concatenate(fields) + of_block + low_c * sum(up)
        if not plain:
            if max(map(abs, score)) >= 1 << 63:
                raise OverflowError("a score does not fit in 64 bits")
            score = score.astype(np.int64)
        yield score


def first(score: np.ndarray, ids: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
    """Of the places ``of`` those of the ``most`` largest scores, ties to smaller ids."""
    if len(of) > most:
        least = np.partition(score[of], len(of) - most)[len(of) - most]
        of = of[score[of] >= least]
    return of[np.lexsort((ids[of], -score[of]))[:most]]


def matrix(t: pa.Table) -> np.ndarray:
    """The vectors of a group, which all have one length."""
    return t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0), np.int64)


def in_blocks(anchors: DataFrame, rows: DataFrame, by: list[str]):
    """Both sides cogrouped: each block of anchors meets each block of rows with the same ``by`` once."""
    count = lambda d, size, name: d.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = stage(count(anchors, ANCHORS, "of_anchors").join(count(rows, CANDIDATES, "of_rows"), by), "blocks")

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        return d.join(blocks, by).withColumn(f"{own}_at", mine).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    key = [*by, "of_anchors_at", "of_rows_at"]
    return dealt(anchors, "of_anchors", "of_rows").groupBy(*key).cogroup(dealt(rows, "of_rows", "of_anchors").groupBy(*key))


def positives(anchors: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """``vec_id, positive_id, positive_score``: an anchor's first ``most`` other rows of its label."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = right.column("vec_id").to_numpy(), []
        for own, score in zip(left.column("vec_id").to_pylist() if right.num_rows else [], products(matrix(left), matrix(right)), strict=False):
            best = first(score, ids, np.flatnonzero(ids != own), most)
            out.append((np.full(len(best), own, ids.dtype), ids[best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [ids[:0], ids[:0], np.zeros(0, np.int64)]
        return pa.table(cols, names=["vec_id", "positive_id", "positive_score"])

    found = in_blocks(anchors, rows, ["label", "size"]).applyInArrow(compare, f"vec_id {kind}, positive_id {kind}, positive_score long")
    place = Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("place")


def mine(df: DataFrame, is_anchor: Column, most_positives: int = 5, most_negatives: int = 10, lower: int = 30, upper: int = 90, scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``is_anchor`` (over vec_id) holds.  A component x
    becomes floor(scale * x).  A negative's score is ``lower`` to ``upper`` hundredths of
    the positive's; the first ``most_negatives`` of each anchor and positive are returned."""
    rows = stage(points(df, scale, id, vector, label), "points")
    anchors = stage(rows.where(is_anchor), "anchors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    best = stage(positives(anchors, rows, most_positives), "positives")
    asked = best.groupBy("vec_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wanted"))  # most_positives at most
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, out = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), []
        each = zip(left.column("vec_id").to_pylist(), left.column("label").to_pylist(), left.column("wanted").to_pylist(), strict=True)
        for (own, of, wanted), score in zip(each if right.num_rows else [], products(matrix(left), matrix(right)), strict=False):
            other = np.flatnonzero(labels != of)
            theirs = score[other]
            for w in wanted:
                low, high = -(-lower * w["positive_score"] // 100), upper * w["positive_score"] // 100
                if low <= high:
                    hit = first(score, ids, other[(theirs >= low) & (theirs <= high)], most_negatives)
                    n = len(hit)
                    out.append((np.full(n, own, ids.dtype), np.full(n, w["positive_id"], ids.dtype), np.full(n, w["positive_score"], np.int64), ids[hit], score[hit]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [ids[:0], ids[:0], np.zeros(0, np.int64), ids[:0], np.zeros(0, np.int64)]
        return pa.table(cols, names=names)

    found = in_blocks(anchors.join(asked, "vec_id"), rows, ["size"]).applyInArrow(compare, f"anchor_id {kind}, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long")
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
