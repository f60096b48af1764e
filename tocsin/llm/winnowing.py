"""Document fingerprints by winnowing.

Rolling hashes of all grams of ``GRAM`` code points are cut into windows of
``WINDOW`` grams, and each window keeps its least hash, the rightmost of equal
ones, with its position.  Any passage of ``GRAM + WINDOW - 1`` code points that two
texts share therefore leaves a common hash in both fingerprints.

Texts shorter than a gram are one gram; with fewer grams than a window all grams
are one window.  Null and empty texts have an empty fingerprint; two empty ones
are alike by 1.

``with_next`` compares each document with the one after it by id.  The order needs
no global sort of texts: ids are cut at approximate quantiles into ranges, each
range is sorted by itself, and the least document of each range is copied to the
range before it (that of the first range to the last).  Rows without an id come
first; rows with one id follow each other by a hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices

#: Texts that share a passage of 23 code points share a hash; about 2/17 of the positions are kept.
GRAM, WINDOW = 8, 16
#: Documents of a range, and ranges, at most; ranges only bound what one task sorts.
RANGE_ROWS, RANGES = 3_000, 50_000
BASE = 0x9E3779B97F4A7C15
LAST = np.uint64(0xFFFFFFFF)
FIRST_ID = -(1 << 63)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << n.bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(text: str) -> np.ndarray:
    """32-bit hashes of all grams, from differences of one running sum."""
    with np.errstate(over="ignore"):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = min(GRAM, len(chars))
        up, down = Powers.upto(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up, out=sums[1:])
        rolled = (sums[gram:] - sums[:-gram]) * down[: len(chars) - gram + 1]
        return mixed(rolled + np.uint64(gram)) >> np.uint64(32)


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams kept."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(text)
    least = hashes << np.uint64(32) | (LAST - np.arange(len(hashes), dtype=np.uint64))  # of equal hashes the rightmost
    window, size = min(WINDOW, len(hashes)), 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: size - window], least[window - size :])
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (LAST - (kept & LAST)).astype(np.int64), (kept >> np.uint64(32)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct hashes of two fingerprints."""
    x, y = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - shared
    return shared / every if every else 1.0


GRAMS = "array<struct<position:long,hash:long>>"


def column(prints: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(p) for p, _ in prints)]).astype(np.int32)
    position, hashes = (pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in prints)])) for k in (0, 1))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([position, hashes], ["position", "hash"]))


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint``: array of struct<position, hash> in text order."""
    src = narrow(df, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), column([fingerprint(t) for t in b.column(1).to_pylist()])], ["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint {GRAMS}")


def in_ranges(src: DataFrame) -> DataFrame:
    """``src`` (doc_id, text) in ranges of ids, sorted, and after each range's rows
    (``late`` 1) a copy of the first document after it."""
    place = src.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)))
    n = place.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = place.agg(F.percentile_approx("place", F.array(*map(F.lit, shares)), max(10_000, 20 * ranges))).first()[0] if shares else []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, p.to_numpy(), "left").astype(np.int32))

    least = sorted((r["range"], r["place"]) for r in place.select("place", range_of("place").alias("range")).groupBy("range").agg(F.min("place").alias("place")).collect())
    heads = np.array([p for _, p in least], np.int64)
    before = np.array([least[k - 1][0] for k in range(len(least))], np.int32)

    @F.pandas_udf("array<int>")
    def targets(p: pd.Series) -> pd.Series:
        values = p.to_numpy()
        own = np.searchsorted(cuts, values, "left")
        at = np.minimum(np.searchsorted(heads, values), max(0, len(heads) - 1))
        return pd.Series([[int(r), int(before[k])] if heads[k] == v else [int(r)] for r, k, v in zip(own, at, values, strict=True)])

    dealt = place.select("*", F.posexplode(targets("place")).alias("late", "range"))
    return dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "late", "place", F.xxhash64("text"))


def edit(text: str, after: str) -> str:
    """The text whose last half gives way to as many first code points of the next one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    rows = in_ranges(narrow(df, id, text)).select("doc_id", "text", "range", "late")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    of_id = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: range, id, text, fingerprint
        for whole in batches:
            for b in slices(whole):
                out = []
                for doc, t, r, late in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    t = t or ""
                    mine = fingerprint(t)
                    if last and last[0] == r:
                        _, of, own, kept = last
                        new = edit(own, t)
                        changed = fingerprint(new)
                        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((of, len(own), digest, kept, changed, likeness(kept[1], changed[1]), likeness(kept[1], mine[1])))
                    last = None if late else (r, doc, t, mine)
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], of_id), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), column(c[3]), column(c[4]), pa.array(c[5], pa.float64()), pa.array(c[6], pa.float64())], names)

    return rows.mapInArrow(run, f"doc_id long, n_chars long, edited_sha256 string, fingerprint {GRAMS}, edited_fingerprint {GRAMS}, near_edited double, near_next double")
