"""Packing documents into training sequences.

Documents are cut at multiples of the sequence length, so that at most one piece
of each is short.  The histogram of piece lengths, which has at most as many rows
as a sequence has tokens, is packed on the driver: lengths are placed longest
first, each into the shortest open packs that have room, and packs of one pattern
are only counted.  Pieces then find their place by their rank among pieces of
their length.  Ranks come from counts of small buckets, so a length that many
pieces share is not ordered in one task.

Strings of the vocabulary's added tokens become their ids, as in ``tokenizers``.  A
null or empty text is just the end token.  Rows may repeat, ids may be null;
each row is a document of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .byte_bpe import model
from .common import int_lists, narrow, slices, stage

SIZE, END = 2048, 1
#: Pieces that one bucket of a length is to hold about.
BUCKET_ROWS = 200_000


def cut(df: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, keep_ids: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens[, ids]`` per piece of each document."""
    src = narrow(df, id, text)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary, added=True)
        for whole in batches:
            for b in slices(whole):
                row, start, length, crc, total, parts = [], [], [], [], [], []
                for k, ids in enumerate(bpe.encode(b.column(1).to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    for at in range(0, n, size):
                        part = ids[4 * at : 4 * (at + size)]
                        row.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if keep_ids:
                            parts.append(part)
                cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays([*cols, int_lists(parts)] if keep_ids else cols, names)

    fields = [src.schema["doc_id"], *(StructField(n, LongType()) for n in names[1:5])] + [StructField("ids", ArrayType(IntegerType()))] * keep_ids
    return src.mapInArrow(run, StructType(fields))


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how many packs have each; a pattern is how often each length occurs in it."""
    open_packs: dict[int, list[list]] = {}  # by tokens used: [pattern, packs]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            used = next((u for u in sorted(open_packs) if u + length <= size), None)
            if used is None:
                each = size // length
                for packs, n in ((left // each, each), (int(left % each > 0), left % each)):
                    if packs:
                        open_packs.setdefault(n * length, []).append([{length: n}, packs])
                left = 0
                continue
            pattern, packs = open_packs[used].pop()
            most = (size - used) // length
            filled = min(packs, left // most)
            n, taken = (most, filled) if filled else (left, 1)
            if packs > taken:
                open_packs[used].append([pattern, packs - taken])
            if not open_packs[used]:
                del open_packs[used]
            open_packs.setdefault(used + n * length, []).append([pattern | {length: n}, taken])
            left -= n * taken
    return [(p, n) for used in sorted(open_packs) for p, n in open_packs[used]]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, pieces in a sequence, first offset) by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for length, n in pattern.items():
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * packs
            offset += n * length
        sequence += packs
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with ``doc_id, start, length, ids_crc32``; read several times, so a
    written table) with ``sequence_id`` and gapless ``offset`` in the sequence."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < k <= size for k in histogram):
        raise ValueError("pieces must have 1 to size tokens")
    buckets = 1 + max(histogram.values(), default=0) // BUCKET_ROWS
    where = places(shortest_pack_first(histogram, size))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets * 16)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "bucket")
    at, rank = ranked.columns.index("length"), ranked.columns.index("rank")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, r = b.column(at).to_numpy(), b.column(rank).to_numpy()
            sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for n in np.unique(length):
                mine, rows = length == n, where[n]
                slot = rows[np.searchsorted(rows[:, 0], r[mine], "right") - 1]
                k = r[mine] - slot[:, 0]
                sequence[mine], offset[mine] = slot[:, 1] + k // slot[:, 2], slot[:, 3] + k % slot[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = [ranked.schema[c] for c in names]
    return ranked.mapInArrow(run, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(df: DataFrame, vocabulary: str, size: int = SIZE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents, cut and placed."""
    pieces = stage(cut(df, vocabulary, size, id=id, text=text), "pieces")
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack(pieces, size).select(*order)
