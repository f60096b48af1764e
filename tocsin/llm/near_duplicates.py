"""Near-duplicate documents by MinHash, banding and verification.

A document's set holds its distinct shingles of five words, as 64-bit hashes.
Documents with equal sets are one class and only its least document goes on.
Minima of many universal hashes form bands; documents that share a band's minima
are candidates, which their short signatures and then their full sets confirm.

A bucket of a band is never paired with itself.  First each of its documents is
compared with one pivot, and confirmed links give first components.  Then only
buckets that still hold several components are compared once more, across
components, in blocks of bounded size; a pair that the components already join needs
no comparison.  A block holds the full sets and gives only links that join what it has
not joined yet, fewer than its rows, so that no pair is written before it is confirmed.
So no link between components of the result is lost to a cap, and groups of near copies
cost a comparison a row.

Documents without words have an empty set and are linked with nothing; those of
fewer than five words have all of them as their one shingle.  Rows with the same
id count as one document; rows with a null id are linked only to equal sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import narrow, settled, slices, stage
from .components import components

WORDS, SIMILARITY = 5, 75  # words in a shingle; similarity in hundredths
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Standard deviations below the expected agreement of signatures from which a candidate is left out.
SLACK = 5.5
#: Documents of a bucket that one comparison takes from each side, and their shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Hashes that are drawn; signatures use the first of them.
DRAWN = HASHES + 1024

with np.errstate(over="ignore"):
    MIXED = np.random.default_rng(20240517)
    FACTOR = MIXED.integers(1, 1 << 63, DRAWN, np.uint64) * np.uint64(2) + np.uint64(1)
    SHIFT = MIXED.integers(0, 1 << 63, DRAWN, np.uint64) * np.uint64(2)
    BYTE = MIXED.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    PLACE = MIXED.integers(1, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << 16) - 1, BASE, np.uint64)]), dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word ``data[start:end]``, from its bytes and its length."""
    size = end - start
    values = BYTE[data]
    out = np.zeros(len(start), np.uint64)
    short = size <= len(POWERS)
    if short.any():
        take = size[short]
        begin = np.cumsum(take) - take
        at = np.arange(int(take.sum())) - np.repeat(begin, take)
        out[short] = np.add.reduceat(values[np.repeat(start[short], take) + at] * POWERS[at], begin)
    for k in np.flatnonzero(~short):  # words of more than 65,536 bytes
        h = np.uint64(0)
        for a in range(int(start[k]), int(end[k]), len(POWERS)):
            part = values[a : min(int(end[k]), a + len(POWERS))]
            h = mix(np.atleast_1d(h + (part * POWERS[: len(part)]).sum(dtype=np.uint64)))[0]
        out[k] = h
    return mix(out + size.astype(np.uint64) * np.uint64(BASE))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
        ends = np.cumsum([len(r) + 1 for r in raw])
        blank = np.concatenate([[True], BLANK[data], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edge[::2], edge[1::2]
        word = word_hashes(data, start, end)
        first = np.searchsorted(start, np.concatenate([[0], ends]))
        if len(word) >= WORDS:
            five = word[: len(word) - WORDS + 1] * PLACE[0]
            for k in range(1, WORDS):
                five = five + word[k : len(word) - WORDS + 1 + k] * PLACE[k]
            five = mix(five)
        out = []
        for a, b in zip(first, first[1:], strict=False):
            n = int(b - a)
            if n >= WORDS:
                out.append(np.unique(five[a : b - WORDS + 1]))
            elif n:
                whole = np.uint64(n) * PLACE[WORDS]
                for k in range(n):
                    whole = whole + word[a + k] * PLACE[k]
                out.append(mix(np.atleast_1d(whole)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the least of its values under each universal hash, of 32 bits."""
    with np.errstate(over="ignore"):
        flat = np.concatenate(sets)
        begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), HASHES), np.uint32)
        flat = flat >> np.uint64(32) ^ flat
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((flat * FACTOR[k] + SHIFT[k]) >> np.uint64(32), begin)
        return out


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(least), 1))
        for k in range(ROWS):
            out = mix(out * PLACE[k] + least[:, k::ROWS].astype(np.uint64))
        return out.view(np.int64)


def signatures(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, bands, signature`` of every row; the last three are
    null for empty sets.  ``signature`` has eight bits of each minimum."""
    import xxhash

    src = narrow(df, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, limit=1 << 20):
                sets = shingles(b.column(1).to_pylist())
                full = [k for k, s in enumerate(sets) if len(s)]
                digest, bands, short = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    least = minima([sets[k] for k in full])
                    keys = band_keys(least)
                    for row, k in enumerate(full):
                        digest[k], bands[k], short[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), keys[row], least[row].astype(np.uint8).tobytes()
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_shingles", "digest", "bands", "signature"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, bands array<long>, signature binary")


def least_agreement() -> int:
    """Equal bytes of two signatures below which sets are, but for SLACK, not similar enough."""
    p = SIMILARITY / 100 + (1 - SIMILARITY / 100) / 256
    return int(HASHES * p - SLACK * (HASHES * p * (1 - p)) ** 0.5)


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures agree often enough, without the signatures."""
    at, least = [pairs.columns.index(c) for c in ("a", "b", "sa", "sb")], least_agreement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            x, y = (np.frombuffer(b"".join(r.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in at[2:])
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([r.column(at[0]).filter(keep), r.column(at[1]).filter(keep)], ["a", "b"])

    t = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {t}, b {t}")


def of_nodes(named: DataFrame, df: DataFrame, id: str, text: str, column: str, make: Callable[[list[np.ndarray]], list[bytes]]) -> DataFrame:
    """``node`` and what ``make`` gives for the sets of the documents in ``named`` (node).
    A Bloom filter keeps other texts out before their sets are made."""
    table, blocks = bloom.build(named, "node", named.count())
    maybe = bloom.possible(narrow(df, id, text), F.col("doc_id"), stage(table, "filter"), blocks, how="keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(make(shingles(b.column(1).to_pylist())), pa.binary())], ["node", column])

    kind = maybe.schema["doc_id"].dataType.simpleString()
    return maybe.mapInArrow(run, f"node {kind}, {column} binary").join(named, "node", "left_semi")


def signed_sets(sets: list[np.ndarray]) -> list[bytes | None]:
    """The signature of each set, of HASHES bytes, and behind it the set; null for empty ones."""
    out: list[bytes | None] = [None] * len(sets)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        for k, row in zip(full, minima([sets[k] for k in full]).astype(np.uint8), strict=True):
            out[k] = row.tobytes() + sets[k].tobytes()
    return out


def confirmed(pairs: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = stage(pairs.distinct(), "pairs")
    named = wanted.select(F.col("a").alias("node")).unionByName(wanted.select(F.col("b").alias("node"))).distinct()
    full = of_nodes(stage(named, "named"), df, id, text, "members", lambda sets: [s.tobytes() for s in sets])
    kind = wanted.schema["a"].dataType.simpleString()
    full = stage(full, "sets")
    both = wanted.join(full.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y in zip(r.column(2), r.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) * 100 >= SIMILARITY * max(len(u), len(v)) else 0
                keep.append(100 * shared >= SIMILARITY * (len(u) + len(v) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column(0).filter(keep), r.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def pivot_pairs(buckets: DataFrame) -> DataFrame:
    """Each document of a bucket with the bucket's pivot (a > b), by an order of documents
    that all buckets share, so that a group of near copies has few pivots."""
    pivots = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node"))["node"].alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    pairs = buckets.join(pivots, "key").where(F.col("node") != F.col("pivot"))
    return pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def across(nodes: DataFrame, first: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """Links (a > b) between documents of different components of ``first`` that share a
    bucket, confirmed on full sets.  Each pair is compared in the first bucket that its two
    share, unless links found before in the same block join them.  (One of two documents
    has its pair tested.)"""
    buckets = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    placed = buckets.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), parts.alias("blocks")).where("n > 2 and low <> high").select("key", "blocks")
    rows = stage(placed.drop("n_shingles").join(mixed, "key"), "mixed")
    full = of_nodes(stage(rows.select("node").distinct(), "named"), df, id, text, "members", signed_sets)
    rows = rows.join(stage(full.where("members is not null").join(nodes.select("node", "bands"), "node"), "sets"), "node")
    block = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    # a row meets each block of its bucket once: from the left if its own is the lower one
    dealt = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component", "members", "bands")
    kind = dealt.schema["node"].dataType.simpleString()
    few = least_agreement()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.Table]:
            kept: list[pa.RecordBatch] = []
            for b in batches:
                kept.append(b)
                t = pa.Table.from_batches(kept).combine_chunks()
                cols = [t.column(k).to_numpy() for k in range(3)]
                cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
                edges = [0, *cut.tolist()]
                for x, y in zip(edges, edges[1:], strict=False):
                    yield t.slice(x, y - x)
                kept = t.slice(edges[-1]).combine_chunks().to_batches()
            if kept:
                yield pa.Table.from_batches(kept)

        for g in groups():
            p, q = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            own, node = (g.column(k).to_numpy() for k in (3, 4))
            part = np.unique(g.column(5).to_numpy(), return_inverse=True)[1]
            both = g.column(6).to_pylist()
            short = np.frombuffer(b"".join([x[:HASHES] for x in both]), np.uint8).reshape(-1, HASHES)
            size = np.array([len(x) - HASHES for x in both]) // 8
            bands, key = g.column(7).combine_chunks().flatten().to_numpy().reshape(-1, BANDS), g.column(0)[0].as_py()
            left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
            sets, a, b = None, [], []
            for k in left:
                hit = right[(part[right] != part[k]) & ((p != q) | (right > k))]
                hit = hit[np.minimum(size[hit], size[k]) * 100 >= SIMILARITY * np.maximum(size[hit], size[k])]
                hit = hit[(short[hit] == short[k]).sum(axis=1) >= few]
                shared = bands[hit] == bands[k]
                hit = hit[bands[k][shared.argmax(axis=1)] == key]
                if not len(hit):
                    continue
                if sets is None:  # members by their number among all of the block
                    numbers = np.unique(np.frombuffer(b"".join([x[HASHES:] for x in both]), np.uint64), return_inverse=True)[1]
                    sets, held = np.split(numbers, np.cumsum(size)[:-1]), np.zeros(len(numbers), bool)
                held[sets[k]] = True
                for j in hit:
                    if part[j] != part[k]:
                        common = np.count_nonzero(held[sets[j]])
                        if 100 * common >= SIMILARITY * (size[j] + size[k] - common):
                            part[part == part[j]] = part[k]
                            a.append(max(node[j], node[k]))
                            b.append(min(node[j], node[k]))
                held[sets[k]] = False
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def groups(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``df``; ids are longs.
    The result is a written stage; the tables that led to it are removed."""
    return settled(df.sparkSession, "groups", lambda: grouped(df, id, text))


def grouped(df: DataFrame, id: str, text: str) -> DataFrame:
    spark = df.sparkSession
    marks = stage(signatures(df, id, text), "signatures")
    classes = marks.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    classes = stage(classes, "classes")
    nodes = marks.join(classes.where("node is not null").withColumnRenamed("digest", "of"), (F.col("of") == F.col("digest")) & (F.col("node") == F.col("doc_id"))).select("node", "n_shingles", "bands", "signature")
    nodes = stage(nodes.dropDuplicates(["node"]), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    short = nodes.select("node", "signature")
    tested = stage(pivot_pairs(buckets), "pivots")
    signed = tested.join(short.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(short.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")
    links = settled(spark, "confirmed", lambda: confirmed(agreeing(signed), df, id, text))
    first = settled(spark, "first", lambda: components(links))
    more = settled(spark, "confirmed", lambda: across(nodes, first, df, id, text))
    whole = components(links.unionByName(more)).withColumnRenamed("component", "least")
    named = classes.join(whole, "node", "left").select("digest", F.coalesce("least", "node").alias("least"))
    out = marks.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce(F.when(F.col("digest").isNotNull(), F.col("least")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
