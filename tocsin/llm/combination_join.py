"""Documents whose sets of word n-grams have a high Jaccard similarity, by prefixes of token combinations.

A token is an n-gram, as a 64-bit hash.  Tokens are ordered from rare to frequent by
counts over all documents, kept in a sketch of fixed size: two rows of ``BUCKETS``
counters, of which the driver and each task hold one copy.  The counts order and class
the tokens, so how good they are affects speed, never the result.

A set is indexed by the tokens of its prefix.  A rare token is a key by itself; tokens
of frequent classes are keys only as combinations of k of one group, k being the
class's number.  One missing token of a group of m takes the group's first m - k + 1
chances, so the prefix is extended until its chances exceed the tokens that a similar
set may lack.  Two similar sets then share a key: of the prefix that ends first, some
group keeps k tokens or some rare token stays, and the other prefix holds them too.
Groups are hashes of tokens, as many as keep a group's combinations few.  Keys hold a
band of sizes, that of the smaller set; a set is indexed for its own band and the one below.

Sets that are equal are one.  A list of sets with one key is never paired with itself.
Each set is first compared with the least set of its lists that it shares most keys
with, and confirmed links give components; that is done twice.  Then lists that still
hold several components are compared across components in blocks of bounded size, by
bitmaps of the sets' parities, whose differing bits are a lower bound of the differing
tokens.  Of the pairs that pass, at first each set's nearest few in each other component
are confirmed on full sets, more in each round, until none was held back.  So no link
between components is lost, and groups of near copies cost a comparison a set.

Documents without words have an empty set and are linked with nothing; those with fewer
words than an n-gram have all of them as their one token.  Rows with one id are one
document with several texts.  Rows with a null id are linked only to equal sets; where
all rows of a set have none, their component is null.  Long texts are read whole, an
empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import narrow, slices, stage
from .components import components
from .near_duplicates import BLANK, LOWER, PLACE, mix, word_hashes

BUCKETS = 1 << 17
#: A token beyond this many documents more than a bucket holds by chance is frequent; times STEP, of the next class.
RARE, STEP = 64, 64
#: Tokens of a prefix to a group of a frequent class, about.
CHANCES = 4
#: Sets of a list that one comparison takes from each side.
BLOCK = 512


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of ``words`` words (five at most)."""
    with np.errstate(over="ignore"):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
        blank = np.concatenate([[True], BLANK[data], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start = edge[::2]
        word = word_hashes(data, start, edge[1::2])
        first = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))
        grams = sum((word[k : max(0, len(word) - words + 1) + k] * PLACE[k] for k in range(1, words)), word[: max(0, len(word) - words + 1)] * PLACE[0])
        grams = mix(grams)
        out = []
        for a, b in zip(first, first[1:], strict=False):
            n = int(b - a)
            if n >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            else:
                out.append(mix(np.atleast_1d((word[a:b] * PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n) * PLACE[-1])) if n else np.zeros(0, np.uint64))
        return out


def buckets(tokens: np.ndarray) -> list[np.ndarray]:
    return [(tokens >> np.uint64(shift)).astype(np.int64) & (BUCKETS - 1) for shift in (3, 40)]


def marks(src: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` (null for empty sets) of every document, and rows of ``bucket, n``: counts of tokens."""
    import xxhash

    kind, names = src.schema["doc_id"].dataType, ["doc_id", "n_shingles", "digest", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = np.zeros(2 * BUCKETS, np.int64), pa.int64()
        for whole in batches:
            ids = whole.schema.field(0).type
            for b in slices(whole, limit=1 << 20):
                sets = shingles(b.column(1).to_pylist(), words)
                for row, at in enumerate(buckets(np.concatenate(sets))):
                    counts[row * BUCKETS : (row + 1) * BUCKETS] += np.bincount(at, minlength=BUCKETS)
                digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), digest, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())], names)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), ids), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names)

    return src.mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles long, digest binary, bucket int, n long")


def sketch(counts: DataFrame) -> tuple[np.ndarray, float]:
    """Both rows of counters, less what a bucket holds on average, and that average: 2 * BUCKETS numbers at any size of input."""
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    load = out.sum() / (2 * BUCKETS)
    return (out - load).astype(np.float32), float(load)


def bands(similarity: int) -> np.ndarray:
    """The least size of each band; similar sets are of one band or of two that are next to each other."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // similarity + 1)
    return np.array(low)


def least_overlap(a: int, b: int, similarity: int) -> int:
    return -(-similarity * (a + b) // (100 + similarity))


def keys_for(tokens: np.ndarray, kind: np.ndarray, band: int, low: int, missing: int, similarity: int) -> np.ndarray:
    """The keys of a set of ordered ``tokens`` of classes ``kind`` in a band whose least
    size is ``low``, if a similar set lacks ``missing`` of them at most."""
    salt = np.uint64(band + 1) * PLACE[1]
    if kind[min(missing, len(kind) - 1)] == 1:  # classes ascend
        return mix(tokens[: missing + 1] + salt)
    # small sets have too few tokens to spare for groups; eight tokens a group leave enough chances to others
    groups = max(1, low // max(8, CHANCES * 100 // max(1, 100 - similarity)))
    kind = np.minimum(kind, 3 if low >= 40 else 2 if low >= 4 else 1)
    of = np.where(kind > 1, kind * groups + (tokens % np.uint64(groups)).astype(np.int64), 0)
    order = np.argsort(of, kind="stable")
    begin = np.flatnonzero(np.diff(of[order], prepend=-1))
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of)) - np.repeat(begin, np.diff(begin, append=len(of))) + 1
    chances = np.cumsum((kind == 1) | (place >= kind))
    end = int(np.searchsorted(chances, missing + 1)) + 1
    if end > len(tokens):
        raise AssertionError("a prefix has too few chances")
    tokens, of, kind = tokens[:end], of[:end], kind[:end]
    out = [mix(tokens[kind == 1] + salt)]
    for g in np.unique(of[kind > 1]):
        own = np.sort(tokens[of == g])
        k = int(kind[of == g][0])
        if len(own) >= k:
            at = np.array(list(combinations(range(len(own)), k)))
            value = np.full(len(at), salt, np.uint64)
            for c in range(k):
                value = mix(value * PLACE[2] + own[at[:, c]])
            out.append(value)
    return np.concatenate(out)


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each of some buckets of tokens: whether an odd number of tokens is in it."""
    size = 1 << max(8, int(len(tokens) - 1).bit_length() - 1)
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def keys(tokens: np.ndarray, seen: np.ndarray, rare: float, similarity: int, low: np.ndarray) -> np.ndarray:
    """All keys of a set, from its tokens and how often each was seen."""
    n = len(tokens)
    kind = 1 + (seen > rare).astype(np.int64) + (seen > rare * STEP)
    order = np.lexsort((tokens, np.where(kind > 1, seen, 0)))
    tokens, kind = tokens[order], kind[order]
    band, smallest, out = int(np.searchsorted(low, n, "right")) - 1, -(-similarity * n // 100), []
    for b in (band, band - 1):
        if b >= 0 and smallest < low[b + 1]:
            partner = max(int(low[b]), smallest)
            out.append(keys_for(tokens, kind, b, int(low[b]), n - least_overlap(n, partner, similarity), similarity))
    return np.unique(np.concatenate(out).view(np.int64))


def index(src: DataFrame, counts: np.ndarray, load: float, words: int, similarity: int) -> DataFrame:
    """``node, n, bits, keys`` of each document that may be similar to an unequal one."""
    low, rare = bands(similarity), RARE + 4 * load**0.5

    def of(tokens: np.ndarray) -> np.ndarray:
        return keys(tokens, np.minimum(*(counts[at + row * BUCKETS] for row, at in enumerate(buckets(tokens)))), rare, similarity, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for b in slices(whole, limit=1 << 20):
                    sets = shingles(b.column(1).to_pylist(), words)
                    # the least size with room for another one: below it similar sets are equal
                    rows = [k for k, s in enumerate(sets) if len(s) and 100 * (len(s) - 1) >= similarity * len(s) or 100 * len(s) >= similarity * (len(s) + 1)]
                    cols = [pa.array([len(sets[k]) for k in rows], pa.int64()), pa.array([parity(sets[k]) for k in rows], pa.binary()), pa.array([of(sets[k]) for k in rows], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], ["node", "n", "bits", "keys"])

    return src.mapInArrow(run, f"node {src.schema['doc_id'].dataType.simpleString()}, n long, bits binary, keys array<long>")


def folded(bits: list[bytes]) -> np.ndarray:
    """Parity bitmaps as rows of words, all brought to the shortest one's length."""
    least = min(map(len, bits))
    out = np.empty((len(bits), least // 8), np.uint64)
    for k, b in enumerate(bits):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, least // 8), axis=0)
    return out


def may_link(n: np.ndarray, of: int, differing: np.ndarray, similarity: int) -> np.ndarray:
    both = n + of
    return differing <= both - 2 * -(-similarity * both // (100 + similarity))


def near(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""
    kind = pairs.schema["a"].dataType.simpleString()
    signed = pairs
    for c in "ab":
        signed = signed.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y, s, t in zip(*(r.column(k).to_pylist() for k in range(2, 6)), strict=True):
                two = folded([s, t])
                keep.append(bool(may_link(np.array(x), y, np.bitwise_count(two[0] ^ two[1]).sum(), similarity)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column(0).filter(keep), r.column(1).filter(keep)], ["a", "b"])

    return signed.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, src: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  A Bloom filter keeps texts out
    that no pair names before their sets are made."""
    named = stage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "named")
    table, blocks = bloom.build(named, "node", named.count())
    maybe = bloom.possible(src, F.col("doc_id"), stage(table, "filter"), blocks, how="keep")
    kind = src.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(b.column(1).to_pylist(), words)], pa.binary())], ["node", "members"])

    full = stage(maybe.mapInArrow(sets, f"node {kind}, members binary").join(named, "node", "left_semi"), "sets")
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y in zip(r.column(2), r.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) * 100 >= similarity * max(len(u), len(v)) else 0
                keep.append(shared > 0 and 100 * shared >= similarity * (len(u) + len(v) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column(0).filter(keep), r.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "ma", "mb").mapInArrow(run, f"a {kind}, b {kind}")


def placed(shared: DataFrame, found: DataFrame | None) -> DataFrame:
    """``key, node, component`` of the lists that still hold several components."""
    if found is None:
        return shared.withColumn("component", F.col("node"))
    rows = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return rows.join(mixed, "key", "left_semi")


def with_pivots(rows: DataFrame) -> DataFrame:
    """For each set that shares a list with another component's least set, one such pair:
    the one that most of its lists name."""
    least = rows.groupBy("key").agg(F.min(F.struct("component", "node")).alias("pivot")).select("key", F.col("pivot.component").alias("of"), F.col("pivot.node").alias("pivot"))
    met = rows.join(least, "key").where("component <> of").groupBy("node", "pivot").agg(F.count("*").alias("lists"))
    best = met.groupBy("node").agg(F.max(F.struct("lists", (-F.col("pivot")).alias("by"), "pivot"))["pivot"].alias("pivot"))
    return best.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def across(rows: DataFrame, nodes: DataFrame, limit: int, similarity: int) -> DataFrame:
    """``key, a, b, more``: pairs (a > b) of different components in one list that bitmaps allow; of a
    set the ``limit`` nearest in each other component, ``more`` if others were held back."""
    count = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(count, "key").join(nodes.select("node", "n", "bits"), "node")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component", "n", "bits")
    kind = dealt.schema["node"].dataType.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
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

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in lists(batches):
            if g.num_rows < 2:
                continue
            p, q = g.column("p")[0].as_py(), g.column("q")[0].as_py()
            own, node, part, n = (g.column(c).to_numpy() for c in ("own", "node", "component", "n"))
            bits = folded(g.column("bits").to_pylist())
            right, out = np.flatnonzero(own == q), []
            for k in np.flatnonzero(own == p):
                to = right[(part[right] != part[k]) & ((p != q) | (right > k))]
                differing = np.bitwise_count(bits[to] ^ bits[k]).sum(axis=1, dtype=np.int64)
                ok = may_link(n[to], int(n[k]), differing, similarity)
                to, differing = to[ok], differing[ok]
                if len(to):
                    order = np.lexsort((node[to], differing, part[to]))
                    to = to[order]
                    begin = np.flatnonzero(np.concatenate([[True], part[to][1:] != part[to][:-1]]))
                    size = np.diff(begin, append=len(to))
                    place = np.arange(len(to)) - np.repeat(begin, size)
                    more = np.repeat(size > limit, size)
                    keep = place < limit
                    out.append((np.maximum(node[to], node[k])[keep], np.minimum(node[to], node[k])[keep], more[keep]))
            if out:
                a, b, more = (pa.array(np.concatenate(c)) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), g.column("key")[0].as_py())), a, b, more], ["key", "a", "b", "more"])

    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, f"key long, a {kind}, b {kind}, more boolean")


def join(df: DataFrame, words: int = 3, similarity: int = 90, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents link where 100 * intersection
    >= ``similarity`` * union of their sets (50 to 100), and ``component_id`` is the least id that links reach."""
    src = narrow(df, id, text)
    seen = stage(marks(src, words), "marks")
    counts, load = sketch(seen.where("bucket is not null"))
    docs = seen.where("bucket is null").select("doc_id", "n_shingles", "digest")
    classes = stage(docs.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    named = stage(docs.join(classes, "digest", "left").select("doc_id", "n_shingles", "node"), "classed")
    # rows with one id and unequal sets
    several = named.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most")
    links = named.join(several.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")

    representatives = classes.where("node is not null").select("node").distinct()
    rows = stage(index(src, counts, load, words, similarity).join(representatives, "node"), "index")
    nodes, listed = rows.drop("keys"), rows.select("node", F.explode("keys").alias("key"))
    lists = listed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    shared = stage(listed.join(lists, "key", "left_semi").select("key", "node").distinct(), "shared")

    found, tested = None, None

    def confirm(pairs: DataFrame) -> bool:
        """Tests the pairs that were not tested before; False if there are none."""
        nonlocal found, tested, links
        new = pairs.select("a", "b").distinct()
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        new = stage(new, "pairs")
        if not new.limit(1).count():
            return False
        links = stage(links.unionByName(confirmed(new, src, words, similarity)), "links")
        tested = new if tested is None else stage(tested.unionByName(new), "tested")
        found = stage(components(links), "components")
        return True

    for _ in range(2):
        confirm(near(with_pivots(placed(shared, found)), nodes, similarity))
    limit, mixed = 2, stage(placed(shared, found), "mixed")
    while True:
        pairs = stage(across(mixed, nodes, limit, similarity), "across")
        confirm(pairs)
        held = stage(pairs.where("more").select("key").distinct(), "held")  # all pairs of the other lists are tested
        if not held.limit(1).count():
            break
        mixed = stage(placed(mixed.join(held, "key", "left_semi").select("key", "node"), found), "mixed")
        limit *= 8
    if found is None:
        found = components(links)
    out = named.join(found, "node", "left")
    component = F.coalesce("component", "node", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
