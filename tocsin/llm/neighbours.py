"""Approximate nearest neighbours from balanced posting lists.

Centroids are fitted on a bounded sample, large clusters being dearer to join so
that lists stay balanced.  Every vector goes to its nearest list and, near a
border, also to others that are almost as near.  Centroids are searched by
following a graph of their neighbours.  A query reads the lists that are not much
farther than its nearest one, so queries between clusters read more lists, and
in any case lists that hold enough vectors.

Nearness is the inner product.  Distances to centroids are taken after adding one
component that gives all vectors the same length, so that the nearest vectors are
those with the largest inner product.  Scores are sums of double products.

Lists longer than ``BLOCK`` are dealt into blocks, and so are the queries of a list;
each pair of blocks is compared once, by matrix product, and keeps each query's
nearest.  A hot list is thus never one task.

Copies of one vector score alike, so of any query's ``k`` nearest only the copies
with the ``k + 1`` smallest ids can be part, the query's own among them.  Lists hold
those, equal queries share one search, and each then leaves out its own row: the
result is that of the whole table, and work does not grow with the square of copies.

Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id or with another dimension than most vectors.  Rows
with one id count once, with the least vector.  Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stage

#: Vectors that centroids are fitted on, rows of a list, and lists, at most or about.
SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 400, 2_048
#: Lists of a vector, and how much farther than the nearest one those may be.
COPIES, COPY_RATIO = 8, 1.10
#: How much farther than its nearest list those of a query may be.
PROBE_RATIO = 1.10
DEGREE, FIRST_LOOK = 24, 16
BLOCK = 2_000


def square(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum(square(x)[:, None] - 2 * x @ c.T + square(c)[None, :], 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, weight: float = 0.3) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        count, sums, even = np.zeros(k), np.zeros_like(c), len(x) / k
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            d = apart(x[part], c)
            to = np.argmin(d + weight * d.min(axis=1).mean() * np.maximum(count / even - 1, 0), axis=1)
            np.add.at(sums, to, x[part])
            count += np.bincount(to, minlength=k)
        full = count > 0
        c[full] = sums[full] / count[full, None]
    return c


def neighbour_graph(c: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid, near ones that no nearer neighbour hides, and the
    nearest of those with a smaller number, so that all are reached from the first."""
    d = apart(c, c)
    out = np.empty((len(c), DEGREE), np.int64)
    order = np.argsort(d, axis=1, kind="stable")
    back: list[list[int]] = [[] for _ in c]
    for i in range(len(c)):
        if i:
            to = int(np.argmin(d[i, :i]))
            back[i].append(to)
            back[to].append(i)
    for i in range(len(c)):
        kept: list[int] = []
        for j in order[i, 1 : 4 * DEGREE]:
            if len(kept) < DEGREE // 2 and all(d[j, n] >= d[i, j] for n in kept):
                kept.append(int(j))
        for j in kept:
            back[j].append(i)
        back[i] = kept + back[i]
    width = max([1, *map(len, back)])
    out = np.repeat(np.arange(len(c))[:, None], width, axis=1)
    for i, n in enumerate(back):
        out[i, : len(n)] = n
    return out


@dataclass
class Index:
    """Bounded by MOST_LISTS centroids; ``longest`` is the squared length that all vectors are given."""

    centroids: np.ndarray
    graph: np.ndarray
    longest: float

    def lifted(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(self.longest - square(x), 0))
        return np.hstack([x, more[:, None]])

    def lists(self, x: np.ndarray, ratio: float, most: int | None = None) -> list[np.ndarray]:
        """For each row the lists within ``ratio`` of its nearest one, nearest first."""
        out: list[np.ndarray] = []
        for a in range(0, len(x), 256):
            out += self.walk(x[a : a + 256], ratio, most)
        return out

    def walk(self, x: np.ndarray, ratio: float, most: int | None) -> list[np.ndarray]:
        n, k = len(x), len(self.centroids)
        rows, own, length = np.arange(n), square(x), square(self.centroids)
        dist, done = np.full((n, k), np.inf), np.zeros((n, k), bool)
        dist[:, 0] = own - 2 * x @ self.centroids[0] + length[0]
        for step in range(k):
            left = np.where(done, np.inf, dist)
            best = left.argmin(axis=1)
            near = left[rows, best]
            go = np.isfinite(near) & ((near <= ratio * ratio * np.maximum(dist.min(axis=1), 0) + 1e-12) | (step < FIRST_LOOK))
            if not go.any():
                break
            r, b = rows[go], best[go]
            done[r, b] = True
            to = self.graph[b]
            d = own[r][:, None] - 2 * np.einsum("ij,ikj->ik", x[r], self.centroids[to]) + length[to]
            dist[r[:, None], to] = d
        dist = np.maximum(dist, 0)
        found = []
        for d in dist:
            ids = np.flatnonzero(d <= ratio * ratio * d.min() + 1e-12)
            found.append(ids[np.argsort(d[ids], kind="stable")][:most])
        return found


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id, v`` (array of doubles) of the vectors that take part."""
    src = df.select(df[id].alias("vec_id"), df[vector].cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = src.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    src = src.where(F.size("v") == (sizes["size"] if sizes else 0))
    return src.groupBy("vec_id").agg(F.min("v").alias("v"))


def first_copies(vectors: DataFrame, most: int) -> DataFrame:
    """The rows that have fewer than ``most`` equal vectors with smaller ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    return vectors.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= most).drop("copy")


def fit(vectors: DataFrame) -> Index:
    """The index's centroids, from about SAMPLE of the vectors (vec_id, v)."""
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, most = vectors.agg(F.count("*"), longest).first()
    if not n:
        return Index(np.zeros((1, 1)), np.zeros((1, 1), np.int64), 0.0)
    sample = bounded_sample(vectors, F.col("vec_id"), SAMPLE).orderBy("vec_id").toArrow()
    if not sample.num_rows:
        sample = vectors.limit(1).toArrow()
    index = Index(np.zeros((1, 1)), np.zeros((1, 1), np.int64), most)
    x = index.lifted(matrix(sample.column("v").combine_chunks()), False)
    c = balanced_centroids(x, max(1, min(MOST_LISTS, n // LIST_ROWS, len(x))))
    return Index(c, neighbour_graph(c), most)


def enough(index: Index, x: np.ndarray, lists: list[np.ndarray], sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """``lists`` of each row, and the next nearest ones until they have ``least`` entries or none is left."""
    for i, own in enumerate(lists):
        if sizes[own].sum() < least:
            order = np.argsort(apart(x[i : i + 1], index.centroids)[0], kind="stable")
            order = np.concatenate([own, order[~np.isin(order, own)]])
            lists[i] = order[: max(len(own), int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1)]
    return lists


def placed(vectors: DataFrame, index: Index, is_query: bool, ratio: float, most: int | None, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """``list, vec_id, v``: a row for each list of each vector."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2_048):
                b = whole.slice(a, 2_048)
                x = index.lifted(matrix(b.column(1)), is_query)
                lists = index.lists(x, ratio, most)
                if sizes is not None:
                    lists = enough(index, x, lists, sizes, least)
                row = np.repeat(np.arange(b.num_rows), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), *(b.column(k).take(pa.array(row)) for k in (0, 1))], ["list", "vec_id", "v"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"list int, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<double>")


def search(df: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each usable vector
    for which ``is_query`` (over vec_id) holds, among all other vectors."""
    vectors = stage(usable(df, id, vector), "vectors")
    kept = stage(first_copies(vectors, k + 1), "kept")
    index = fit(kept)
    lists = stage(placed(kept, index, False, COPY_RATIO, COPIES), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in lists.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    asked = stage(vectors.where(is_query).groupBy("v").agg(F.min("vec_id").alias("vec_id")), "asked")
    # a vector is in COPIES lists at most, so this many entries hold k other vectors
    queries = stage(placed(asked, index, True, probe_ratio, None, sizes, (k + 1) * COPIES), "queries")
    size = lambda d, name: d.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = stage(size(lists, "vb").join(size(queries, "qb"), "list"), "blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", "list"), F.col(own)).cast("int")
        return rows.join(blocks, "list").select("list", mine.alias(f"{own}_at"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"), "vec_id", "v")

    kind = vectors.schema["vec_id"].dataType.simpleString()
    key = ["list", "vb_at", "qb_at"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            q, x = (matrix(t.column("v").combine_chunks()) for t in (left, right))
            of, ids = (t.column("vec_id").to_numpy() for t in (left, right))
            for a in range(0, len(q), 256):
                near = q[a : a + 256] @ x.T
                worst = np.partition(near, -k - 1, axis=1)[:, -k - 1] if near.shape[1] > k + 1 else np.full(len(near), -np.inf)
                for i, (row, least) in enumerate(zip(near, worst, strict=True)):
                    hit = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & np.isfinite(row)) if np.isfinite(least) else np.flatnonzero(np.isfinite(row))
                    score = (x[hit] * q[a + i]).sum(axis=1)
                    best = np.lexsort((ids[hit], -score))[: k + 1]
                    out.append((np.full(len(best), of[a + i]), ids[hit][best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    pairs = dealt(queries, "qb", "vb").groupBy(*key).cogroup(dealt(lists, "vb", "qb").groupBy(*key)).applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = pairs.distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k + 1)
    near = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    same = vectors.where(is_query).join(asked.withColumnRenamed("vec_id", "query_id"), "v").select("vec_id", "query_id")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("own")), 1, k)
    out = same.withColumnRenamed("vec_id", "own").join(near, "query_id").select(F.col("own").alias("query_id"), F.posexplode(others).alias("at", "found"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "found.vec_id", "found.score")
