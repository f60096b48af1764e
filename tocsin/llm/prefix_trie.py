"""The prefix trie of conversations, by hashes of fixed-length blocks of turns.

A turn is known by the digest of its role and text, a sequence of turns by the
exclusive or of two 64-bit hashes of each turn with its place.  So a prefix's hash is
a running sum that may be taken in parts.  Blocks of ``BLOCK`` turns are hashed first and
conversations grouped by the hash up to each block's end.  A group goes on as one
representative, its least conversation, and its number of members.  Where a prefix is
continued by one group only, that block's turn boundaries are the representative's;
only where several groups diverge are the boundaries inside that block compared turn
by turn, and only among the representatives.

The nodes whose least member is one conversation lie on one path, a chain.  Chains
hang on nodes of other chains, so sums over subtrees are taken over chains, by pointer
doubling, and then along each chain.  Neither needs a round for each level.

No conversation, prefix or group of equal conversations is gathered: turns are
numbered by ranges of the sorted table, running values are taken in cells, with one
row a cell beyond them, and lists of ids are hashed as a stream of joined parts.

Order is by turn, null first, then by the digest; null role or text is empty.  Rows
without a conversation id take no part.  Repeated rows are turns of their own.  An
empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Turns of a block; blocks, and nodes of a chain, of a cell of a running value.
BLOCK, CELL = 8, 512
#: Ids that are joined into one part of a list.
IDS = 1_000
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, at, digest, chars`` in order of ``at`` within each part of a
    conversation; and ``conv_id, part, first, before, n``: where each part begins, how
    many turns come before it, and all turns of the conversation."""
    role, text = F.coalesce(df[role], F.lit("")), F.coalesce(df[text], F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    src = df.select(df[conv].alias("conv_id"), df[turn].alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    put = src.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stage(put.select("conv_id", F.shiftright("at", 33).alias("part"), "at", "digest", "chars"), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")  # a row for each part of the sorted table that holds the conversation
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(*BEFORE)), F.lit(0))
    return rows, stage(parts.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(whole).alias("n")), "parts")


def conversations(df: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, digest, chars`` of each turn, and ``conv_id, length``."""
    rows, parts = turns(df, **names)
    placed = rows.join(parts, ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    return placed.select("conv_id", "pos", "digest", "chars"), parts.where("before = 0").select("conv_id", F.col("n").alias("length"))


def with_shared_heads(df: DataFrame, base: Column, heads: Column, most: int, **names: str) -> tuple[DataFrame, DataFrame]:
    """As ``conversations``, but each conversation has the first ``heads`` turns (at most
    ``most``) of conversation ``base`` in place of its own first ``heads``; both are
    expressions over conv_id.  None are put in where ``base`` is absent."""
    rows, parts = turns(df, **names)
    known = parts.where("before = 0").select("conv_id", "n", base.alias("base"), F.least(heads, F.lit(most)).cast("long").alias("heads"))
    shared = known.join(known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    known = stage(shared.withColumn("put", F.least("heads", F.coalesce("base_n", F.lit(0)))).select("conv_id", "n", "base", "heads", "put"), "heads")
    placed = rows.join(parts.drop("n").join(known, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    own = placed.where("pos > heads").select("conv_id", (F.col("pos") - F.col("heads") + F.col("put")).alias("pos"), "digest", "chars")
    head = placed.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = known.join(head, "base").where("pos <= put").select(known["conv_id"], "pos", "digest", "chars")
    length = F.col("put") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))
    return own.unionByName(taken), known.select("conv_id", length.alias("length"))


def chained(rows: DataFrame) -> DataFrame:
    """``conv_id, blk, p1, p2, a1, a2`` of each block: the hashes of all turns before it and up to its end."""
    own = rows.groupBy("conv_id", "blk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    own = stage(own.withColumn("cell", F.expr(f"blk div {CELL}")), "blocks")
    cells = own.groupBy("conv_id", "cell").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    over = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(*BEFORE)
    cells = cells.select("conv_id", "cell", *(F.coalesce(F.bit_xor(f"x{k}").over(over), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    inner = Window.partitionBy("conv_id", "cell").orderBy("blk").rowsBetween(*SO_FAR)
    after = {f"a{k}": xor(F.bit_xor(f"x{k}").over(inner), F.col(f"c{k}")) for k in (1, 2)}
    out = own.join(cells, ["conv_id", "cell"]).withColumns(after)
    return stage(out.select("conv_id", "blk", *(xor(F.col(f"a{k}"), F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)), "a1", "a2"), "chained")


def nodes(rows: DataFrame, blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, depth, h1, h2, u1, u2, n_convs, chars`` of each node: its least member,
    its own hash and its parent's, members, and characters of its last text."""
    groups = stage(blocks.groupBy("blk", "a1", "a2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "groups")
    beside = groups.groupBy("blk", "p1", "p2").agg(F.count("*").alias("siblings"))
    few = groups.select("blk", "p1", "p2", "conv_id", "n_convs").join(beside, ["blk", "p1", "p2"])
    over = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(*SO_FAR)
    inside = rows.join(few, ["conv_id", "blk"]).withColumns({f"h{k}": xor(F.bit_xor(f"x{k}").over(over), F.col(f"p{k}")) for k in (1, 2)})
    inside = inside.select("conv_id", F.col("pos").alias("depth"), "h1", "h2", xor(F.col("h1"), F.col("x1")).alias("u1"), xor(F.col("h2"), F.col("x2")).alias("u2"), "n_convs", "chars", "siblings")
    inside = stage(inside, "inside")
    alone = inside.where("siblings = 1").drop("siblings")
    least = [F.min("conv_id").alias("conv_id"), F.max("u1").alias("u1"), F.max("u2").alias("u2"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars")]
    split = inside.where("siblings > 1").groupBy("depth", "h1", "h2").agg(*least)
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("u1"), zero.alias("u2"), "n_convs", zero.alias("chars"))
    return stage(alone.unionByName(split).unionByName(root), "nodes")


def joined_hash(members: DataFrame, key: list[str], member: str) -> DataFrame:
    """``key`` and ``ends_sha256``: SHA-256 of each key's members, ascending, joined by
    commas.  First parts of bounded length are joined where ranges of the sorted rows
    lie, then a key's parts pass its hash one after the other."""
    src = members.select(*key, F.col(member).alias("member"))
    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in key)
    kind, names = src.schema["member"].dataType.simpleString(), [*key, "first", "ids"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, out = list(zip(*(b.column(k).to_pylist() for k in range(len(key))), strict=True)), b.column(len(key)).to_pylist(), []
            for k, i in zip(keys, ids, strict=True):
                if out and out[-1][0] == k and len(out[-1][1]) < IDS:
                    out[-1][1].append(i)
                else:
                    out.append((k, [i]))
            cols = [list(c) for c in zip(*((*k, own[0], ",".join(map(str, own))) for k, own in out), strict=True)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, [*(f.type for f in b.schema), pa.string()], strict=True)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, types = None, hashlib.sha256(), []

        def rows(done: list) -> pa.RecordBatch:
            cols = [list(c) for c in zip(*((*k, h) for k, h in done), strict=True)] or [[] for _ in range(len(key) + 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, pa.string()], strict=True)], [*key, "ends_sha256"])

        for b in batches:
            types, done = [f.type for f in b.schema][: len(key)], []
            for *k, _, ids in zip(*(b.column(c).to_pylist() for c in range(len(names))), strict=True):
                if k != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield rows(done)
        if now is not None:
            yield rows([(now, sha.hexdigest())])

    order = [*key, "member"]
    some = src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(parts, f"{kinds}, first {kind}, ids string")
    return some.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def chains_of(found: DataFrame) -> DataFrame:
    """``conv_id, start, last, saved, parent, attach``: each chain's first and last depth, its
    own saved tokens, and the chain and depth that it hangs on."""
    per = found.groupBy("conv_id").agg(F.min(F.struct("depth", "u1", "u2")).alias("top"), F.max("depth").alias("last"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    per = per.select("conv_id", F.col("top.depth").alias("start"), "last", "saved", (F.col("top.depth") - 1).alias("attach"), F.col("top.u1").alias("h1"), F.col("top.u2").alias("h2"))
    above = found.select(F.col("conv_id").alias("parent"), F.col("depth").alias("attach"), "h1", "h2")
    return stage(per.join(above, ["attach", "h1", "h2"], "left").drop("h1", "h2"), "chains")


def totals(chains: DataFrame) -> DataFrame:
    """``conv_id, leaves, saved``: of each chain with all that hangs on it."""
    ends = chains.where("parent is not null").select(F.col("parent").alias("conv_id"), F.col("attach").alias("last")).distinct().withColumn("goes_on", F.lit(0).cast("long"))
    now = chains.join(ends, ["conv_id", "last"], "left")
    now = stage(now.select("conv_id", F.coalesce("goes_on", F.lit(1).cast("long")).alias("leaves"), "saved", F.col("parent").alias("up")), "totals")
    while now.where("up is not null").limit(1).count():  # each round doubles how far below a chain is summed
        add = now.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "conv_id")
        jump = now.select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        now = stage(now.join(add, "conv_id", "left").join(jump, "up", "left").select("conv_id", *sums, F.col("further").alias("up")), "totals")
    return now.drop("up")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the conversations' prefix trie, from ``conv_id, pos, digest,
    chars`` of each turn and ``conv_id, length`` of each conversation (0: turnless):
    ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    hashed = rows.withColumns({"blk": F.expr(f"(pos - 1) div {BLOCK}"), "x1": F.xxhash64("pos", "digest"), "x2": F.xxhash64("digest", "pos", F.lit("x"))})
    rows, lengths = stage(hashed.drop("digest"), "hashed"), stage(lengths, "lengths")
    blocks = chained(rows)
    found = nodes(rows, blocks, lengths)
    ends = lengths.join(blocks.groupBy("conv_id").agg(F.max(F.struct("blk", "a1", "a2")).alias("end")), "conv_id", "left")
    ends = ends.select("conv_id", F.col("length").alias("depth"), *(F.coalesce(f"end.a{k}", F.lit(0)).alias(f"h{k}") for k in (1, 2)))
    lists = joined_hash(ends, ["depth", "h1", "h2"], "conv_id")
    chains = chains_of(found)
    hung = chains.where("parent is not null").select("conv_id", "parent", "attach").join(totals(chains), "conv_id")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), F.col("attach").alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("kid_leaves"), F.sum("saved").alias("kid_saved"))
    out = found.join(lists, ["depth", "h1", "h2"], "left").select("conv_id", "depth", "n_convs", "chars", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    out = out.join(hung, ["conv_id", "depth"], "left").join(chains.drop("saved"), "conv_id")
    at_end = F.when((F.col("depth") == F.col("last")) & F.col("kids").isNull(), 1).otherwise(0)
    out = out.withColumns({
        "n_children": F.coalesce("kids", F.lit(0)) + F.when(F.col("depth") < F.col("last"), 1).otherwise(0),
        "leaves": F.coalesce("kid_leaves", F.lit(0)) + at_end,
        "saved": F.coalesce("kid_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars"),
        "parent_conv_id": F.when(F.col("depth") > F.col("start"), F.col("conv_id")).otherwise(F.col("parent")),
        "cell": F.expr(f"depth div {CELL}"),
    })
    out = stage(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved", "ends_sha256", "cell"), "on-chains")
    cells = out.groupBy("conv_id", "cell").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    over = Window.partitionBy("conv_id").orderBy(F.desc("cell")).rowsBetween(*BEFORE)
    cells = cells.select("conv_id", "cell", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"below_{c}") for c in ("leaves", "saved")))
    inner = Window.partitionBy("conv_id", "cell").orderBy(F.desc("depth")).rowsBetween(*SO_FAR)
    sums = [(F.sum(c).over(inner) + F.col(f"below_{c}")).alias(n) for c, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    return out.join(cells, ["conv_id", "cell"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, "ends_sha256")
