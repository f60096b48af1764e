"""The prefix trie beside one built node by node in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tocsin.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, pos int, digest int, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Each conversation's (role, text) in order of turn."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in own.items()}


def with_heads(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return out


def brute(own):
    members = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node in members:
        for d in range(len(node) + 1):
            top = node[:d]
            leaves[top] = leaves.get(top, 0) + (node not in kids)
            saved[top] = saved.get(top, 0) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = set()
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(own[c]) == len(node))))
        out.add((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table():
    rng = random.Random(3)
    rows = []

    def put(c, texts, first=0):
        rows.extend((c, first + k, "user" if k % 2 else "assistant", x) for k, x in enumerate(texts))

    for c in range(0, 260):
        put(c, [f"t{rng.randrange(3)}é😀" for _ in range(rng.randint(1, 9))])
    for c in range(400, 440):  # logs that grow by one turn, each a prefix of the next
        put(c, [f"turn {k}" for k in range(c - 399)])
    for c in range(500, 560):  # equal conversations
        put(c, ["same"] * 17)
    for c in range(600, 630):  # siblings that part at and inside borders of blocks
        put(c, [f"x{k}" for k in range(c - 600)] + ["y"] * 8)
    put(700, [str(k) for k in range(150)])
    put(701, [str(k) for k in range(140)] + ["other"])
    rows.extend([(-150, None, None, "first"), (-150, 0, "user", None), (-150, 1, "", ""), (-100, 5, "user", "b"), (-100, 5, "user", "b"), (-100, 5, "user", "a"), (None, 1, "user", "lost"), (903, 0, "user", "alone")])
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def found(df):
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("block", "cell", "ids"), [(8, 512, 1_000), (3, 4, 7)])
def test_nodes_beside_brute_force(spark, monkeypatch, block, cell, ids):
    for name, n in (("BLOCK", block), ("CELL", cell), ("IDS", ids)):
        monkeypatch.setattr(pt, name, n)
    rows = table()
    assert found(pt.trie(*pt.conversations(frame(spark, rows)))) == brute(sequences(rows))


def test_rebuilt_conversations(spark):
    rows, c = table(), F.col("conv_id")
    want = with_heads(sequences(rows))
    assert min(map(len, want.values())) == 0  # a turnless one
    assert found(pt.trie(*pt.with_shared_heads(frame(spark, rows), c - c % 100, F.crc32(c.cast("string")) % 6, 5))) == brute(want)


def test_empty_table(spark):
    df = frame(spark, [])
    assert pt.trie(*pt.conversations(df)).count() == 0
    assert pt.trie(*pt.with_shared_heads(df, F.col("conv_id"), F.lit(2), 2)).count() == 0
    assert pt.trie(*pt.conversations(frame(spark, [(None, 0, "user", "x")]))).count() == 0


def test_other_names(spark):
    df = spark.createDataFrame([("a", 1, "u", "x", 0), ("b", 1, "u", "x", 0), ("b", 2, "u", "y", 0)], "talk string, nr int, who string, said string, conv_id int")
    got = found(pt.trie(*pt.conversations(df, conv="talk", turn="nr", role="who", text="said")))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {("a", 0, None, 2, 1, 1, 1, sha("")), ("a", 1, "a", 2, 1, 1, 1, sha("a")), ("b", 2, "a", 1, 0, 1, 0, sha("b"))}


def test_of_the_table_beside_sql(spark):
    from harness import compare, duck
    from tocsin.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert compare("op11_prefix_trie", QUERIES["op11_prefix_trie"](spark, sf), duck(sf), ORACLES["op11_prefix_trie"]) == ""
