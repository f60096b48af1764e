"""Pieces, byte-level ids, counts under edits and packing, beside the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tocsin.llm import byte_bpe, packing, pieces, token_counts

PIECES, BYTES = (public_tokenizers.path(f) for f in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
PARTS = ["a", "th", "ing", " ", "  ", "\n", " \n", "▁", "é", "漢", "😀", "\x00", "\t", "\xa0", "'s", " '", "'re", "12", "٣", "½", "<s>", "<|endoftext|>", "the", " the", "Ж", "\r\n"]
TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
ROWS = [(1, None), (2, ""), (3, " "), (4, "a b\n\nc  d"), (5, "x" * 5000), (5, "x" * 5000), (None, "the end"), (7, "ab " * 3000 + "é")]


@pytest.fixture(scope="module")
def sp():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


def frame(spark, rows=ROWS):
    # columns whose names clash with those that operators add
    return spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in rows], "doc_id long, text string, ids string, length string, n_tokens int, sequence_id string")


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_pieces_equal_library(text):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=PIECES) if "sp" not in CACHE else CACHE["sp"]
    CACHE["sp"] = own
    want = own.encode(text)
    got = np.frombuffer(pieces.table(PIECES).encode(text), "<i4").tolist()
    assert got == want
    assert pieces.table(PIECES).decode(got) == own.decode(got)


CACHE: dict = {}


def test_decode_any_ids(sp):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([1, 2, 3, 5, 13, 130, 200, 255, 259, 264, 300, 28705]) for _ in range(rng.randint(0, 8))]
        assert pieces.table(PIECES).decode(ids) == sp.decode(ids)


def test_long_text_without_blank(sp):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghi") for _ in range(50_000))
    assert np.frombuffer(pieces.table(PIECES).encode(text), "<i4").tolist() == sp.encode(text)


def test_encode_decode_frames(spark, sp):
    out = pieces.decode(pieces.encode(frame(spark), PIECES), PIECES).collect()
    want = sorted((i or 0, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t in ROWS)
    assert sorted((r["doc_id"] or 0, tuple(r["ids"]), r["decoded"]) for r in out) == want
    assert pieces.encode(frame(spark, []), PIECES).count() == 0


@settings(max_examples=600, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_byte_ids_equal_library(texts):
    if "hf" not in CACHE:
        from tokenizers import Tokenizer

        CACHE["hf"] = Tokenizer.from_file(BYTES)
        CACHE["hf"].encode_special_tokens = True
    got = [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.model(BYTES).encode(texts)]
    assert got == [CACHE["hf"].encode(t, add_special_tokens=False).ids for t in texts]
    assert all("".join(byte_bpe.chunks(t)) == t for t in texts if t)


@settings(max_examples=300, deadline=None)
@given(text=TEXT, edits=st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12), TEXT), max_size=4))
def test_counts_follow_edits(text, edits):
    bpe = byte_bpe.model(BYTES)
    [parts] = token_counts.leaves(BYTES)([text])
    tree = token_counts.Tree(np.frombuffer(b"".join(c for c, _ in parts), "<i4"), np.frombuffer(b"".join(t for _, t in parts), "<i4"))
    for start, deleted, inserted in edits:
        at = min(start, len(text))
        want = text[:at] + inserted + text[at + deleted :]
        text, _ = tree.edit(text, start, deleted, inserted, bpe)
        assert text == want
        assert tree.sums[1].tolist() == [len(text), len(bpe.one(text))]


def test_edits_read_little(spark, hf):
    docs = frame(spark).withColumn("edits", F.when(F.col("doc_id") != 2, F.expr("array(named_struct('start', 9L, 'deleted', 2L, 'inserted', ' new'), null, named_struct('start', 1L, 'deleted', null, 'inserted', null))")))
    trees = token_counts.grow(docs, BYTES)
    assert {(r["doc_id"], r["n_tokens"]) for r in trees.collect()} == {(i, len(hf.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS}
    edits = F.expr("array(named_struct('start', 9L, 'deleted', 2L, 'inserted', ' new'), null, named_struct('start', 1L, 'deleted', null, 'inserted', null))")
    out = token_counts.recount(trees.withColumn("edits", edits), BYTES).collect()
    want = {(i, (t or "")[:9] + " new" + (t or "")[11:]) for i, t in ROWS}
    assert {(r["doc_id"], r["text"]) for r in out} == want
    assert all(r["n_tokens"] == len(hf.encode(r["text"], add_special_tokens=False).ids) for r in out)
    assert max(r["n_read"] for r in out if r["doc_id"] == 7) < 20


@settings(max_examples=200, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_every_length_is_packed_once(counts):
    packs = packing.shortest_pack_first(counts, 64)
    assert all(0 < sum(k * n for k, n in p.items()) <= 64 for p, _ in packs)
    total: dict = {}
    for p, times in packs:
        for k, n in p.items():
            total[k] = total.get(k, 0) + n * times
    assert total == counts


def test_pack_documents(spark, hf):
    rng = random.Random(5)
    rows = ROWS + [(100 + k, "ab cd " * rng.randint(0, 900)) for k in range(200)] + [(1000 + k, "same text") for k in range(400)]
    out = packing.pack_documents(frame(spark, rows), BYTES).collect()
    want: list = []
    for i, t in rows:
        ids = np.array(hf.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i or 0, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == sorted(want)
    used: dict = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(2048 - sum(n for _, n in s) for s in used.values()) < 0.02 * 2048 * len(used)
    assert packing.pack_documents(frame(spark, []), BYTES).count() == 0


def test_kept_ids(spark):
    r = packing.cut(frame(spark, [(1, "a b c")]), BYTES, size=2, keep_ids=True).orderBy("start").collect()
    assert [len(x["ids"]) for x in r] == [2, 2]
    assert r[1]["ids"][-1] == 1


def test_registered(spark, sp):
    from tocsin.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, sf).collect()}
    for i, t in docs.items():
        ids = sp.encode(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    for r in QUERIES["op4_token_counts"](spark, sf).collect():
        x = docs[r["doc_id"]]
        n = len(x)
        y = x[: n // 2] + x[:20] + x[n // 2 + 40 :]
        y = y[: n // 3] + x[:20] + y[n // 3 :]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_sha256"]) == (len(t.encode(x).ids), len(t.encode(y).ids), sha(y))


MARKED = st.lists(st.sampled_from([*PARTS, "<|endoftext|>", "<|end", "oftext|>", "<", "|>", "!!"]), max_size=25).map("".join)


@settings(max_examples=600, deadline=None)
@given(texts=st.lists(MARKED, max_size=4))
def test_added_tokens_equal_library(texts):
    from tokenizers import Tokenizer

    t = CACHE.setdefault("added", Tokenizer.from_file(BYTES))
    got = [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.model(BYTES, added=True).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=600, deadline=None)
@given(text=MARKED, edits=st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12), MARKED), max_size=4))
def test_counts_follow_edits_of_added_tokens(text, edits):
    from tokenizers import Tokenizer

    t = CACHE.setdefault("added", Tokenizer.from_file(BYTES))
    bpe = byte_bpe.model(BYTES, added=True)
    [parts] = token_counts.leaves(BYTES, added=True)([text])
    tree = token_counts.Tree(np.frombuffer(b"".join(c for c, _ in parts), "<i4"), np.frombuffer(b"".join(n for _, n in parts), "<i4"))
    for start, deleted, inserted in edits:
        at = min(start, len(text))
        want = text[:at] + inserted + text[at + deleted :]
        text, _ = tree.edit(text, start, deleted, inserted, bpe)
        assert text == want
        assert tree.sums[1].tolist() == [len(text), len(t.encode(text, add_special_tokens=False).ids)]


def test_operators_read_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "a  <|endoftext|><|endoftext|>\n\n b"), (4, "a <|endof"), (5, None)]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    assert want[1] == [64, 220, 50256, 275, 1]
    got = {r["doc_id"]: r for r in packing.cut(frame(spark, rows), BYTES, keep_ids=True).collect()}
    for i, ids in want.items():
        assert got[i]["ids"] == ids
        assert (got[i]["length"], got[i]["doc_tokens"], got[i]["ids_crc32"]) == (len(ids), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    trees = token_counts.grow(frame(spark, rows), BYTES)
    assert {r["doc_id"]: r["n_tokens"] + 1 for r in trees.collect()} == {i: len(x) for i, x in want.items()}
    edits = F.expr("array(named_struct('start', 9L, 'deleted', 0L, 'inserted', 'text|>'), named_struct('start', 3L, 'deleted', 1L, 'inserted', ''))")
    for r in token_counts.recount(trees.withColumn("edits", edits), BYTES).collect():
        assert r["n_tokens"] == len(t.encode(r["text"], add_special_tokens=False).ids)


def test_new_chunks_are_counted_at_once(monkeypatch):
    calls: list = []

    def counted(self, pre_tokens, real=byte_bpe.ByteBpe.count):
        calls.append(len(pre_tokens))
        return real(self, pre_tokens)

    monkeypatch.setattr(byte_bpe.ByteBpe, "count", counted)
    monkeypatch.setattr(token_counts, "LEAVES", {})
    texts = [" ".join(f"Word{k}x{j}" for j in range(20)) for k in range(50)] + ["", "a  b\n c", "é 'll"]
    got = token_counts.leaves(BYTES)(texts)
    assert len(calls) == 1
    assert [sum(np.frombuffer(b"".join(n for _, n in p), "<i4").tolist()) for p in got] == [len(byte_bpe.model(BYTES).one(t)) for t in texts]
    assert [sum(np.frombuffer(b"".join(c for c, _ in p), "<i4").tolist()) for p in got] == list(map(len, texts))
