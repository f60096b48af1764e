"""Encoding and decoding with a merge-type piece vocabulary.

``encode`` keeps, for each prefix of a segment, the one last piece that the
prefix's encoding can have.  An automaton lists the pieces that end at a
position; the piece that is compatible with the last piece of the prefix before
it is the one.  Two pieces are compatible if merging their joined text gives
just the two.  Ids are then read backwards along the last pieces, so time is
linear in the text, however long it is without a blank.

A text is cut into segments only where no piece of the vocabulary holds the two
neighbouring characters, so cuts change nothing; segments repeat a lot and are
kept in a bounded cache.  Null and empty texts have no ids.  Rows may repeat; each
is encoded by itself.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import int_lists, narrow, slices

SPACE = "▁"
#: Segments kept in a worker, in each of two generations, and the longest one that is kept.
CACHE, CACHED_LENGTH = 300_000, 48
#: Pairs of pieces whose compatibility is kept.
PAIRS = 1_000_000
#: Ids whose bytes are gathered in one step.
GATHERED = 1 << 18
PROBE = "ﬁÅÅ①Ａ  　x \ty "

codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class PieceTable:
    """The vocabulary of one model file, its automaton and the cache."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        if sp.normalize(PROBE) != (SPACE + PROBE).replace(" ", SPACE):
            raise ValueError("only models that change nothing but blanks are supported")
        self.bytes_of, self.byte_id, self.piece, self.score, self.id_of = [b""] * n, [0] * 256, [""] * n, [0.0] * n, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.piece[i], self.score[i], self.id_of[piece] = piece, sp.get_score(i), i
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        #: each id's bytes in a row of equal width, and which of them count
        self.width = np.array([len(b) for b in self.bytes_of])
        self.padded = np.array(self.bytes_of, f"S{max(1, self.width.max())}").view(np.uint8).reshape(n, -1)
        self.counts = np.arange(self.padded.shape[1]) < self.width[:, None]
        self.spaced = np.array([p.startswith(SPACE) for p in self.piece])
        if not all(c in self.id_of for p in self.id_of for c in p):
            raise ValueError("each character of a piece must be a piece")
        self.pairs = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.fit: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merged(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: blanks join nothing on their left but blanks, and line ends join nothing
        self.by_blank = not any("\n" in p or (p[1] == SPACE and p[0] != SPACE) for p in self.pairs) and "\n" not in self.id_of
        self.line = self.unknown("\n")
        self.kept: dict[str, dict[str, bytes]] = {"word": {}, "bare": {}}
        self.older: dict[str, dict[str, bytes]] = {"word": {}, "bare": {}}

    def merged(self, text: str) -> list[int]:
        """Ids of a short text by merging the best pair, leftmost first, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.id_of[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        got = self.fit.get(key)
        if got is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            x, y = self.piece[a], self.piece[b]
            got = self.fit[key] = x[-1] + y[0] not in self.pairs or (x + y not in self.id_of and self.merged(x + y) == [a, b])
        return got

    def unknown(self, char: str) -> bytes:
        return np.array([self.byte_id[b] for b in char.encode()], "<i4").tobytes()

    def segment(self, text: str) -> bytes:
        """Ids of a segment, as little-endian 32-bit integers."""
        last, size_of, fit = [-1] * len(text), [0] * len(text), self.fit
        for end, (i, size) in self.automaton.iter(text):
            if not size_of[end]:
                before = last[end - size] if end >= size else -1
                if before >= 0:
                    fits = fit.get(before << 24 | i)
                    if fits is None:
                        fits = self.compatible(before, i)
                    if not fits:
                        continue
                last[end], size_of[end] = i, size
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            if last[at] < 0:
                ids.extend(self.byte_id[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                ids.append(last[at])
                at -= size_of[at]
        ids.reverse()
        return struct.pack(f"<{len(ids)}i", *ids)

    def cached(self, kind: str, key: str, text: str) -> bytes:
        """Ids of a segment: of the newer generation of kept ones, the older, or found anew."""
        newer = self.kept[kind]
        got = newer.get(key)
        if got is None:
            got = self.older[kind].get(key)
            if got is None:
                got = self.segment(text)
            if len(key) <= CACHED_LENGTH:
                if len(newer) >= CACHE:
                    self.older[kind], self.kept[kind] = newer, {}
                self.kept[kind][key] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = " " + text.replace(SPACE, " ")
        if not self.by_blank:
            return self.segment(text.replace(" ", SPACE))
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line)
            words = line.split(" ")
            if "" in words[1:]:  # runs of blanks go with the word after them
                out += [self.cached("bare", s, s) for s in re.findall(r"▁*[^▁]+|▁+", line.replace(" ", SPACE))]
                continue
            if words[0]:
                out.append(self.cached("bare", words[0], words[0]))
            del words[0]
            ids = list(map(self.kept["word"].get, words))
            if None in ids:
                ids = [x if x is not None else self.cached("word", w, SPACE + w) for x, w in zip(ids, words, strict=True)]
            out += ids
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.texts(pa.array([ids], pa.list_(pa.int32())))[0]

    def texts(self, ids: pa.ListArray) -> list[str]:
        """The text of each row's ids, without the blank that encoding puts in front; null rows have none."""
        length = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        parts = [flat[k : k + GATHERED] for k in range(0, len(flat), GATHERED)]
        data = b"".join([self.padded[p][self.counts[p]].tobytes() for p in parts])
        place = np.concatenate([[0], np.cumsum(self.width[flat])])
        first = np.concatenate([[0], np.cumsum(length)])
        out = []
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            begin, end = int(place[a]), int(place[b])
            if end > begin:  # the id that gives the first byte
                begin += bool(self.spaced[flat[np.searchsorted(place, begin, "right") - 1]])
            out.append(data[begin:end].decode("utf-8", "one_byte"))
        return out


TABLES: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    if path not in TABLES:
        TABLES[path] = PieceTable(path)
    return TABLES[path]


def encode(df: DataFrame, model: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, without begin and end ids; with
    ``decoded`` also the text of the ids, made in the same pass."""
    src = narrow(df, id, text)
    more = [StructField("decoded", StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for whole in batches:
            for b in slices(whole):
                ids = int_lists([t.encode(x) for x in b.column(1).to_pylist()])
                texts = [pa.array(t.texts(ids), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0), ids, *texts], ["doc_id", "ids", *(f.name for f in more)])

    return src.mapInArrow(run, StructType([src.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), *more]))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and its ids' text in a column ``out``; null ids are taken as none."""
    at = df.columns.index(ids)
    fields = [f for f in df.schema.fields if f.name != out]
    keep = [df.columns.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for whole in batches:
            for b in slices(whole, at, GATHERED):
                texts = pa.array(t.texts(b.column(at)), pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), texts], [*(f.name for f in fields), out])

    return df.mapInArrow(run, StructType([*fields, StructField(out, StringType())]))
