"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens; a node holds the code
points and the tokens below it.  An edit is found by descending over code
points.  Only pre-tokens it touches, with the context that the pre-token pattern
looks at beside them, are read again, until a new boundary falls on an old one;
from there on the text and so its pre-tokens are as before.  The new pre-tokens
go to the first touched leaf, the others become empty, and the sums above them
are renewed.  Counts equal those of tokenizing the edited text anew.  The string of
an added token is a pre-token, also where an edit makes it or breaks it up.

Null and empty texts have an empty tree and no tokens.  Edits apply in order;
positions are code points of the text as left by the edits before, those outside
it are moved to its end.  Null edits and null fields of one count as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .byte_bpe import PATTERN, ByteBpe, ChunkCache, model
from .common import int_lists, narrow, slices

PRE_TOKEN = regex.compile(PATTERN)
#: Code points before a change that the pattern may have looked across from an earlier pre-token.
CONTEXT = 2
LEAVES: dict[tuple[str, bool], ChunkCache] = {}


def pre_tokens(text: str, at: int, mark: re.Pattern | None) -> Iterator:
    """Matches of the pre-tokens from ``at`` on, of added tokens too."""
    for m in mark.finditer(text, at) if mark else ():
        yield from PRE_TOKEN.finditer(text, at, m.start())
        yield m
        at = m.end()
    yield from PRE_TOKEN.finditer(text, at)


class Tree:
    """Sums of code points and tokens over leaves in text order."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(chars), 1] = tokens
        half = self.size
        while half > 1:
            half //= 2
            self.sums[half : 2 * half] = self.sums[2 * half : 4 * half : 2] + self.sums[2 * half + 1 : 4 * half : 2]

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at``, and where it begins."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if at >= start + left:
                start += left
                node += 1
        return node, start

    def put(self, node: int, last: int, chars: int, tokens: int) -> None:
        """A leaf's new sums; those after it and before ``last`` become empty."""
        self.sums[node:last] = 0
        self.sums[node] = chars, tokens
        low, high = node, last - 1
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2 : 2] + self.sums[2 * low + 1 : 2 * high + 2 : 2]

    def edit(self, text: str, start: int, deleted: int, inserted: str, bpe: ByteBpe) -> tuple[str, int]:
        """The new text, and how many pre-tokens were read again."""
        start = min(max(0, start), len(text))
        end = min(len(text), start + max(0, deleted))
        new = text[:start] + inserted + text[end:]
        shift, touched = len(new) - len(text), start + len(inserted)
        begins = start
        if bpe.mark:  # an added token across the start changes what it begins with
            near = max(0, start - bpe.longest)
            begins = min([start, *(m.start() for t in (text, new) for m in bpe.mark.finditer(t, near, start + bpe.longest))])
        first, at = self.leaf(max(0, begins - CONTEXT)) if text else (self.size, 0)
        found, old_end, stop = [], len(text), None
        for m in pre_tokens(new, at, bpe.mark):
            found.append(m[0])
            old = m.end() - shift
            if m.end() >= touched and end <= old < len(text):
                stop, edge = self.leaf(old)
                if edge == old and stop > first:  # the first leaf takes the new pre-tokens
                    old_end = old
                    break
        last = stop if stop is not None and old_end < len(text) else 2 * self.size
        self.put(first, last, old_end + shift - at, sum(bpe.count(found)))
        return new, len(found)


def leaves(path: str, added: bool = False) -> ChunkCache:
    """For chunks of text: the code points and the tokens of their pre-tokens."""
    if (path, added) not in LEAVES:
        bpe = model(path, added)

        def compute(new: list[str]) -> list[tuple[bytes, bytes]]:
            parts = list(map(PRE_TOKEN.findall, new))
            found = list(chain.from_iterable(parts))
            chars, tokens = np.array(list(map(len, found)), "<i4").tobytes(), np.array(bpe.count(found), "<i4").tobytes()
            ends = [0, *(4 * np.cumsum(list(map(len, parts)))).tolist()]
            return [(chars[a:b], tokens[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

        LEAVES[path, added] = ChunkCache(compute, (b"", b""), bpe.mark, {t: (np.array([len(t)], "<i4").tobytes(), np.array([1], "<i4").tobytes()) for t in bpe.added})
    return LEAVES[path, added]


def grow(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_tokens, leaf_chars, leaf_tokens``: each document's tree by its leaves."""
    src = narrow(df, id, text)
    ints = ArrayType(IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = leaves(vocabulary, added=True)
        for whole in batches:
            for b in slices(whole):
                parts = cache(b.column(1).to_pylist())
                chars, tokens = [b"".join([c for c, _ in p]) for p in parts], [b"".join([t for _, t in p]) for p in parts]
                n = pa.array([int(np.frombuffer(t, "<i4").sum(dtype=np.int64)) for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, int_lists(chars), int_lists(tokens)], ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("n_tokens", LongType()), StructField("leaf_chars", ints), StructField("leaf_tokens", ints)]))


def recount(trees: DataFrame, vocabulary: str, edits: str = "edits", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_tokens, n_read, leaf_chars, leaf_tokens`` after the edits in
    column ``edits`` (array of struct<start, deleted, inserted>) of what ``grow``
    returned, and the columns ``keep`` as they were.  ``n_read``: pre-tokens that
    were read again."""
    src = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", trees[edits].alias("edits"), *keep)
    ints = ArrayType(IntegerType())
    names = ["doc_id", "text", "n_tokens", "n_read", "leaf_chars", "leaf_tokens", *keep]

    def flat(column: pa.ListArray) -> list[np.ndarray]:
        values, ends = column.flatten().to_numpy(), np.cumsum([0, *(x or 0 for x in pa.compute.list_value_length(column).to_pylist())])
        return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary, added=True)
        for whole in batches:
            for b in slices(whole):
                rows = []
                for text, chars, tokens, changes in zip(b.column(1).to_pylist(), flat(b.column(2)), flat(b.column(3)), b.column(4).to_pylist(), strict=True):
                    tree, text, read = Tree(chars, tokens), text or "", 0
                    for c in changes or []:
                        if c:
                            text, n = tree.edit(text, c["start"] or 0, c["deleted"] or 0, c["inserted"] or "", bpe)
                            read += n
                    left = tree.sums[tree.size :]
                    left = left[left.any(axis=1)].astype("<i4")
                    rows.append((text, int(tree.sums[1, 1]), read, left[:, 0].tobytes(), left[:, 1].tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), int_lists(cols[3]), int_lists(cols[4]), *(b.column(5 + k) for k in range(len(keep)))], names)

    types = [src.schema["doc_id"].dataType, StringType(), LongType(), LongType(), ints, ints, *(src.schema[c].dataType for c in keep)]
    return src.mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, types, strict=True)]))
