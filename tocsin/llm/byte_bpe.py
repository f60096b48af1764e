"""Byte-level BPE of whole texts, by way of pieces of text that encode alone.

The pre-tokens of a byte-level pattern begin at a blank unless blanks meet, so a
text falls into chunks at its single blanks and each chunk encodes as it does in
the text.  Chunks repeat; what is computed for one is kept in a bounded cache.
Texts in which white space meets a blank are cut only at the other blanks.

Strings of added tokens (``<|endoftext|>``) are one token each where a model has
them; the texts between them encode alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, CACHED_LENGTH = 400_000, 48
#: A blank between two white-space characters is no place to cut.
MEETS = re.compile(r"\s \s")
CUT = re.compile(r"(?<!\s) | (?!\s)")


def chunks(text: str) -> list[str]:
    """Consecutive parts of a text whose pre-tokens are those of the text."""
    if not MEETS.search(text) and not (text.startswith(" ") and text[1:2].isspace()) and not (text.endswith(" ") and text[-2:-1].isspace()):
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]
    edges = [m.start() for m in CUT.finditer(text) if m.start()]
    return [text[a:b] for a, b in zip([0, *edges], [*edges, len(text)], strict=True)]


class ChunkCache:
    """``compute`` gets the distinct new chunks of a batch and gives a value for each.

    Words after a blank are looked up without the blank.  Only words without white
    space at their edges are kept there, so a text whose words are all found has
    no blank that meets other white space.

    ``added`` has the values of strings that ``mark`` finds: they are chunks of their
    own, and texts end before and begin behind them."""

    def __init__(self, compute: Callable[[list[str]], list], empty, mark: re.Pattern | None = None, added: dict | None = None):
        self.compute, self.kept, self.bare, self.empty, self.mark, self.added = compute, {}, {}, empty, mark, added

    def __call__(self, texts: list[str | None]) -> list[list]:
        """Values of the chunks of each text, in order."""
        if not self.mark or not any(t and self.mark.search(t) for t in texts):
            return self.plain(texts)
        parts = [self.mark.split(t or "") for t in texts]  # every other one is an added token
        found = iter(self.plain([p for ps in parts for p in ps[::2]]))
        return [[v for k, p in enumerate(ps) for v in ([self.added[p]] if k % 2 else next(found))] for ps in parts]

    def plain(self, texts: list[str | None]) -> list[list]:
        kept, bare = self.kept, self.bare
        if len(kept) + len(bare) > CACHE:
            kept.clear()
            bare.clear()
        out, late, new = [], [], {}
        for k, t in enumerate(texts):
            words = (t or "").split(" ")
            first, words[0] = words[0], ""
            found = list(map(kept.get, words))
            found[0] = bare.get(first) if first else self.empty
            if None in found:
                new_words = [w for w, v in zip(words[1:], found[1:], strict=True) if v is None]
                if all(new_words) and list(map(str.strip, new_words)) == new_words:
                    new |= {" " + w: 1 for w in new_words}
                    if found[0] is None:
                        new[first] = 1
                    late.append((k, first, words, found))
                else:
                    parts = chunks(t)
                    new |= {p: 1 for p in parts if p not in bare}
                    late.append((k, None, parts, None))
            out.append(found)
        fresh = dict(zip(new, self.compute(list(new)), strict=True)) if new else {}
        for k, first, parts, found in late:
            if found is None:
                out[k] = [fresh[p] if p in fresh else bare[p] for p in parts]
            else:
                out[k] = [fresh[" " + w] if v is None else v for w, v in zip(parts, found, strict=True)] if found[0] is not None else [fresh[first], *(fresh[" " + w] if v is None else v for w, v in zip(parts[1:], found[1:], strict=True))]
        for c, v in fresh.items():
            if len(c) <= CACHED_LENGTH:
                w = c[1:]
                if c[0] == " " and w and w.strip() == w:
                    kept[w] = v
                else:
                    bare[c] = v
        return out


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones
    for themselves, the others for those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """The ids that ``tokenizers`` gives with the vocabulary file at ``path``; strings of
    added tokens are those tokens if ``added``, else ordinary text.  Single chunks are
    merged by ``tiktoken`` under ranks read from that file, which takes half the time."""

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocabulary = spec["pre_tokenizer"], spec["model"]["vocab"]
        if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without a blank in front is needed")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("merges must have their ids in order")
        own = byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if added and any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be found wherever their strings are")
        if added and any(a[k:] == b[: len(a) - k] or b in a[k:] for a in special for b in special for k in range(1, len(a))):
            raise ValueError("strings of added tokens must not overlap")
        ranks = {bytes(own[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.one = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = special if added else {}
        self.mark = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.longest = max(map(len, self.added), default=0)
        self.ids = ChunkCache(lambda new: [np.array(self.one(x), "<u4").tobytes() for x in new], b"", self.mark, {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()})
        self.counts: dict[str, int] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(x) for x in self.ids(texts)]

    def count(self, pre_tokens: list[str]) -> list[int]:
        """Number of ids of each pre-token."""
        if len(self.counts) > CACHE:
            self.counts.clear()
        new = [p for p in dict.fromkeys(pre_tokens) if p not in self.counts]
        if new:
            self.counts.update((p, 1 if p in self.added else len(self.one(p))) for p in new)
        return [self.counts[p] for p in pre_tokens]


MODELS: dict[tuple[str, bool], ByteBpe] = {}


def model(path: str, added: bool = False) -> ByteBpe:
    if (path, added) not in MODELS:
        MODELS[path, added] = ByteBpe(path, added)
    return MODELS[path, added]
