"""Language identification by rank order of n-grams.

A profile lists the most frequent n-grams of one to three letters, words being
padded with a mark, from most to least frequent.  A document is compared with
each language's profile by how far its own n-grams are out of place there; an
n-gram that a profile lacks counts as far away as possible.  The score is one
minus the least distance as a share of the greatest possible.

Texts that are null or have no letter are ``und`` with score 0.  Ties of frequency
go by the n-gram, ties of distance by the language's name.  Without training rows
all documents are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import slices

PROFILE, ORDERS, MARK = 300, 3, "_"
#: Training documents of a language, and languages, at most.
TRAINING_ROWS, LANGUAGES = 1_000, 1_000
NONE = "und"


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Alphabet:
    """Numbers for the letters that occur in profiles; all other letters share one."""

    def __init__(self, letters: list[str]):
        self.base = len(letters) + 2
        self.table = is_letter() * np.uint16(len(letters) + 1)
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

    def numbers(self, text: str) -> np.ndarray:
        """Letters as numbers with one 0 before, between and after words."""
        s = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def ranked(self, text: str, most: int) -> np.ndarray:
        """Codes of the most frequent n-grams, in order."""
        s, k = self.numbers(text), self.base
        if len(s) < 3:
            return np.zeros(0, np.int64)
        two = s[:-1] * k + s[1:]
        three = (two[:-1] * k + s[2:])[s[1:-1] > 0]  # none across two words
        codes, n = np.unique(np.concatenate([s[s > 0], two + k, three + k + k * k]), return_counts=True)
        return codes[np.argsort(-n, kind="stable")[:most]]

    def code(self, gram: str, number: dict[str, int]) -> int:
        out = 0
        for c in gram:
            out = out * self.base + number[c]
        return out + (0, 0, self.base, self.base + self.base**2)[len(gram)]


@dataclass
class Profiles:
    """Each language's n-grams from most to least frequent; bounded by LANGUAGES * PROFILE."""

    grams: dict[str, list[str]]

    def ready(self) -> None:
        letters = sorted({c for g in self.grams.values() for x in g for c in x} - {MARK})
        number = {c: k + 1 for k, c in enumerate(letters)} | {MARK: 0}
        self.alphabet = Alphabet(letters)
        self.sorted = []
        for name in sorted(self.grams):
            codes = np.array([self.alphabet.code(g, number) for g in self.grams[name]], np.int64)
            order = np.argsort(codes)
            self.sorted.append((name, codes[order], order))

    def judge(self, text: str | None) -> tuple[str, float]:
        mine = self.alphabet.ranked(text, PROFILE) if text and self.grams else ()
        if not len(mine):
            return NONE, 0.0
        best = (2.0, NONE)
        for name, codes, rank in self.sorted:
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            far = np.where(codes[at] == mine, np.minimum(np.abs(rank[at] - np.arange(len(mine))), PROFILE), PROFILE)
            best = min(best, (float(far.sum()) / (PROFILE * len(mine)), name))
        return best[1], 1.0 - best[0]


def gram_counts(src: DataFrame) -> DataFrame:
    """``lang, gram, n``: n-gram counts of each partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        totals: dict[str, Counter] = {}
        for whole in batches:
            for b in slices(whole):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = Counter("".join(c if c.isalpha() else " " for c in text.lower()).split())
                    into = totals.setdefault(lang, Counter())
                    for w, n in words.items():
                        padded = MARK + w + MARK
                        for size in range(1, ORDERS + 1):
                            for k in range(len(padded) - size + 1):
                                g = padded[k : k + size]
                                if g != MARK:
                                    into[g] += n
        rows = [(lang, g, n) for lang, c in totals.items() for g, n in c.items()]
        for k in range(0, len(rows), 50_000):
            cols = list(zip(*rows[k : k + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "gram", "n"])

    return src.mapInArrow(run, "lang string, gram string, n long")


def train(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS) -> Profiles:
    """Profiles from ``labelled``; of each language about ``rows`` documents, all if
    there are fewer, picked by a hash of the id."""
    src = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].alias("text"), labelled[id].alias("doc_id")).where("lang is not null and text is not null")
    sizes = src.groupBy("lang").agg(F.count("*").alias("rows")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Profiles({})
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, rows / r["rows"]) * (1 << 20)))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < share[F.col("lang")]
    counts = gram_counts(src.where(chance).select("lang", "text")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(top)).where(F.col("place") <= PROFILE).collect()
    grams: dict[str, list[str]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["place"])):
        grams.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(grams)


def predict(df: DataFrame, profiles: Profiles, id: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` and, if given, a boolean ``held_out`` from ``keep``."""
    cols = [df[id].alias("doc_id"), df[text].alias("text")] + ([keep.alias("held_out")] if keep is not None else [])
    src = df.select(*cols)
    rest = src.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles.ready()
        for whole in batches:
            for b in slices(whole):
                found = [profiles.judge(t) for t in b.column(1).to_pylist()]
                said, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k + 2) for k in range(len(rest))), said, score], ["doc_id", *(f.name for f in rest), "lang_pred", "score"])

    return src.mapInArrow(run, StructType([src.schema["doc_id"], *(StructField(f.name, BooleanType()) for f in rest), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def keep_known(df: DataFrame, profiles: Profiles, least: float, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is in a language of the profiles with a score of at least ``least``."""
    at, types = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles.ready()
        for whole in batches:
            for b in slices(whole, at):
                yield b.filter(pa.array([profiles.judge(t)[1] >= least for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, types)
