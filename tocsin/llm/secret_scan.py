"""Secrets in texts: fixed patterns, and strings that look random.

Two character models say how likely each character follows the one before, one
for random strings and one for ordinary identifiers; both are counted from
labelled samples.  A run of identifier characters is reported as ``random`` if
its log-likelihood ratio per step is high enough and no pattern has found it.

Null and empty texts have no spans.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, narrow, slices

#: The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
WORDS = (b"passw", b"secret", b"token", b"api")
#: Characters of the models, and of the runs they judge.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 16
#: Mean log-likelihood ratio per step from which a run counts as random.
RATIO_LEAST = 1.0
TRAINING_ROWS = 20_000
#: Steps that the single-character frequencies weigh as much as.
BACK_OFF = 20
N = len(SYMBOLS)


def class_table(chars: bytes) -> bytes:
    return bytes(1 if b in chars else 0 for b in range(256))


IS_HEX, IS_RUN = class_table(b"0123456789abcdef"), class_table(SYMBOLS.encode())
NUMBER = np.full(256, 255, np.uint8)
NUMBER[list(SYMBOLS.encode())] = np.arange(N)


def runs(data: bytes, table: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of a class of bytes with at least ``least`` of them."""
    marks = data.translate(table)
    wanted, at = b"\x01" * least, 0
    while (at := marks.find(wanted, at)) >= 0:
        end = marks.find(b"\x00", at)
        end = len(marks) if end < 0 else end
        yield at, end
        at = end


def base_spans(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, the secret) in bytes; each kind's matches by itself."""
    found = []
    low = data.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(data) if len(m[0]) >= ACCESS_LEAST]
    found += [(a, 2, b, data[a:b]) for a, b in runs(data, IS_HEX, HEX_LEAST)]
    return found


def free_runs(data: bytes, taken: list[tuple[int, int, int, bytes]], least: int) -> list[tuple[int, int]]:
    """Runs of identifier characters that no span of ``taken`` touches."""
    return [(a, b) for a, b in runs(data, IS_RUN, least) if not any(s < b and a < e for s, _, e, _ in taken)]


@dataclass
class Markov:
    """Log-likelihood ratio of each step, random against ordinary."""

    ratio: np.ndarray

    def score(self, token: bytes) -> float:
        s = NUMBER[np.frombuffer(token, np.uint8)]
        return float(self.ratio[s[:-1], s[1:]].mean())


def steps(labelled: DataFrame) -> DataFrame:
    """``label, a, b, n`` for the steps of ``labelled`` (token string, label 1 for random)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N, N), np.int64)
        for b in batches:
            for token, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = NUMBER[np.frombuffer((token or "").encode(), np.uint8)]
                ok = (s[:-1] < N) & (s[1:] < N)
                np.add.at(total[label], (s[:-1][ok], s[1:][ok]), 1)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*where, total[where])], ["label", "a", "b", "n"])

    return labelled.select("token", "label").mapInArrow(run, "label long, a long, b long, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Markov:
    """Both models; a step that follows a character too rarely seen is taken from how
    often the model has its second character at all.  At most 2 * N * N rows are collected."""
    n = np.zeros((2, N, N))
    for r in steps(labelled).collect():
        n[r["label"], r["a"], r["b"]] += r["n"]
    single = n.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((n + BACK_OFF * single) / (n.sum(axis=2, keepdims=True) + BACK_OFF))
    return Markov(logs[1] - logs[0])


def labelled_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> DataFrame:
    """``token, label`` from about ``rows`` documents: what the patterns find is random, other runs are ordinary."""
    src = bounded_sample(narrow(df, id, text).where("text is not null"), F.col("doc_id"), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                tokens, labels = [], []
                for t in b.column(1).to_pylist():
                    data = t.encode()
                    taken = base_spans(data)
                    plain = [data[a:e] for a, e in free_runs(data, taken, ASSIGN_LEAST)]
                    secret = [s for _, _, _, s in taken]
                    tokens += [x.decode() for x in secret + plain]
                    labels += [1] * len(secret) + [0] * len(plain)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(labels, pa.int64())], ["token", "label"])

    return src.mapInArrow(run, "token string, label long")


def scan(df: DataFrame, model: Markov, id: str = "doc_id", text: str = "text", least: float = RATIO_LEAST) -> DataFrame:
    """``doc_id, spans``: array of struct<kind, start, end> by start, then kind."""
    src = narrow(df, id, text)

    def spans(t: str | None) -> list[dict]:
        data = (t or "").encode()
        taken = base_spans(data)
        found = [(a, k, b) for a, k, b, _ in taken]
        found += [(a, 3, b) for a, b in free_runs(data, taken, RUN_LEAST) if model.score(data[a:b]) >= least]
        if found and not t.isascii():
            point = {p: len(data[:p].decode()) for a, _, b in found for p in (a, b)}
            found = [(point[a], k, point[b]) for a, k, b in found]
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spans(t) for t in b.column(1).to_pylist()], kind)], ["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
