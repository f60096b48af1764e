"""Sensor vocabularies as data: which (sensor type, state, number) means what."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Sign:
    """A condition on a journal row.  Empty parts do not restrict."""

    stypes: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    but: tuple[str, ...] = ()  # sensor types excluded
    lo: float | None = None  # num >= lo
    hi: float | None = None  # num <= hi
    below: float | None = None  # num < below
    above: float | None = None  # num > above

    def column(self) -> Column:
        parts = []
        if self.stypes:
            parts.append(F.col("stype").isin(*self.stypes))
        if self.but:
            parts.append(~F.col("stype").isin(*self.but))
        if self.states:
            parts.append(F.col("state").isin(*self.states))
        for bound, test in (
            (self.lo, lambda v: F.col("num") >= v),
            (self.hi, lambda v: F.col("num") <= v),
            (self.below, lambda v: F.col("num") < v),
            (self.above, lambda v: F.col("num") > v),
        ):
            if bound is not None:
                parts.append(test(F.lit(float(bound))))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_sign(signs) -> Column:
    return reduce(lambda a, b: a | b, [s.column() for s in signs])


def first_match(rules: list[tuple[str, Sign]]) -> Column:
    """Label of the first rule that holds, NULL if none."""
    out = None
    for label, sign in rules:
        out = F.when(sign.column(), F.lit(label)) if out is None else out.when(sign.column(), F.lit(label))
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Everything site-specific the labelling needs."""

    triggers: list[tuple[str, Sign]]
    counters: list[tuple[str, Sign]]
    armed: Sign
    disarmed: Sign
    openings: tuple[Sign, ...]
    motion: tuple[Sign, ...]
    doors: tuple[Sign, ...]
    visit_motion: tuple[Sign, ...]
    mass: Sign
    flooded: Sign
    power_back: tuple[Sign, ...]
    power_lost: tuple[Sign, ...]
    gas: Sign
    temperature: Sign
    undefined: tuple[str, ...] = ()
    link_skip: tuple[str, ...] = ()
    types: tuple[str, ...] = ("fire", "gas", "flood", "equipment", "sensor", "intrusion")
