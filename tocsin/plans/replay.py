"""Point-in-time rebuilds and dual computation of mart columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import Vocabulary, first_match
from ..functions.timebase import DAY, HOUR, MINUTE, ORIGIN_US, hour_of, hour_start
from ..operators.interval import interval_join
from ..operators.scan import asof_join
from ..operators.settle import settle
from . import features as X
from . import labels as L

LOOK_DAYS = 100


def asof_view(journal: DataFrame, t: int, guard: Column, ignored: DataFrame | None = None, days: int = LOOK_DAYS) -> DataFrame:
    """The journal as known at ``t``: the last ``days`` and all guard history,
    without ignored periods (guard rows stay: they are state, not events).
    ``ignored``: a, b in microseconds; a short settings table."""
    seen = journal.where((F.col("us") < t) & ((F.col("us") >= t - days * DAY) | guard))
    if ignored is None:
        return seen
    keep = seen.where(guard)
    rest = seen.where(~guard)
    marked = ignored.withColumn("_all", F.lit(1))
    clean = interval_join(rest.withColumn("_all", F.lit(1)), marked, ["_all"], "us", "a", "b", DAY, how="left_anti")
    return keep.unionByName(clean.drop("_all"))


def snapshot_at(journal: DataFrame, objects: DataFrame, t: int, voc: Vocabulary, p: L.LabelParams, days: int = LOOK_DAYS, ignored=None) -> DataFrame:
    """The feature row of every object for the hour ending at ``t``, rebuilt
    from the journal before ``t`` alone."""
    guard_row = voc.armed.column() | voc.disarmed.column()
    seen = asof_view(journal, t, guard_row, ignored, days)
    # each stage feeds several later ones: settle it once
    guard = settle(L.guard_timeline(seen, voc))
    openings = settle(
        L.with_arrival(L.opening_then_motion(L.armed_openings(seen, guard, voc), seen, voc, p), guard, p)
    )
    triggers = settle(L.journal_triggers(seen, voc).unionByName(L.intrusion_triggers(openings, p)))
    noise = L.noise_mass(triggers, voc, p).unionByName(L.noise_power_flood(triggers, voc, p))
    visits = settle(L.visits(seen, guard, voc, p))
    eps = settle(L.episodes(settle(L.mark_noise(triggers, noise)), visits, p))
    hi = (t - ORIGIN_US) // HOUR
    lo = hi - days * 24
    stages = X.Stages(seen, objects, guard, openings, triggers, visits, eps)
    grid = X.hour_grid(stages, voc, p, lo, hi)
    # the guard state may have changed last before the window: seed its first hour
    before = (
        guard.where(hour_of("us") < lo)
        .groupBy("object_id")
        .agg(F.max_by(F.col("armed").cast("int"), F.col("us")).alias("_seed"))
    )
    grid = (
        grid.join(before, "object_id", "left")
        .withColumn("guard_last", F.when(F.col("h") == lo, F.coalesce("guard_last", "_seed")).otherwise(F.col("guard_last")))
        .drop("_seed")
    )
    grid = settle(grid)
    own = X.object_features(grid, voc).where(F.col("h") == hi - 1)
    coll = X.collector_features(grid, voc).where(F.col("h") == hi - 1)
    return own.join(coll, ["collector_id", "h"])


def snapshot_diff(rows: DataFrame, mart: DataFrame, names: list[str], tol: float = 1e-3) -> DataFrame:
    """Per feature: values compared, equal ones and rows that differ."""
    a = rows.select("object_id", "h", F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("i", "x"))
    b = mart.select("object_id", "h", F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("i", "y"))
    both = a.join(b, ["object_id", "h", "i"])
    miss = lambda c: F.col(c).isNull() | F.isnan(c)
    same = (miss("x") & miss("y")) | F.coalesce(
        F.abs(F.col("x") - F.col("y")) <= tol * F.greatest(F.lit(1.0), F.abs("y")), F.lit(False)
    )
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return both.groupBy(label.alias("feature")).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(same).alias("equal"), F.count_if(~same).alias("differ")
    )


def direct_counts(rows: DataFrame, journal: DataFrame, triggers: DataFrame, eps: DataFrame, voc: Vocabulary) -> DataFrame:
    """Mart columns of the given (object, hour) rows counted straight from the
    journal, a second way to the same numbers."""
    rows = rows.withColumn("e", hour_start("h") + HOUR)

    def back(hours: int, points: DataFrame, t: str, aggs: list[Column]) -> DataFrame:
        spans = rows.select("object_id", F.col("h").alias("_h"), (F.col("e") - hours * HOUR).alias("a"), F.col("e").alias("b"))
        hit = interval_join(points, spans, ["object_id"], t, "a", "b", width=hours * HOUR)
        return hit.groupBy("object_id", F.col("_h").alias("h")).agg(*aggs)

    counter = first_match(voc.counters)
    known = triggers.where("type = 'fire'").select("object_id", (F.col("us") + 10 * MINUTE).alias("kt"))
    quiet = eps.where("noise is null")
    n = F.count(F.lit(1)).cast("double")
    parts = [
        back(6, journal.withColumn("_k", counter), "us", [F.count_if(F.col("_k") == "smoke").cast("double").alias("smoke_6h")]),
        back(168, journal, "us", [n.alias("events_168h")]),
        back(24, journal, "us", [F.round(F.max(F.when(voc.gas.column(), F.col("num"))), 6).alias("gas_max_24h")]),
        back(24, known, "kt", [n.alias("trig_fire_24h")]),
        back(168, quiet.where("type = 'equipment'").select("object_id", "t0"), "t0", [n.alias("onset_equipment_168h")]),
    ]
    out = rows
    for p in parts:
        out = out.join(p, ["object_id", "h"], "left")
    fires = quiet.where("type = 'fire'").select("object_id", F.col("t0").alias("ft"))
    out = asof_join(out, fires, ["object_id"], "e", "ft", {"ft": "ft"}, direction="forward", how="left")
    nxt = F.least(F.coalesce(hour_of("ft") - F.col("h"), F.lit(X.NEXT_CAP)), F.lit(X.NEXT_CAP)).cast("bigint")
    counts = ["smoke_6h", "events_168h", "trig_fire_24h", "onset_equipment_168h"]
    return out.fillna(0.0, subset=counts).select("object_id", "h", *counts, "gas_max_24h", nxt.alias("next_fire"))
