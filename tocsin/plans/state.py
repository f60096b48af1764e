"""Alarm state, operator decisions and the messages of an hour."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timebase import DAY, HOUR, hour_start, ts_of
from ..operators.interval import interval_join
from ..operators.ranks import exact_quantiles
from ..operators.runs import mark_runs
from ..operators.scan import asof_join
from ..operators.sliding import sliding_quantiles

# fixed values of the alarm rules, hours
CHATTER_GAP = 6
REJECT_HOURS = 168
THRESHOLD_HOURS = 90 * 24
HORIZON = 24
ACTIONS = ("TAKE", "REJECT", "MUTE", "REOPEN", "CONFIRMED")


# ---- forecast log ---------------------------------------------------------------


def forecast_history(scores, thresholds, statuses, type_: str, object_id: int, a: int, b: int) -> DataFrame:
    """Score, threshold and status of one pair over ``[a, b)``."""
    mine = (F.col("type") == type_) & (F.col("object_id") == object_id) & (F.col("h") >= a) & (F.col("h") < b)
    return (
        scores.where(mine)
        .join(thresholds, [c for c in thresholds.columns if c != "thr"])
        .join(statuses.where(mine), ["type", "object_id", "h"], "left")
        .orderBy("h")
    )


def log_sweep(log: DataFrame, h: str, keep: int) -> DataFrame:
    last = log.agg(F.max(h).alias("m")).first()["m"]
    return log.where(F.col(h) > last - keep)


# ---- thresholds -----------------------------------------------------------------


def threshold_90d(history: DataFrame, asks: DataFrame, share: DataFrame, ignored: DataFrame | None = None, window: int = THRESHOLD_HOURS) -> DataFrame:
    """Threshold of each asked (type, h): the fleet's quantile over the hours
    ``[h - window + 1, h]``; with nothing there, over the last known window.
    Hours of ignored periods (a, b in hours) take no part."""
    rows = history.select("type", "h", "p")
    if ignored is not None:
        marks = ignored.withColumn("_k", F.lit(1))
        rows = interval_join(rows.withColumn("_k", F.lit(1)), marks, ["_k"], "h", "a", "b", 24, how="left_anti").drop("_k")
    last = rows.groupBy("type").agg(F.max("h").alias("_last"), F.min("h").alias("_first"))
    spans = (
        asks.join(last, "type")
        .withColumn("_b", F.when(F.col("h") - window + 1 <= F.col("_last"), F.col("h")).otherwise(F.col("_last")))
        .withColumn("_b", F.when(F.col("h") < F.col("_first"), F.col("_last")).otherwise(F.col("_b")))
        .select("type", F.col("h").alias("at"), (F.col("_b") - window + 1).alias("_a"), (F.col("_b") + 1).alias("_b"))
    )
    windows = spans.join(share, "type").withColumn("qs", F.array(1 - F.col("share")))
    out = sliding_quantiles(rows, ["type"], "h", "p", windows.select("type", "at", F.col("_a").alias("a"), F.col("_b").alias("b"), "qs"), ["at"], window)
    return out.select("type", F.col("at").alias("h"), F.col("value").alias("thr"))


def share_estimate(history: DataFrame, by: list[str], share: float) -> DataFrame:
    """The threshold a share gives and its alarms per object-day."""
    thr = exact_quantiles(history, by, "p", [1.0 - share]).select(*by, F.col("value").alias("thr"))
    j = history.join(thr, by)
    return j.groupBy(*by).agg(
        F.max("thr").alias("threshold"),
        (F.count_if(F.col("p") >= F.col("thr")) / (F.count(F.lit(1)) / 24)).alias("alarms_per_object_day"),
        F.round(F.count(F.lit(1)) / 24, 1).alias("object_days"),
    )


# ---- the rule state of one (object, type) ---------------------------------------


class PairRules:
    """What the rules remember about one pair between hours."""

    def __init__(self, start=None, last_on=None, rejected=None, muted_until=None):
        self.start, self.last_on, self.rejected, self.muted_until = start, last_on, rejected, muted_until

    def dump(self) -> tuple:
        return (self.start, self.last_on, self.rejected, self.muted_until)

    def fact(self) -> str | None:
        """A real episode ends rejection and mute; names what it ended."""
        was = "REJECTED" if self.rejected is not None else "MUTED" if self.muted_until is not None else None
        self.rejected = self.muted_until = None
        return was

    def decide(self, h: int, action: str, until: int | None, rejectable: bool) -> bool:
        if action == "REJECT" and rejectable:
            self.rejected = h
            return True
        if action == "MUTE":
            self.muted_until = until if until is not None else h + REJECT_HOURS
            return True
        if action in ("REOPEN", "CONFIRMED"):
            return self.fact() is not None
        return False

    def hour(self, h: int, score: float, thr: float, strict: float | None) -> tuple[bool, int, str | None]:
        """``(alarm, hours since the signal ended, status)`` of an hour.
        ``strict`` is the score that breaks through a rejection: infinity for
        never, None where the type knows no rejection."""
        raw = score >= thr
        since = 0
        if raw:
            if self.last_on is None or h - self.last_on > CHATTER_GAP + 1:
                self.start = h
            self.last_on = h
        elif self.last_on is not None:
            since = h - self.last_on
        alarm, status = raw, "ALARM" if raw else None
        if self.rejected is not None and strict is not None:
            alarm = score >= strict
            status = "ALARM" if alarm else "REJECTED"
        if self.muted_until is not None and h < self.muted_until:
            alarm, status = False, "MUTED"
        if strict is not None and self.rejected is not None and h - self.rejected > REJECT_HOURS:
            self.rejected = None
        if self.muted_until is not None and h >= self.muted_until:
            self.muted_until = None
        return alarm, since, status if (raw or alarm) else None


RULE_INPUT = "object_id bigint, type string, h bigint, step int, score double, thr double, strict double, rejectable boolean, action string, until bigint"
RULE_OUTPUT = "object_id bigint, type string, h bigint, alarm boolean, since bigint, status string, cleared string"
FACT, TICK, DECISION = 0, 1, 2


def rule_inputs(ticks: DataFrame, facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """One ordered feed per pair: in an hour facts come first, then the tick,
    then the decisions taken on what the tick showed."""
    t = ticks.select("object_id", "type", "h", F.lit(TICK).alias("step"), "score", "thr", "strict", "rejectable")
    f = facts.select("object_id", "type", "h", F.lit(FACT).alias("step"))
    d = decisions.select("object_id", "type", "h", F.lit(DECISION).alias("step"), "action", "until", "rejectable")
    return t.unionByName(f, allowMissingColumns=True).unionByName(d, allowMissingColumns=True)


def play(rules: PairRules, rows: pd.DataFrame) -> list[tuple]:
    """Feed ordered rows of one pair; one output row per tick and per clearing."""
    out = []
    for r in rows.sort_values(["h", "step", "action"], na_position="first").itertuples(index=False):
        key = (int(r.object_id), r.type, int(r.h))
        if r.step == FACT:
            was = rules.fact()
            if was:
                out.append((*key, None, None, None, was))
        elif r.step == TICK:
            strict = None if pd.isna(r.strict) else float(r.strict)
            out.append((*key, *rules.hour(int(r.h), float(r.score), float(r.thr), strict), None))
        else:
            rules.decide(int(r.h), r.action, None if pd.isna(r.until) else int(r.until), bool(r.rejectable))
    return out


OUT_COLUMNS = ["object_id", "type", "h", "alarm", "since", "status", "cleared"]


def alarm_rules(feed: DataFrame) -> DataFrame:
    """The state machine over whole histories.  A pair has one tick an hour
    and a human's decisions: its rows are bounded by the period."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(play(PairRules(), pdf), columns=OUT_COLUMNS)
        return out.astype({"since": "Int64", "alarm": "boolean"})

    return feed.groupBy("object_id", "type").applyInPandas(run, RULE_OUTPUT)


MEMORY = "object_id bigint, type string, start bigint, last_on bigint, rejected bigint, muted_until bigint"


def advance(feed: DataFrame, memory: DataFrame) -> DataFrame:
    """The state machine over new rows only, from the stored memory of every
    pair.  Rows of ``RULE_OUTPUT`` have ``of = 'rule'``; rows with ``of =
    'memory'`` are the memory afterwards, also of pairs without new rows."""
    fields = MEMORY.replace("object_id bigint, type string, ", "")
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        was = old.iloc[0][names] if len(old) else []
        rules = PairRules(*(None if pd.isna(x) else int(x) for x in was))
        rows = [(*r, "rule", *[None] * len(names)) for r in play(rules, new)]
        rows.append((int(key[0]), key[1], *[None] * (len(OUT_COLUMNS) - 2), "memory", *rules.dump()))
        out = pd.DataFrame(rows, columns=[*OUT_COLUMNS, "of", *names], dtype=object)
        return out.astype({n: "Int64" for n in ("object_id", "h", "since", *names)} | {"alarm": "boolean"})

    keyed = memory.selectExpr("object_id AS _object", "type AS _type", *names)
    return keyed.groupBy("_object", "_type").cogroup(feed.groupBy("object_id", "type")).applyInPandas(run, f"{RULE_OUTPUT}, of string, {fields}")


def recurred(decisions: DataFrame, onsets: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rejected or muted pairs that later had an episode: hours after the last
    decision before it."""
    muting = decisions.where(F.col("action").isin("REJECT", "MUTE"))
    j = asof_join(
        onsets, muting, ["object_id", "type"], "h", "h", {"h": "decided", "action": "was", "command_id": "command_id"},
        strict=True, width=24,
    )
    back = F.col("h") - F.col("decided")
    return j.withColumn("hours_after_decision", back).withColumn("within_horizon", back <= horizon)


# ---- commands --------------------------------------------------------------------

KINDS = (
    "decision.take",
    "decision.reject",
    "decision.mute",
    "decision.reopen",
    "decision.confirmed",
    "settings.operating",
    "settings.works",
    "settings.gaps",
    "model.switch",
    "retrain.request",
)


def commands(envelopes: DataFrame) -> DataFrame:
    """Each command once, with its fate: applied, duplicate, stale or refused.

    ``envelopes``: arrival, body (JSON).  Settings apply only when newer than
    every version applied before them.
    """
    e = F.from_json("body", "schema int, command_id string, kind string, payload string, issued_at string")
    p = F.from_json(F.col("e.payload"), "object_id bigint, type string, until string, version bigint")
    rows = envelopes.select("arrival", e.alias("e")).select("arrival", "e.*", p.alias("p"))
    settings = F.col("kind").startswith("settings.")
    decision = F.col("kind").startswith("decision.")
    refusal = (
        F.when(F.col("schema").isNull() | (F.col("schema") != 1), "envelope is not schema 1")
        .when(F.coalesce("command_id", F.lit("")) == "", "no command_id")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), "unknown kind")
        .when(F.col("payload").isNull() | ~F.col("payload").startswith("{"), "payload is not an object")
        .when(decision & (F.col("p.object_id").isNull() | F.col("p.type").isNull()), "object_id and type are needed")
        .when(settings & F.col("p.version").isNull(), "no version")
    )
    judged = rows.withColumn("refusal", refusal)
    # the first accepted arrival of an id acts; later ones are duplicates
    first = judged.where("refusal is null").groupBy("command_id").agg(F.min("arrival").alias("_first"))
    j = judged.join(first, "command_id", "left")
    acts = F.col("refusal").isNull() & (F.col("arrival") == F.col("_first"))
    # highest version applied before, per settings table: settings commands
    # are typed by people, so a table's own history is short
    w = Window.partitionBy("_table").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_acts", acts).withColumn("_table", F.when(settings & acts, F.col("kind")).otherwise(F.col("command_id")))
    before = F.max(F.when(settings & F.col("_acts"), F.col("p.version"))).over(w)
    fate = (
        F.when(F.col("refusal").isNotNull(), "refused")
        .when(~F.col("_acts"), "duplicate")
        .when(settings & (F.col("p.version") <= F.coalesce(before, F.lit(0))), "stale")
        .otherwise("applied")
    )
    return j.select(
        "arrival", "command_id", "kind", fate.alias("fate"), "refusal",
        F.col("p.object_id").alias("object_id"), F.col("p.type").alias("type"), F.col("p.version").alias("version"),
    )


def versioned_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows added, removed or changed between two versions of a table."""
    a = old.select(key, F.struct(*values).alias("_a"))
    b = new.select(key, F.struct(*values).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def replace_if_newer(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of the greatest version of the two tables (each has ``version``);
    the current one stays on a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = both.agg(F.max(F.struct("version", (-F.col("_new")).alias("n"))).alias("b")).first()["b"]
    if best is None:
        return current
    return both.where((F.col("version") == best["version"]) & (F.col("_new") == -best["n"])).drop("_new")


def works_validate(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Broken rules of a work schedule, one row per (row, rule).  Columns are
    text: work_id, object_id, incident_types, starts_at, ends_at, and row."""
    a, b = F.col("starts_at").try_cast("timestamp_ntz"), F.col("ends_at").try_cast("timestamp_ntz")
    listed = F.filter(F.split("incident_types", ","), lambda t: t != "")
    again = F.row_number().over(Window.partitionBy("work_id").orderBy("row")) > 1
    rows = rows.withColumn("_again", again)
    blank = F.trim(F.coalesce("work_id", F.lit(""))) == ""
    unknown = F.size(F.array_except(listed, F.array(*[F.lit(t) for t in types]))) > 0
    rules = {
        "work_id blank or repeated": blank | F.col("_again"),
        "object_id is not a number": ~F.coalesce("object_id", F.lit("")).rlike("^[0-9]*$"),
        "unknown incident types": (F.size(listed) == 0) | unknown,
        "bad start or end": a.isNull() | b.isNull(),
        "start is not before end": F.coalesce(a >= b, F.lit(False)),
    }
    broken = F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    return rows.select("row", F.explode(F.array_compact(broken)).alias("rule"))


def operating_validate(settings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Violations of operating settings: shares and k outside the bounds of
    their type, missing or unknown types, no reason."""
    j = bounds.join(settings, "type", "full")
    out_of = lambda c, lo, hi: (F.col(c) < F.col(lo)) | (F.col(c) > F.col(hi))
    problem = (
        F.when(F.col("share_min").isNull(), "unknown type")
        .when(F.col("share").isNull(), "type is missing")
        .when(out_of("share", "share_min", "share_max"), "share out of bounds")
        .when(F.coalesce(out_of("reject_k", "k_min", "k_max"), F.lit(False)), "reject_k out of bounds")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason")
    )
    return j.select("type", problem.alias("problem")).where("problem is not null")


# ---- work windows at an hour -----------------------------------------------------

NOT_MUTED = ("sensor",)


def works_mute(pairs: DataFrame, windows: DataFrame, width: int = DAY) -> DataFrame:
    """Pairs (object_id, collector_id, type, h) inside an active window of
    their object or collector; the first window by work_id wins.  Forecasts of
    sensor faults are never muted."""
    at = pairs.where(~F.col("type").isin(*NOT_MUTED)).withColumn("_t", hour_start("h"))
    places = at.withColumn("place", F.explode(F.array_distinct(F.array("object_id", "collector_id"))))
    hit = interval_join(places, windows.withColumnRenamed("object_id", "place"), ["place"], "_t", "a", "b", width)
    hit = hit.where(F.array_contains("types", F.col("type")))
    return hit.groupBy("object_id", "type", "h").agg(F.min("work_id").alias("work_id"))


def status_table(rows: DataFrame, muted: DataFrame) -> DataFrame:
    """ALARM / MUTED / REJECTED of the hour with its reason and reference.
    ``rows``: object_id, type, h, raw, alarm, decided (status), command_id."""
    j = rows.join(muted, ["object_id", "type", "h"], "left").where("raw or alarm")
    works = F.col("work_id").isNotNull()
    status = F.when(works & F.col("raw"), "MUTED").when(works, None).when(F.col("alarm"), "ALARM").otherwise(F.col("decided"))
    reason = F.when(works, "works").when(~F.col("alarm") & F.col("decided").isNotNull(), "decision")
    ref = F.when(works, F.col("work_id")).when(~F.col("alarm"), F.col("command_id"))
    return j.select("object_id", "type", "h", status.alias("status"), reason.alias("reason"), ref.alias("ref")).where(
        "status is not null"
    )


# ---- messages ----------------------------------------------------------------------


def forecast_message(rows: DataFrame, version: str, horizon: int = HORIZON) -> DataFrame:
    """One nested message per (object, hour) with a block per type.  ``rows``:
    object_id, type, h, score, threshold, alarm, since, reasons, evidence."""
    on = F.col("alarm")
    block = F.struct(
        F.round("score", 6).alias("score"),
        F.round("threshold", 6).alias("threshold"),
        on.alias("alarm"),
        F.when(on, F.col("since")).alias("since_hours"),
        F.when(on, F.col("reasons")).alias("reasons"),
        F.when(on, F.col("evidence")).alias("evidence"),
    )
    end = F.date_format(ts_of(hour_start("h") + HOUR), "yyyy-MM-dd'T'HH:mm:ss")
    types = F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", block.alias("b")))))
    return rows.groupBy("object_id", "h").agg(types.alias("types")).select(
        "object_id",
        "h",
        F.to_json(
            F.struct(
                F.lit(1).alias("schema"),
                F.lit("forecast").alias("kind"),
                "object_id",
                end.alias("hour_end"),
                F.lit(horizon).alias("horizon_hours"),
                F.lit(version).alias("model_version"),
                F.lit("live").alias("clock"),
                "types",
            )
        ).alias("message"),
    )


def fact_message(facts: DataFrame, version: str) -> DataFrame:
    """By-fact message per (object, hour): only live types.  Heat beside a live
    fire becomes the fire's ``temperature`` field, not a type of its own.
    ``facts``: object_id, h, type, started, last, new, note, work_id, direction."""
    fire = F.max(F.when(F.col("type") == "fire", 1)).over(Window.partitionBy("object_id", "h"))
    heat = (F.col("type") == "temperature") & (F.col("direction") == "hot") & (fire == 1)
    m = facts.withColumn("_heat", F.coalesce(heat, F.lit(False)))
    info = F.struct("direction", F.col("started").alias("started_at"))
    warm = F.max(F.when(F.col("_heat"), info)).over(Window.partitionBy("object_id", "h"))
    block = F.struct(
        F.col("started").alias("started_at"), F.col("last").alias("last_at"), "new", "note", "work_id",
        F.when((F.col("type") == "temperature"), F.col("direction")).alias("direction"),
        F.when(F.col("type") == "fire", F.col("_warm")).alias("temperature"),
    )
    return (
        m.withColumn("_warm", warm)
        .where(~F.col("_heat"))
        .groupBy("object_id", "h")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", block.alias("b"))))).alias("types"))
        .select(
            "object_id", "h",
            F.to_json(F.struct(F.lit(1).alias("schema"), F.lit("fact").alias("kind"), "object_id", F.lit(version).alias("model_version"), "types")).alias("message"),
        )
    )


def card_lifecycle(alarms: DataFrame, rows: DataFrame) -> DataFrame:
    """Continuous alarm hours of a pair as one card.  A card closes on the
    first later hour that says no alarm; without one it is open."""
    keys = ["type", "object_id"]
    runs = mark_runs(alarms, keys, "h", 0, "_r")
    cards = runs.groupBy(*keys, "_r").agg(F.min("h").alias("start"), F.max("h").alias("last")).drop("_r")
    quiet = rows.where("not alarm").select(*keys, F.col("h").alias("_q"))
    closed = asof_join(cards, quiet, keys, "last", "_q", {"_q": "closed"}, direction="forward", strict=True, how="left", width=24)
    return closed.withColumn("age", F.col("last") - F.col("start") + 1).withColumn("open", F.col("closed").isNull())


def object_status(objects: DataFrame, facts: DataFrame, blind: DataFrame, forecasts: DataFrame, accident_types: list[str], now: int, alive: int = 2 * HOUR) -> DataFrame:
    """ALARM over OFFLINE over WATCH over NORMAL.  ``facts``: object_id, type,
    last; ``blind``: object_id, last; ``forecasts``: object_id with an open card."""
    live = F.col("last") >= now - alive
    marks = (
        facts.where(live & F.col("type").isin(*accident_types)).select("object_id", F.lit(3).alias("rank"))
        .unionByName(blind.where(live).select("object_id", F.lit(2).alias("rank")))
        .unionByName(forecasts.select("object_id", F.lit(1).alias("rank")))
    )
    top = marks.groupBy("object_id").agg(F.max("rank").alias("rank"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("NORMAL", "WATCH", "OFFLINE", "ALARM")]), F.coalesce("rank", F.lit(0)) + 1)
    return objects.select("object_id").join(top, "object_id", "left").select("object_id", name.alias("status"))


def evidence_pickets(forecasts: DataFrame, pickets: DataFrame, lo: int, hi: int) -> DataFrame:
    """Forecasts whose evidence sensors stand on pickets of ``[lo, hi]``.
    ``forecasts``: object_id, type, h, evidence (array of sensor ids)."""
    e = forecasts.select("object_id", "type", "h", F.explode("evidence").alias("channel_id"))
    near = pickets.where((F.col("picket") >= lo) & (F.col("picket") <= hi))
    return e.join(near, "channel_id").groupBy("object_id", "type", "h").agg(F.count_distinct("channel_id").alias("sensors"))


# ---- notices ------------------------------------------------------------------------


def plan_notices(messages: DataFrame, sent: DataFrame, chunk: int, keep_us: int = DAY) -> tuple[DataFrame, DataFrame]:
    """Who gets which notice in which chunk, and refused messages.

    ``messages``: notice_id, channel, subject, text, recipients (array), at;
    ``sent``: notice_id, recipient, at.  Recipients are trimmed, lowered for
    mail, distinct, and those served within the keeping time are left out.
    """
    refusal = (
        F.when(F.coalesce("notice_id", F.lit("")) == "", "no id")
        .when(~F.coalesce(F.col("channel").isin("email", "telegram"), F.lit(False)), "unknown channel")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")
        .when(F.coalesce(F.size("recipients"), F.lit(0)) < 1, "no recipients")
    )
    judged = messages.withColumn("refusal", refusal)
    good = judged.where("refusal is null").drop("refusal")
    tidy = F.transform("recipients", lambda r: F.when(F.col("channel") == "email", F.lower(F.trim(r))).otherwise(F.trim(r)))
    each = good.withColumn("recipient", F.explode(F.array_distinct(F.filter(tidy, lambda r: r != ""))))
    each = each.drop("recipients").dropDuplicates(["notice_id", "recipient"])
    done = sent.select("notice_id", "recipient", F.col("at").alias("_sent"))
    served = each.join(done, ["notice_id", "recipient"]).where(F.col("_sent") >= F.col("at") - keep_us)
    todo = each.join(served.select("notice_id", "recipient"), ["notice_id", "recipient"], "left_anti")
    w = Window.partitionBy("notice_id").orderBy("recipient")
    return (
        todo.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / chunk)),
        judged.where("refusal is not null"),
    )
