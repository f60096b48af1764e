"""Forecast models on pyspark.ml: training, folds, calibration, reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.timebase import DAY, HOUR, MINUTE, ts_of
from ..operators.interval import interval_join
from ..operators.isotonic import along, isotonic
from ..operators.moments import counts_within
from ..operators.ranks import exact_quantiles, ranked
from ..operators.settle import settle
from . import metrics as M

MISSING = -1e9  # trees here take no missing values: a far constant and a flag
LEVELS = (0.4, 0.5, 0.6, 0.75)


def time_split(mart: DataFrame, period: Column, parts: dict[str, list[int]]) -> DataFrame:
    """Mark rows train / val / test by lists of periods; other rows go."""
    out = F.lit(None).cast("string")
    for name, values in parts.items():
        out = F.when(period.isin(*values), F.lit(name)).otherwise(out)
    return mart.withColumn("split", out).where(F.col("split").isNotNull())


def baseline_freq(train: DataFrame, rows: DataFrame, target: str, horizon: int) -> DataFrame:
    """The object's positive rate in training, the overall one if unseen."""
    y = (F.col(target) <= horizon).cast("double")
    rate = train.groupBy("object_id").agg(F.avg(y).alias("freq"))
    prior = train.agg(F.avg(y).alias("_prior")).first()["_prior"]
    return rows.join(rate, "object_id", "left").withColumn("freq", F.coalesce("freq", F.lit(prior)))


def baseline_scores(mart: DataFrame, type_: str) -> DataFrame:
    return mart.withColumn("rules", F.col(f"trig_{type_}_24h").cast("double")).withColumn("recency", (-F.col(f"since_{type_}")).cast("double"))


def inputs(rows: DataFrame, features: list[str], nullable: list[str]) -> tuple[DataFrame, list[str]]:
    """Features with a sentinel for NULL and a flag beside each nullable one."""
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features}
    cols |= {f"{f}_missing": F.col(f).isNull().cast("double") for f in nullable}
    return rows.withColumns(cols), [*features, *[f"{f}_missing" for f in nullable]]


def train_gbt(
    rows: DataFrame, features: list[str], nullable: list[str], label: str, weight: str | None = None, val: str | None = None,
    seed: int = 7, trees: int = 20, depth: int = 5, rate: float = 0.1,
):
    """Binary boosting with a weight and an early-stop column."""
    data, names = inputs(rows, features, nullable)
    gbt = GBTClassifier(
        labelCol=label, featuresCol="_x", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8,
        featureSubsetStrategy="0.6",
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    if val:
        gbt = gbt.setParams(validationIndicatorCol=val, validationTol=0.001)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), gbt]).fit(data)
    return model, names


def score(model, rows: DataFrame, features: list[str], nullable: list[str], out: str = "p") -> DataFrame:
    keep = rows.columns
    data, _ = inputs(rows.select("*", F.struct(*keep).alias("_row")), features, nullable)
    p = model.transform(data).withColumn(out, vector_to_array("probability")[1])
    return p.select("_row.*", out)


def each(spark: SparkSession, keys: Iterable, job: Callable, at_once: int = 4) -> dict:
    """``job`` of every key, ``at_once`` at a time.  Fits do not read each other, so
    their small stages share the executors instead of waiting in a row."""
    keys = list(keys)
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(keys, pool.map(lambda k: inheritable_thread_target(spark)(job)(k), keys), strict=True))


def later_block(rows: DataFrame, first: int, horizon: int) -> DataFrame:
    """Validation is the block from hour ``first`` on (``is_val``).  Hours whose targets
    look into it belong to neither side and go."""
    h = F.col("h")
    return rows.where((h < first - horizon) | (h >= first)).withColumn("is_val", h >= first)


def train_types(
    rows: DataFrame, types: Iterable[str], features: Callable[[str], list[str]], nullable: list[str], first: int, horizon: int = 24,
    least: int = 5, weight: float = 2.0, **settings,
) -> dict[str, tuple | str]:
    """A model and its names for every type, from one table of features and targets;
    the reason where a type has too few rows of a class before the validation block."""
    types, blocks = list(types), settle(later_block(rows, first, horizon))
    hit = lambda t: F.coalesce((F.col(f"next_{t}") <= horizon).cast("double"), F.lit(0.0))
    seen = blocks.where(~F.col("is_val")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(hit(t)).alias(t) for t in types)).first()

    def fit(t: str):
        if not seen["n"] or seen[t] < least or seen["n"] - seen[t] < least:
            return "too few rows of a class"
        data = blocks.select(*features(t), "is_val", hit(t).alias("y")).withColumn("w", F.when(F.col("y") > 0, weight).otherwise(1.0))
        return train_gbt(data, features(t), nullable, "y", "w", "is_val", **settings)

    return each(rows.sparkSession, types, fit)


def score_types(models: dict[str, tuple | str], rows: DataFrame, features: Callable[[str], list[str]], nullable: list[str]) -> DataFrame:
    """``type, object_id, h, next, p, unscored`` of every row and type; without a model
    ``p`` is NULL and ``unscored`` says why."""
    out = None
    for t, model in models.items():
        if isinstance(model, str):
            part = rows.withColumns({"p": F.lit(None).cast("double"), "unscored": F.lit(model)})
        else:
            part = score(model[0], rows, features(t), nullable).withColumn("unscored", F.lit(None).cast("string"))
        part = part.select(F.lit(t).alias("type"), "object_id", "h", F.col(f"next_{t}").alias("next"), "p", "unscored")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no types")
    return out


def importance_of_types(spark, models: dict[str, tuple | str], top: int = 20) -> DataFrame:
    """The importances of every type's model: ``type, feature, importance``."""
    out = spark.createDataFrame([], "type string, feature string, importance double")
    for t, model in models.items():
        if not isinstance(model, str):
            out = out.unionByName(importance_table(spark, *model, top).withColumn("type", F.lit(t)))
    return out


def soft_labels(rows: DataFrame, target: str, confirmed: str, horizon: int, soft: float) -> DataFrame:
    """Unconfirmed positives as two weighted rows: positive with ``soft`` and
    negative with the rest."""
    pos, sure = F.col(target) <= horizon, F.col(confirmed) <= horizon
    two = F.array(
        F.struct(F.lit(1.0).alias("y"), F.lit(float(soft)).alias("w")), F.struct(F.lit(0.0).alias("y"), F.lit(1.0 - soft).alias("w"))
    )
    one = lambda y: F.array(F.struct(F.lit(y).alias("y"), F.lit(1.0).alias("w")))
    parts = F.when(~pos, one(0.0)).when(sure, one(1.0)).otherwise(two)
    return rows.withColumn("_l", F.explode(parts)).withColumn("y", F.col("_l.y")).withColumn("w", F.col("_l.w")).drop("_l").where("w > 0")


def importance_table(spark, model, names: list[str], top: int = 20) -> DataFrame:
    """Normalised importance; the vector has one value per feature."""
    v = model.stages[-1].featureImportances.toArray()
    total = float(v.sum()) or 1.0
    rows = sorted(((n, float(x) / total) for n, x in zip(names, v)), key=lambda r: -r[1])[:top]
    return spark.createDataFrame([(n, round(x, 4)) for n, x in rows], "feature string, importance double")


def false_hours_at_recall(scores: DataFrame, by: list[str], levels=LEVELS, horizon: int = 24) -> DataFrame:
    """Exact false hours at recall levels: an episode is caught from its best
    score in the window down, so the threshold of level L is the L-th best."""
    eps = M.onsets(scores, by)
    keys = scores.select(*by, "object_id", "h", "p")
    best = M.windows_of(eps, horizon).join(keys, [*by, "object_id", "h"]).groupBy(*by, "object_id", "e").agg(F.max("p").alias("best"))
    total = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    lv = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    need = total.select("*", lv).withColumn("_k", F.greatest(F.ceil(F.col("level") * F.col("n")), F.lit(1)))
    r = ranked(best, by, "best", descending=True)
    thr = need.join(r.select(*by, "best", "cum_n"), by).where(F.col("cum_n") >= F.col("_k")).groupBy(*by, "level").agg(F.max("best").alias("thr"))
    false = M.alarm_rows(scores.where(F.col("next") > horizon), thr, by, "level", horizon)
    cost = false.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("false_hours"))
    return thr.join(cost, [*by, "level"], "left").fillna(0, subset=["false_hours"])


def tuning_objective(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.avg(F.log1p("false_hours")).alias("objective"))


def horizon_sweep(scores: DataFrame, by: list[str], horizons: list[int], per_day: float, days: float) -> DataFrame:
    """Base rate, PR-AUC, its lift, and precision and recall at an alarm
    budget, for several horizons of one mart."""
    out = None
    thr = M.threshold_for_rate(scores, by, per_day, days)
    for H in horizons:
        e = M.evaluate(scores, thr, by, H).select(
            *by, F.lit(H).alias("horizon"), "base_rate", "pr_auc",
            (F.col("pr_auc") / F.greatest("base_rate", F.lit(1e-9))).alias("lift"), "precision", "recall_episodes", "lead_median_h",
        )
        out = e if out is None else out.unionByName(e)
    return out


def isotonic_fit(scores: DataFrame, by: list[str], horizon: int = 24) -> DataFrame:
    """``by, lo, hi, n, value``: the share of scores that came true, rising with the score, for every group."""
    return isotonic(scores, by, "p", M.positive(horizon))


def confidence(blocks: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` with ``confidence``: linear between the blocks, level at the ends."""
    return along(blocks, scores, by, "p", "confidence")


def reasons_topk(rows: DataFrame, importances: DataFrame, labels: DataFrame, features: list[str], k: int) -> DataFrame:
    """The most important features of every row with its values.  The k names
    are the same for all rows of a type, so only they are unpivoted."""
    w = Window.partitionBy("type").orderBy(F.col("importance").desc(), "feature")
    top = importances.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(labels, "feature", "left")
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    lists = top.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("place", "feature", "label"))).alias("_t"))
    j = rows.withColumn("_v", values).join(lists, "type").withColumn("_x", F.explode("_t"))
    return j.select("type", "object_id", "h", "_x.place", "_x.feature", "_x.label", F.col("_v")[F.col("_x.feature")].alias("value"))


def feature_label(names: DataFrame, bases: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """Human label of a feature code: base, scope, window.  ``names``:
    feature; ``bases``: base, text."""
    hours = F.regexp_extract("feature", "_([0-9]+)h$", 1)
    stem = F.regexp_replace("feature", "_[0-9]+h$", "")
    scope, base = F.lit(""), stem
    for prefix, text in scopes.items():
        scope = F.when(stem.startswith(prefix), F.lit(text)).otherwise(scope)
        base = F.when(stem.startswith(prefix), F.substring(stem, len(prefix) + 1, 200)).otherwise(base)
    n = hours.try_cast("int")
    window = F.when(n <= 24, F.concat(n, F.lit(" h"))).otherwise(F.concat((n / 24).cast("int"), F.lit(" d")))
    j = names.withColumn("base", base).withColumn("_s", scope).withColumn("_w", window).join(bases, "base", "left")
    full = F.concat(F.col("text"), F.col("_s"), F.coalesce(F.concat(F.lit(" over "), F.col("_w")), F.lit("")))
    return j.select("feature", F.coalesce(full, F.col("feature")).alias("label"))


# ---- second stage ---------------------------------------------------------------


def cascade_features(alarms: DataFrame, all_alarms: DataFrame, work: DataFrame, by: list[str]) -> DataFrame:
    """Second-stage inputs of every alarm hour: score, other types alarming,
    run length, disarmed, visiting."""
    from .alarms import with_run_position

    keys = ["run", "split", "object_id", "h"]
    near = all_alarms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pos = with_run_position(alarms, by, 0)
    return (
        pos.join(near, keys)
        .join(work.select("object_id", "h", "disarmed", "visiting"), ["object_id", "h"], "left")
        .withColumn("near", (F.col("_n") - 1).cast("double"))
        .withColumn("run_hours", (F.col("position") + 1).cast("double"))
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("disarmed", "visiting")})
        .drop("_n", "position")
    )


def time_blocks(rows: DataFrame, t: str, folds: int) -> tuple[DataFrame, list]:
    """Contiguous blocks of time with about equally many rows, and the last moment of each but the last."""
    edges = [r["value"] for r in exact_quantiles(rows, [], t, [i / folds for i in range(1, folds)]).orderBy("q").collect()]
    block = F.lit(0)
    for e in edges:
        block = block + (F.col(t) > e).cast("int")
    return rows.withColumn("block", block), edges


def out_of_fold(rows: DataFrame, t: str, features: list[str], label: str, folds: int, trees: int = 10, depth: int = 3, gap: int = 0) -> DataFrame:
    """Every row scored by a model that saw neither its block of time nor rows within
    ``gap`` of it, whose outcomes overlap; where no model could be fitted ``oof`` is
    NULL and ``unscored`` says why."""
    marked, edges = time_blocks(rows, t, folds)
    blocks = settle(marked)
    out = None
    for b in range(folds):
        held, fit = blocks.where(F.col("block") == b), blocks.where(F.col("block") != b)
        if gap and 0 < b <= len(edges):
            fit = fit.where((F.col(t) <= edges[b - 1] - gap) | (F.col("block") > b))
        if gap and b < len(edges):
            fit = fit.where((F.col(t) > edges[b] + gap) | (F.col("block") < b))
        n = fit.agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n")).first()
        if not n["p"] or not n["n"] or n["p"] < 5 or n["n"] < 5:
            part = held.withColumn("oof", F.lit(None).cast("double")).withColumn("unscored", F.lit("too few rows of a class"))
        else:
            model, _ = train_gbt(fit, features, [], label, trees=trees, depth=depth)
            part = score(model, held, features, [], "oof").withColumn("unscored", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    return out


def keep_threshold(oof: DataFrame, label: str, keep: float) -> DataFrame:
    """The out-of-fold score that keeps a share of the true rows."""
    return exact_quantiles(oof.where(F.col(label) == 1), [], "oof", [1.0 - keep]).select(F.col("value").alias("thr"))


def second_stage(rows: DataFrame, t: str, features: list[str], label: str, folds: int, keep: float, gap: int = 0) -> DataFrame:
    """Out-of-fold scores and which rows the second stage lets through."""
    oof = settle(out_of_fold(rows, t, features, label, folds, gap=gap))
    thr = keep_threshold(oof, label, keep).first()
    cutoff = thr["thr"] if thr is not None else None
    passed = F.col("oof").isNull() | (F.col("oof") >= F.lit(cutoff)) if cutoff is not None else F.lit(True)
    return oof.withColumn("passed", passed)


def second_stages(rows: DataFrame, types: Iterable[str], t: str, features: list[str], label: str, folds: int, keep: float, gap: int = 0) -> DataFrame:
    """The second stage of every type, each with folds, models and a threshold of its own."""
    parts = each(rows.sparkSession, types, lambda k: second_stage(rows.where(F.col("type") == k), t, features, label, folds, keep, gap))
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no types")
    return out


def walk_forward(
    mart: DataFrame, type_: str, features: list[str], nullable: list[str], start: int, end: int, step: int, strategy: str,
    horizon: int = 24, val_hours: int = 14 * 24, share: float = 0.1, trees: int = 10, depth: int = 4,
) -> DataFrame:
    """Refit every ``step`` hours with a gap of the horizon and score the hours
    ahead.  Strategies: all, dN (last N days), decayN (half-life N days),
    frozen (first model, fresh threshold), thrfix (fresh model, first
    threshold).  Every hour from ``start`` to ``end`` stays: where a fold has no
    model or no threshold, ``p`` is NULL, there is no alarm, and ``unscored``
    says why."""
    target = f"next_{type_}"
    rows = mart.select("object_id", "h", F.col(target).alias("next"), *features)
    rows = rows.withColumn("y", M.positive(horizon).cast("double"))
    model = thr = out = None

    def fold(t: int, scored: DataFrame | None, why: str | None) -> DataFrame:
        if scored is None:
            scored = ahead.withColumn("p", F.lit(None).cast("double"))
        alarm = F.coalesce(F.col("p") >= F.lit(thr).cast("double"), F.lit(False)) if why is None else F.lit(False)
        cols = ["object_id", "h", "next", "p", alarm.alias("alarm"), F.lit(t).alias("fold"), F.lit(why).cast("string").alias("unscored")]
        part = scored.select(*cols)
        return part if out is None else out.unionByName(part)

    for t in range(start, end, step):
        ahead = rows.where((F.col("h") >= t) & (F.col("h") < min(t + step, end)))
        cut = t - horizon
        seen = rows.where(F.col("h") < cut)
        if strategy.startswith("d") and strategy[1:].isdigit():
            seen = seen.where(F.col("h") >= cut - int(strategy[1:]) * 24)
        val = F.col("h") >= cut - val_hours
        weight = None
        if strategy.startswith("decay"):
            age = (F.lit(cut) - F.col("h")) / (int(strategy[5:]) * 24.0)
            seen, weight = seen.withColumn("w", F.pow(F.lit(2.0), -age)), "w"
        fit = seen.where(F.col("h") < cut - val_hours - horizon)  # targets end before validation begins
        n = fit.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
        trainable = bool(n["p"]) and n["p"] >= 5 and n["p"] != n["n"]
        if not trainable:
            out = fold(t, None, "too few positive rows")
            continue
        if model is None or strategy != "frozen":
            model, _ = train_gbt(fit, features, nullable, "y", weight, trees=trees, depth=depth)
        if thr is None or strategy != "thrfix":
            v = score(model, seen.where(val), features, nullable)
            q = exact_quantiles(v, [], "p", [1.0 - share]).first()
            if q is None:
                out = fold(t, None, "no validation rows")
                continue
            thr = q["value"]
        out = fold(t, score(model, ahead, features, nullable), None)
    if out is None:
        raise ValueError("no fold between start and end")
    return out.withColumn("strategy", F.lit(strategy))


def walks(mart: DataFrame, types: Iterable[str], strategies: Iterable[str], features: Callable[[str], list[str]], *args, **settings) -> DataFrame:
    """``walk_forward`` of every type and strategy, written one by one: ``type, strategy``
    and its columns, one row for each object, hour, type and strategy."""
    keys = [(t, st) for t in types for st in strategies]
    parts = each(mart.sparkSession, keys, lambda k: settle(walk_forward(mart, k[0], features(k[0]), *args, strategy=k[1], **settings).withColumn("type", F.lit(k[0]))))
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no types or strategies")
    return out


# ---- filter of by-fact notices -----------------------------------------------------


def notice_features(eps: DataFrame, triggers: DataFrame, noise: DataFrame, wait: int = 10 * MINUTE) -> DataFrame:
    """What is known about an episode ``wait`` after its start.

    Counts over windows are differences of running counts at the windows' ends, so a
    trigger is one row however many episodes' windows hold it."""
    key, both, t0 = ["object_id", "type", "t0"], ["object_id", "type"], F.col("t0")
    e = eps.select(*key, F.col("noise").isNull().cast("double").alias("real"))
    one, soon = {"n": F.lit(1)}, {"w10": (t0, t0 + (wait + 1))}
    starts = eps.select(*both, F.col("t0").alias("us"), F.col("noise").isNotNull().alias("_nz"))
    back = {f"prev_{h}h": (t0 - h * HOUR, t0) for h in (1, 24, 168)}
    long = {f"ep_{d}d": (t0 - d * DAY, t0) for d in (30, 180)}
    spans = e.select(*key, t0.alias("_a"), (t0 + wait).alias("_b"))
    near = interval_join(triggers.select("object_id", "channel_id", "us").distinct(), spans, ["object_id"], "us", "_a", "_b", HOUR, closed=True)
    parts = [
        near.groupBy(*key).agg(F.count_distinct("channel_id").alias("ch10")),  # of the ten minutes only
        counts_within(triggers, ["object_id"], "us", one, e, key, soon, DAY).withColumnRenamed("w10_n", "tr10"),
        counts_within(noise, both, "us", one, e, key, soon, DAY).withColumnRenamed("w10_n", "marked10"),
        counts_within(triggers, both, "us", one, e, key, back, DAY).withColumnsRenamed({f"{w}_n": w for w in back}),
        counts_within(starts, both, "us", one | {"nz": F.col("_nz")}, e, key, long, 30 * DAY).withColumnsRenamed({f"{w}_n": w for w in long}).drop("ep_30d_nz"),
    ]
    out = e
    for p in parts:
        out = out.join(p, key, "left")
    share = F.when(F.col("ep_180d") > 0, F.col("ep_180d_nz") / F.col("ep_180d")).otherwise(F.lit(-1.0))
    return (
        out.fillna(0, subset=["ch10", "tr10", "marked10", *back, *long])
        .withColumn("noise_180d", share)
        .drop("ep_180d_nz")
        .withColumn("hour", F.hour(ts_of("t0")).cast("double"))
        .withColumn("dow", (F.dayofweek(ts_of("t0")) - 1).cast("double"))
    )


NOTICE_FEATURES = ["ch10", "tr10", "marked10", "prev_1h", "prev_24h", "prev_168h", "ep_30d", "ep_180d", "noise_180d", "hour", "dow"]


# ---- a short-horizon score over the daily one ---------------------------------------


def urgent_overlay(daily: DataFrame, urgent: DataFrame, by: list[str], share: float, shares: list[float], horizon: int = 6) -> DataFrame:
    """Episodes a short-horizon score adds to the daily one, with the false
    runs and hours it costs."""
    d_thr = M.threshold_for_share(daily, by, [share])
    d = M.alarm_rows(daily, d_thr, by)
    u_thr = M.threshold_for_share(urgent, by, shares)
    u = M.alarm_rows(urgent, u_thr, by, "share", horizon)
    eps = M.seen_episodes(daily, by)
    caught = M.catches(d, eps, by).select(*by, "object_id", "e")
    quick = M.catches(u, eps, by, ["share"], horizon)
    gained = quick.join(caught, [*by, "object_id", "e"], "left_anti").groupBy(*by, "share").agg(
        F.count(F.lit(1)).alias("gained"), F.percentile("lead", 0.5).alias("lead_median_h")
    )
    extra = u.join(d.select(*by, "object_id", "h"), [*by, "object_id", "h"], "left_anti")
    cost = M.signals(extra, [*by, "share"]).withColumn("false_runs", F.col("signals") - F.col("signals_true"))
    hours = extra.groupBy(*by, "share").agg(F.count(F.lit(1)).alias("extra_hours"))
    base = caught.groupBy(*by).agg(F.count(F.lit(1)).alias("caught_daily"))
    return (
        hours.join(cost.select(*by, "share", "false_runs"), [*by, "share"], "left")
        .join(gained, [*by, "share"], "left")
        .join(base, by, "left")
        .fillna(0, subset=["gained", "false_runs", "caught_daily"])
    )
