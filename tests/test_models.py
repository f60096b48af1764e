"""Models of all types, folds that stay apart and as rows; a replayed micro-batch replaces itself."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harness import DATA

from tocsin.plans import models as P
from tocsin.sources.sinks import scratch
from tocsin.streaming.common import put


def test_folds_without_model_stay(spark):
    mart = spark.range(300).select((F.col("id") % 3).alias("object_id"), F.floor(F.col("id") / 3).alias("h"), F.lit(None).cast("double").alias("next_gas"), F.rand(1).alias("x"))
    got = P.walk_forward(mart, "gas", ["x"], [], 40, 100, 30, "all", horizon=4, val_hours=10).collect()
    assert sorted((r["object_id"], r["h"]) for r in got) == sorted((o, h) for o in range(3) for h in range(40, 100))
    assert {(r["p"], r["alarm"], r["unscored"]) for r in got} == {(None, False, "too few positive rows")}
    assert {(r["h"] < 70, r["fold"]) for r in got} == {(True, 40), (False, 70)}


def test_replayed_batch_replaces_itself(spark):
    path = scratch(spark, "replay") + "/rows"
    for n in (0, 1, 1):
        put(spark.range(n * 10, n * 10 + 5), path, n)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [*range(5), *range(10, 15)]


def mart(spark, hours=400):
    """Hours of five objects: ``next_a`` is soon where x is high, ``next_b`` where it is low, ``next_c`` never."""
    rows = spark.range(5 * hours).select((F.col("id") % 5).alias("object_id"), F.floor(F.col("id") / 5).alias("h"), F.rand(3).alias("x"), F.rand(4).alias("z"))
    soon = lambda hit: F.when(hit, 2.0).otherwise(500.0)
    return rows.withColumns({"next_a": soon(F.col("x") > 0.8), "next_b": soon(F.col("x") < 0.3), "next_c": F.lit(None).cast("double")})


def test_all_types_from_one_table(spark):
    train, test = mart(spark).where("h < 300").cache(), mart(spark).where("h >= 300").cache()
    models = P.train_types(train, ["a", "b", "c"], lambda t: ["x", "z"], [], 250, trees=5, depth=3)
    assert models["c"] == "too few rows of a class"
    out = P.score_types(models, test, lambda t: ["x", "z"], []).collect()
    assert sorted((r["type"], r["object_id"], r["h"]) for r in out) == sorted((t, o, h) for t in "abc" for o in range(5) for h in range(300, 400))
    assert {(r["p"], r["unscored"]) for r in out if r["type"] == "c"} == {(None, "too few rows of a class")}
    for t in "ab":
        high = min(r["p"] for r in out if r["type"] == t and r["next"] == 2.0)
        low = sorted(r["p"] for r in out if r["type"] == t and r["next"] != 2.0)
        assert high > low[int(len(low) * 0.9)]
    assert {(r["type"], r["feature"]) for r in P.importance_of_types(spark, models).collect()} == {(t, f) for t in "ab" for f in "xz"}


def test_no_types_trained_on_no_rows(spark):
    models = P.train_types(mart(spark).where("h < 0"), ["a", "c"], lambda t: ["x"], [], 250)
    assert set(models.values()) == {"too few rows of a class"}
    assert P.score_types(models, mart(spark, 2), lambda t: ["x"], []).where("p IS NULL AND unscored IS NOT NULL").count() == 20
    assert P.importance_of_types(spark, models).count() == 0


def test_validation_is_a_later_block_with_a_gap(spark):
    got = P.later_block(spark.range(100).withColumnRenamed("id", "h"), 70, 24).collect()
    assert sorted((r["h"], r["is_val"]) for r in got) == [*((h, False) for h in range(46)), *((h, True) for h in range(70, 100))]


@pytest.mark.parametrize("gap", [0, 24])
def test_folds_stay_apart(spark, monkeypatch, gap):
    """What a fold's model read, beside the block that it scores."""
    rows = mart(spark, 300).withColumn("y", (F.col("next_a") < 24).cast("double"))
    train, score, fits, helds = P.train_gbt, P.score, [], []
    monkeypatch.setattr(P, "train_gbt", lambda data, *a, **k: (fits.append({r["h"] for r in data.select("h").collect()}), train(data, *a, **k))[1])
    monkeypatch.setattr(P, "score", lambda m, data, *a, **k: (helds.append({r["h"] for r in data.select("h").collect()}), score(m, data, *a, **k))[1])
    out = P.out_of_fold(rows, "h", ["x", "z"], "y", 3, trees=2, depth=2, gap=gap).collect()
    assert sorted((r["object_id"], r["h"]) for r in out) == sorted((o, h) for o in range(5) for h in range(300))
    assert len(fits) == 3 and all(r["oof"] is not None for r in out)
    for fit, held in zip(fits, helds, strict=True):
        apart = {h for h in range(300) if h < min(held) - gap or h > max(held) + gap}
        assert fit == apart - held


@pytest.mark.parametrize(
    ("name", "key", "sf", "types", "scored"),
    [
        ("train_gbt", ["type", "object_id", "h"], "0.001", 6, 4), ("importance_table", ["type", "feature"], "0.001", 4, 4), ("cascade_oof", ["type", "object_id", "h", "split"], "0.001", 4, 3),
        # noise enough for a filter is there from this size on, and only of fires and sensors
        ("notice_filter_oof", ["type", "object_id", "t0"], "0.01", 5, 2), ("walk_forward", ["type", "strategy", "object_id", "h"], "0.001", 6, 4),
    ],
)
def test_jobs_over_all_types(spark, name, key, sf, types, scored):
    out = entry.queries()[name](spark, f"{DATA}/sf{sf}").cache()
    assert out.count() == out.select(*key).distinct().count()
    assert out.select("type").distinct().count() == types
    score = {"train_gbt": "p", "importance_table": "importance", "cascade_oof": "oof", "notice_filter_oof": "oof", "walk_forward": "p"}[name]
    assert out.where(F.col(score).isNotNull()).select("type").distinct().count() >= scored
    if "unscored" in out.columns:
        assert out.where(F.col(score).isNull() != F.col("unscored").isNotNull()).count() == 0
