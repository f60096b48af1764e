"""Registered queries beside their checking SQL at the smallest size, and the
plans behind them."""

import re

import pytest

import __spark_entry__ as entry
from harness import DATA, compare, duck, types_of
from tocsin.catalog import load

SF = f"{DATA}/sf0.001"
# state machines, model training and pieces whose check is elsewhere in tests
NO_SQL = {
    "feature_families", "snapshot_diff", "budget_split", "train_gbt",
    "importance_table", "cascade_oof", "walk_forward", "notice_filter_oof", "sensor_model", "route_extent", "alarm_rules",
    "decision_events", "fact_clears", "alarm_rules_stream", "walk_compare",
}
CHECKED = """trig_classify guard_timeline arrival_flag noise_mass visit_trace episodes episode_confirmed noise_works restart_flag service_sessions
hour_grid window_sum object_features targets mart_assemble calendar join_hourly_pack pr_curve signals evaluate psi false_hour_curve fold_rank
rolling_threshold dispatch_load own_threshold silence_table mix_reference_scale clean_dedup ingest_normalize ingest_rejects reference_upsert
evidence temp_episodes blind_episodes live_facts spike_flag flapping_flag channel_silence commands_dedupe works_mute pair_hours weather_base
sensor_features picket_parse rec_context rec_assemble audit_parse group_closure work_intervals notice_rules confidence_table""".split()


def test_inventory():
    qs, sql = load()
    assert set(qs) - set(sql) == NO_SQL
    assert set(sql) <= set(qs)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql()[name]
    assert compare(name, df, con, sql) in ("", "EMPTY")
    assert not types_of(df, con, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filter_pushed(spark):
    from tocsin.catalog.site import journal
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{SF}/events.parquet").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("user_id", "ts")
    plan = plan_of(e)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(journal(spark, SF).select("us", "stype"))).group(1)
    assert "props" not in schema and "event_id" not in schema


@pytest.mark.parametrize("name", ["episodes", "noise_mass", "pair_hours", "pr_curve", "spread_features", "blind_link", "rec_context", "notice_rules"])
def test_no_cross_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
