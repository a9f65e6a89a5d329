from __future__ import annotations

import pytest
from helpers import assert_features, event, expected_features, frame, random_events
from pyspark.sql import functions as F

from tallyguard.operators.features import add_features, trailing_counts_by_range


def by_seq(df):
    return {r["event_seq"]: r["features"] for r in df.collect()}


@pytest.mark.parametrize("seed,chunk_rows", [(1, 1_000_000), (2, 40), (3, 5)])
def test_matches_brute_force_with_ties_and_split_accounts(spark, seed, chunk_rows):
    rows = random_events(seed)
    df = add_features(frame(spark, rows).repartition(5), chunk_rows=chunk_rows)
    assert_features(df, expected_features(rows))


def test_second_event_sees_the_first(spark):
    rows = [event(1), event(2, 30, amount=250.0)]
    f = by_seq(add_features(frame(spark, rows)))
    assert f[1]["device_new_for_account"] == 1.0
    assert f[1]["time_since_last_tx_sec"] == 86_400.0
    assert f[2]["tx_count_1m"] >= 1.0
    assert f[2]["device_new_for_account"] == 0.0
    assert f[2]["amount_vs_recent_avg_ratio"] > 1.0


def test_long_jump_between_cities(spark):
    rows = [event(1, city="Oslo"), event(2, 300, city="Lisbon")]
    assert by_seq(add_features(frame(spark, rows)))[2]["geo_distance_from_last_tx_km"] > 1000.0


@pytest.mark.parametrize("age,expected", [(60, (1, 1, 1)), (60.000001, (0, 1, 1)), (300, (0, 1, 1)), (301, (0, 0, 1)), (3600, (0, 0, 1)), (3600.000001, (0, 0, 0))])
def test_windows_are_closed(spark, age, expected):
    f = by_seq(add_features(frame(spark, [event(1), event(2, age)])))[2]
    assert (f["tx_count_1m"], f["tx_count_5m"], f["tx_count_1h"]) == expected


def test_events_at_the_same_time_count_in_arrival_order(spark):
    f = by_seq(add_features(frame(spark, [event(3), event(1), event(2)])))
    assert [f[i]["tx_count_1m"] for i in (1, 2, 3)] == [0, 1, 2]


def test_risk_flag_crosses_accounts_but_not_time(spark):
    rows = [
        event(1, 0, account_id="a"),
        event(2, 10, account_id="b", metadata={"merchant_risk_level": "high"}),
        event(3, 20, account_id="c"),
        event(4, 20, account_id="c", merchant_id="other"),
    ]
    f = by_seq(add_features(frame(spark, rows)))
    assert [f[i]["high_risk_merchant_flag"] for i in (1, 2, 3, 4)] == [0, 1, 1, 0]


def test_state_lifetime_starts_history_anew(spark):
    day = 86_400
    rows = [event(1), event(2, 2 * day), event(3, 2 * day + 31 * day), event(4, 2 * day + 31 * day + 5)]
    kept = by_seq(add_features(frame(spark, rows)))
    lived = by_seq(add_features(frame(spark, rows), state_ttl_seconds=30 * day))
    assert kept[3]["device_new_for_account"] == 0.0
    assert lived[2]["device_new_for_account"] == 0.0
    assert lived[3]["device_new_for_account"] == 1.0
    assert lived[3]["time_since_last_tx_sec"] == 86_400.0
    assert lived[4]["account_merchant_tx_count_30d"] == 1.0


def test_range_form_equals_expiry_form(spark):
    rows = random_events(7, 200)
    events = frame(spark, rows)
    ranged = {r["event_seq"]: (r["n_short"], r["n_medium"], r["n_long"]) for r in trailing_counts_by_range(events).collect()}
    f = by_seq(add_features(events, chunk_rows=20))
    assert ranged == {s: (v["tx_count_1m"], v["tx_count_5m"], v["tx_count_1h"]) for s, v in f.items()}


def test_one_wide_shuffle_and_no_python(spark):
    df = add_features(frame(spark, random_events(1, 50)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("ENSURE_REQUIREMENTS") <= 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_session_time_zone_does_not_matter(spark):
    rows = random_events(5, 60)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert_features(add_features(frame(spark, rows)), expected_features(rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_spend_is_exact(spark):
    rows = [event(i, i, amount=0.1) for i in range(50)]
    f = add_features(frame(spark, rows)).where(F.col("event_seq") == 49).first()["features"]
    assert f["spend_sum_1h"] == 4.9


def test_tasks_follow_the_events_not_the_shuffled_bytes(spark, monkeypatch):
    from tallyguard.operators import features

    monkeypatch.setattr(features, "EVENTS_PER_TASK", 60)
    rows = random_events(5, 300)
    for chunk_rows in (1_000_000, 20):
        found = add_features(frame(spark, rows), chunk_rows=chunk_rows)
        # The windows take the rows as they were dealt: no second exchange joins them again.
        assert found.rdd.getNumPartitions() == 5
        assert found.count() == len(rows)
