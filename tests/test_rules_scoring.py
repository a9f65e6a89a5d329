from __future__ import annotations

import pytest
from helpers import event, frame
from pyspark.sql import functions as F

from tallyguard.operators.rules import apply_rules, load_rules, parse_rules
from tallyguard.operators.scoring import LogisticScorer, decision_label, final_score, reason_codes, score
from tallyguard.plans.decisions import decide
from tallyguard.schemas import FEATURE_STRUCT, FEATURES, RULE_HIT


def with_features(spark, amount=25.0, **features):
    values = tuple(float(features.get(name, 0.0)) for name in FEATURES)
    schema = f"amount double, features {FEATURE_STRUCT.simpleString()}"
    return spark.createDataFrame([(amount, values)], schema)


def hits(spark, amount=25.0, **features):
    row = apply_rules(with_features(spark, amount, **features), load_rules()).first()
    return {h["rule_id"]: h for h in row["rule_hits"]}


def test_card_testing(spark):
    found = hits(spark, 9.0, tx_count_5m=5, time_since_last_tx_sec=20)
    assert "repeated_small_amount_card_testing" in found
    assert found["very_high_velocity"]["metadata"] == {"value": 5.0}
    assert found["very_high_velocity"]["feature"] == "tx_count_5m"


def test_impossible_travel_and_geo_combo(spark):
    found = hits(
        spark,
        500.0,
        geo_distance_from_last_tx_km=1700,
        time_since_last_tx_sec=900,
        international_mismatch=1,
        night_tx_flag=1,
    )
    assert list(found) == ["impossible_travel", "risky_geo_combo"]


def test_limits_are_inclusive(spark):
    assert "high_amount_on_new_device" in hits(spark, 1500.0, device_new_for_account=1)
    assert "high_amount_on_new_device" not in hits(spark, 1499.99, device_new_for_account=1)
    assert "impossible_travel" in hits(spark, geo_distance_from_last_tx_km=500, time_since_last_tx_sec=3600)
    assert "impossible_travel" not in hits(spark, geo_distance_from_last_tx_km=500, time_since_last_tx_sec=3601)


@pytest.mark.parametrize(
    "change", [{"severity": "fatal"}, {"type": "magic"}, {"op": "approximately"}]
)
def test_bad_rules_are_refused_at_load(change):
    rule = {
        "rule_id": "r",
        "type": "threshold",
        "severity": "low",
        "score_delta": 0.1,
        "explanation": "",
        "feature": "amount",
        "op": "gt",
        "threshold": 1,
    }
    parse_rules([rule])
    with pytest.raises(ValueError):
        parse_rules([{**rule, **change}])
    with pytest.raises(ValueError):
        parse_rules([rule, rule])


def verdict(spark, probability, severities):
    rows = [("r", s, 0.32, "", None, {}) for s in severities]
    df = spark.createDataFrame(
        [(probability, rows)], f"p double, hits array<{RULE_HIT.simpleString()}>"
    )
    total = final_score(F.col("p"), F.col("hits"))
    return df.select(
        total.alias("score"),
        decision_label(total, F.col("hits"), F.lit(0.55), F.lit(0.82)).alias("decision"),
    ).first()


def test_critical_hit_blocks(spark):
    row = verdict(spark, 0.41, ["critical"])
    assert row["decision"] == "BLOCK"
    assert row["score"] == pytest.approx(0.41 * 0.78 + 0.22 + 0.32 * 0.25)


def test_decisions_by_score_and_severity(spark):
    assert verdict(spark, 0.1, [])["decision"] == "APPROVE"
    assert verdict(spark, 0.1, ["high"])["decision"] == "REVIEW"
    assert verdict(spark, 0.1, ["medium", "low"])["decision"] == "APPROVE"
    assert verdict(spark, 0.72, [])["decision"] == "REVIEW"
    assert verdict(spark, 1.0, ["low", "medium"])["decision"] == "BLOCK"
    assert verdict(spark, 1.0, ["critical"] * 5)["score"] == 1.0


def test_rule_share_is_limited(spark):
    assert verdict(spark, 0.0, ["critical", "high", "medium"])["score"] == pytest.approx(0.35)


def test_reasons_name_rules_first_and_stop_at_eight(spark):
    df = apply_rules(
        with_features(
            spark,
            10.0,
            tx_count_5m=7,
            geo_distance_from_last_tx_km=800,
            device_new_for_account=1,
            amount_vs_recent_avg_ratio=4.2,
            high_risk_merchant_flag=1,
            failed_auth_count_recent=2,
            time_since_last_tx_sec=10,
        ),
        load_rules(),
    )
    codes = [r["code"] for r in df.select(reason_codes(F.col("features"), F.col("rule_hits")).alias("r")).first()["r"]]
    assert codes == [
        "rule:impossible_travel",
        "rule:very_high_velocity",
        "rule:repeated_small_amount_card_testing",
        "rule:blacklist_hit",
        "velocity_spike",
        "geo_jump",
        "new_device",
        "amount_spike",
    ]


def test_scorer_treats_missing_features_as_zero(spark):
    df = with_features(spark).withColumn("rule_hits", F.array().cast(f"array<{RULE_HIT.simpleString()}>"))
    nulls = df.withColumn("features", F.struct(*[F.lit(None).cast("double").alias(f) for f in FEATURES]))
    scorer = LogisticScorer()
    assert score(df, scorer).first()["model_probability"] == score(nulls, scorer).first()["model_probability"]


def test_decide_gives_one_open_case_per_event(spark):
    rows = decide(frame(spark, [event(1), event(2, 5)])).collect()
    assert len({r["case_id"] for r in rows}) == 2
    assert {r["status"] for r in rows} == {"open"}
    assert rows[0]["model_metadata"]["review_threshold"] == 0.55
