"""Contract types, enumerations and feature order shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the event contract.
DECISIONS = ["APPROVE", "REVIEW", "BLOCK"]
FEEDBACK_LABELS = ["fraud", "false_positive", "legitimate", "review"]
SEVERITIES = ["low", "medium", "high", "critical"]
CHANNELS = ["pos", "ecommerce", "upi", "wallet", "transfer"]
PAYMENT_METHODS = ["credit_card", "debit_card", "upi", "wallet", "bank_transfer"]
SCENARIOS = [
    "normal_behavior",
    "velocity_burst_fraud",
    "impossible_travel",
    "card_testing",
    "account_takeover",
    "new_device_high_amount",
    "risky_merchant_pattern",
]

# The model's feature order.
FEATURES = [
    "amount",
    "prior_auth_failures",
    "card_present",
    "is_international",
    "tx_count_1m",
    "tx_count_5m",
    "tx_count_1h",
    "spend_sum_1h",
    "spend_avg_30d_proxy",
    "amount_vs_recent_avg_ratio",
    "device_new_for_account",
    "merchant_new_for_account",
    "geo_distance_from_last_tx_km",
    "time_since_last_tx_sec",
    "failed_auth_count_recent",
    "international_mismatch",
    "night_tx_flag",
    "high_risk_merchant_flag",
    "account_age_days",
    "account_merchant_tx_count_30d",
    "channel_ecommerce",
    "channel_pos",
    "channel_upi",
    "channel_wallet",
    "channel_transfer",
]

# Topic names.
RAW_TOPIC = "tx.raw"
VALIDATED_TOPIC = "tx.validated"
ENRICHED_TOPIC = "tx.enriched"
SCORED_TOPIC = "tx.scored"
DECISIONS_TOPIC = "tx.decisions"
FEEDBACK_TOPIC = "tx.feedback"
DLQ_TOPIC = "tx.dlq"

# Trailing windows, state lifetime and default thresholds.
WINDOW_1M = 60
WINDOW_5M = 300
WINDOW_1H = 3600
STATE_TTL_SECONDS = 2_592_000
FIRST_EVENT_GAP_SECONDS = 86_400.0
REVIEW_THRESHOLD = 0.55
BLOCK_THRESHOLD = 0.82

TRANSACTION = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("payment_instrument_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("channel", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_agent_hash", T.StringType()),
        T.StructField("email_hash", T.StringType()),
        T.StructField("phone_hash", T.StringType()),
        T.StructField("prior_auth_failures", T.IntegerType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("card_present", T.BooleanType()),
        T.StructField("is_international", T.BooleanType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("simulation_scenario", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
CONTRACT = TRANSACTION.fieldNames()

RULE_HIT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("score_delta", T.DoubleType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

REASON = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

MODEL_METADATA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("model_alias", T.StringType()),
        T.StructField("registered_at", T.TimestampType()),
        T.StructField("review_threshold", T.DoubleType()),
        T.StructField("block_threshold", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("feedback_id", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("analyst_id", T.StringType()),
        T.StructField("feedback_label", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

FEATURE_STRUCT = T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])
