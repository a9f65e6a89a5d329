"""Queries over events: scans, decoding, routing, de-duplication, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.functions.scalars import (
    epoch_millis,
    hour_start,
    identity_hash,
    relative_age,
    round_exact,
    scenario_label,
    time_until,
)
from tallyguard.operators.dedupe import claim_first, duplicate_deliveries, duplicate_report, latest_per_key
from tallyguard.operators.features import (
    account_context,
    add_features,
    first_risk_marks,
    trailing_counts_by_range,
)
from tallyguard.operators.metrics import counters
from tallyguard.operators.skew import lookup
from tallyguard.operators.validate import contract_columns, dead_letters, normalise, route_messages, valid_events
from tallyguard.plans.oracle_parts import FEATURE_LIST, compared_sql, features_cte, uuid_sql
from tallyguard.plans.registry import AS_OF, WITH_FEATURES, WITH_MESSAGES, WITH_TX, query
from tallyguard.plans.training import feature_frame
from tallyguard.schemas import FEATURES
from tallyguard.session import work_dir, written
from tallyguard.sources.adapter import (
    epoch_micros,
    load_transactions,
    raw_messages,
    read_table,
    repeated_messages,
    transactions,
)
from tallyguard.sources.json_events import coerce_training_rows
from tallyguard.sources.sinks import dead_letter_messages, export_csv
from tallyguard.sources.tables import read_csv_events

FEATURE_INPUT = [
    "event_id",
    "event_time",
    "account_id",
    "merchant_id",
    "amount",
    "country",
    "latitude",
    "longitude",
    "channel",
    "device_id",
    "prior_auth_failures",
    "card_present",
    "is_international",
    "metadata",
    "event_seq",
]


def event_seconds(column: str = "event_time"):
    return F.unix_seconds(F.col(column)).alias("t")


def compared(name: str, column):
    """A feature rounded to six digits; the age, whose sixth digit may be a tie, in whole seconds."""
    if name == "account_age_days":
        return F.round(column * 86_400).cast("bigint").alias("account_age_seconds")
    return F.round(column, 6).alias(name)


def picked(df, *names: str):
    """Event key and some features, rounded for comparison."""
    return df.select("event_seq", *[compared(n, F.col("features")[n]) for n in names])


def picked_sql(*names: str) -> str:
    columns = ", ".join(map(compared_sql, names))
    return f"{WITH_FEATURES} SELECT event_seq, {columns} FROM feats"


def feature_input(spark, sf_dir):
    return load_transactions(spark, sf_dir).select(*FEATURE_INPUT)


@query(
    "transactions",
    f"""{WITH_TX} SELECT event_id, event_seq, t, account_id, customer_id, transaction_id, merchant_id, merchant_category,
    amount, currency, country, city, latitude, longitude, channel, device_id, CAST(prior_auth_failures AS BIGINT) AS prior_auth_failures,
    payment_method, card_present, is_international, CAST(label AS BIGINT) AS label, simulation_scenario,
    CASE WHEN risky THEN 'high' ELSE 'low' END AS risk_level FROM tx""",
)
def _transactions(spark, sf_dir):
    tx = load_transactions(spark, sf_dir)
    names = (
        "event_id event_seq account_id customer_id transaction_id merchant_id merchant_category amount currency "
        "country city latitude longitude channel device_id payment_method card_present is_international "
        "simulation_scenario"
    ).split()
    return tx.select(
        *names,
        event_seconds(),
        F.col("prior_auth_failures").cast("bigint").alias("prior_auth_failures"),
        F.col("label").cast("bigint").alias("label"),
        F.col("metadata")["merchant_risk_level"].alias("risk_level"),
    )


@query(
    "decoded_events",
    f"""{WITH_MESSAGES} SELECT event_id, transaction_id, account_id, amount, channel, t, card_present,
    CAST(label AS BIGINT) AS label, country, latitude FROM valid_tx""",
)
def _decoded_events(spark, sf_dir):
    events = valid_events(route_messages(raw_messages(load_transactions(spark, sf_dir))))
    return events.select(
        "event_id",
        "transaction_id",
        "account_id",
        "amount",
        "channel",
        event_seconds(),
        "card_present",
        F.col("label").cast("bigint").alias("label"),
        "country",
        "latitude",
    )


@query(
    "message_routes",
    f"{WITH_MESSAGES} SELECT event_seq, route, error_message FROM messages",
)
def _message_routes(spark, sf_dir):
    routed = route_messages(raw_messages(load_transactions(spark, sf_dir)))
    return routed.select("event_seq", "route", "error_message")


EXTREMES = ["inf", "nan", "1e12", "1e15", "-inf"]


@query(
    "extreme_amounts",
    f"""{WITH_MESSAGES}, m AS (SELECT *, event_seq // 5 % 5 AS i, route <> 'validation' AND event_seq % 5 = 0 AS extreme FROM messages)
    SELECT event_seq, CASE WHEN extreme THEN 'processing' ELSE route END AS route, CASE WHEN extreme THEN concat_ws(', ',
      CASE WHEN i = 4 THEN 'amount must be positive' END, 'amount must be a number below 1000000000000',
      CASE WHEN event_seq % 71 = 0 AND event_seq % 73 <> 0 THEN 'prior_auth_failures cannot be negative' END) ELSE error_message END AS error_message,
    CASE WHEN extreme OR route <> 'good' THEN 0 ELSE 1 END AS decided FROM m""",
)
def _extreme_amounts(spark, sf_dir):
    """Every fifth message has an amount that no column can hold; all the others are decided."""
    from tallyguard.plans.decisions import decide

    seq = F.col("event_seq")
    chosen = F.get(F.array(*[F.lit(x) for x in EXTREMES]), (F.floor(seq / 5) % 5).cast("int"))
    changed = F.regexp_replace(
        "value", F.lit('"amount":"?[0-9.Ee+-]+"?'), F.concat(F.lit('"amount":"'), chosen, F.lit('"'))
    )
    messages = raw_messages(load_transactions(spark, sf_dir))
    messages = messages.withColumn("value", F.when(seq % 5 == 0, changed).otherwise(F.col("value")))
    routed = written(route_messages(messages), "routed")
    decided = decide(valid_events(routed)).select("event_seq", F.lit(1).alias("decided"))
    return lookup(routed.select("event_seq", "route", "error_message"), decided, ["event_seq"], "event_seq").fillna(
        0, ["decided"]
    )


@query(
    "dead_letters",
    f"""{WITH_MESSAGES} SELECT {uuid_sql("'tx.raw:' || event_seq || ':' || route")} AS dead_letter_id,
    CASE WHEN route = 'processing' THEN event_id END AS event_id, 'tx.raw' AS source_topic,
    route AS failed_stage, error_message, CASE WHEN route = 'processing' THEN transaction_id END AS transaction_id
    FROM messages WHERE route <> 'good'""",
)
def _dead_letters(spark, sf_dir):
    letters = dead_letters(route_messages(raw_messages(load_transactions(spark, sf_dir))))
    return letters.select(
        "dead_letter_id",
        "event_id",
        "source_topic",
        "failed_stage",
        "error_message",
        F.get_json_object("raw_payload", "$.transaction_id").alias("transaction_id"),
    )


@query(
    "dead_letter_messages",
    f"""{WITH_MESSAGES} SELECT CASE WHEN route = 'processing' THEN event_id END AS message_key, 'tx.dlq' AS topic,
    route AS failed_stage FROM messages WHERE route <> 'good'""",
)
def _dead_letter_messages(spark, sf_dir):
    letters = dead_letters(route_messages(raw_messages(load_transactions(spark, sf_dir))))
    return dead_letter_messages(letters).select(
        F.col("key").alias("message_key"), "topic", F.get_json_object("value", "$.failed_stage").alias("failed_stage")
    )


@query(
    "source_errors",
    f"""{WITH_TX} SELECT 'kafka_source' AS failed_stage, 'source delivered no value' AS error_message,
    '{{"error":"source delivered no value"}}' AS raw_payload, count(*) AS letters FROM tx WHERE event_seq % 11 = 0""",
)
def _source_errors(spark, sf_dir):
    messages = raw_messages(load_transactions(spark, sf_dir))
    lost = messages.withColumn("value", F.when(F.col("event_seq") % 11 != 0, F.col("value")))
    letters = dead_letters(route_messages(lost)).where("failed_stage = 'kafka_source'")
    return letters.groupBy("failed_stage", "error_message", "raw_payload").agg(F.count(F.lit(1)).alias("letters"))


@query(
    "normalised_events",
    f"""{WITH_TX} SELECT event_id, CAST(printf('%.2f', amount * 1.2345e0) AS DOUBLE) AS normalized_amount,
    upper(currency) AS normalized_currency, 'valid' AS validation_status, 'tx.raw' AS received_topic FROM tx""",
)
def _normalised_events(spark, sf_dir):
    events = load_transactions(spark, sf_dir).withColumn("amount", F.col("amount") * 1.2345)
    return normalise(events).select(
        "event_id", "normalized_amount", "normalized_currency", "validation_status", "received_topic"
    )


@query(
    "rounded_prices",
    """SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', CAST(l_extendedprice AS DOUBLE) * (1e0 - CAST(l_discount AS DOUBLE))) AS DOUBLE)
    AS net FROM lineitem""",
)
def _rounded_prices(spark, sf_dir):
    net = F.col("l_extendedprice").cast("double") * (F.lit(1.0) - F.col("l_discount").cast("double"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", round_exact(net).alias("net"))


def _repeated(spark, sf_dir):
    return valid_events(route_messages(repeated_messages(raw_messages(load_transactions(spark, sf_dir)))))


@query(
    "claimed_events",
    f"{WITH_MESSAGES} SELECT event_id, transaction_id, event_seq, t, amount FROM valid_tx",
)
def _claimed_events(spark, sf_dir):
    return claim_first(_repeated(spark, sf_dir)).select(
        "event_id", "transaction_id", "event_seq", event_seconds(), "amount"
    )


@query(
    "duplicate_deliveries",
    f"""{WITH_MESSAGES} SELECT event_id, event_seq + 1000000000000 AS event_seq FROM valid_tx WHERE event_seq % 50 = 0""",
)
def _duplicate_deliveries(spark, sf_dir):
    return duplicate_deliveries(_repeated(spark, sf_dir)).select("event_id", "event_seq")


@query(
    "duplicate_report",
    f"""{WITH_MESSAGES} SELECT count(*) + count(*) FILTER (event_seq % 50 = 0) AS deliveries, count(*) AS events,
    count(*) FILTER (event_seq % 50 = 0) AS duplicates FROM valid_tx""",
)
def _duplicate_report(spark, sf_dir):
    return duplicate_report(_repeated(spark, sf_dir))


@query(
    "latest_event_per_account",
    f"""{WITH_TX} SELECT account_id, event_seq, t, amount, country FROM tx
    QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY t DESC, event_seq DESC) = 1""",
)
def _latest_event_per_account(spark, sf_dir):
    tx = load_transactions(spark, sf_dir).select("account_id", "event_seq", "event_time", "amount", "country")
    latest = latest_per_key(tx, ["account_id"], ["event_time", "event_seq"])
    return latest.select("account_id", "event_seq", event_seconds(), "amount", "country")


@query(
    "csv_round_trip",
    f"""{WITH_TX} SELECT event_id, transaction_id, t, amount, CAST(label AS BIGINT) AS label, is_international,
    CASE WHEN risky THEN 'high' ELSE 'low' END AS risk_level FROM tx""",
)
def _csv_round_trip(spark, sf_dir):
    path = work_dir(spark, "csv")
    export_csv(load_transactions(spark, sf_dir), path)
    return read_csv_events(spark, path).select(
        "event_id",
        "transaction_id",
        event_seconds(),
        "amount",
        F.col("label").cast("bigint").alias("label"),
        "is_international",
        F.col("metadata")["merchant_risk_level"].alias("risk_level"),
    )


@query(
    "coerced_training_rows",
    f"""{WITH_TX} SELECT event_id, amount, CASE WHEN risky THEN 'high' ELSE 'low' END AS risk_level,
    CAST(27 AS BIGINT) AS fields FROM tx""",
)
def _coerced_training_rows(spark, sf_dir):
    tx = load_transactions(spark, sf_dir)
    quoted = F.concat(F.lit("{'merchant_risk_level': '"), F.col("metadata")["merchant_risk_level"], F.lit("'}"))
    rows = tx.withColumns({"metadata": quoted, "amount": F.col("amount").cast("string"), "extra": F.lit(1)})
    coerced = coerce_training_rows(rows.drop("event_seq", "amount_exact"))
    return coerced.select(
        "event_id",
        "amount",
        F.col("metadata")["merchant_risk_level"].alias("risk_level"),
        F.lit(len(contract_columns(coerced).columns)).cast("bigint").alias("fields"),
    )


@query(
    "identity_hashes",
    f"""{WITH_TX} SELECT event_seq, substr(sha256(account_id || ':' || device_id), 1, 16) AS user_agent_hash FROM tx""",
)
def _identity_hashes(spark, sf_dir):
    tx = load_transactions(spark, sf_dir)
    return tx.select(
        "event_seq", identity_hash(F.concat_ws(":", "account_id", "device_id")).alias("user_agent_hash")
    )


@query(
    "display_texts",
    f"""{WITH_TX}, aged AS (SELECT event_seq, t, simulation_scenario, {AS_OF} - t AS age, t - {AS_OF - 43200} AS ahead FROM tx)
    SELECT event_seq, t * 1000 AS millis, t // 3600 * 3600 AS hour,
      CASE simulation_scenario WHEN 'normal_behavior' THEN 'normal behavior' WHEN 'impossible_travel' THEN 'impossible travel'
        WHEN 'account_takeover' THEN 'account takeover' ELSE 'new device high amount' END AS scenario,
      CASE WHEN age < 5 THEN 'updated just now' WHEN age < 60 THEN 'updated ' || age || 's ago'
        ELSE 'updated ' || CAST(floor(age / 60e0 + 0.5e0) AS BIGINT) || 'm ago' END AS age_text,
      CASE WHEN ahead < 5 THEN 'expires in a few seconds' WHEN ahead < 60 THEN 'expires in ' || ahead || 's'
        ELSE 'expires in ' || CAST(floor(ahead / 60e0 + 0.5e0) AS BIGINT) || 'm' END AS ahead_text
    FROM aged""",
)
def _display_texts(spark, sf_dir):
    tx = load_transactions(spark, sf_dir)
    ts = F.col("event_time")
    return tx.select(
        "event_seq",
        epoch_millis(ts).alias("millis"),
        hour_start(F.unix_micros(ts)).alias("hour"),
        scenario_label(F.col("simulation_scenario")).alias("scenario"),
        relative_age(ts, F.timestamp_seconds(F.lit(AS_OF))).alias("age_text"),
        time_until(ts, F.timestamp_seconds(F.lit(AS_OF - 43_200))).alias("ahead_text"),
    )


VELOCITY = ["tx_count_1m", "tx_count_5m", "tx_count_1h", "spend_sum_1h", "failed_auth_count_recent"]
NOVELTY = ["device_new_for_account", "merchant_new_for_account", "account_merchant_tx_count_30d"]
TRAVEL = [
    "geo_distance_from_last_tx_km",
    "time_since_last_tx_sec",
    "international_mismatch",
    "account_age_days",
]
PROFILE = [
    "amount",
    "prior_auth_failures",
    "card_present",
    "is_international",
    "spend_avg_30d_proxy",
    "amount_vs_recent_avg_ratio",
    "night_tx_flag",
    "high_risk_merchant_flag",
    *[f for f in FEATURES if f.startswith("channel_")],
]


@query("velocity_features", picked_sql(*VELOCITY))
def _velocity_features(spark, sf_dir):
    return picked(add_features(feature_input(spark, sf_dir)), *VELOCITY)


@query("novelty_features", picked_sql(*NOVELTY))
def _novelty_features(spark, sf_dir):
    return picked(add_features(feature_input(spark, sf_dir)), *NOVELTY)


@query("travel_features", picked_sql(*TRAVEL))
def _travel_features(spark, sf_dir):
    return picked(add_features(feature_input(spark, sf_dir)), *TRAVEL)


@query("profile_features", picked_sql(*PROFILE))
def _profile_features(spark, sf_dir):
    return picked(add_features(feature_input(spark, sf_dir)), *PROFILE)


FRAME_SQL = f"""{WITH_FEATURES} SELECT event_seq, t, {FEATURE_LIST}, CAST(coalesce(label, 0) AS BIGINT) AS label, simulation_scenario FROM feats"""


def _frame(events, **options):
    rows = feature_frame(events, **options)
    return rows.select(
        "event_seq",
        F.floor(F.col("event_us") / 1_000_000).cast("bigint").alias("t"),
        *[compared(f, F.col(f)) for f in FEATURES],
        F.col("label").cast("bigint").alias("label"),
        "simulation_scenario",
    )


@query("feature_frame", FRAME_SQL)
def _feature_frame(spark, sf_dir):
    return _frame(load_transactions(spark, sf_dir))


@query("feature_frame_split_accounts", FRAME_SQL)
def _feature_frame_split_accounts(spark, sf_dir):
    """The same features with every account cut into many time chunks."""
    return _frame(load_transactions(spark, sf_dir), chunk_rows=50)


@query(
    "trailing_counts_by_range",
    f"""{WITH_FEATURES} SELECT event_seq, CAST(n_short AS BIGINT) AS n_short, CAST(n_medium AS BIGINT) AS n_medium,
    CAST(n_long AS BIGINT) AS n_long FROM feats""",
)
def _trailing_counts_by_range(spark, sf_dir):
    tx = load_transactions(spark, sf_dir).select("event_seq", "event_time", "account_id")
    return trailing_counts_by_range(tx).select("event_seq", "n_short", "n_medium", "n_long")


LIFETIME = 3 * 86_400


def _slow_events(spark, sf_dir):
    """Transactions at their real pace, one account per user: accounts fall silent for days."""
    events = read_table(spark, sf_dir, "events")
    real = events.select(
        F.col("event_id").alias("event_seq"),
        F.timestamp_seconds(F.floor(epoch_micros(events, "ts") / 1_000_000)).alias("event_time"),
        F.concat(F.lit("acct_"), F.col("user_id").cast("string")).alias("account_id"),
    )
    tx = transactions(events).drop("event_time", "account_id")
    return tx.join(real, "event_seq")


@query(
    "features_with_state_lifetime",
    f"""{WITH_TX}, slow0 AS (
      SELECT tx.* REPLACE (epoch_us(e.ts) // 1000000 AS t, 'acct_' || e.user_id AS account_id), 'acct_' || e.user_id AS account
      FROM tx JOIN events e ON e.event_id = tx.event_seq),
    slow1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY account_id ORDER BY t, event_seq) > {LIFETIME} THEN 1 ELSE 0 END AS gone FROM slow0),
    slow AS (SELECT * REPLACE (account_id || '#' || sum(gone) OVER (PARTITION BY account_id ORDER BY t, event_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS account_id) FROM slow1),
    {features_cte('slow', 'lived')}
    SELECT event_seq, account, round(spend_avg_30d_proxy, 6) AS spend_avg_30d_proxy, device_new_for_account, time_since_last_tx_sec,
      round(account_age_days, 6) AS account_age_days, account_merchant_tx_count_30d, high_risk_merchant_flag FROM lived""",
)
def _features_with_state_lifetime(spark, sf_dir):
    rows = add_features(_slow_events(spark, sf_dir), state_ttl_seconds=LIFETIME)
    f = F.col("features")
    return rows.select(
        "event_seq",
        F.col("account_id").alias("account"),
        F.round(f["spend_avg_30d_proxy"], 6).alias("spend_avg_30d_proxy"),
        f["device_new_for_account"].alias("device_new_for_account"),
        f["time_since_last_tx_sec"].alias("time_since_last_tx_sec"),
        F.round(f["account_age_days"], 6).alias("account_age_days"),
        f["account_merchant_tx_count_30d"].alias("account_merchant_tx_count_30d"),
        f["high_risk_merchant_flag"].alias("high_risk_merchant_flag"),
    )


@query(
    "account_context",
    f"""{WITH_FEATURES} SELECT event_seq, account_id, CAST(life_n AS BIGINT) AS rolling_count,
    round(coalesce(CAST(life_sum AS DOUBLE), 0e0), 6) AS rolling_sum, t0 AS last_t, country0 AS last_country,
    CASE WHEN life_n > 0 THEN t_first END AS first_t, device_rn > 1 AS known_device, merchant_rn > 1 AS known_merchant,
    CAST(n_long AS BIGINT) AS recent_count, risk = 1 AS high_risk_merchant FROM feats""",
)
def _account_context(spark, sf_dir):
    context = account_context(feature_input(spark, sf_dir))
    return context.select(
        "event_seq",
        "account_id",
        "rolling_count",
        F.round("rolling_sum", 6).alias("rolling_sum"),
        F.unix_seconds("last_time").alias("last_t"),
        "last_country",
        F.unix_seconds("first_seen").alias("first_t"),
        "known_device",
        "known_merchant",
        "recent_count",
        "high_risk_merchant",
    )


@query(
    "merchant_risk_marks",
    f"""{WITH_TX} SELECT merchant_id, t, event_seq FROM tx WHERE risky
    QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY t, event_seq) = 1""",
)
def _merchant_risk_marks(spark, sf_dir):
    marks = first_risk_marks(feature_input(spark, sf_dir))
    return marks.select(
        "merchant_id",
        F.floor(F.col("__risk")["us"] / 1_000_000).cast("bigint").alias("t"),
        F.col("__risk")["seq"].alias("event_seq"),
    )


@query(
    "events_at_risky_merchants",
    f"{WITH_TX} SELECT event_seq, merchant_id FROM tx WHERE merchant_id IN (SELECT merchant_id FROM tx WHERE risky)",
)
def _events_at_risky_merchants(spark, sf_dir):
    events = feature_input(spark, sf_dir)
    risky = first_risk_marks(events).select("merchant_id")
    return lookup(events, risky, ["merchant_id"], "event_seq", how="left_semi").select("event_seq", "merchant_id")


@query(
    "events_by_scenario_and_label",
    f"""{WITH_TX} SELECT simulation_scenario, CAST(label AS BIGINT) AS label, count(*) AS events FROM tx GROUP BY ALL""",
)
def _events_by_scenario_and_label(spark, sf_dir):
    counts = counters(load_transactions(spark, sf_dir), "simulation_scenario", "label")
    return counts.withColumn("label", F.col("label").cast("bigint"))
