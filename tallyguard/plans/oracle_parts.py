"""SQL building blocks for the cross-check of each query on another engine.

The SQL states the semantics directly (range frames, self-evident filters) and shares nothing
with the Spark builders but the fixed values of rules, weights and windows.
"""

from __future__ import annotations

from tallyguard.schemas import CHANNELS, FEATURES

TX = """
tx0 AS (
  SELECT event_id AS event_seq,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000.0) AS BIGINT) + 1704067200 + 64800 AS t,
         CAST(floor(user_id / 10.0) AS BIGINT) AS acct,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         event_type AS kind, value
  FROM events),
tx1 AS (
  SELECT *,
    CASE kind WHEN 'click' THEN 'ecommerce' WHEN 'view' THEN 'pos' WHEN 'purchase' THEN 'upi'
              WHEN 'signup' THEN 'wallet' WHEN 'error' THEN 'transfer' END AS channel,
    CASE WHEN k BETWEEN 90 AND 92 THEN 5 WHEN k BETWEEN 93 AND 94 THEN 6 ELSE CAST(acct % 5 AS INTEGER) END AS city_no,
    CAST(value * 10 AS DECIMAL(14,2)) AS amount_exact,
    lpad(lower(to_hex(event_seq)), 16, '0') AS hex_seq
  FROM tx0),
tx AS (
  SELECT event_seq, t, k, amount_exact,
    '00000000-0000-0000-' || substr(hex_seq, 1, 4) || '-' || substr(hex_seq, 5, 12) AS event_id,
    'acct_' || acct AS account_id, 'cust_' || acct AS customer_id,
    'txn_' || lpad(CAST(event_seq AS VARCHAR), CAST(greatest(8, length(CAST(event_seq AS VARCHAR))) AS INTEGER), '0') AS transaction_id,
    'pi_' || acct AS payment_instrument_id,
    'm_' || (k % 20) AS merchant_id, 'category_' || (k % 20 % 7) AS merchant_category,
    CAST(amount_exact AS DOUBLE) AS amount,
    CASE WHEN event_seq % 7 = 0 THEN CASE WHEN city_no < 5 THEN 'inr' ELSE 'usd' END
         ELSE CASE WHEN city_no < 5 THEN 'INR' ELSE 'USD' END END AS currency,
    CASE city_no WHEN 5 THEN 'SG' WHEN 6 THEN 'AE' ELSE 'IN' END AS country,
    CASE city_no WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Delhi' WHEN 3 THEN 'Hyderabad'
                 WHEN 4 THEN 'Chennai' WHEN 5 THEN 'Singapore' ELSE 'Dubai' END AS city,
    CASE city_no WHEN 0 THEN 19.0760e0 WHEN 1 THEN 12.9716e0 WHEN 2 THEN 28.6139e0 WHEN 3 THEN 17.3850e0
                 WHEN 4 THEN 13.0827e0 WHEN 5 THEN 1.3521e0 ELSE 25.2048e0 END AS latitude,
    CASE city_no WHEN 0 THEN 72.8777e0 WHEN 1 THEN 77.5946e0 WHEN 2 THEN 77.2090e0 WHEN 3 THEN 78.4867e0
                 WHEN 4 THEN 80.2707e0 WHEN 5 THEN 103.8198e0 ELSE 55.2708e0 END AS longitude,
    channel,
    CASE WHEN k >= 97 THEN 'dev_x' || event_seq ELSE 'dev_' || (k % 11) END AS device_id,
    CAST(CASE WHEN kind = 'error' THEN 1 + k % 4 ELSE 0 END AS INTEGER) AS prior_auth_failures,
    CASE channel WHEN 'ecommerce' THEN 'credit_card' WHEN 'pos' THEN 'debit_card' WHEN 'upi' THEN 'upi'
                 WHEN 'wallet' THEN 'wallet' ELSE 'bank_transfer' END AS payment_method,
    channel = 'pos' AS card_present, city_no >= 5 AS is_international,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k >= 90 OR value >= 150 THEN 1 ELSE 0 END AS label,
    CASE WHEN k BETWEEN 90 AND 94 THEN 'impossible_travel' WHEN k BETWEEN 95 AND 96 THEN 'account_takeover'
         WHEN k >= 97 THEN 'new_device_high_amount' ELSE 'normal_behavior' END AS simulation_scenario,
    (k % 20 = 19 AND kind = 'signup') AS risky
  FROM tx1)"""


def features_cte(source: str = "tx", name: str = "feats", windows: tuple[int, int, int] = (60, 300, 3600)) -> str:
    """Feature rows over any relation with the columns of ``tx``."""
    short, medium, long = windows

    def trailing(expr: str, seconds: int, alias: str) -> str:
        return (
            f"coalesce(sum({expr}) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW), 0)"
            f" - coalesce(sum({expr}) OVER (PARTITION BY account_id, t ORDER BY event_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {alias}"
        )

    flags = ", ".join(f"CASE WHEN channel = '{c}' THEN 1e0 ELSE 0e0 END AS channel_{c}" for c in CHANNELS)
    return f"""
{name}_h AS (
  SELECT *,
    {trailing("1", short, "n_short")},
    {trailing("1", medium, "n_medium")},
    {trailing("1", long, "n_long")},
    {trailing("amount_exact", long, "spend")},
    {trailing("CASE WHEN prior_auth_failures > 0 THEN 1 ELSE 0 END", medium, "fails")},
    row_number() OVER acct - 1 AS life_n,
    sum(amount_exact) OVER (PARTITION BY account_id ORDER BY t, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life_sum,
    row_number() OVER (PARTITION BY account_id, device_id ORDER BY t, event_seq) AS device_rn,
    row_number() OVER (PARTITION BY account_id, merchant_id ORDER BY t, event_seq) AS merchant_rn,
    lag(latitude) OVER acct AS lat0, lag(longitude) OVER acct AS lon0, lag(t) OVER acct AS t0,
    lag(country) OVER acct AS country0, first_value(t) OVER acct AS t_first,
    max(CASE WHEN risky THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id ORDER BY t, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk
  FROM {source}
  WINDOW acct AS (PARTITION BY account_id ORDER BY t, event_seq)),
{name} AS (
  SELECT * REPLACE (is_international AS is_international),
    amount AS f_amount, CAST(prior_auth_failures AS DOUBLE) AS f_prior_auth_failures,
    CASE WHEN card_present THEN 1e0 ELSE 0e0 END AS f_card_present,
    CASE WHEN is_international THEN 1e0 ELSE 0e0 END AS f_is_international,
    CAST(n_short AS DOUBLE) AS tx_count_1m, CAST(n_medium AS DOUBLE) AS tx_count_5m, CAST(n_long AS DOUBLE) AS tx_count_1h,
    CAST(spend AS DOUBLE) AS spend_sum_1h,
    CASE WHEN life_n > 0 THEN CAST(life_sum AS DOUBLE) / life_n ELSE amount END AS spend_avg_30d_proxy,
    amount / greatest(CASE WHEN life_n > 0 THEN CAST(life_sum AS DOUBLE) / life_n ELSE amount END, 1e0) AS amount_vs_recent_avg_ratio,
    CASE WHEN device_rn = 1 THEN 1e0 ELSE 0e0 END AS device_new_for_account,
    CASE WHEN merchant_rn = 1 THEN 1e0 ELSE 0e0 END AS merchant_new_for_account,
    CASE WHEN t0 IS NULL THEN 0e0 ELSE 12742e0 * asin(sqrt(pow(sin(radians(latitude - lat0) / 2), 2)
      + cos(radians(lat0)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon0) / 2), 2))) END AS geo_distance_from_last_tx_km,
    CASE WHEN t0 IS NULL THEN 86400e0 ELSE CAST(t - t0 AS DOUBLE) END AS time_since_last_tx_sec,
    CAST(fails AS DOUBLE) AS failed_auth_count_recent,
    CASE WHEN is_international AND country0 IS NOT NULL AND country0 <> country THEN 1e0 ELSE 0e0 END AS international_mismatch,
    CASE WHEN (t // 3600) % 24 < 6 OR (t // 3600) % 24 >= 23 THEN 1e0 ELSE 0e0 END AS night_tx_flag,
    CAST(risk AS DOUBLE) AS high_risk_merchant_flag,
    (t - t_first) / 86400e0 AS account_age_days,
    CAST(merchant_rn - 1 AS DOUBLE) AS account_merchant_tx_count_30d,
    {flags}
  FROM {name}_h)"""


def feature_column(name: str) -> str:
    """Column of a feature in the ``feats`` relation (four share their name with the event)."""
    if name in ("amount", "prior_auth_failures", "card_present", "is_international"):
        return f"f_{name}"
    return name


def compared_sql(name: str) -> str:
    """A feature as the queries show it: rounded to six digits, the age in whole seconds."""
    if name == "account_age_days":
        return f"CAST(round({feature_column(name)} * 86400e0) AS BIGINT) AS account_age_seconds"
    return f"round({feature_column(name)}, 6) AS {name}"


FEATURE_LIST = ", ".join(map(compared_sql, FEATURES))


def uuid_sql(text: str) -> str:
    digest = f"sha256({text})"
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in parts)


# Rules, weights and reasons, written out as SQL conditions.
RULES = [
    ("impossible_travel", "critical", 0.32, "geo_distance_from_last_tx_km >= 500 AND time_since_last_tx_sec <= 3600"),
    ("very_high_velocity", "high", 0.20, "tx_count_5m >= 5"),
    ("repeated_small_amount_card_testing", "high", 0.24, "tx_count_5m >= 4 AND amount <= 15"),
    ("high_amount_on_new_device", "high", 0.22, "device_new_for_account <> 0 AND amount >= 1500"),
    ("blacklist_hit", "critical", 0.28, "high_risk_merchant_flag >= 1"),
    ("risky_geo_combo", "medium", 0.14, "international_mismatch <> 0 AND night_tx_flag <> 0"),
]
WEIGHTS = {"low": 0.04, "medium": 0.08, "high": 0.14, "critical": 0.22}
REASONS = [
    ("velocity_spike", "tx_count_5m >= 4"),
    ("geo_jump", "geo_distance_from_last_tx_km >= 500"),
    ("new_device", "device_new_for_account >= 1"),
    ("amount_spike", "amount_vs_recent_avg_ratio >= 3"),
    ("high_risk_merchant", "high_risk_merchant_flag >= 1"),
    ("auth_failures", "failed_auth_count_recent >= 1"),
]


def scored_cte(intercept: float, weights: dict[str, float], source: str = "feats") -> str:
    flags = ", ".join(f"({cond}) AS r{i}" for i, (_, _, _, cond) in enumerate(RULES))
    total = " + ".join(
        f"CASE WHEN r{i} THEN {WEIGHTS[sev]!r}e0 + {delta!r}e0 * 0.25e0 ELSE 0e0 END"
        for i, (_, sev, delta, _) in enumerate(RULES)
    )
    z = f"({intercept!r}e0)" + "".join(
        f" + {feature_column(name)} * ({w:.10f}e0)" for name, w in weights.items()
    )
    critical = " OR ".join(f"r{i}" for i, r in enumerate(RULES) if r[1] == "critical")
    high = " OR ".join(f"r{i}" for i, r in enumerate(RULES) if r[1] == "high")
    names = ", ".join(f"CASE WHEN r{i} THEN '{r[0]}' END" for i, r in enumerate(RULES))
    codes = ", ".join(
        [f"CASE WHEN r{i} THEN 'rule:{r[0]}' END" for i, r in enumerate(RULES)]
        + [f"CASE WHEN {cond} THEN '{code}' END" for code, cond in REASONS]
    )
    return f"""
flagged AS (SELECT *, {flags} FROM {source}),
rated AS (SELECT *, 1e0 / (1e0 + exp(-({z}))) AS model_probability, {total} AS rule_weight FROM flagged),
judged AS (SELECT *, least(1e0, model_probability * 0.78e0 + least(rule_weight, 0.35e0)) AS final_score FROM rated),
scored AS (SELECT *,
    CASE WHEN ({critical}) OR final_score >= 0.82e0 THEN 'BLOCK'
         WHEN final_score >= 0.55e0 OR ({high}) THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
    CASE WHEN concat_ws(',', {names}) = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(concat_ws(',', {names}), ',') END AS rule_ids,
    CASE WHEN concat_ws(',', {codes}) = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(concat_ws(',', {codes}), ',')[1:8] END AS codes,
    {uuid_sql("'case:' || event_id")} AS case_id
  FROM judged)"""


FEEDBACK = f"""
fb0 AS (
  SELECT case_id, transaction_id, event_id, event_seq, t,
    CASE event_seq % 4 WHEN 0 THEN 'fraud' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'legitimate' ELSE 'review' END AS first_label
  FROM scored WHERE event_seq % 5 = 0),
fb1 AS (
  SELECT *, first_label AS feedback_label, t + 60 AS created, 1 AS turn FROM fb0
  UNION ALL
  SELECT *, CASE WHEN first_label = 'fraud' THEN 'legitimate' ELSE 'fraud' END, t + 120, 2 FROM fb0 WHERE event_seq % 15 = 0),
feedback AS (
  SELECT {uuid_sql("'feedback:' || event_id || ':' || turn")} AS feedback_id, case_id, transaction_id, event_id,
    'analyst_' || (event_seq % 3) AS analyst_id, feedback_label, created
  FROM fb1),
cases AS (
  SELECT s.case_id, s.transaction_id, s.event_id, s.event_seq, s.account_id, s.merchant_id, s.decision, s.t, s.final_score,
    s.simulation_scenario, s.rule_ids, s.amount, s.country, s.channel,
    CASE WHEN f.feedback_label IS NULL OR f.feedback_label = 'review' THEN 'open' ELSE 'closed' END AS status
  FROM scored s LEFT JOIN (
    SELECT case_id, feedback_label FROM feedback
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created DESC, feedback_id DESC) = 1) f USING (case_id))"""

# Messages that decode and pass the checks, and the stage and text of those that do not.
MESSAGES = """
messages AS (
  SELECT *,
    CASE WHEN event_seq % 97 = 0 OR event_seq % 89 = 0 OR event_seq % 83 = 0 OR event_seq % 79 = 0 THEN 'validation'
         WHEN event_seq % 73 = 0 OR event_seq % 71 = 0 THEN 'processing' ELSE 'good' END AS route,
    CASE WHEN event_seq % 97 = 0 THEN 'message: must be a JSON object'
         WHEN event_seq % 89 = 0 THEN 'country: field required'
         WHEN event_seq % 83 = 0 THEN 'unknown fields: unexpected'
         WHEN event_seq % 79 = 0 THEN 'channel: must be one of pos, ecommerce, upi, wallet, transfer'
         WHEN event_seq % 73 = 0 THEN 'amount must be positive'
         WHEN event_seq % 71 = 0 THEN 'prior_auth_failures cannot be negative' ELSE '' END AS error_message
  FROM tx),
valid_tx AS (SELECT * EXCLUDE (route, error_message) FROM messages WHERE route = 'good')"""
