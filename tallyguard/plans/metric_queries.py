"""Rates, quantiles, gauges and alerts over the event and decision tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyguard.operators.dedupe import claim_first, duplicate_deliveries
from tallyguard.operators.metrics import (
    ALERTS,
    LATENCY_BOUNDS,
    alert_states,
    alert_summary,
    counter_rate,
    error_ratio,
    exact_quantile,
    histogram_quantile,
    increase,
    latest_gauge,
    max_over_time,
    rate,
    stage_counters,
)
from tallyguard.operators.validate import dead_letters, route_messages, valid_events
from tallyguard.plans.decisions import decide
from tallyguard.plans.registry import WITH_MESSAGES, WITH_SCORES, WITH_TX, WITH_VALID_SCORES, query
from tallyguard.plans.store import decision_store
from tallyguard.session import written
from tallyguard.sources.adapter import load_transactions, raw_messages, repeated_messages


def sliding_sql(source: str, labels: str, window: int, agg: str, name: str) -> str:
    """Aggregate of all rows in [tick - window, tick) for each minute ``tick`` that has any."""
    group = f"{labels}, " if labels else ""
    return f"""{name} AS (SELECT {group}tick, {agg} FROM (
      SELECT *, unnest(generate_series((t // 60 + 1) * 60, (t // 60) * 60 + {window}, 60)) AS tick FROM {source}) GROUP BY ALL)"""


def _us(column: str = "event_time"):
    return F.unix_micros(column)


@query(
    "event_rate",
    f"{WITH_TX}, {sliding_sql('tx', '', 300, 'count(*) AS n', 'w')} SELECT tick, round(n / 300e0, 6) AS rate FROM w",
)
def _event_rate(spark, sf_dir):
    rows = rate(load_transactions(spark, sf_dir), _us())
    return rows.select("tick", F.round("rate", 6).alias("rate"))


@query(
    "decision_rate",
    f"{WITH_SCORES}, {sliding_sql('scored', 'decision', 300, 'count(*) AS n', 'w')} SELECT decision, tick, round(n / 300e0, 6) AS rate FROM w",
)
def _decision_rate(spark, sf_dir):
    rows = rate(decision_store(spark, sf_dir).scored, _us(), ["decision"])
    return rows.select("decision", "tick", F.round("rate", 6).alias("rate"))


@query(
    "decision_increase",
    f"{WITH_SCORES}, {sliding_sql('scored', 'decision', 3600, 'count(*) AS n', 'w')} SELECT decision, tick, n AS increase FROM w WHERE decision <> 'APPROVE'",
)
def _decision_increase(spark, sf_dir):
    flagged = decision_store(spark, sf_dir).scored.where(F.col("decision").isin("BLOCK", "REVIEW"))
    return increase(flagged, _us(), ["decision"])


def _routes(spark, sf_dir):
    """Stage and time of each raw message, from the failure cases of the adapter."""
    routed = route_messages(raw_messages(load_transactions(spark, sf_dir)))
    return written(routed.select("event_seq", "timestamp", "route"), "routes")


def _ratio(spark, sf_dir):
    routes = _routes(spark, sf_dir)
    return error_ratio(rate(routes.where("route <> 'good'"), _us("timestamp")), rate(routes, _us("timestamp")))


RATIO_SQL = f"""{WITH_MESSAGES}, bad AS (SELECT * FROM messages WHERE route <> 'good'),
    {sliding_sql('messages', '', 300, 'count(*) AS n', 'w')}, {sliding_sql('bad', '', 300, 'count(*) AS n', 'v')},
    ratio AS (SELECT w.tick, coalesce(v.n / 300e0, 0e0) / greatest(w.n / 300e0, 1e0) AS value FROM w LEFT JOIN v USING (tick))"""


@query("error_ratio", f"{RATIO_SQL} SELECT tick, round(value, 6) AS value FROM ratio")
def _error_ratio(spark, sf_dir):
    return _ratio(spark, sf_dir).select("tick", F.round("value", 6).alias("value"))


@query(
    "dead_letter_rate",
    f"""{WITH_MESSAGES}, bad AS (SELECT * FROM messages WHERE route <> 'good'), {sliding_sql('bad', 'route', 300, 'count(*) AS n', 'v')}
    SELECT route, tick, round(n / 300e0, 6) AS rate FROM v""",
)
def _dead_letter_rate(spark, sf_dir):
    rows = rate(_routes(spark, sf_dir).where("route <> 'good'"), _us("timestamp"), ["route"])
    return rows.select("route", "tick", F.round("rate", 6).alias("rate"))


RESET_SECONDS = 21_600


@query(
    "counter_rate",
    f"""{WITH_TX}, per AS (SELECT channel, t // 60 * 60 AS t, count(*) AS n FROM tx GROUP BY ALL),
    grown AS (SELECT channel, t, CASE WHEN row_number() OVER (PARTITION BY channel ORDER BY t) = 1 THEN 0 ELSE n END AS n FROM per),
    {sliding_sql('grown', 'channel', 300, 'sum(n) AS n', 'w')} SELECT channel, tick, round(n / 300e0, 6) AS rate FROM w""",
)
def _counter_rate(spark, sf_dir):
    """Rates from a counter of events per channel that is sampled each minute and starts anew every
    six hours, as one of a restarted worker does."""
    second = F.unix_seconds("event_time")
    per = load_transactions(spark, sf_dir).groupBy("channel", F.floor(second / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    life = Window.partitionBy("channel", F.floor(F.col("minute") * 60 / RESET_SECONDS)).orderBy("minute")
    samples = per.select("channel", "minute", F.sum("n").over(life).alias("total"))
    rows = counter_rate(samples, F.col("minute") * 60_000_000, "total", ["channel"])
    return rows.select("channel", "tick", F.round("rate", 6).alias("rate"))


def latencies(spark, sf_dir):
    """Latency samples: the value of each event in thousandths, labelled by channel."""
    tx = load_transactions(spark, sf_dir)
    return tx.select("event_time", "channel", (F.col("amount") / 10_000).alias("latency"))


BUCKET_SQL = " + ".join(f"(CASE WHEN latency > {b!r}e0 THEN 1 ELSE 0 END)" for b in LATENCY_BOUNDS)
BOUNDS_SQL = ", ".join(f"{b!r}e0" for b in LATENCY_BOUNDS)


def quantile_sql(labels: str) -> str:
    group = f"{labels}, " if labels else ""
    return f"""{WITH_TX}, lat0 AS (SELECT t, channel, amount / 10000 AS latency FROM tx), lat AS (SELECT *, {BUCKET_SQL} AS b FROM lat0),
    {sliding_sql('lat', f'{group}b', 300, 'count(*) AS n', 'w')},
    r AS (SELECT *, sum(n) OVER (PARTITION BY {group}tick ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {group}tick) * 0.95e0 AS rank FROM w),
    q AS (SELECT * FROM r WHERE upto >= rank QUALIFY row_number() OVER (PARTITION BY {group}tick ORDER BY b) = 1),
    p95 AS (SELECT {group}tick, CASE WHEN b = {len(LATENCY_BOUNDS)} THEN {LATENCY_BOUNDS[-1]!r}e0 ELSE
      coalesce([{BOUNDS_SQL}][b], 0e0) + ([{BOUNDS_SQL}][b + 1] - coalesce([{BOUNDS_SQL}][b], 0e0)) * (rank - (upto - n)) / n END AS value FROM q)"""


@query("latency_p95", f"{quantile_sql('')} SELECT tick, round(value, 6) AS value FROM p95")
def _latency_p95(spark, sf_dir):
    rows = histogram_quantile(latencies(spark, sf_dir), _us(), F.col("latency"))
    return rows.select("tick", F.round("value", 6).alias("value"))


@query("latency_p95_by_channel", f"{quantile_sql('channel')} SELECT channel, tick, round(value, 6) AS value FROM p95")
def _latency_p95_by_channel(spark, sf_dir):
    rows = histogram_quantile(latencies(spark, sf_dir), _us(), F.col("latency"), labels=["channel"])
    return rows.select("channel", "tick", F.round("value", 6).alias("value"))


@query(
    "latency_p95_exact",
    f"""{WITH_TX}, r AS (SELECT (t // 300 + 1) * 300 AS tick, amount / 10000 AS v,
      row_number() OVER (PARTITION BY t // 300 ORDER BY amount) - 1 AS i, (count(*) OVER (PARTITION BY t // 300) - 1) * 0.95e0 AS place FROM tx)
    SELECT tick, round(max(v) FILTER (i = floor(place)), 6) AS low, round(max(v) FILTER (i = ceil(place)), 6) AS high,
      round(max(place - floor(place)), 6) AS part FROM r GROUP BY tick""",
)
def _latency_p95_exact(spark, sf_dir):
    rows = exact_quantile(latencies(spark, sf_dir), _us(), F.col("latency"))
    return rows.select("tick", *[F.round(c, 6).alias(c) for c in ("low", "high", "part")])


@query(
    "gauge_max_15m",
    f"""{WITH_TX}, {sliding_sql('tx', 'channel', 900, 'max(amount) AS m', 'w')} SELECT channel, tick, m AS value FROM w""",
)
def _gauge_max_15m(spark, sf_dir):
    return max_over_time(load_transactions(spark, sf_dir), _us(), "amount", 900, ["channel"])


@query(
    "gauge_max_24h",
    f"""{WITH_TX}, m AS (SELECT t // 60 * 60 AS t, max(amount) AS amount FROM tx GROUP BY 1), {sliding_sql('m', '', 86400, 'max(amount) AS m', 'w')}
    SELECT tick, m AS value FROM w""",
)
def _gauge_max_24h(spark, sf_dir):
    return max_over_time(load_transactions(spark, sf_dir), _us(), "amount", 86_400)


@query(
    "latest_gauge",
    f"{WITH_TX} SELECT channel, arg_max(amount, t * 1000000000 + event_seq) AS value FROM tx GROUP BY channel",
)
def _latest_gauge(spark, sf_dir):
    return latest_gauge(load_transactions(spark, sf_dir), ["channel"], "amount", ["event_time", "event_seq"])


def state_sql(series: str, name: str) -> str:
    limit, hold = ALERTS[name]
    return f"""over_{name} AS (SELECT tick, value, tick - 60 * row_number() OVER (ORDER BY tick) AS island FROM {series} WHERE value > {limit!r}e0),
    state_{name} AS (SELECT '{name}' AS alert, tick, value, CASE WHEN tick - min(tick) OVER (PARTITION BY island) >= {hold} THEN 'firing' ELSE 'pending' END AS state
      FROM over_{name} UNION ALL SELECT '{name}', tick, value, 'inactive' FROM {series} WHERE NOT value > {limit!r}e0)"""


def _states(series, name):
    limit, hold = ALERTS[name]
    return alert_states(series, name, limit, hold)


@query(
    "alert_error_ratio",
    f"{RATIO_SQL}, {state_sql('ratio', 'error_ratio')} SELECT alert, tick, state FROM state_error_ratio",
)
def _alert_error_ratio(spark, sf_dir):
    return _states(_ratio(spark, sf_dir), "error_ratio").select("alert", "tick", "state")


@query(
    "alert_dead_letters",
    f"""{WITH_MESSAGES}, bad AS (SELECT * FROM messages WHERE route <> 'good'), {sliding_sql('bad', '', 300, 'count(*) / 300e0 AS value', 'v')},
    {state_sql('v', 'dlq_rate')} SELECT alert, tick, state FROM state_dlq_rate""",
)
def _alert_dead_letters(spark, sf_dir):
    rows = rate(_routes(spark, sf_dir).where("route <> 'good'"), _us("timestamp"))
    return _states(rows.withColumnRenamed("rate", "value"), "dlq_rate").select("alert", "tick", "state")


def _latency_alerts(spark, sf_dir):
    p95 = histogram_quantile(latencies(spark, sf_dir), _us(), F.col("latency"))
    return _states(p95, "worker_p95").unionByName(_states(p95, "state_store_p95"))


LATENCY_ALERTS = f"""{quantile_sql('')}, {state_sql('p95', 'worker_p95')}, {state_sql('p95', 'state_store_p95')},
    states AS (SELECT * FROM state_worker_p95 UNION ALL SELECT * FROM state_state_store_p95)"""


@query("alert_latency", f"{LATENCY_ALERTS} SELECT alert, tick, state FROM states")
def _alert_latency(spark, sf_dir):
    return _latency_alerts(spark, sf_dir).select("alert", "tick", "state")


@query(
    "alert_drift",
    f"""{WITH_SCORES}, per AS (SELECT t // 60 * 60 AS t, avg(model_probability) AS g FROM scored GROUP BY 1),
    {sliding_sql('per', '', 900, 'max(g) AS value', 'w')}, {state_sql('w', 'dataset_drift')} SELECT alert, tick, state FROM state_dataset_drift""",
)
def _alert_drift(spark, sf_dir):
    """The drift alert over a gauge per minute (the mean probability), its 15 minute maximum."""
    minute = (F.floor(_us() / 60_000_000) * 60_000_000).cast("bigint").alias("us")
    gauge = decision_store(spark, sf_dir).events.groupBy(minute).agg(F.avg("model_probability").alias("g"))
    return _states(max_over_time(gauge, F.col("us"), "g", 900), "dataset_drift").select("alert", "tick", "state")


@query(
    "alert_summary",
    f"""{LATENCY_ALERTS} SELECT count(*) AS alert_count, array_to_string(list_sort(list(DISTINCT state)), ',') AS statuses
    FROM states WHERE state <> 'inactive'""",
)
def _alert_summary(spark, sf_dir):
    active = _latency_alerts(spark, sf_dir).where("state <> 'inactive'")
    summary = alert_summary(active.withColumnRenamed("state", "status"))
    return summary.select("alert_count", F.array_join("statuses", ",").alias("statuses"))


@query(
    "stage_counters",
    f"""{WITH_VALID_SCORES}, dup AS (SELECT count(*) AS n FROM valid_tx WHERE event_seq % 50 = 0),
    bad AS (SELECT route, count(*) + count(*) FILTER (event_seq % 50 = 0) AS n FROM messages WHERE route <> 'good' GROUP BY route)
    SELECT 'validated' AS stage, 'ok' AS status, count(*) AS events FROM scored UNION ALL SELECT 'enriched', 'ok', count(*) FROM scored
    UNION ALL SELECT 'decisioned', decision, count(*) FROM scored GROUP BY decision
    UNION ALL SELECT route, 'failed', n FROM bad UNION ALL SELECT 'dedupe', 'duplicate', n FROM dup WHERE n > 0""",
)
def _stage_counters(spark, sf_dir):
    routed = written(route_messages(repeated_messages(raw_messages(load_transactions(spark, sf_dir)))), "routed")
    events = valid_events(routed)
    return stage_counters(decide(claim_first(events)), dead_letters(routed), duplicate_deliveries(events))

