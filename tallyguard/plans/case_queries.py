"""Queries over decisions, cases, feedback and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.functions.scalars import is_notable, is_recent
from tallyguard.operators.cases import (
    audit_rows,
    case_feedback,
    case_header,
    case_timelines,
    latest_feedback,
    link_feedback,
    route_feedback,
    list_cases,
    new_activities,
    page_info,
    recent_activity,
    transaction_with_score,
    with_case_context,
    with_case_status,
)
from tallyguard.operators.dashboard import (
    analytics_trends,
    cases_live_window,
    dashboard_overview,
    recent_window_metrics,
)
from tallyguard.operators.dedupe import latest_per_key
from tallyguard.operators.metrics import counters
from tallyguard.operators.rules import first_rule_id, rule_hit_counts, rule_hit_rows
from tallyguard.plans.decisions import decide, decide_messages
from tallyguard.plans.oracle_parts import RULES
from tallyguard.plans.registry import (
    AS_OF,
    WITH_CASES,
    WITH_SCORES,
    WITH_VALID_SCORES,
    query,
)
from tallyguard.plans.store import decision_store
from tallyguard.schemas import FEEDBACK
from tallyguard.session import work_dir
from tallyguard.sources.adapter import load_transactions, raw_messages, repeated_messages
from tallyguard.sources.sinks import (
    decision_rows,
    fan_out,
    feedback_messages,
    raw_rows,
    scored_rows,
    write_batch,
    write_messages,
    write_rows,
)
from tallyguard.sources.tables import read_raw_table


def clock(seconds: int = AS_OF):
    return F.timestamp_seconds(F.lit(seconds))


def t(column: str):
    return F.unix_seconds(F.col(column))


def codes_text():
    return F.array_join(F.transform("reason_codes", lambda r: r["code"]), ",")


DECISION_SQL = """SELECT event_seq, transaction_id, account_id, case_id, decision, round(model_probability, 6) AS model_probability,
    round(final_score, 6) AS final_score, coalesce(array_to_string(rule_ids, ','), '') AS rules,
    coalesce(array_to_string(codes, ','), '') AS reasons FROM scored"""


def decision_view(events):
    return events.select(
        "event_seq",
        "transaction_id",
        "account_id",
        "case_id",
        "decision",
        F.round("model_probability", 6).alias("model_probability"),
        F.round("final_score", 6).alias("final_score"),
        F.array_join(F.transform("rule_hits", lambda h: h["rule_id"]), ",").alias("rules"),
        codes_text().alias("reasons"),
    )


@query("decisions", f"{WITH_SCORES} {DECISION_SQL}")
def _decisions(spark, sf_dir):
    return decision_view(decide(load_transactions(spark, sf_dir)))


@query("decisions_from_messages", f"{WITH_VALID_SCORES} {DECISION_SQL}")
def _decisions_from_messages(spark, sf_dir):
    messages = repeated_messages(raw_messages(load_transactions(spark, sf_dir)))
    good, _ = decide_messages(messages)
    return decision_view(good)


HITS_SQL = " UNION ALL ".join(
    f"SELECT event_seq, '{rule_id}' AS rule_id, '{severity}' AS severity, {delta!r}e0 AS score_delta FROM scored WHERE r{i}"
    for i, (rule_id, severity, delta, _) in enumerate(RULES)
)


@query("rule_hits", f"{WITH_SCORES} {HITS_SQL}")
def _rule_hits(spark, sf_dir):
    return rule_hit_rows(decision_store(spark, sf_dir).events, "event_seq").select(
        "event_seq", "rule_id", "severity", "score_delta"
    )


@query(
    "rule_hit_counts",
    f"{WITH_SCORES} SELECT rule_id, severity, count(*) AS hits FROM ({HITS_SQL}) GROUP BY ALL",
)
def _rule_hit_counts(spark, sf_dir):
    return rule_hit_counts(decision_store(spark, sf_dir).events)


@query(
    "reason_codes",
    f"""{WITH_SCORES} SELECT event_seq, CAST(i AS BIGINT) AS position, codes[i] AS code
    FROM (SELECT event_seq, codes, unnest(range(1, len(codes) + 1)) AS i FROM scored)""",
)
def _reason_codes(spark, sf_dir):
    events = decision_store(spark, sf_dir).events
    rows = events.select("event_seq", F.posexplode("reason_codes").alias("i", "reason"))
    return rows.select("event_seq", (F.col("i") + 1).cast("bigint").alias("position"), F.col("reason")["code"].alias("code"))


@query(
    "reason_counts",
    f"""{WITH_SCORES} SELECT code, count(*) AS events, round(sum(CASE WHEN decision = 'BLOCK' THEN 1e0 ELSE 0e0 END), 6) AS blocked
    FROM (SELECT unnest(codes) AS code, decision FROM scored) GROUP BY code""",
)
def _reason_counts(spark, sf_dir):
    rows = decision_store(spark, sf_dir).events.select(F.explode("reason_codes").alias("reason"), "decision")
    return rows.groupBy(F.col("reason")["code"].alias("code")).agg(
        F.count(F.lit(1)).alias("events"), F.sum((F.col("decision") == "BLOCK").cast("double")).alias("blocked")
    )


STAGE_SQL = """ UNION ALL """.join(
    f"SELECT '{topic}' AS topic, account_id AS message_key, transaction_id, {decision} AS decision, {velocity} AS velocity FROM scored"
    for topic, decision, velocity in (
        ("tx.validated", "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"),
        ("tx.enriched", "CAST(NULL AS VARCHAR)", "tx_count_5m"),
        ("tx.scored", "CAST(NULL AS VARCHAR)", "tx_count_5m"),
        ("tx.decisions", "decision", "CAST(NULL AS DOUBLE)"),
    )
)


READ_FIELDS = "transaction_id string, decision string, features struct<tx_count_5m: double>"


def _message_view(messages):
    """Every message is parsed once, for all the fields that are read."""
    rows = messages.select("topic", F.col("key").alias("message_key"), F.from_json("value", READ_FIELDS).alias("v"))
    return rows.select(
        "topic",
        "message_key",
        F.col("v")["transaction_id"].alias("transaction_id"),
        F.col("v")["decision"].alias("decision"),
        F.col("v")["features"]["tx_count_5m"].alias("velocity"),
    )


@query("stage_messages", f"{WITH_SCORES} {STAGE_SQL}")
def _stage_messages(spark, sf_dir):
    return _message_view(fan_out(decision_store(spark, sf_dir).events))


@query("written_stage_messages", f"{WITH_SCORES} {STAGE_SQL}")
def _written_stage_messages(spark, sf_dir):
    """The messages written by topic, the batch written twice as after a retry, and read back."""
    path = work_dir(spark, "messages")
    messages = fan_out(decision_store(spark, sf_dir).events)
    for _ in range(2):
        write_messages(messages, path, batch_id=0)
    return _message_view(spark.read.parquet(path))


@query(
    "written_tables",
    f"""{WITH_SCORES} SELECT 'raw' AS kind, event_id, amount AS number, country AS word FROM scored
    UNION ALL SELECT 'scored', event_id, round(final_score, 6), decision FROM scored
    UNION ALL SELECT 'decision', event_id, 0.55e0, 'open' FROM scored""",
)
def _written_tables(spark, sf_dir):
    """The three decision tables after a write and a read."""
    events = decision_store(spark, sf_dir).events
    path = work_dir(spark, "tables")
    write_rows(raw_rows(events), f"{path}/raw", ("event_month",))
    write_batch(scored_rows(events), f"{path}/scored", 0)
    write_batch(scored_rows(events), f"{path}/scored", 0)
    write_batch(decision_rows(events), f"{path}/decisions", 0)
    raw = spark.read.parquet(f"{path}/raw").select(
        F.lit("raw").alias("kind"),
        "event_id",
        F.col("amount").cast("double").alias("number"),
        F.col("payload")["country"].alias("word"),
    )
    scored = spark.read.parquet(f"{path}/scored").select(
        F.lit("scored").alias("kind"), "event_id", F.round("score", 6).alias("number"), F.col("decision").alias("word")
    )
    cases = spark.read.parquet(f"{path}/decisions").select(
        F.lit("decision").alias("kind"),
        "event_id",
        F.col("model_metadata")["review_threshold"].alias("number"),
        F.col("case_status").alias("word"),
    )
    return raw.unionByName(scored).unionByName(cases)


@query(
    "raw_table_by_time",
    f"{WITH_SCORES} SELECT event_seq, t, transaction_id, amount, simulation_scenario AS scenario FROM scored",
)
def _raw_table_by_time(spark, sf_dir):
    path = work_dir(spark, "raw")
    write_rows(decision_store(spark, sf_dir).raw, path, ("event_month",))
    return read_raw_table(spark, path, ordered=True).select(
        "event_seq", t("event_time").alias("t"), "transaction_id", F.col("amount").cast("double").alias("amount"), "scenario"
    )


CASE_COLUMNS = """case_id, transaction_id, decision, status, t AS decision_t, round(final_score, 6) AS score, simulation_scenario AS scenario,
    coalesce(array_to_string(rule_ids, ','), '') AS rules, account_id, merchant_id, amount, country, channel"""


def case_view(cases):
    return cases.select(
        "case_id",
        "transaction_id",
        "decision",
        "status",
        t("decision_time").alias("decision_t"),
        F.round("score", 6).alias("score"),
        "scenario",
        F.array_join(F.transform("rule_hits", lambda h: h["rule_id"]), ",").alias("rules"),
        "account_id",
        "merchant_id",
        "amount",
        "country",
        "channel",
    )


def current_cases(store):
    return with_case_status(store.decisions, store.feedback)


@query(
    "case_list_open_reviews",
    f"""{WITH_CASES} SELECT {CASE_COLUMNS} FROM cases WHERE status = 'open' AND decision = 'REVIEW'
    ORDER BY t DESC, case_id LIMIT 50 OFFSET 50""",
)
def _case_list_open_reviews(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    page = list_cases(current_cases(s), s.scored, s.raw, page=2, page_size=50, status="open", decision="REVIEW")
    return case_view(page)


@query(
    "case_list_search_by_decision",
    f"""{WITH_CASES} SELECT {CASE_COLUMNS} FROM cases WHERE contains(transaction_id, '77')
    ORDER BY cases.decision, case_id LIMIT 20""",
)
def _case_list_search_by_decision(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return case_view(list_cases(current_cases(s), s.scored, s.raw, search="77", sort_by="decision", sort_order="asc"))


@query(
    "case_page_info",
    f"""{WITH_CASES} SELECT 2 AS page, 50 AS page_size, count(*) AS total,
    greatest(1, CAST(ceil(count(*) / 50e0) AS BIGINT)) AS total_pages FROM cases WHERE status = 'open' AND decision = 'REVIEW'""",
)
def _case_page_info(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return page_info(current_cases(s), 2, 50, status="open", decision="REVIEW")


@query("case_status", f"{WITH_CASES} SELECT case_id, decision, status FROM cases")
def _case_status(spark, sf_dir):
    return current_cases(decision_store(spark, sf_dir)).select(
        "case_id", "decision", F.col("case_status").alias("status")
    )


@query("cases_with_context", f"{WITH_CASES} SELECT {CASE_COLUMNS} FROM cases")
def _cases_with_context(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    order = ["event_time", "event_seq"]
    return case_view(
        with_case_context(
            current_cases(s).select("case_id", "transaction_id", "decision", "case_status", "decision_time"),
            latest_per_key(s.scored, ["transaction_id"], order),
            latest_per_key(s.raw.select("transaction_id", "amount", "payload", *order), ["transaction_id"], order),
        )
    )


@query(
    "transactions_with_score",
    f"{WITH_SCORES} SELECT transaction_id, amount, t, round(final_score, 6) AS score, decision, tx_count_5m AS velocity FROM scored",
)
def _transactions_with_score(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return transaction_with_score(s.raw, s.scored).select(
        "transaction_id",
        F.col("payload")["amount"].alias("amount"),
        t("event_time").alias("t"),
        F.round("score", 6).alias("score"),
        "decision",
        F.col("features")["tx_count_5m"].alias("velocity"),
    )


LOOKUP_ID = "txn_00000042"


@query(
    "transaction_lookup",
    f"{WITH_SCORES} SELECT transaction_id, country, round(final_score, 6) AS score, decision FROM scored WHERE transaction_id = '{LOOKUP_ID}'",
)
def _transaction_lookup(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return transaction_with_score(s.raw, s.scored, LOOKUP_ID).select(
        "transaction_id", F.col("payload")["country"].alias("country"), F.round("score", 6).alias("score"), "decision"
    )


def _newest_marked_case(s):
    """Id of the case with the newest feedback."""
    row = s.feedback.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc()).select("case_id").first()
    return row["case_id"]


NEWEST_CASE_SQL = "(SELECT case_id FROM feedback ORDER BY created DESC, feedback_id DESC LIMIT 1)"


@query(
    "case_detail",
    f"""{WITH_CASES} SELECT c.case_id, c.transaction_id, c.decision, c.status, round(c.final_score, 6) AS score, c.country,
    s.tx_count_5m AS velocity FROM cases c JOIN scored s USING (case_id) WHERE c.case_id = {NEWEST_CASE_SQL}""",
)
def _case_detail(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return case_header(current_cases(s), s.scored, s.raw, _newest_marked_case(s)).select(
        "case_id",
        "transaction_id",
        "decision",
        F.col("case_status").alias("status"),
        F.round("score", 6).alias("score"),
        F.col("raw_transaction")["country"].alias("country"),
        F.col("features")["tx_count_5m"].alias("velocity"),
    )


TIMELINE_SQL = """
    SELECT case_id, 'ingested' AS type, t AS happened, 'Transaction received' AS detail FROM cases
    UNION ALL SELECT case_id, 'scored', t, 'Scored ' || printf('%.3f', final_score) || ' with logistic_baseline 1' FROM cases
    UNION ALL SELECT case_id, 'feedback', created, analyst_id || ' marked ' || feedback_label FROM feedback"""


@query("case_timelines", f"{WITH_CASES} {TIMELINE_SQL}")
def _case_timelines(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    rows = case_timelines(s.decisions, s.scored, s.raw, s.feedback)
    return rows.select("case_id", "type", t("timestamp").alias("happened"), "detail")


@query("case_timeline", f"{WITH_CASES} SELECT * FROM ({TIMELINE_SQL}) WHERE case_id = {NEWEST_CASE_SQL}")
def _case_timeline(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    rows = case_timelines(s.decisions, s.scored, s.raw, s.feedback, _newest_marked_case(s))
    return rows.select("case_id", "type", t("timestamp").alias("happened"), "detail")


@query(
    "case_feedback",
    f"""{WITH_CASES} SELECT case_id, feedback_id, feedback_label,
    row_number() OVER (PARTITION BY case_id ORDER BY created DESC, feedback_id) AS position FROM feedback""",
)
def _case_feedback(spark, sf_dir):
    rows = case_feedback(decision_store(spark, sf_dir).feedback)
    return rows.select("case_id", "feedback_id", "feedback_label", "position")


@query(
    "latest_feedback_per_transaction",
    f"""{WITH_CASES} SELECT transaction_id, feedback_label, analyst_id, created FROM feedback
    QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY created DESC, feedback_id DESC) = 1""",
)
def _latest_feedback_per_transaction(spark, sf_dir):
    rows = latest_feedback(decision_store(spark, sf_dir).feedback, "transaction_id")
    return rows.select("transaction_id", "feedback_label", "analyst_id", t("created_at").alias("created"))


ACTIVITY_SQL = """
    decision_acts AS (SELECT 'decision:' || case_id AS id, 'decision' AS type, t AS happened, transaction_id, decision, final_score AS score,
      rule_ids[1] AS rule_id,
      concat_ws(' • ', decision, transaction_id, rule_ids[1], 'score ' || printf('%.2f', final_score)) AS message FROM cases),
    feedback_acts AS (SELECT 'feedback:' || feedback_id AS id, 'feedback' AS type, created AS happened, transaction_id,
      CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS rule_id,
      analyst_id || ' marked ' || feedback_label AS message FROM feedback)"""


@query(
    "recent_activity",
    f"""{WITH_CASES}, {ACTIVITY_SQL}
    SELECT id, type, happened, transaction_id, decision, round(score, 6) AS score, rule_id, message FROM (
      (SELECT * FROM decision_acts ORDER BY happened DESC, id LIMIT 12) UNION ALL
      (SELECT * FROM feedback_acts ORDER BY happened DESC, id LIMIT 12)) ORDER BY happened DESC, id LIMIT 12""",
)
def _recent_activity(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    rows = recent_activity(current_cases(s), s.scored, s.feedback, limit=12)
    return rows.select(
        "id", "type", t("timestamp").alias("happened"), "transaction_id", "decision", F.round("score", 6).alias("score"), "rule_id", "message"
    )


def _activities(s):
    """All activities as one table (not only the newest)."""
    events = s.events
    judged = events.select(
        F.concat(F.lit("decision:"), "case_id").alias("id"),
        F.lit("decision").alias("type"),
        F.col("decided_at").alias("timestamp"),
        "decision",
        F.col("final_score").alias("score"),
        first_rule_id(F.col("rule_hits")).alias("rule_id"),
    )
    marked = s.feedback.select(
        F.concat(F.lit("feedback:"), "feedback_id").alias("id"),
        F.lit("feedback").alias("type"),
        F.col("created_at").alias("timestamp"),
    )
    return judged.unionByName(marked, allowMissingColumns=True)


@query(
    "notable_activities",
    f"""{WITH_CASES}, {ACTIVITY_SQL}
    SELECT id, type, happened, rule_id, {AS_OF} - happened <= 3600 AS recent FROM (SELECT * FROM decision_acts UNION ALL SELECT * FROM feedback_acts)
    WHERE type = 'feedback' OR decision IN ('BLOCK', 'REVIEW') OR score >= 0.9""",
)
def _notable_activities(spark, sf_dir):
    rows = _activities(decision_store(spark, sf_dir))
    notable = rows.where(is_notable(F.col("type"), F.col("decision"), F.col("score")))
    return notable.select(
        "id", "type", t("timestamp").alias("happened"), "rule_id", is_recent(F.col("timestamp"), clock(), 3600).alias("recent")
    )


@query(
    "new_activities",
    f"""{WITH_CASES}, {ACTIVITY_SQL}
    SELECT id, type, happened FROM (SELECT * FROM decision_acts UNION ALL SELECT * FROM feedback_acts) WHERE happened >= {AS_OF - 7200}""",
)
def _new_activities(spark, sf_dir):
    """Activities of the full snapshot that a snapshot taken two hours earlier did not hold."""
    current = _activities(decision_store(spark, sf_dir))
    previous = current.where(F.col("timestamp") < clock(AS_OF - 7200))
    return new_activities(previous, current).select("id", "type", t("timestamp").alias("happened"))


@query(
    "linked_feedback",
    f"""{WITH_CASES} SELECT case_id, transaction_id, event_id, analyst_id, feedback_label, created FROM feedback""",
)
def _linked_feedback(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    entries = s.feedback.select("case_id", "analyst_id", "feedback_label", "notes", "created_at")
    return link_feedback(entries, s.decisions).select(
        "case_id", "transaction_id", "event_id", "analyst_id", "feedback_label", t("created_at").alias("created")
    )


@query(
    "routed_feedback",
    f"""{WITH_CASES} SELECT case_id, transaction_id, analyst_id, created, CAST(NULL AS VARCHAR) AS error FROM feedback
    UNION ALL SELECT 'lost-' || case_id, NULL, analyst_id, created, 'unknown case lost-' || case_id FROM feedback WHERE feedback_label = 'fraud'""",
)
def _routed_feedback(spark, sf_dir):
    """All feedback, and again the entries that say fraud, for cases that don't exist."""
    s = decision_store(spark, sf_dir)
    entries = s.feedback.select("case_id", "analyst_id", "feedback_label", "notes", "created_at")
    lost = entries.where("feedback_label = 'fraud'").withColumn("case_id", F.concat(F.lit("lost-"), "case_id"))
    return route_feedback(entries.unionByName(lost), s.decisions).select(
        "case_id", "transaction_id", "analyst_id", t("created_at").alias("created"), "error"
    )


@query(
    "feedback_audit",
    f"""{WITH_CASES} SELECT 'fraud_case' AS entity_type, case_id AS entity_id, 'analyst_feedback' AS action, analyst_id AS actor,
    feedback_label, created FROM feedback""",
)
def _feedback_audit(spark, sf_dir):
    rows = audit_rows(decision_store(spark, sf_dir).feedback)
    return rows.select(
        "entity_type",
        "entity_id",
        "action",
        "actor",
        F.get_json_object("payload", "$.feedback_label").alias("feedback_label"),
        t("created_at").alias("created"),
    )


@query(
    "feedback_messages",
    f"""{WITH_CASES} SELECT case_id AS message_key, 'tx.feedback' AS topic, feedback_id, feedback_label FROM feedback""",
)
def _feedback_messages(spark, sf_dir):
    feedback = decision_store(spark, sf_dir).feedback.select(*FEEDBACK.fieldNames())
    return feedback_messages(feedback).select(
        F.col("key").alias("message_key"),
        "topic",
        F.get_json_object("value", "$.feedback_id").alias("feedback_id"),
        F.get_json_object("value", "$.feedback_label").alias("feedback_label"),
    )


def overview_sql(hours: int) -> str:
    return f"""{WITH_SCORES} SELECT {hours} AS window_hours, count(*) AS total_transactions,
    count(*) FILTER (decision = 'BLOCK') AS blocked_transactions, count(*) FILTER (decision = 'REVIEW') AS review_transactions,
    count(*) FILTER (decision = 'APPROVE') AS approved_transactions, round(coalesce(avg(final_score), 0e0), 6) AS average_score
    FROM scored WHERE t >= {AS_OF - hours * 3600}"""


@query("dashboard_overview", overview_sql(24))
def _dashboard_overview(spark, sf_dir):
    rows = dashboard_overview(decision_store(spark, sf_dir).scored, 24, clock())
    return rows.withColumn("average_score", F.round("average_score", 6))


@query("dashboard_overview_last_hours", overview_sql(3))
def _dashboard_overview_last_hours(spark, sf_dir):
    rows = dashboard_overview(decision_store(spark, sf_dir).scored, 3, clock())
    return rows.withColumn("average_score", F.round("average_score", 6))


@query(
    "recent_window_metrics",
    f"""{WITH_CASES} SELECT 600 AS window_seconds, count(*) FILTER (t >= {AS_OF - 600}) AS processed_transactions,
    count(*) FILTER (t >= {AS_OF - 600} AND decision = 'BLOCK') AS blocked_transactions,
    count(*) FILTER (t >= {AS_OF - 600} AND decision = 'REVIEW') AS review_transactions,
    count(*) FILTER (decision = 'REVIEW' AND status = 'open') AS open_review_backlog FROM cases""",
)
def _recent_window_metrics(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return recent_window_metrics(s.scored, current_cases(s), 600, clock())


@query(
    "analytics_trends",
    f"""{WITH_SCORES} SELECT t // 3600 * 3600 AS bucket, decision, count(*) AS "count" FROM scored
    WHERE t >= {AS_OF - 8 * 3600} GROUP BY ALL""",
)
def _analytics_trends(spark, sf_dir):
    return analytics_trends(decision_store(spark, sf_dir).scored, 8, clock())


@query(
    "cases_live_window",
    f"""{WITH_CASES} SELECT 300 AS window_seconds, count(*) FILTER (status = 'open' AND decision = 'BLOCK') AS matching_cases,
    count(*) FILTER (decision = 'BLOCK') AS blocked_cases, count(*) FILTER (decision = 'REVIEW') AS review_cases
    FROM cases WHERE t >= {AS_OF - 300}""",
)
def _cases_live_window(spark, sf_dir):
    s = decision_store(spark, sf_dir)
    return cases_live_window(current_cases(s), 300, clock(), status="open", decision="BLOCK")


@query(
    "predictions_by_decision",
    f"""{WITH_SCORES} SELECT decision, 'champion' AS model_alias, count(*) AS events FROM scored GROUP BY ALL""",
)
def _predictions_by_decision(spark, sf_dir):
    events = decision_store(spark, sf_dir).events
    return counters(events.select("decision", F.col("model_metadata")["model_alias"].alias("model_alias")), "decision", "model_alias")
