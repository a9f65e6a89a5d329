"""Case queues, case details and activity feeds over the decision, score, raw and feedback tables.

Expected columns: ``decisions`` (case_id, transaction_id, event_id, decision, case_status,
decision_time, rule_hits, ...), ``scored`` (transaction_id, account_id, merchant_id, score,
scenario, rule_hits, model_name, model_version, event_time, event_seq, ...), ``raw``
(transaction_id, amount, payload, event_time, event_seq), ``feedback`` (the feedback contract).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.scalars import activity_message, scored_text, uuid_from
from tallyguard.operators.dedupe import latest_per_key
from tallyguard.operators.rules import first_rule_id
from tallyguard.operators.skew import keyed_running, lookup

MAX_PAGE_SIZE = 100
MAX_ACTIVITIES = 12


def latest_feedback(feedback: DataFrame, key: str) -> DataFrame:
    return latest_per_key(feedback, [key], ["created_at", "feedback_id"])


def with_case_status(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Decisions with the status their latest feedback left them in.

    A case starts open. Feedback closes it, unless the label asks for another review. Feedback
    is append-only, so the status is derived instead of updated in place. Case ids are unique
    on both sides, so the join cannot be skewed.
    """
    latest = latest_feedback(feedback, "case_id").select("case_id", "feedback_label")
    joined = decisions.join(latest, "case_id", "left")
    status = (
        F.when(F.col("feedback_label").isNull(), F.col("case_status"))
        .when(F.col("feedback_label") == "review", F.lit("open"))
        .otherwise(F.lit("closed"))
    )
    return joined.withColumn("case_status", status).drop("feedback_label")


def case_filter(status: str | None = None, decision: str | None = None, search: str | None = None) -> Column:
    """Optional equality on status and decision and a literal substring of the transaction id."""
    condition = F.lit(True)
    if status:
        condition = condition & (F.col("case_status") == status)
    if decision:
        condition = condition & (F.col("decision") == decision)
    if search:
        condition = condition & F.col("transaction_id").contains(F.lit(search))
    return condition


def _transactions_of(cases: DataFrame, most: int = 1) -> list[str]:
    """The transactions of a few cases. Case ids are unique, so one case is one row at most."""
    found = cases.select("transaction_id").limit(most).collect()
    return sorted({row[0] for row in found if row[0] is not None})


def _broadcast_left(cases: DataFrame, side: DataFrame, on: list[str], _: str) -> DataFrame:
    """The join of ``with_case_context`` for a page, whose other side has at most 100 rows."""
    return cases.join(F.broadcast(side), on, "left")


def _latest_for(table: DataFrame, transactions: list[str]) -> DataFrame:
    """Latest row per transaction, only for the transactions of one page (at most 100)."""
    wanted = table.where(F.col("transaction_id").isin(transactions))
    return latest_per_key(wanted, ["transaction_id"], ["event_time", "event_seq"])


def list_cases(
    decisions: DataFrame,
    scored: DataFrame,
    raw: DataFrame,
    page: int = 1,
    page_size: int = 20,
    status: str | None = None,
    decision: str | None = None,
    search: str | None = None,
    sort_by: str = "decision_time",
    sort_order: str = "desc",
) -> DataFrame:
    """One page of cases with their latest score and raw transaction.

    The page, at most 100 rows, is taken first; its transactions are then a filter that the scans
    of scores and raw rows can use.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page must be at least 1 and page_size between 1 and 100")
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be asc or desc")
    key = "decision" if sort_by == "decision" else "decision_time"
    order = F.col(key).asc() if sort_order == "asc" else F.col(key).desc()
    cut = (
        decisions.where(case_filter(status, decision, search))
        .select("case_id", "transaction_id", "decision", "case_status", "decision_time")
        .orderBy(order, F.col("case_id"))
        .offset((page - 1) * page_size)
        .limit(page_size)
    )
    rows = cut.collect()
    taken = decisions.sparkSession.createDataFrame(rows, cut.schema)
    wanted = sorted({r["transaction_id"] for r in rows if r["transaction_id"] is not None})
    latest = _latest_for(scored, wanted), _latest_for(raw, wanted)
    return with_case_context(taken, *latest, join=_broadcast_left).orderBy(order, F.col("case_id"))


def with_case_context(
    cases: DataFrame, latest_scored: DataFrame, latest_raw: DataFrame, join=lookup
) -> DataFrame:
    """Cases left joined to the latest score and raw row of their transaction.

    Several cases may share a transaction; ``lookup`` spreads one that has very many.
    """
    score_side = latest_scored.select(
        "transaction_id", "score", "scenario", "rule_hits", "account_id", "merchant_id"
    )
    raw_side = latest_raw.select(
        "transaction_id",
        F.col("amount").cast("double").alias("amount"),
        F.col("payload")["country"].alias("country"),
        F.col("payload")["channel"].alias("channel"),
    )
    joined = join(cases, score_side, ["transaction_id"], "case_id")
    joined = join(joined, raw_side, ["transaction_id"], "case_id")
    empty = F.array().cast(latest_scored.schema["rule_hits"].dataType)
    return joined.select(
        "case_id",
        "transaction_id",
        "decision",
        F.col("case_status").alias("status"),
        "decision_time",
        "score",
        "scenario",
        F.coalesce("rule_hits", empty).alias("rule_hits"),
        "account_id",
        "merchant_id",
        "amount",
        "country",
        "channel",
    )


def page_info(decisions: DataFrame, page: int = 1, page_size: int = 20, **filters: str | None) -> DataFrame:
    """Page, size, matching total and number of pages (at least 1)."""
    total = decisions.where(case_filter(**filters)).agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        "total",
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / page_size)).alias("total_pages"),
    )


def transaction_with_score(raw: DataFrame, scored: DataFrame, transaction_id: str | None = None) -> DataFrame:
    """Latest raw row per transaction with its latest score; missing scores stay NULL.

    With ``transaction_id`` the equality reaches both scans.
    """
    if transaction_id is not None:
        raw = raw.where(F.col("transaction_id") == transaction_id)
        scored = scored.where(F.col("transaction_id") == transaction_id)
    order = ["event_time", "event_seq"]
    left = latest_per_key(raw.select("transaction_id", "payload", *order), ["transaction_id"], order)
    right = latest_per_key(
        scored.select(
            "transaction_id",
            "score",
            "decision",
            "model_name",
            "model_version",
            "rule_hits",
            "reason_codes",
            "features",
            *order,
        ),
        ["transaction_id"],
        order,
    ).drop(*order)
    return left.drop("event_seq").join(right, "transaction_id", "left")


def case_header(decisions: DataFrame, scored: DataFrame, raw: DataFrame, case_id: str) -> DataFrame:
    """The one-row part of a case: verdict, score, reasons, features and raw transaction."""
    case = decisions.where(F.col("case_id") == case_id)
    wanted = _transactions_of(case)
    score_side = _latest_for(scored, wanted).select("transaction_id", "score", "reason_codes", "features")
    raw_side = _latest_for(raw, wanted).select("transaction_id", F.col("payload").alias("raw_transaction"))
    return case.join(score_side, "transaction_id", "left").join(raw_side, "transaction_id", "left")


def case_feedback(feedback: DataFrame, case_id: str | None = None) -> DataFrame:
    """Feedback rows with their position, newest first, per case.

    Rows instead of a nested list: a case with very much feedback stays spread over tasks.
    """
    rows = feedback if case_id is None else feedback.where(F.col("case_id") == case_id)
    ordered = rows.withColumns({"__newest": -F.unix_micros("created_at"), "__id": F.col("feedback_id")})
    numbered = keyed_running(ordered, ["case_id"], "__newest", "__id", {"position": F.lit(1).cast("bigint")})
    return numbered.withColumn("position", F.col("position") + 1).drop("__newest", "__id")


def case_timelines(
    decisions: DataFrame, scored: DataFrame, raw: DataFrame, feedback: DataFrame, case_id: str | None = None
) -> DataFrame:
    """Timeline rows of one case, or of all: received, scored and each feedback."""
    cases = decisions.select("case_id", "transaction_id")
    if case_id is not None:
        cases = cases.where(F.col("case_id") == case_id)
        feedback = feedback.where(F.col("case_id") == case_id)
        wanted = _transactions_of(cases)
        latest_raw, latest_scored = _latest_for(raw, wanted), _latest_for(scored, wanted)
    else:
        order = ["event_time", "event_seq"]
        latest_raw = latest_per_key(raw.select("transaction_id", *order), ["transaction_id"], order)
        latest_scored = latest_per_key(
            scored.select("transaction_id", "score", "model_name", "model_version", *order),
            ["transaction_id"],
            order,
        )
    received = lookup(cases, latest_raw, ["transaction_id"], "case_id", how="inner").select(
        "case_id",
        F.lit("ingested").alias("type"),
        F.lit(0).alias("step"),
        F.col("event_time").alias("timestamp"),
        F.lit("Transaction received").alias("detail"),
    )
    rated = lookup(cases, latest_scored, ["transaction_id"], "case_id", how="inner").select(
        "case_id",
        F.lit("scored").alias("type"),
        F.lit(1).alias("step"),
        F.col("event_time").alias("timestamp"),
        scored_text(F.col("score"), F.col("model_name"), F.col("model_version")).alias("detail"),
    )
    marked = feedback.select(
        "case_id",
        F.lit("feedback").alias("type"),
        F.lit(2).alias("step"),
        F.col("created_at").alias("timestamp"),
        feedback_message().alias("detail"),
    )
    rows = received.unionByName(rated).unionByName(marked)
    if case_id is not None:
        return rows.orderBy("timestamp", "step", "detail")
    return rows


def feedback_message() -> Column:
    return F.concat(F.col("analyst_id"), F.lit(" marked "), F.col("feedback_label"))


def recent_activity(decisions: DataFrame, scored: DataFrame, feedback: DataFrame, limit: int = 8) -> DataFrame:
    """The newest decisions and feedback, merged, newest first."""
    if not 1 <= limit <= MAX_ACTIVITIES:
        raise ValueError("limit must be between 1 and 12")
    newest = (
        decisions.select("case_id", "transaction_id", "decision", "case_status", "decision_time", "rule_hits")
        .orderBy(F.col("decision_time").desc(), F.col("case_id"))
        .limit(limit)
    )
    rated = scored.select("transaction_id", "score", "scenario", "event_time", "event_seq")
    ratings = _latest_for(rated, _transactions_of(newest, limit)).select("transaction_id", "score", "scenario")
    rule_id = first_rule_id(F.col("rule_hits"))
    judged = newest.join(ratings, "transaction_id", "left").select(
        F.concat(F.lit("decision:"), "case_id").alias("id"),
        F.lit("decision").alias("type"),
        F.col("decision_time").alias("timestamp"),
        "case_id",
        "transaction_id",
        "decision",
        F.col("case_status").alias("status"),
        "score",
        "scenario",
        rule_id.alias("rule_id"),
        activity_message(F.col("decision"), F.col("transaction_id"), rule_id, F.col("score")).alias("message"),
    )
    marked = (
        feedback.orderBy(F.col("created_at").desc(), F.col("feedback_id"))
        .limit(limit)
        .select(
            F.concat(F.lit("feedback:"), "feedback_id").alias("id"),
            F.lit("feedback").alias("type"),
            F.col("created_at").alias("timestamp"),
            "case_id",
            "transaction_id",
            "feedback_label",
            "analyst_id",
            feedback_message().alias("message"),
        )
    )
    merged = judged.unionByName(marked, allowMissingColumns=True)
    return merged.orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit)


def new_activities(previous: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the current snapshot whose id the previous one did not have."""
    return current.join(previous.select(key).distinct(), key, "left_anti")


def route_feedback(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Feedback entries with the transaction and event of their case, and an ``error``.

    ``feedback`` holds case_id, analyst_id, feedback_label, notes and created_at. The error is
    NULL for entries that can be stored; entries for unknown cases say so and have no
    transaction. Many entries for one case are spread by their own content.
    """
    cases = decisions.select("case_id", "transaction_id", "event_id", F.lit(True).alias("__known"))
    entry = F.concat_ws(
        "|", "case_id", "analyst_id", "feedback_label", F.unix_micros("created_at").cast("string")
    )
    keyed = feedback.withColumn("feedback_id", uuid_from(entry))
    error = F.when(F.col("__known").isNull(), F.concat(F.lit("unknown case "), F.coalesce("case_id", F.lit("null"))))
    return lookup(keyed, cases, ["case_id"], "feedback_id").withColumn("error", error).drop("__known")


def link_feedback(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """The feedback entries of known cases, with the transaction and event of their case."""
    return route_feedback(feedback, decisions).where(F.col("error").isNull()).drop("error")


def audit_rows(feedback: DataFrame) -> DataFrame:
    """Audit entries of feedback."""
    return feedback.select(
        F.lit("fraud_case").alias("entity_type"),
        F.col("case_id").alias("entity_id"),
        F.lit("analyst_feedback").alias("action"),
        F.col("analyst_id").alias("actor"),
        F.to_json(F.struct(*feedback.columns)).alias("payload"),
        "created_at",
    )
