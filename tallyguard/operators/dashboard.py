"""Dashboard aggregates over the score and decision tables.

Each is one conditional aggregate over one filtered scan. ``as_of`` fixes the clock; it
defaults to the current time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.scalars import hour_start
from tallyguard.operators.cases import case_filter


def since(column: str, seconds: int, as_of: Column | None = None) -> Column:
    """Trailing-time filter; also prunes month partitions where the table has them."""
    clock = F.current_timestamp() if as_of is None else as_of
    return F.col(column) >= F.timestamp_add("SECOND", F.lit(-seconds), clock)


def recent(table: DataFrame, column: str, seconds: int, as_of: Column | None = None) -> DataFrame:
    rows = table.where(since(column, seconds, as_of))
    if "event_month" in table.columns:
        clock = F.current_timestamp() if as_of is None else as_of
        first = F.timestamp_add("SECOND", F.lit(-seconds), clock)
        rows = rows.where(F.col("event_month") >= month_of(first))
    return rows


def month_of(ts: Column) -> Column:
    """Month of a timestamp in UTC as ``yyyy-MM`` text."""
    wall = F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.substring(wall.cast("string"), 1, 7)


def dashboard_overview(scored: DataFrame, hours: int = 24, as_of: Column | None = None) -> DataFrame:
    total = F.count(F.lit(1))
    blocked = F.count_if(F.col("decision") == "BLOCK")
    review = F.count_if(F.col("decision") == "REVIEW")
    return recent(scored, "event_time", hours * 3600, as_of).agg(
        F.lit(hours).alias("window_hours"),
        total.alias("total_transactions"),
        blocked.alias("blocked_transactions"),
        review.alias("review_transactions"),
        (total - blocked - review).alias("approved_transactions"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
    )


def recent_window_metrics(
    scored: DataFrame, decisions: DataFrame, window_seconds: int = 60, as_of: Column | None = None
) -> DataFrame:
    """Counts of the trailing window, and the whole backlog of open REVIEW cases."""
    backlog = decisions.agg(
        F.count_if((F.col("decision") == "REVIEW") & (F.col("case_status") == "open"))
    ).scalar()
    return (
        recent(scored, "event_time", window_seconds, as_of)
        .agg(
            F.lit(window_seconds).alias("window_seconds"),
            F.count(F.lit(1)).alias("processed_transactions"),
            F.count_if(F.col("decision") == "BLOCK").alias("blocked_transactions"),
            F.count_if(F.col("decision") == "REVIEW").alias("review_transactions"),
        )
        .withColumn("open_review_backlog", backlog)
    )


def analytics_trends(scored: DataFrame, hours: int = 24, as_of: Column | None = None) -> DataFrame:
    """Decisions per hour (``bucket`` is the epoch second of the hour start), ordered."""
    bucket = hour_start(F.unix_micros("event_time")).alias("bucket")
    return (
        recent(scored, "event_time", hours * 3600, as_of)
        .groupBy(bucket, "decision")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("bucket", "decision")
    )


def cases_live_window(
    decisions: DataFrame,
    window_seconds: int = 30,
    as_of: Column | None = None,
    status: str | None = None,
    decision: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Matching cases of the trailing window; blocked and review counts ignore the filters."""
    return decisions.where(since("decision_time", window_seconds, as_of)).agg(
        F.lit(window_seconds).alias("window_seconds"),
        F.count_if(case_filter(status, decision, search)).alias("matching_cases"),
        F.count_if(F.col("decision") == "BLOCK").alias("blocked_cases"),
        F.count_if(F.col("decision") == "REVIEW").alias("review_cases"),
    )
