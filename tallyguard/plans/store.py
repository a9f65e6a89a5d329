"""Decision tables of a data folder, written once per session and shared by the queries.

The analytics read stored tables, as they would in production: the decision job runs once,
its result goes to the shared work folder, and every query after it is a pruned scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.scalars import uuid_from
from tallyguard.plans.decisions import decide
from tallyguard.session import work_dir
from tallyguard.sources.adapter import load_transactions
from tallyguard.sources.sinks import decision_rows, raw_rows, scored_rows, with_id_filters

_written: dict[tuple[str, str], str] = {}


@dataclass(frozen=True)
class Store:
    events: DataFrame
    raw: DataFrame
    scored: DataFrame
    decisions: DataFrame
    feedback: DataFrame


def feedback_entries(events: DataFrame) -> DataFrame:
    """Analyst feedback derived from the cases: a label a minute after each fifth decision, and
    a second, opposite one another minute later for each fifteenth."""
    seq = F.col("event_seq")
    labels = F.array(*[F.lit(x) for x in ("fraud", "false_positive", "legitimate", "review")])
    first = F.get(labels, (seq % 4).cast("int"))
    second = F.when(first == "fraud", F.lit("legitimate")).otherwise(F.lit("fraud"))
    late = F.col("decided_at")
    entries = F.array(
        F.struct(
            first.alias("feedback_label"),
            F.timestamp_add("SECOND", F.lit(60), late).alias("created_at"),
            F.lit(1).alias("turn"),
        ),
        F.struct(
            second.alias("feedback_label"),
            F.timestamp_add("SECOND", F.lit(120), late).alias("created_at"),
            F.lit(2).alias("turn"),
        ),
    )
    rows = events.where(seq % 5 == 0).select(
        "case_id", "transaction_id", "event_id", "event_seq", F.inline(entries)
    )
    return rows.where((F.col("turn") == 1) | (seq % 15 == 0)).select(
        uuid_from(F.concat(F.lit("feedback:"), "event_id", F.lit(":"), F.col("turn").cast("string"))).alias(
            "feedback_id"
        ),
        "case_id",
        "transaction_id",
        "event_id",
        F.concat(F.lit("analyst_"), (seq % 3).cast("string")).alias("analyst_id"),
        "feedback_label",
        F.lit(None).cast("string").alias("notes"),
        "created_at",
    )


def decision_store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = work_dir(spark, "decided")
        decided = decide(load_transactions(spark, sf_dir)).drop("amount_exact")
        with_id_filters(decided.write.partitionBy("event_month"), decided.columns).parquet(path)
        _written[key] = path
    events = spark.read.parquet(_written[key])
    return Store(
        events=events,
        raw=raw_rows(events),
        scored=scored_rows(events),
        decisions=decision_rows(events),
        feedback=feedback_entries(events),
    )
