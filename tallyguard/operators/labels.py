"""Training labels from raw transactions and analyst feedback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.skew import keyed_running, lookup

MINIMUM_LABELLED = 200


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """Per transaction: number of entries and the latest label (partial aggregation first)."""
    return feedback.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("feedback_count"),
        F.max_by("feedback_label", F.struct("created_at", "feedback_id")).alias("latest_feedback_label"),
    )


def feedback_labels(feedback: DataFrame) -> DataFrame:
    """The label list of each transaction as rows, position 1 being the newest.

    A list column would put all entries of one transaction into one row; rows have no such limit.
    """
    ordered = feedback.select(
        "transaction_id",
        "feedback_label",
        (-F.unix_micros("created_at")).alias("__newest"),
        F.col("feedback_id").alias("__id"),
    )
    numbered = keyed_running(
        ordered, ["transaction_id"], "__newest", "__id", {"position": F.lit(1).cast("bigint")}
    )
    return numbered.select("transaction_id", (F.col("position") + 1).alias("position"), "feedback_label")


def training_frame(raw: DataFrame, feedback: DataFrame) -> DataFrame:
    """Raw transactions with resolved labels.

    The latest feedback decides: fraud gives 1, false_positive and legitimate give 0, review
    keeps the synthetic label (and its source stays ``synthetic`` even if there is none).
    """
    joined = lookup(raw, feedback_rollup(feedback), ["transaction_id"], "event_id")
    latest = F.col("latest_feedback_label")
    resolved = F.when(latest == "fraud", 1).when(latest.isin("false_positive", "legitimate"), 0)
    source = (
        F.when(resolved.isNotNull(), "analyst_feedback")
        .when(latest.isNotNull() | F.col("label").isNotNull(), "synthetic")
        .otherwise("unlabeled")
    )
    return joined.withColumns(
        {
            "label": F.coalesce(resolved, F.col("label")).cast("int"),
            "label_source": source,
            "feedback_count": F.coalesce("feedback_count", F.lit(0).cast("bigint")),
        }
    )


def labelled(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("label").isNotNull())


def training_source(
    frame: DataFrame, fallback: Callable[[], DataFrame], minimum: int = MINIMUM_LABELLED
) -> DataFrame:
    """The labelled table rows where there are enough of them, else the fallback data set, which is
    read only then."""
    rows = labelled(frame)
    if rows.limit(minimum).count() < minimum:
        return fallback()
    return rows
