"""Table projections, messages and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from tallyguard.functions.scalars import iso_utc, uuid_from
from tallyguard.operators.dashboard import month_of
from tallyguard.schemas import (
    CONTRACT,
    DECISIONS_TOPIC,
    DLQ_TOPIC,
    ENRICHED_TOPIC,
    FEEDBACK_TOPIC,
    SCORED_TOPIC,
    VALIDATED_TOPIC,
)

VALIDATED_FIELDS = [
    "normalized_amount",
    "normalized_currency",
    "validation_status",
    "validation_errors",
    "received_topic",
]
SCORED_FIELDS = ["model_probability", "final_score", "model_metadata", "rule_hits", "reason_codes"]
DECISION_FIELDS = [
    "case_id",
    "event_id",
    "transaction_id",
    "account_id",
    "decision",
    "status",
    "final_score",
    "model_probability",
    "model_metadata",
    "rule_hits",
    "reason_codes",
    "decided_at",
    "simulation_scenario",
]


def with_case(scored: DataFrame, decided_at: str | None = None) -> DataFrame:
    """Adds case id (derived from the event id), open status and decision time."""
    clock = F.col(decided_at) if decided_at else F.current_timestamp()
    return scored.withColumns(
        {
            "case_id": uuid_from(F.concat(F.lit("case:"), "event_id")),
            "status": F.lit("open"),
            "decided_at": clock,
            "event_month": month_of(F.col("event_time")),
        }
    )


def raw_rows(events: DataFrame) -> DataFrame:
    """``transactions_raw``: key columns, exact amount and the whole payload."""
    return events.select(
        "event_id",
        "transaction_id",
        "account_id",
        "customer_id",
        "merchant_id",
        F.col("amount").cast("decimal(14,2)").alias("amount"),
        "currency",
        "channel",
        F.col("simulation_scenario").alias("scenario"),
        F.struct(*CONTRACT, F.col("received_topic").alias("source_topic")).alias("payload"),
        "label",
        "event_time",
        "event_seq",
        "event_month",
    )


def scored_rows(events: DataFrame) -> DataFrame:
    """``transactions_scored``; the threshold column holds the review threshold."""
    model = F.col("model_metadata")
    return events.select(
        "event_id",
        "transaction_id",
        "account_id",
        "merchant_id",
        model["model_name"].alias("model_name"),
        model["model_version"].alias("model_version"),
        "decision",
        F.col("simulation_scenario").alias("scenario"),
        F.col("final_score").alias("score"),
        model["review_threshold"].alias("threshold"),
        "rule_hits",
        "features",
        "reason_codes",
        "event_time",
        "event_seq",
        "event_month",
    )


def decision_rows(events: DataFrame) -> DataFrame:
    """``fraud_decisions``: one open case per event."""
    return events.select(
        "case_id",
        "transaction_id",
        "event_id",
        "account_id",
        F.col("event_id").alias("scored_event_id"),
        "decision",
        F.lit("stream_worker").alias("source"),
        F.col("status").alias("case_status"),
        "model_metadata",
        "rule_hits",
        F.col("decided_at").alias("decision_time"),
        "event_month",
    )


def registry_rows(models: DataFrame) -> DataFrame:
    """``model_registry`` rows from model metadata, stage ``active``."""
    return models.select(
        "model_name",
        "model_version",
        F.col("model_alias").alias("alias"),
        "run_id",
        F.lit("active").alias("stage"),
        F.struct(*[c for c in models.columns if c != "created_at"]).alias("metadata"),
        "created_at",
    )


def _as_text(df: DataFrame, fields: list[str]):
    """JSON text of the fields, times as ISO-8601 in UTC, NULLs kept."""
    values = []
    for name in fields:
        value = F.col(name)
        if df.schema[name].dataType.typeName() == "timestamp":
            value = iso_utc(value)
        values.append(value.alias(name))
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def stage_messages(events: DataFrame) -> dict[str, DataFrame]:
    """The four stage messages of each decided event, keyed by account."""
    validated = [*CONTRACT, *VALIDATED_FIELDS]
    stages = {
        VALIDATED_TOPIC: validated,
        ENRICHED_TOPIC: [*validated, "features"],
        SCORED_TOPIC: [*validated, "features", *SCORED_FIELDS],
        DECISIONS_TOPIC: DECISION_FIELDS,
    }
    return {
        topic: events.select(
            F.col("account_id").alias("key"),
            _as_text(events, fields).alias("value"),
            F.lit(topic).alias("topic"),
        )
        for topic, fields in stages.items()
    }


def fan_out(events: DataFrame) -> DataFrame:
    """All stage messages as one frame with a topic per row, the form a topic sink takes."""
    merged = None
    for frame in stage_messages(events).values():
        merged = frame if merged is None else merged.unionByName(frame)
    return merged


def feedback_messages(feedback: DataFrame) -> DataFrame:
    """Feedback as messages keyed by case."""
    return feedback.select(
        F.col("case_id").alias("key"),
        _as_text(feedback, feedback.columns).alias("value"),
        F.lit(FEEDBACK_TOPIC).alias("topic"),
    )


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as messages keyed by event id (NULL where unknown)."""
    return letters.select(
        F.col("event_id").alias("key"),
        _as_text(letters, letters.columns).alias("value"),
        F.lit(DLQ_TOPIC).alias("topic"),
    )


# Ids that single rows are looked up by. They are random, so their ranges tell nothing.
POINT_IDS = ("transaction_id", "event_id", "case_id")


def with_id_filters(writer: DataFrameWriter, columns: list[str]) -> DataFrameWriter:
    """The writer with a Bloom filter for each id column in every row group, as large as its ids need:
    a look-up by id reads only the row groups that may hold it."""
    for name in POINT_IDS:
        if name in columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def write_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Appends rows to a Parquet table.

    Rows are not moved between tasks for it: a month with very many rows is written by many
    tasks. The file size limit keeps a large task from making one huge file.
    """
    writer = with_id_filters(df.write.mode("append").option("maxRecordsPerFile", 5_000_000), df.columns)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes the rows of one batch so that a repeated batch replaces its own rows only."""
    with_id_filters(df.write.mode("overwrite"), df.columns).parquet(f"{path}/batch_id={batch_id}")


def write_messages(df: DataFrame, path: str, batch_id: int) -> None:
    """Messages of one batch, a folder per topic. The values are JSON texts with the same names in each
    row, which this compression makes far smaller than the default one."""
    target = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("topic").parquet(target)


def topic_options(brokers: str, **more: str) -> dict[str, str]:
    """Options of the topic writer: all replicas confirm, and a retry doesn't write twice."""
    return {
        "kafka.bootstrap.servers": brokers,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.compression.type": "zstd",
        **more,
    }


def topic_rows(messages: DataFrame) -> DataFrame:
    """Messages as the topic writer takes them: binary key and value, and the topic of each row."""
    return messages.select(F.col("key").cast("binary"), F.col("value").cast("binary"), "topic")


def write_topics(messages: DataFrame, brokers: str, **more: str) -> None:
    """Sends messages to their topics. Needs Spark's Kafka package on the class path."""
    topic_rows(messages).write.format("kafka").options(**topic_options(brokers, **more)).save()


def export_csv(events: DataFrame, path: str) -> None:
    """Contract columns as CSV with a header, ``metadata`` as JSON text, times in UTC."""
    columns = []
    for name in CONTRACT:
        value = F.col(name)
        if name == "metadata":
            value = F.to_json(value)
        elif name == "event_time":
            value = iso_utc(value)
        columns.append(value.alias(name))
    events.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report (a few rows) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


