"""Validation, normalisation and routing of decoded messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.scalars import round_exact, uuid_from
from tallyguard.schemas import CONTRACT, RAW_TOPIC
from tallyguard.sources.json_events import decode_events

GOOD, CONTRACT_ERROR, BUSINESS_ERROR, SOURCE_ERROR = "good", "validation", "processing", "kafka_source"


# The largest amount that the stored decimals hold.
MAX_AMOUNT = 1e12


def in_range(value: Column, limit: float) -> Column:
    """Whether a number is finite and closer to zero than the limit; NULL passes."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < limit), F.lit(True))


def business_errors(
    account_id: Column,
    transaction_id: Column,
    amount: Column,
    failures: Column,
    latitude: Column | None = None,
    longitude: Column | None = None,
) -> Column:
    """Messages of the broken business rules, comma separated; empty text when there is none.

    A number that isn't finite, or too large to store, breaks a rule, so that nothing after this
    check meets a value that it can't convert.
    """
    checks = [
        (account_id == "", "account_id is required"),
        (transaction_id == "", "transaction_id is required"),
        (amount <= 0, "amount must be positive"),
        (~in_range(amount, MAX_AMOUNT), f"amount must be a number below {MAX_AMOUNT:.0f}"),
        (failures < 0, "prior_auth_failures cannot be negative"),
    ]
    for name, degrees in (("latitude", latitude), ("longitude", longitude)):
        if degrees is not None:
            checks.append((~in_range(degrees, MAX_AMOUNT), f"{name} must be a finite number"))
    return F.concat_ws(", ", *[F.when(broken, F.lit(text)) for broken, text in checks])


def normalise(events: DataFrame, source_topic: str = RAW_TOPIC) -> DataFrame:
    """Adds the validated-stage columns to valid events."""
    return events.withColumns(
        {
            "normalized_amount": round_exact(F.col("amount"), 2),
            "normalized_currency": F.upper("currency"),
            "validation_status": F.lit("valid"),
            "validation_errors": F.array().cast("array<string>"),
            "received_topic": F.lit(source_topic),
        }
    )


def route_messages(messages: DataFrame) -> DataFrame:
    """Adds ``event``, ``route`` and ``error_message`` to raw messages.

    Each message takes exactly one route: good, validation (breaks the contract), processing
    (breaks a business rule) or kafka_source (the source delivered no value). Bad messages are
    routed before duplicates are dropped, so a corrected retry under the same id is accepted.
    """
    decoded = decode_events(messages)
    event = F.col("event")
    broken = business_errors(
        event["account_id"],
        event["transaction_id"],
        event["amount"],
        event["prior_auth_failures"],
        event["latitude"],
        event["longitude"],
    )
    no_value = F.col("value").isNull()
    contract = F.size("errors") > 0
    return decoded.withColumns(
        {
            "route": F.when(no_value, SOURCE_ERROR)
            .when(contract, CONTRACT_ERROR)
            .when(broken != "", BUSINESS_ERROR)
            .otherwise(GOOD),
            "error_message": F.when(no_value, F.lit("source delivered no value"))
            .when(contract, F.concat_ws("; ", "errors"))
            .otherwise(broken),
        }
    )


def valid_events(routed: DataFrame) -> DataFrame:
    """Contract columns and ``event_seq`` of the good messages."""
    return routed.where(F.col("route") == GOOD).select("event.*", "event_seq")


def dead_letters(routed: DataFrame, created_at: Column | None = None) -> DataFrame:
    """One dead letter per message off the good route."""
    business = F.col("route") == BUSINESS_ERROR
    payload = (
        F.when(business, F.to_json("event"))
        .when(F.col("route") == SOURCE_ERROR, F.to_json(F.struct(F.col("error_message").alias("error"))))
        .otherwise(F.to_json(F.struct(F.col("value").alias("payload"))))
    )
    position = F.concat_ws(":", F.col("topic"), F.col("event_seq").cast("string"), F.col("route"))
    return routed.where(F.col("route") != GOOD).select(
        uuid_from(position).alias("dead_letter_id"),
        F.when(business, F.col("event")["event_id"]).alias("event_id"),
        F.col("topic").alias("source_topic"),
        F.col("route").alias("failed_stage"),
        "error_message",
        payload.alias("raw_payload"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def contract_columns(df: DataFrame) -> DataFrame:
    """Only the contract fields."""
    return df.select(*CONTRACT)
