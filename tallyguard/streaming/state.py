"""What a running stream knows, read from the state in its checkpoint."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def operator_of(spark: SparkSession, checkpoint: str, variable: str) -> int:
    """The number of the stateful step that has a state variable of this name."""
    steps = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").distinct()
    for step in steps.collect():
        properties = json.loads(step["operatorProperties"] or "{}")
        names = [json.loads(v)["stateName"] if isinstance(v, str) else v["stateName"] for v in properties.get("stateVariables", [])]
        if variable in names:
            return step["operatorId"]
    raise ValueError(f"no step of the stream in {checkpoint} has a state {variable!r}")


def read_state(spark: SparkSession, checkpoint: str, variable: str, batch_id: int | None = None) -> DataFrame:
    """Keys and values of a state variable after a batch, the last one unless given. The rows are
    read where the state lies, partition by partition."""
    reader = (
        spark.read.format("statestore")
        .option("operatorId", operator_of(spark, checkpoint, variable))
        .option("stateVarName", variable)
    )
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def account_states(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """One row per account in the state: events and spend of its present life, first and last event,
    and how many devices and merchants it has used. This is the context of its next event."""
    profile, account = F.col("value"), F.col("key")["account_id"].alias("account_id")
    return read_state(spark, checkpoint, "profile", batch_id).select(
        account,
        profile["n"].alias("rolling_count"),
        (profile["total"].cast("decimal(38,0)") / 1_000_000).cast("double").alias("rolling_sum"),
        F.timestamp_micros(profile["first_us"]).alias("first_seen"),
        F.timestamp_micros(profile["last_us"]).alias("last_time"),
        profile["latitude"].alias("last_latitude"),
        profile["longitude"].alias("last_longitude"),
        profile["country"].alias("last_country"),
        profile["known_devices"].alias("known_devices"),
        profile["known_merchants"].alias("known_merchants"),
    )
