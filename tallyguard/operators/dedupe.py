"""First delivery per event, duplicate reports and latest row per key.

The first of a rank and the aggregations both have a step before the shuffle, in which many
copies of one key shrink to one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.skew import lookup


def _ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, keys, [F.col(c).asc() for c in order])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; end the order with an id to settle ties."""
    return _ranked(df, keys, [F.col(c).desc() for c in order])


def claim_first(events: DataFrame) -> DataFrame:
    """Each event id once: its first delivery in (time, sequence) order."""
    return first_per_key(events, ["event_id"], ["event_time", "event_seq"])


def duplicate_deliveries(events: DataFrame) -> DataFrame:
    """All deliveries but the first of each event id."""
    first = events.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("event_time", "event_seq")).alias("first")
    )
    repeated = first.where("copies > 1").drop("copies")
    marked = lookup(events, repeated, ["event_id"], "event_seq", how="inner")
    return marked.where(F.col("first") < F.struct("event_time", "event_seq")).drop("first")


def duplicate_report(events: DataFrame) -> DataFrame:
    """One row: deliveries, distinct events and duplicates."""
    per_event = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return per_event.agg(
        F.sum("n").alias("deliveries"),
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    )
