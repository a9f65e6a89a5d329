"""Batch scans: CSV datasets, raw tables, registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.operators.dedupe import latest_per_key
from tallyguard.schemas import TRANSACTION
from tallyguard.sources.json_events import coerce_training_rows

CSV_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name in ("metadata", "event_time") else f.dataType)
        for f in TRANSACTION.fields
    ]
)


def read_csv_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a CSV dataset with the 27 contract columns; no schema inference."""
    rows = spark.read.schema(CSV_SCHEMA).option("header", True).option("escape", '"').csv(path)
    return coerce_training_rows(rows)


def read_raw_table(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """The raw transaction table; sorted by event time only where the reader asks for it."""
    rows = spark.read.parquet(path)
    return rows.orderBy("event_time", "event_seq") if ordered else rows


def current_model(registry: DataFrame, alias: str = "champion") -> DataFrame:
    """The newest registry row of an alias (none if there is no such row)."""
    return latest_per_key(registry.where(F.col("alias") == alias), ["alias"], ["created_at", "model_version"])


def current_models(registry: DataFrame) -> DataFrame:
    """The newest registry row of every alias."""
    return latest_per_key(registry, ["alias"], ["created_at", "model_version"])
