"""Streaming sources with the columns of raw messages: key, value, topic, timestamp, event_seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.schemas import RAW_TOPIC

MESSAGE_SCHEMA = "key string, value string, topic string, timestamp timestamp, event_seq bigint"


def kafka_messages(
    spark: SparkSession, brokers: str, topic: str = RAW_TOPIC, max_per_trigger: int = 2_000_000
) -> DataFrame:
    """The raw topic. Needs Spark's Kafka package on the class path.

    The arrival order inside a partition is the offset; a key always lies in one partition, so
    the offset breaks ties between events of one account.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_per_trigger)
        .option("startingOffsets", "earliest")
        .load()
        .select(
            F.col("key").cast("string"),
            F.col("value").cast("string"),
            "topic",
            "timestamp",
            F.col("offset").alias("event_seq"),
        )
    )


def file_messages(spark: SparkSession, path: str, max_files: int = 1, kind: str = "parquet") -> DataFrame:
    """The same columns from files, oldest first."""
    return (
        spark.readStream.format(kind)
        .schema(MESSAGE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A driver table read as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}*.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(sf_dir)
    )
