"""The streaming decision job: messages in, decisions, stage messages and dead letters out."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyguard.functions.scalars import hour_start
from tallyguard.operators.features import FeatureWindows
from tallyguard.operators.metrics import bucket_counts
from tallyguard.operators.rules import Rule, apply_rules, load_rules
from tallyguard.operators.scoring import FittedScorer, LogisticScorer, score
from tallyguard.operators.validate import GOOD, dead_letters, normalise, route_messages
from tallyguard.sources.sinks import (
    dead_letter_messages,
    decision_rows,
    fan_out,
    raw_rows,
    scored_rows,
    with_case,
    write_batch,
    write_messages,
)
from tallyguard.schemas import STATE_TTL_SECONDS
from tallyguard.streaming.processor import (
    CLAIM_BUCKETS,
    CLAIM_SECONDS,
    EVENT,
    MERCHANT_SALTS,
    REPEAT,
    TIMES,
    carried,
    claimed_rows,
    history_features,
    with_history,
)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COPY_SALTS = 8


# Least state partitions of a stream, and rows of a micro-batch that a partition should have at most.
LEAST_PARTITIONS = 16
PARTITION_ROWS = 250_000


def suited_partitions(spark: SparkSession, batch_rows: int = 0) -> int:
    """State partitions of a stream on this cluster: two a core, at most ``spark.sql.shuffle.partitions``,
    and more where micro-batches are large. Opening a store and its Python worker costs about a second
    for each stateful step and micro-batch, and every output is written once a partition, so many more
    partitions than cores only cost time."""
    cores = max(LEAST_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
    return max(min(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(batch_rows / PARTITION_ROWS))


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None = None) -> Iterator[None]:
    """Settings a stream takes over when it starts; the session gets its own back.

    State lies in RocksDB: it may grow beyond the heap, and stateful processors need it. Every
    state partition is a store of its own that commits in each micro-batch. A checkpoint keeps
    the number of partitions it began with, so ``state_partitions`` should suit the cluster that
    the stream may grow to; unless given, it is that of ``suited_partitions``.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.shuffle.partitions": str(state_partitions or suited_partitions(spark)),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drop_repeats(
    events: DataFrame, horizon: str = "30 days", copy_salts: int = COPY_SALTS, clock: str = "event_time"
) -> DataFrame:
    """First delivery of each event id within the horizon of the ``clock`` column, repeats dropped
    silently. The decision job marks repeats instead (``claimed_rows``).

    Rows older than the horizon behind the newest one are dropped with the claims they would
    need. Deliveries are first reduced per (id, salt) and then per id, so that an id delivered
    very often does not send all its copies to one task.
    """
    marked = events.withWatermark(clock, horizon)
    if copy_salts > 1:
        marked = (
            marked.withColumn("__salt", F.pmod(F.xxhash64("event_seq"), F.lit(copy_salts)))
            .dropDuplicatesWithinWatermark(["event_id", "__salt"])
            .drop("__salt")
        )
    return marked.dropDuplicatesWithinWatermark(["event_id"])


def decided_stream(
    messages: DataFrame,
    claim_seconds: int = CLAIM_SECONDS,
    claim_buckets: int = CLAIM_BUCKETS,
    windows: FeatureWindows = FeatureWindows(),
    state_ttl_seconds: int | None = STATE_TTL_SECONDS,
    late_seconds: int = 0,
    wait_seconds: int | None = None,
    merchant_salts: int = MERCHANT_SALTS,
) -> DataFrame:
    """Good messages with their features, repeated deliveries, and bad messages as they came.

    ``route`` tells them apart. All pass the stateful steps in one branch, so a message is read
    and decoded once. The clock is the arrival time, so an event that is late by its own time is
    still claimed and decided. Rules and scores are added per micro-batch, so that a new model
    takes effect without a restart.
    """
    routed = route_messages(messages)
    event = F.struct("event.*", "event_seq")
    good = F.col("route") == GOOD
    schema = routed.select(event.alias("e")).schema["e"].dataType
    lost = F.struct(*routed.columns)
    lost_schema = routed.select(lost.alias("e")).schema["e"].dataType
    arrived = F.coalesce("timestamp", F.col("event")["event_time"])
    payload = F.when(good, F.to_json(event, TIMES)).otherwise(F.to_json(lost, TIMES))
    timed = routed.withColumn("__arrived", arrived).withWatermark("__arrived", "0 seconds")
    rows = timed.select(*carried(F.col("event"), F.col("event_seq"), F.col("__arrived"), payload, F.col("route")))
    claimed = claimed_rows(rows, claim_seconds, claim_buckets)
    history = with_history(claimed, windows, state_ttl_seconds, late_seconds, wait_seconds, merchant_salts)
    found = history.withColumn("event", F.when(F.col("kind") == EVENT, F.from_json("payload", schema, TIMES)))
    columns = [F.col("event")[c].alias(c) for c in schema.fieldNames()]
    repeated = F.struct("event_id", F.col("seq").alias("event_seq"), "repeat_of", F.timestamp_millis("arrived").alias("arrived"))
    is_event, is_repeat = F.col("kind") == EVENT, F.col("route") == REPEAT
    return found.select(
        "route",
        F.timestamp_millis("arrived").alias("arrived"),
        F.when(is_event, F.struct(*columns, history_features().alias("features"))).alias("good"),
        F.when(is_repeat, repeated).alias("repeat"),
        F.when(~is_event & ~is_repeat, F.from_json("payload", lost_schema, TIMES)).alias("bad"),
    )


def stage_counts(decided: DataFrame, batch: DataFrame) -> DataFrame:
    """Events of a batch by stage, status and minute of arrival (``at``, in seconds). The counts of
    batches add up, so rates and totals come from a table that is small whatever the events."""
    at = (F.floor(F.unix_seconds("arrived") / 60) * 60).cast("bigint").alias("at")
    events = F.count(F.lit(1)).alias("events")
    stages = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), status.alias("status"))
            for stage, status in (
                ("validated", F.lit("ok")),
                ("enriched", F.lit("ok")),
                ("decisioned", F.col("decision")),
            )
        ]
    )
    good = decided.groupBy(at, "decision").agg(events).select("at", F.inline(stages), "events")
    repeated = F.col("route") == REPEAT
    stage = F.when(repeated, "dedupe").otherwise(F.col("route")).alias("stage")
    status = F.when(repeated, "duplicate").otherwise("failed").alias("status")
    others = batch.where(F.col("route") != GOOD).groupBy(at, stage, status).agg(events)
    return good.unionByName(others).groupBy("at", "stage", "status").agg(F.sum("events").alias("events"))


def latency_counts(decided: DataFrame) -> DataFrame:
    """Histograms of a batch by minute of arrival: how long events took to arrive (``source``), and
    from there to their decision (``end_to_end``)."""
    seconds = {
        "source": F.unix_micros("arrived") - F.unix_micros("event_time"),
        "end_to_end": F.unix_micros(F.current_timestamp()) - F.unix_micros("arrived"),
    }
    samples = F.array(
        *[F.struct(F.lit(k).alias("stage"), (F.greatest(v, F.lit(0)) / 1_000_000).alias("latency")) for k, v in seconds.items()]
    )
    rows = decided.select("arrived", F.inline(samples))
    return bucket_counts(rows, F.unix_micros("arrived"), F.col("latency"), ["stage"])


class BatchWriter:
    """Writes one micro-batch: tables, duplicates, stage messages, dead letters, and the counts and
    latencies that rates and alerts are made of.

    Every output folder carries the batch id and is overwritten on a retry, so a batch that
    runs twice leaves one set of rows. The last write publishes the batch: ``published`` shows
    a reader only batches whose outputs are all there.
    """

    def __init__(self, out_dir: str, scorer=None, rules: list[Rule] | None = None, reload=None) -> None:
        self.out_dir = out_dir
        self.scorer = scorer or LogisticScorer()
        self.rules = load_rules() if rules is None else rules
        self.reload = reload

    def _current_scorer(self) -> LogisticScorer | FittedScorer:
        """The scorer in use; asks ``reload`` for a newer model before each batch."""
        newer = self.reload() if self.reload else None
        if newer is not None and newer.model.model_version != self.scorer.model.model_version:
            self.scorer = newer
        return self.scorer

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        decided = None
        try:
            timed = "arrived" in batch.columns
            arrived = ["arrived"] if timed else []
            enriched = normalise(batch.where(F.col("route") == GOOD).select("good.*", *arrived))
            judged = score(apply_rules(enriched, self.rules), self._current_scorer())
            decided = with_case(judged, "event_time").persist(StorageLevel.MEMORY_AND_DISK)
            bad = F.col("bad").isNotNull()
            letters = dead_letters(batch.where(bad).select("bad.*"))
            if "repeat" in batch.columns:
                write_batch(batch.where(F.col("repeat").isNotNull()).select("repeat.*"), f"{self.out_dir}/duplicates", batch_id)
            write_batch(raw_rows(decided), f"{self.out_dir}/transactions_raw", batch_id)
            write_batch(scored_rows(decided), f"{self.out_dir}/transactions_scored", batch_id)
            write_batch(decision_rows(decided), f"{self.out_dir}/fraud_decisions", batch_id)
            write_batch(letters, f"{self.out_dir}/dead_letters", batch_id)
            messages = fan_out(decided).unionByName(dead_letter_messages(letters))
            write_messages(messages, f"{self.out_dir}/messages", batch_id)
            if timed:
                write_batch(stage_counts(decided, batch), f"{self.out_dir}/stage_counts", batch_id)
                write_batch(latency_counts(decided), f"{self.out_dir}/latency_counts", batch_id)
            publish_batch(batch.sparkSession, self.out_dir, batch_id)
        finally:
            if decided is not None:
                decided.unpersist()
            batch.unpersist()


def publish_batch(spark: SparkSession, out_dir: str, batch_id: int) -> None:
    """Marks a batch as complete, by one small file."""
    write_batch(spark.range(1).select(F.current_timestamp().alias("at")), f"{out_dir}/published", batch_id)


def published(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """The rows of an output table whose batches are complete. Batch ids are folder names, so where
    Spark broadcasts the ids it skips the folders of other batches."""
    done = spark.read.parquet(f"{out_dir}/published").select("batch_id").distinct()
    return spark.read.parquet(f"{out_dir}/{table}").join(done, "batch_id", "left_semi")


def start_stream(
    messages: DataFrame,
    out_dir: str,
    checkpoint: str,
    writer: BatchWriter | None = None,
    trigger: dict[str, object] | None = None,
    state_partitions: int | None = None,
    **options: object,
) -> StreamingQuery:
    """Starts the decision job on a stream of messages."""
    with stream_settings(messages.sparkSession, state_partitions):
        return (
            decided_stream(messages, **options)
            .writeStream.queryName("decisions")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(writer or BatchWriter(out_dir))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", state_partitions: int | None = None
) -> None:
    """Runs a stream over all available input into a Parquet folder, then stops."""
    with stream_settings(stream.sparkSession, state_partitions):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .option("path", path)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def run_hourly_counts(events: DataFrame, label: str, path: str, checkpoint: str) -> None:
    """Writes the counts by hour and label that each micro-batch adds.

    A micro-batch needs no state and no watermark: its counts go to a folder of its own, which a
    retry overwrites. So no row is too late, and an hour is readable while it is still open.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        hour = hour_start(F.unix_micros("event_time")).alias("bucket")
        write_batch(batch.groupBy(hour, label).agg(F.count(F.lit(1)).alias("added")), path, batch_id)

    query = (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(add)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def hourly_counts(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The counts so far: the sum of what the micro-batches added."""
    return spark.read.parquet(path).groupBy("bucket", label).agg(F.sum("added").alias("count"))


def progress_counters(query: StreamingQuery) -> list[dict[str, object]]:
    """Rows and rates per finished micro-batch, and rows dropped as too late."""
    return [
        {
            "batch_id": p["batchId"],
            "input_rows": p["numInputRows"],
            "rows_per_second": p.get("processedRowsPerSecond"),
            "late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", [])),
            "duration_ms": p.get("durationMs", {}).get("triggerExecution"),
        }
        for p in query.recentProgress
    ]


class StreamCounters(StreamingQueryListener):
    """Keeps what each micro-batch reported, while the stream runs: rows, rows too late for the
    claims, and how long the batch and its phases took. Only the newest ``keep`` are held."""

    def __init__(self, keep: int = 1_000) -> None:
        self.rows: deque[dict[str, object]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append(
            {
                "name": p.name,
                "batch_id": p.batchId,
                "started": p.timestamp,
                "input_rows": p.numInputRows,
                "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
                "state_commit_ms": sum(s.commitTimeMs for s in p.stateOperators),
                "batch_ms": p.durationMs.get("triggerExecution", 0),
            }
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        """The held batches as a table, the input of rates, latency histograms and alerts."""
        schema = (
            "name string, batch_id long, started string, input_rows long, late_rows long, state_rows long, "
            "state_commit_ms long, batch_ms long"
        )
        table = spark.createDataFrame(list(self.rows), schema)
        return table.withColumn("started", F.col("started").cast("timestamp"))
