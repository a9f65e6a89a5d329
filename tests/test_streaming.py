from __future__ import annotations

import json
import random
import time
from collections import Counter
from dataclasses import replace
from datetime import timedelta

import pandas as pd
import pytest
from helpers import assert_features, expected_features, frame, random_events
from pyspark.sql import functions as F

from tallyguard.functions.scalars import iso_utc
from tallyguard.operators.features import FeatureWindows, add_features
from tallyguard.operators.scoring import LogisticScorer
from tallyguard.schemas import CONTRACT
from tallyguard.sources.sinks import topic_options, topic_rows
from tallyguard.sources.streams import MESSAGE_SCHEMA, file_messages
from tallyguard.streaming import job, processor
from tallyguard.streaming.job import (
    BatchWriter,
    StreamCounters,
    decided_stream,
    hourly_counts,
    progress_counters,
    published,
    run_hourly_counts,
    run_to_table,
    start_stream,
    stream_settings,
)
from tallyguard.streaming.processor import CARRIED, carried, local_repeats, stream_features
from tallyguard.streaming.state import account_states


def write_parts(spark, rows, folder, parts):
    """Events in time order, one file per part."""
    ordered = sorted(rows, key=lambda r: (r["event_time"], r["event_seq"]))
    size = -(-len(ordered) // parts)
    for i in range(parts):
        part = frame(spark, ordered[i * size : (i + 1) * size])
        part.coalesce(1).write.parquet(f"{folder}/part{i}")
    return frame(spark, rows).schema


def run(spark, schema, folder, out, checkpoint, **options):
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", False)
        .parquet(f"{folder}/part*")
    )
    run_to_table(stream_features(stream, **options), out, checkpoint, state_partitions=3)
    return spark.read.parquet(out)


def test_many_micro_batches_equal_brute_force(spark, tmp_path):
    rows = random_events(11, 240)
    schema = write_parts(spark, rows, f"{tmp_path}/in", 3)
    out = run(spark, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert_features(out, expected_features(rows))


def test_state_lifetime_equals_batch(spark, tmp_path):
    rows = random_events(12, 120)
    for i, row in enumerate(rows):
        row["event_time"] = row["event_time"].replace(day=1 + (row["event_seq"] * 7) % 28)
    schema = write_parts(spark, rows, f"{tmp_path}/in", 2)
    out = run(spark, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", state_ttl_seconds=3 * 86_400)
    batch = add_features(frame(spark, rows), state_ttl_seconds=3 * 86_400)
    assert_features(out, {r["event_seq"]: r["features"].asDict() for r in batch.collect()})


def messages_of(spark, rows, folder, parts):
    ordered = sorted(rows, key=lambda r: (r["event_time"], r["event_seq"]))
    size = -(-len(ordered) // parts)
    for i in range(parts):
        events = frame(spark, ordered[i * size : (i + 1) * size])
        fields = [iso_utc(F.col(c)).alias(c) if c == "event_time" else F.col(c) for c in CONTRACT]
        events.select(
            F.col("account_id").alias("key"),
            F.to_json(F.struct(*fields)).alias("value"),
            F.lit("tx.raw").alias("topic"),
            F.col("event_time").alias("timestamp"),
            "event_seq",
        ).coalesce(1).write.parquet(f"{folder}/part{i}")


def test_decision_stream_writes_each_event_once(spark, tmp_path):
    rows = random_events(13, 90)
    messages_of(spark, rows, f"{tmp_path}/in", 2)
    extra = [("k", "not json", "tx.raw", None, 9_001), ("k", json.dumps({"amount": -5}), "tx.raw", None, 9_002)]
    spark.createDataFrame(extra, MESSAGE_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part2")
    spark.read.parquet(f"{tmp_path}/in/part0").withColumn("event_seq", F.col("event_seq") + 10_000).coalesce(
        1
    ).write.parquet(f"{tmp_path}/in/part3")

    calls = []

    def reload():
        calls.append(1)
        return None

    writer = BatchWriter(f"{tmp_path}/out", reload=reload)
    query = start_stream(
        file_messages(spark, f"{tmp_path}/in/part*"), f"{tmp_path}/out", f"{tmp_path}/cp", writer, state_partitions=2
    )
    query.awaitTermination()
    scored = spark.read.parquet(f"{tmp_path}/out/transactions_scored")
    assert scored.count() == len(rows)
    assert scored.select("event_id").distinct().count() == len(rows)
    assert spark.read.parquet(f"{tmp_path}/out/dead_letters").count() == 2
    topics = {r["topic"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/messages").groupBy("topic").count().collect()}
    assert topics["tx.decisions"] == topics["tx.validated"] == len(rows) and topics["tx.dlq"] == 2
    expected = expected_features(rows)
    got = {r["transaction_id"]: r["features"] for r in scored.collect()}
    for row in rows:
        wanted = expected[row["event_seq"]]
        assert got[row["transaction_id"]]["tx_count_1h"] == wanted["tx_count_1h"]
    assert len(calls) >= 4
    assert sum(p["input_rows"] for p in progress_counters(query)) >= len(rows)

    before = scored.count()
    again = start_stream(file_messages(spark, f"{tmp_path}/in/part*"), f"{tmp_path}/out", f"{tmp_path}/cp", writer)
    again.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/transactions_scored").count() == before


def test_repeated_batch_replaces_itself(spark, tmp_path):
    writer = BatchWriter(f"{tmp_path}/out")
    rows = frame(spark, random_events(14, 20))
    good = add_features(rows).select(F.lit("good").alias("route"), F.struct("*").alias("good"))
    bad_type = "struct<key:string,value:string,topic:string,timestamp:timestamp,event_seq:bigint,event:" + (
        rows.select(F.struct(*CONTRACT).alias("e")).schema["e"].dataType.simpleString()
    ) + ",errors:array<string>,route:string,error_message:string>"
    batch = good.withColumn("bad", F.lit(None).cast(bad_type))
    writer(batch, 7)
    writer(batch, 7)
    assert spark.read.parquet(f"{tmp_path}/out/fraud_decisions").count() == 20


class Versions:
    """Hands out the second model from the second micro-batch on."""

    def __init__(self):
        self.calls = 0

    def __call__(self):
        self.calls += 1
        return versioned("2") if self.calls > 1 else None


def versioned(version):
    scorer = LogisticScorer()
    scorer.model = replace(scorer.model, model_version=version)
    return scorer


def test_a_new_model_takes_effect_between_micro_batches(spark, tmp_path):
    rows = random_events(15, 40)
    messages_of(spark, rows, f"{tmp_path}/in", 2)
    writer = BatchWriter(f"{tmp_path}/out", versioned("1"), reload=Versions())
    counters = StreamCounters()
    spark.streams.addListener(counters)
    try:
        start_stream(
            file_messages(spark, f"{tmp_path}/in/part*"), f"{tmp_path}/out", f"{tmp_path}/cp", writer, state_partitions=2
        ).awaitTermination()
        deadline = time.time() + 20
        while sum(r["input_rows"] for r in counters.rows) < len(rows) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    scored = spark.read.parquet(f"{tmp_path}/out/transactions_scored")
    used = scored.select("batch_id", "model_version").distinct().collect()
    assert {(r["batch_id"] > 0, r["model_version"]) for r in used} == {(False, "1"), (True, "2")}
    table = counters.frame(spark)
    # The source is read once for each branch of the stream.
    assert table.agg(F.sum("input_rows")).first()[0] >= len(rows)
    assert table.where("batch_ms > 0 AND started IS NOT NULL").count() >= 2


def test_late_events_are_decided_and_every_message_has_one_route(spark, tmp_path):
    rows = random_events(16, 60)
    late = [dict(r, event_time=r["event_time"] - timedelta(days=45)) for r in rows[:9]]
    kept = rows[9:]
    messages_of(spark, kept, f"{tmp_path}/a", 1)
    messages_of(spark, late, f"{tmp_path}/b", 1)
    arrived = F.lit(max(r["event_time"] for r in kept).replace(tzinfo=None)).cast("timestamp")
    spark.read.parquet(f"{tmp_path}/a/part0").write.parquet(f"{tmp_path}/in/part0")
    spark.read.parquet(f"{tmp_path}/b/part0").withColumn("timestamp", arrived).write.parquet(f"{tmp_path}/in/part1")
    bad = [("k", "{}", "tx.raw", None, 9_001), ("k", None, "tx.raw", None, 9_002)]
    spark.createDataFrame(bad, MESSAGE_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part2")
    start_stream(file_messages(spark, f"{tmp_path}/in/part*"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    decided = {r["transaction_id"] for r in spark.read.parquet(f"{tmp_path}/out/transactions_scored").collect()}
    letters = spark.read.parquet(f"{tmp_path}/out/dead_letters").count()
    assert decided == {r["transaction_id"] for r in rows}
    assert len(decided) + letters == len(rows) + len(bad)


def test_hours_are_counted_while_they_are_open(spark, tmp_path):
    rows = random_events(17, 80)
    schema = write_parts(spark, rows, f"{tmp_path}/in", 3)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
    run_hourly_counts(live, "channel", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["bucket"], r["channel"]): r["count"] for r in hourly_counts(spark, f"{tmp_path}/out", "channel").collect()}
    wanted = Counter((int(r["event_time"].timestamp()) // 3600 * 3600, r["channel"]) for r in rows)
    assert got == wanted


def test_topic_rows_are_binary(spark):
    rows = topic_rows(spark.createDataFrame([("k", "v", "t")], "key string, value string, topic string"))
    assert [f.dataType.simpleString() for f in rows.schema] == ["binary", "binary", "string"]
    assert topic_options("a:1", linger="5")["kafka.acks"] == "all"


def shuffled_parts(spark, rows, folder, parts, delay, seed):
    """Rows that arrive up to ``delay`` seconds late, cut into files by arrival, and a last row that
    is no event. Inside a file the order is random."""
    rng = random.Random(seed)
    late = [dict(r, arrived=r["event_time"] + timedelta(seconds=rng.randint(0, delay))) for r in rows]
    late.sort(key=lambda r: r["arrived"])
    size = -(-len(late) // parts)
    schema = frame(spark, rows).schema.add("arrived", "timestamp")

    def write(part, i):
        spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in part], schema).coalesce(1).write.parquet(
            f"{folder}/part{i}"
        )

    for i in range(parts):
        part = late[i * size : (i + 1) * size]
        rng.shuffle(part)
        write(part, i)
    write([{"arrived": late[-1]["arrived"] + timedelta(days=9)}], parts)
    return schema


def test_events_out_of_order_get_the_features_of_the_batch(spark, tmp_path):
    rows = random_events(21, 240)
    schema = shuffled_parts(spark, rows, f"{tmp_path}/in", 4, 7_200, 5)
    arrivals = [r["event_seq"] for i in range(4) for r in spark.read.parquet(f"{tmp_path}/in/part{i}").collect()]
    in_order = [r["event_seq"] for r in sorted(rows, key=lambda r: (r["event_time"], r["event_seq"]))]
    assert arrivals != in_order
    options = dict(wait_seconds=7_200, clock="arrived", merchant_salts=3)
    out = run(spark, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", **options)
    assert out.count() == len(rows)
    assert_features(out, expected_features(rows))


def test_a_late_event_does_not_replace_the_last_one(spark, tmp_path):
    rows = sorted(random_events(22, 60), key=lambda r: (r["event_time"], r["event_seq"]))
    rows = [dict(r, account_id="one", event_seq=i) for i, r in enumerate(rows)]
    late, rest = rows[20], rows[:20] + rows[21:]
    for i, part in enumerate((rest[:40], [late], rest[40:])):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    out = run(spark, frame(spark, rows).schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r["event_seq"]: r["features"] for r in out.collect()}
    wanted = expected_features(rows)
    assert len(got) == len(rows)
    for row in rest[40:]:
        for name in ("time_since_last_tx_sec", "geo_distance_from_last_tx_km", "account_age_days", "tx_count_1h"):
            assert abs(got[row["event_seq"]][name] - wanted[row["event_seq"]][name]) < 1e-6


def state_rows(spark, schema, folder, tmp_path, **options):
    """Features by event and the state rows of every step after each batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")
    with stream_settings(spark, 2):
        query = (
            stream_features(stream, **options)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/cp")
            .option("path", f"{tmp_path}/out")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return [[s["numRowsTotal"] for s in p["stateOperators"]] for p in query.recentProgress]


def test_silent_accounts_leave_the_state(spark, tmp_path):
    rows = random_events(23, 80)
    span = max(r["event_time"] for r in rows) - min(r["event_time"] for r in rows)
    lifetime = int(span.total_seconds()) + 3 * 86_400
    schema = write_parts(spark, rows, f"{tmp_path}/in", 2)
    end = max(r["event_time"] for r in rows)
    back = dict(rows[0], event_seq=900, event_id="00000000-0000-4000-8000-000000000900")
    back["event_time"] = end + timedelta(seconds=2 * lifetime + 10)
    frame(spark, [back]).coalesce(1).write.parquet(f"{tmp_path}/in/part5")
    totals = state_rows(spark, schema, f"{tmp_path}/in", tmp_path, state_ttl_seconds=lifetime)
    # The accounts' step is the one that ever holds the most. All but the account that came back,
    # whose state began anew, are gone: profile, window, device, merchant, timer and its two indices.
    most = [max(column) for column in zip(*[t for t in totals if t])]
    accounts = most.index(max(most))
    assert most[accounts] > 40
    assert totals[-1][accounts] <= 8
    got = {r["event_seq"]: r["features"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[900]["device_new_for_account"] == 1.0 and got[900]["account_age_days"] == 0.0


def test_one_merchant_is_spread_over_salts(spark, tmp_path):
    rows = [dict(r, merchant_id="hot") if i % 10 else r for i, r in enumerate(random_events(24, 200))]
    schema = write_parts(spark, rows, f"{tmp_path}/in", 3)
    out = run(spark, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", merchant_salts=8)
    wanted = expected_features(rows)
    assert {w["high_risk_merchant_flag"] for w in wanted.values()} == {0.0, 1.0}
    assert_features(out, wanted)
    events = frame(spark, rows).where("merchant_id = 'hot'")
    counts = [r["count"] for r in events.groupBy((F.pmod(F.xxhash64("event_seq"), F.lit(8)))).count().collect()]
    assert len(counts) == 8 and max(counts) < 60


def test_repeats_are_reported_and_claims_expire(spark, tmp_path):
    rows = random_events(25, 50)
    messages_of(spark, rows, f"{tmp_path}/in", 2)
    first = spark.read.parquet(f"{tmp_path}/in/part0")
    span = int((max(r["event_time"] for r in rows) - min(r["event_time"] for r in rows)).total_seconds())
    first.withColumn("event_seq", F.col("event_seq") + 10_000).coalesce(1).write.parquet(f"{tmp_path}/in/part2")
    later = F.timestamp_add("SECOND", F.lit(10 * span + 100), F.col("timestamp"))
    first.withColumns({"event_seq": F.col("event_seq") + 20_000, "timestamp": later}).coalesce(1).write.parquet(
        f"{tmp_path}/in/part3"
    )
    query = start_stream(
        file_messages(spark, f"{tmp_path}/in/part*"),
        f"{tmp_path}/out",
        f"{tmp_path}/cp",
        claim_seconds=2 * span + 50,
        claim_buckets=4,
        state_partitions=2,
    )
    query.awaitTermination()
    repeats = published(spark, f"{tmp_path}/out", "duplicates").collect()
    sent = {r["event_seq"] for r in first.collect()}
    assert {(r["event_seq"], r["repeat_of"]) for r in repeats} == {(s + 10_000, s) for s in sent}
    # After the horizon an id is claimed anew.
    assert published(spark, f"{tmp_path}/out", "transactions_scored").count() == len(rows) + len(sent)


def test_copies_in_one_file_meet_before_the_claims(spark):
    rows = random_events(26, 3)
    events = frame(spark, rows * 40).withColumn("event_seq", F.monotonically_increasing_id())
    event = F.struct(*events.columns)
    narrow = events.coalesce(1).select(*carried(event, F.col("event_seq"), F.col("event_time"), F.lit("{}")))
    marked = narrow.mapInArrow(local_repeats, CARRIED).collect()
    firsts = {r["event_id"]: r["seq"] for r in marked if r["kind"] == 0}
    assert len(marked) == 120 and len(firsts) == 3
    assert all(r["repeat_of"] == firsts[r["event_id"]] for r in marked if r["route"] == "repeat")
    assert len({r["account_id"] for r in marked if r["route"] == "repeat"}) > 100


def test_a_reader_sees_whole_batches_only(spark, tmp_path, monkeypatch):
    rows = random_events(27, 40)
    good = add_features(frame(spark, rows)).select(F.lit("good").alias("route"), F.struct("*").alias("good"))
    bad_type = "struct<key:string,value:string,topic:string,timestamp:timestamp,event_seq:bigint,event:" + (
        frame(spark, rows).select(F.struct(*CONTRACT).alias("e")).schema["e"].dataType.simpleString()
    ) + ",errors:array<string>,route:string,error_message:string>"
    batch = good.withColumn("bad", F.lit(None).cast(bad_type))
    writer = BatchWriter(f"{tmp_path}/out")
    writer(batch, 1)
    monkeypatch.setattr(job, "write_messages", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        writer(batch, 2)
    for table in ("transactions_raw", "transactions_scored", "fraud_decisions"):
        assert spark.read.parquet(f"{tmp_path}/out/{table}").count() == 80
        assert published(spark, f"{tmp_path}/out", table).count() == 40
    monkeypatch.undo()
    writer(batch, 2)
    assert published(spark, f"{tmp_path}/out", "fraud_decisions").count() == 80


def test_a_stream_decodes_a_message_once(spark, tmp_path):
    rows = random_events(28, 10)
    messages_of(spark, rows, f"{tmp_path}/in", 1)
    stream = decided_stream(file_messages(spark, f"{tmp_path}/in/part*"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1


def test_context_of_accounts_while_the_stream_runs(spark, tmp_path):
    rows = random_events(29, 100)
    schema = write_parts(spark, rows, f"{tmp_path}/in", 2)
    run(spark, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    states = {r["account_id"]: r for r in account_states(spark, f"{tmp_path}/cp").collect()}
    ordered = sorted(rows, key=lambda r: (r["event_time"], r["event_seq"]))
    assert set(states) == {r["account_id"] for r in rows}
    for name, state in states.items():
        mine = [r for r in ordered if r["account_id"] == name]
        assert state["rolling_count"] == len(mine)
        assert abs(state["rolling_sum"] - sum(float(r["amount"]) for r in mine)) < 1e-6
        assert state["last_country"] == mine[-1]["country"]
        assert state["known_devices"] == len({r["device_id"] for r in mine})
    before = account_states(spark, f"{tmp_path}/cp", batch_id=0)
    assert before.agg(F.sum("rolling_count")).first()[0] == 50


def test_state_partitions_suit_the_cluster_and_the_batch(spark, tmp_path):
    from tallyguard.streaming.job import LEAST_PARTITIONS, PARTITION_ROWS, stream_settings, suited_partitions

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        suited = max(LEAST_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
        with stream_settings(spark):
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(suited)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
        with stream_settings(spark, 3):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        # Large micro-batches get more, so that a task's share of one stays the same.
        assert suited_partitions(spark, 500 * PARTITION_ROWS) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class KeptState:
    """One state variable of one key, in memory; counts the calls."""

    calls = 0

    def __init__(self):
        self.kept = None

    def _call(self):
        KeptState.calls += 1

    def exists(self):
        self._call()
        return bool(self.kept)

    def get(self):
        self._call()
        return self.kept

    def update(self, value):
        self._call()
        self.kept = value

    def containsKey(self, key):
        self._call()
        return key in (self.kept or {})

    def getValue(self, key):
        self._call()
        return self.kept[key]

    def updateValue(self, key, value):
        self._call()
        self.kept = {**(self.kept or {}), key: value}

    def clear(self):
        self._call()
        self.kept = None


class KeptHandle:
    def getValueState(self, *_):
        return KeptState()

    getMapState = getValueState

    def registerTimer(self, _):
        KeptState.calls += 1


def account_batches(devices, starts):
    """Micro-batches of one account: rows of a second each, with devices and merchants by number."""
    rng = random.Random(5)
    out = []
    for start in starts:
        rows = []
        for i in range(40):
            row = {name: None for name in CARRIED.fieldNames()}
            row |= {"kind": 0, "route": "good", "event_id": f"e{start}-{i}", "account_id": "a", "country": rng.choice("XY")}
            row |= {"merchant_id": f"m{rng.randrange(9)}", "device_id": f"d{rng.randrange(devices)}", "latitude": 1.0 * i}
            row |= {"longitude": 2.0, "arrived": 0, "us": (start + i) * 1_000_000, "seq": i, "micros": 10 + i, "failed": i % 2}
            rows.append({**row, "risky": False, "repeat_of": -1, "payload": "{}"})
        out.append(pd.DataFrame(rows))
    return out


def histories(batches, together, monkeypatch):
    monkeypatch.setattr(processor, "SEEN_TOGETHER", together, raising=False)
    step = processor.AccountHistory(FeatureWindows(), 1_000, 0, None)
    step.init(KeptHandle())
    found = [pd.concat(list(step.handleInputRows(("a",), iter([b.copy()]), None))) for b in batches]
    return pd.concat(found, ignore_index=True), step


def test_an_account_takes_few_calls_of_the_state(monkeypatch):
    """However many devices and merchants its events have."""
    KeptState.calls = 0
    batches = account_batches(30, [0, 100, 200])
    found, _ = histories(batches, 2_000, monkeypatch)
    # An entry of the state for each device and merchant when it is new.
    new = sum(len({x for b in batches for x in b[c]}) for c in ("device_id", "merchant_id"))
    assert KeptState.calls <= new + 5 * len(batches)
    seen = pd.concat(batches, ignore_index=True)
    assert found["device_before"].tolist() == seen.groupby("device_id").cumcount().tolist()
    assert found["merchant_before"].tolist() == seen.groupby("merchant_id").cumcount().tolist()
    assert found["life_n"].tolist() == list(range(120))
    assert found["life_sum"].tolist() == [str(x) for x in [0, *seen["micros"].cumsum().tolist()[:-1]]]
    assert found["last_us"].tolist()[1:] == seen["us"].tolist()[:-1] and found["last_us"].isna()[0]
    assert found["last_country"].tolist()[1:] == seen["country"].tolist()[:-1]


def test_many_devices_of_an_account_lie_in_entries_of_their_own(monkeypatch):
    """Also over a silence after which the account begins anew."""
    batches = account_batches(25, [0, 100, 5_000, 5_100])
    few, step = histories(batches, 3, monkeypatch)
    many, _ = histories(batches, 2_000, monkeypatch)
    pd.testing.assert_frame_equal(few, many)
    seen = pd.concat(batches[2:], ignore_index=True)
    assert few["device_before"].tolist()[80:] == seen.groupby("device_id").cumcount().tolist()
    life = processor.Life.of(step.profile.get())
    assert (life.known_devices, life.known_merchants) == (seen["device_id"].nunique(), seen["merchant_id"].nunique())
    assert len(life.devices) == 3 and len(step.devices.kept) == life.known_devices


def test_waiting_rows_share_entries_of_the_state():
    rows = pd.concat(account_batches(5, [0, 100, 200]), ignore_index=True)
    rows.loc[3, ["device_id", "latitude"]] = None
    entries = processor.packed(rows)
    assert len(entries) == 1
    pd.testing.assert_frame_equal(processor.unpacked(iter(entries)), rows, check_dtype=False)
