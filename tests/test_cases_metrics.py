from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import event, frame
from pyspark.sql import functions as F

from tallyguard.operators.cases import list_cases, new_activities, page_info, with_case_status
from tallyguard.operators.drift import categorical_drift, dataset_drift, numeric_drift
from tallyguard.operators.evaluation import (
    average_precision,
    choose_thresholds,
    chronological_split,
    class_balance,
    confusion_matrix,
    roc_auc,
    threshold_sweep,
)
from tallyguard.operators.labels import feedback_labels, training_frame, training_source
from tallyguard.operators.metrics import (
    alert_states,
    alert_summary,
    bucket_counts,
    bucket_quantile,
    counter_increments,
    counter_rate,
    histogram_quantile,
)
from tallyguard.plans.decisions import decide
from tallyguard.schemas import FEEDBACK
from tallyguard.sources.sinks import decision_rows, raw_rows, scored_rows, write_batch

T0 = datetime(2026, 4, 20, 12)


def feedback(spark, rows):
    data = [
        (f"f{i}", case, txn, "e", "analyst_007", label, None, T0 + timedelta(seconds=at))
        for i, (case, txn, label, at) in enumerate(rows)
    ]
    return spark.createDataFrame(data, FEEDBACK)


def test_latest_feedback_overrides_the_label(spark):
    raw = raw_rows(decide(frame(spark, [event(1, label=0), event(2, label=1), event(3, label=None), event(4, label=1)])))
    given = feedback(
        spark,
        [("c", "txn_1", "fraud", 1), ("c", "txn_2", "fraud", 1), ("c", "txn_2", "legitimate", 2), ("c", "txn_3", "review", 1)],
    )
    out = {r["transaction_id"]: r for r in training_frame(raw, given).collect()}
    assert (out["txn_1"]["label"], out["txn_1"]["label_source"]) == (1, "analyst_feedback")
    assert (out["txn_1"]["feedback_count"], out["txn_1"]["latest_feedback_label"]) == (1, "fraud")
    assert (out["txn_2"]["label"], out["txn_2"]["feedback_count"]) == (0, 2)
    assert (out["txn_3"]["label"], out["txn_3"]["label_source"]) == (None, "synthetic")
    assert (out["txn_4"]["label"], out["txn_4"]["label_source"], out["txn_4"]["feedback_count"]) == (1, "synthetic", 0)
    labels = {(r["transaction_id"], r["position"]): r["feedback_label"] for r in feedback_labels(given).collect()}
    assert labels[("txn_2", 1)] == "legitimate" and labels[("txn_2", 2)] == "fraud"
    assert labels[("txn_1", 1)] == "fraud"
    assert training_source(raw, lambda: raw.limit(0)).count() == 0
    assert training_source(raw, lambda: raw.limit(0), minimum=2).count() == 3


def test_case_paging_and_status(spark):
    decided = decide(frame(spark, [event(i, i) for i in range(1, 8)]))
    raw, scored, cases = raw_rows(decided), scored_rows(decided), decision_rows(decided)
    ids = {r["transaction_id"]: r["case_id"] for r in cases.collect()}
    given = feedback(
        spark,
        [(ids["txn_1"], "txn_1", "fraud", 100), (ids["txn_2"], "txn_2", "fraud", 100), (ids["txn_2"], "txn_2", "review", 200)],
    )
    now = with_case_status(cases, given)
    assert {r["transaction_id"] for r in now.where("case_status = 'closed'").collect()} == {"txn_1"}
    first = [r["transaction_id"] for r in list_cases(now, scored, raw, 1, 3).collect()]
    third = [r["transaction_id"] for r in list_cases(now, scored, raw, 3, 3).collect()]
    assert first == ["txn_7", "txn_6", "txn_5"] and third == ["txn_1"]
    assert tuple(page_info(now, 1, 3).first()) == (1, 3, 7, 3)
    assert page_info(now, 1, 3, search="nothing").first()["total_pages"] == 1
    assert list_cases(now, scored, raw, search="xn_3").count() == 1
    assert list_cases(now, scored, raw, search="xn%3").count() == 0
    empty = list_cases(now, scored.limit(0), raw.limit(0), 1, 1).first()
    assert empty["score"] is None and empty["rule_hits"] == [] and empty["amount"] is None
    with pytest.raises(ValueError):
        list_cases(now, scored, raw, 0)


def test_new_activities(spark):
    previous = spark.createDataFrame([("decision:1",)], "id string")
    current = spark.createDataFrame([("decision:1",), ("decision:2",), ("feedback:1",)], "id string")
    assert new_activities(previous, current).count() == 2


def scores(spark, labels, probabilities):
    return spark.createDataFrame(list(zip(labels, probabilities)), "label int, probability double")


def test_threshold_sweep_and_choice(spark):
    df = scores(spark, [0, 0, 1, 1, 1], [0.1, 0.2, 0.7, 0.88, 0.95])
    sweep = threshold_sweep(df)
    assert sweep.count() == 18
    chosen = choose_thresholds(sweep).first()
    assert chosen["review_threshold"] == pytest.approx(0.25)
    assert chosen["block_threshold"] == pytest.approx(0.95)


def test_threshold_choice_without_a_precise_threshold(spark):
    chosen = choose_thresholds(threshold_sweep(scores(spark, [0, 0, 0, 1], [0.9, 0.9, 0.9, 0.9]))).first()
    assert chosen["review_threshold"] == pytest.approx(0.1)
    assert chosen["block_threshold"] == pytest.approx(0.2)


def test_curves_with_ties(spark):
    labels = [0, 1, 1, 0, 1, 0, 0, 1]
    p = [0.1, 0.4, 0.35, 0.8, 0.8, 0.4, 0.2, 0.9]
    df = scores(spark, labels, p)
    pairs = [(a, b) for a, la in zip(p, labels) if la for b, lb in zip(p, labels) if not lb]
    assert roc_auc(df).first()[0] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    area, hits = 0.0, 0
    for cut in sorted(set(p), reverse=True):
        tp = sum(la for x, la in zip(p, labels) if x >= cut)
        area += (tp - hits) / 4 * (tp / sum(x >= cut for x in p))
        hits = tp
    assert average_precision(df).first()[0] == pytest.approx(area)
    assert {(r[0], r[1]): r[2] for r in confusion_matrix(df, 0.5).collect()} == {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 2}


def test_split_and_balance(spark):
    rows = [(i // 4, i, i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "event_us long, event_seq long, label int")
    train, test = chronological_split(df)
    assert sorted(r["event_seq"] for r in train.collect()) == list(range(8))
    assert sorted(r["event_seq"] for r in test.collect()) == [8, 9]
    one_train, one_test = chronological_split(df.limit(1))
    assert one_train.count() == one_test.count() == 1
    assert class_balance(df).first()["positive_weight"] == 1.0
    assert tuple(class_balance(df.where("label = 0")).first()) == (1, 4, 4.0)


def test_drift_finds_a_shift_and_only_that(spark):
    base = [(float(i % 50), float((i * 7) % 13), i % 2, "x" if i % 3 else "y") for i in range(500)]
    schema = "a double, b double, label int, s string"
    reference = spark.createDataFrame(base, schema)
    shifted = spark.createDataFrame([(a * 3, b, lab, s) for a, b, lab, s in base], schema)
    report = {r["column"]: r for r in numeric_drift(reference, shifted, ["a", "b"]).collect()}
    assert report["a"]["drifted"] and not report["b"]["drifted"]
    assert report["b"]["statistic"] == 0.0 and report["b"]["p_value"] == 1.0
    assert not categorical_drift(reference, shifted, "s").first()["drifted"]
    one_sided = shifted.withColumn("s", F.lit("x"))
    assert categorical_drift(reference, one_sided, "s").first()["drifted"]
    assert dataset_drift(numeric_drift(reference, shifted, ["a", "b"])).first()["dataset_drift_score"] == 0.5


def test_alert_needs_an_unbroken_run(spark):
    rows = [(60 * i, 1.0) for i in range(1, 8)] + [(60 * 9, 1.0), (600, 0.0), (660, 1.0)]
    df = spark.createDataFrame(rows, "tick long, value double")
    states = {r["tick"] // 60: r["state"] for r in alert_states(df, "x", 0.5, 300).collect()}
    assert [states[i] for i in (1, 5, 6, 7)] == ["pending", "pending", "firing", "firing"]
    assert (states[9], states[10], states[11]) == ("pending", "inactive", "pending")


def test_alert_summary(spark):
    alerts = spark.createDataFrame([("firing",), ("resolved",)], "status string")
    assert tuple(alert_summary(alerts).first()) == (2, ["firing", "resolved"])
    with_null = spark.createDataFrame([("firing",), (None,), ("firing",)], "status string")
    assert tuple(alert_summary(with_null).first()) == (3, ["firing"])


def test_quantile_interpolates_inside_the_bucket(spark):
    df = spark.createDataFrame([(0, 0.3)] * 10 + [(0, 99.0)], "us long, v double")
    inner = histogram_quantile(df, F.col("us"), F.col("v"), 0.5, window_seconds=60).first()
    assert inner["value"] == pytest.approx(0.25 + 0.25 * 5.5 / 10)
    outer = histogram_quantile(df, F.col("us"), F.col("v"), 0.99, window_seconds=60).first()
    assert outer["value"] == 10.0


def rows_read(df) -> int:
    """Rows that the scan of a collected frame gave, before any filter on rows."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_lookup_by_id_reads_few_row_groups(spark, tmp_path):
    for batch in range(12):
        ids = spark.range(batch * 1000, batch * 1000 + 1000, numPartitions=1)
        rows = ids.selectExpr("sha2(cast(id as string), 256) AS transaction_id", "uuid() AS event_id", "id AS amount")
        write_batch(rows, f"{tmp_path}/t", batch)
    table = spark.read.parquet(f"{tmp_path}/t")
    wanted = table.where("transaction_id = sha2('7123', 256)")
    assert [r.amount for r in wanted.collect()] == [7123]
    assert rows_read(table.where(F.col("transaction_id") == wanted.first().transaction_id)) <= 2000
    assert rows_read(table.where("amount >= 0")) == 12_000


def test_counter_rates_take_out_resets(spark):
    samples = [(0, 5), (60, 9), (120, 2), (180, 2), (240, 8), (300, 1)]
    df = spark.createDataFrame([("a", t, v) for t, v in samples] + [("b", 0, 7)], "label string, t long, total long")
    us = F.col("t") * 1_000_000
    grown = {(r.label, r.t): r.added for r in counter_increments(df, us, "total", ["label"]).collect()}
    assert grown == {("a", 0): 0, ("a", 60): 4, ("a", 120): 2, ("a", 180): 0, ("a", 240): 6, ("a", 300): 1, ("b", 0): 0}
    rates = {(r.label, r.tick): r.rate for r in counter_rate(df, us, "total", ["label"], 120).collect()}
    assert rates["a", 120] == pytest.approx(4 / 120) and rates["a", 300] == pytest.approx(6 / 120)
    assert rates["a", 360] == pytest.approx(7 / 120)


def test_histograms_of_batches_add_up(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1200), rng.choice("xy"), rng.expovariate(4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "t long, stage string, latency double")
    us = F.col("t") * 1_000_000
    parts = [bucket_counts(df.where(F.col("t") % 3 == i), us, F.col("latency"), ["stage"]) for i in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2])
    got = {(r.stage, r.tick): r.value for r in bucket_quantile(merged, labels=["stage"]).collect()}
    whole = {(r.stage, r.tick): r.value for r in histogram_quantile(df, us, F.col("latency"), labels=["stage"]).collect()}
    assert got == pytest.approx(whole) and len(got) > 20


def test_written_messages_are_compressed_well(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from tallyguard.sources.sinks import write_messages

    rows = spark.range(20).selectExpr("cast(id as string) AS key", "'{}' AS value", "'tx.scored' AS topic")
    write_messages(rows, f"{tmp_path}/messages", 0)
    (name, *_) = glob.glob(f"{tmp_path}/messages/batch_id=0/topic=tx.scored/*.parquet")
    assert pq.ParquetFile(name).metadata.row_group(0).column(1).compression == "ZSTD"
    assert spark.read.parquet(f"{tmp_path}/messages").count() == 20
