from __future__ import annotations

import json
from datetime import UTC, datetime

import pytest
from helpers import event
from pyspark.sql import functions as F

from tallyguard.functions.scalars import round_exact, scenario_label
from tallyguard.operators.dedupe import claim_first, duplicate_deliveries, duplicate_report, latest_per_key
from tallyguard.operators.validate import dead_letters, route_messages, valid_events
from tallyguard.plans.decisions import decide
from tallyguard.sources.sinks import raw_rows

SCHEMA = "key string, value string, topic string, timestamp timestamp, event_seq long"


def body(**changes):
    row = event(1)
    row.pop("event_seq")
    row["event_time"] = row["event_time"].isoformat()
    row.update(changes)
    return {k: v for k, v in row.items() if v != "<drop>"}


def routed(spark, *values):
    rows = [
        ("k", v if v is None or isinstance(v, str) else json.dumps(v), "tx.raw", datetime(2026, 1, 1), i)
        for i, v in enumerate(values)
    ]
    return route_messages(spark.createDataFrame(rows, SCHEMA))


ACCEPTED = [
    ({}, "amount", 100.0),
    ({"amount": "1.5"}, "amount", 1.5),
    ({"amount": 3}, "amount", 3.0),
    ({"card_present": "yes"}, "card_present", True),
    ({"card_present": 0}, "card_present", False),
    ({"label": None}, "label", None),
    ({"label": "1"}, "label", 1),
    ({"prior_auth_failures": "<drop>"}, "prior_auth_failures", 0),
    ({"prior_auth_failures": 2.0}, "prior_auth_failures", 2),
    ({"metadata": {"a": 1}}, "metadata", {"a": "1"}),
    ({"metadata": "<drop>"}, "metadata", {}),
    ({"event_id": "ABCDEF00000000000000000000000001"}, "event_id", "abcdef00-0000-0000-0000-000000000001"),
]
REFUSED = [
    ({"account_id": 5}, "account_id: must be text"),
    ({"amount": "abc"}, "amount: must be a number"),
    ({"amount": None}, "amount: must be a number"),
    ({"country": "<drop>"}, "country: field required"),
    ({"card_present": 2}, "card_present: must be true or false"),
    ({"label": 1.5}, "label: must be a whole number"),
    ({"event_time": "nope"}, "event_time: must be a time"),
    ({"event_id": None}, "event_id: must be a UUID"),
    ({"metadata": "x"}, "metadata: must be an object"),
    ({"payment_method": "cash"}, "payment_method: must be one of credit_card, debit_card, upi, wallet, bank_transfer"),
    ({"zeta": 1, "alpha": 2}, "unknown fields: alpha, zeta"),
]


def test_values_are_converted_or_refused(spark):
    rows = routed(spark, *[body(**c) for c, *_ in ACCEPTED], *[body(**c) for c, _ in REFUSED]).orderBy("event_seq").collect()
    for (change, field, expected), row in zip(ACCEPTED, rows):
        assert row["route"] == "good", (change, row["error_message"])
        assert row["event"][field] == expected, change
    for (change, message), row in zip(REFUSED, rows[len(ACCEPTED) :]):
        assert (row["route"], row["error_message"]) == ("validation", message), change


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2024-01-01T00:00:00", datetime(2024, 1, 1, tzinfo=UTC)),
        ("2024-01-01T05:30:00.5+05:30", datetime(2024, 1, 1, 0, 0, 0, 500_000, tzinfo=UTC)),
        (1_704_067_200, datetime(2024, 1, 1, tzinfo=UTC)),
        (1_704_067_200_000, datetime(2024, 1, 1, tzinfo=UTC)),
    ],
)
def test_times(spark, value, expected):
    df = routed(spark, body(event_time=value)).select(F.unix_micros(F.col("event")["event_time"]))
    assert df.first()[0] == int(expected.timestamp() * 1_000_000)


def test_broken_message_gives_one_dead_letter(spark):
    letters = dead_letters(routed(spark, {"amount": -5})).collect()
    assert len(letters) == 1
    assert letters[0]["failed_stage"] == "validation"
    assert letters[0]["event_id"] is None
    assert json.loads(letters[0]["raw_payload"]) == {"payload": '{"amount": -5}'}


def test_business_errors_keep_the_event(spark):
    letters = dead_letters(routed(spark, body(amount=-1, account_id="", prior_auth_failures=-2))).collect()
    assert letters[0]["failed_stage"] == "processing"
    assert letters[0]["error_message"] == (
        "account_id is required, amount must be positive, prior_auth_failures cannot be negative"
    )
    assert letters[0]["event_id"] == body()["event_id"]
    assert json.loads(letters[0]["raw_payload"])["amount"] == -1


def test_source_errors_have_their_own_stage(spark):
    letter = dead_letters(routed(spark, None)).first()
    assert letter["failed_stage"] == "kafka_source"
    assert "error" in json.loads(letter["raw_payload"])


def test_every_message_takes_one_route(spark):
    df = routed(spark, body(), "not json", body(amount=0), None, "[1]", body(x=1))
    good, bad = valid_events(df).count(), dead_letters(df).count()
    assert (good, bad) == (1, 5)


def test_missing_id_is_stable(spark):
    ids = {routed(spark, body(event_id="<drop>")).first()["event"]["event_id"] for _ in range(2)}
    assert len(ids) == 1


def test_copies_are_claimed_once(spark):
    rows = [("a", datetime(2026, 1, 1, 0, 0, s), i) for i, s in enumerate([5, 3, 3, 9])] + [("b", datetime(2026, 1, 1), 9)]
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, event_seq long")
    assert {(r["event_id"], r["event_seq"]) for r in claim_first(df).collect()} == {("a", 1), ("b", 9)}
    assert {r["event_seq"] for r in duplicate_deliveries(df).collect()} == {0, 2, 3}
    assert tuple(duplicate_report(df).first()) == (5, 2, 3)
    assert {r["event_seq"] for r in latest_per_key(df, ["event_id"], ["event_time", "event_seq"]).collect()} == {3, 9}


def test_rounding_is_that_of_the_exact_value(spark):
    values = [0.125, 0.375, 2.675, 1.005, 1234567.885, 0.615, -0.125]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_exact(F.col("v")).alias("r"))
    for row in df.collect():
        assert row["r"] == round(row["v"], 2)


def test_scenario_labels(spark):
    names = ["new_device_high_amount", "velocity_burst_fraud", "", None]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(scenario_label(F.col("s")))
    assert [r[0] for r in df.collect()] == [
        "new device high amount",
        "velocity burst",
        "unknown scenario",
        "unknown scenario",
    ]


EXTREME = ["inf", "-inf", "nan", 1e12, 1e15, 1e300, "1e400"]


@pytest.mark.parametrize("amount", EXTREME)
def test_an_amount_out_of_range_is_a_dead_letter_and_the_others_are_decided(spark, amount):
    other = body(event_id="00000000-0000-0000-0000-000000000002")
    df = routed(spark, body(amount=amount), other).persist()
    letters = dead_letters(df).collect()
    assert [x["failed_stage"] for x in letters] == ["processing"]
    assert "amount must be" in letters[0]["error_message"]
    decided = decide(valid_events(df))
    assert raw_rows(decided).count() == 1 and decided.first()["decision"] is not None


def test_the_largest_amount_is_stored(spark):
    decided = decide(valid_events(routed(spark, body(amount=999_999_999_999.99))))
    assert float(raw_rows(decided).first()["amount"]) == 999_999_999_999.99


@pytest.mark.parametrize("field", ["latitude", "longitude"])
def test_a_place_that_is_no_number_is_a_dead_letter(spark, field):
    assert routed(spark, body(**{field: "nan"})).first()["error_message"] == f"{field} must be a finite number"


def test_repeated_and_nested_fields(spark):
    text = json.dumps(body())
    rows = routed(spark, text[:-1] + ', "metadata": {"k": [1, {"a": null}]}}', "{}", "", "null", '"text"').collect()
    assert [r["route"] for r in rows[1:]] == ["validation"] * 4
