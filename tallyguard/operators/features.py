"""The 25 behavioural features of a transaction, as one set-based job.

A feature of an event sees the events of its account that came strictly earlier in
(event time, sequence) order. Trailing windows are closed: an event aged exactly W counts.

Each event is laid out as one arrival row and one narrow expiry row per window, which takes
the event out of the running sums right after age W. The running sums then cost the same
however many events a window holds, and one sort serves all account features. Accounts that
hold very many rows are cut into time chunks; the totals of earlier chunks come in as carry
rows. All of it needs one shuffle of the wide rows: the novelty and merchant counters use a
finer grouping of the same partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.functions.scalars import haversine_km, seconds_between, utc_hour
from tallyguard.operators.skew import CHUNK, CHUNK_ROWS, HEAVY, fill_missing, find_chunks, lookup
from tallyguard.schemas import (
    CHANNELS,
    FEATURES,
    FIRST_EVENT_GAP_SECONDS,
    WINDOW_1H,
    WINDOW_1M,
    WINDOW_5M,
)

MICROS = 1_000_000
DAY_US = 86_400 * MICROS
MONEY = "decimal(20,6)"

CARRY, EXPIRY, ARRIVAL = 0, 1, 2

EVENTS_PER_TASK = 25_000


@dataclass(frozen=True)
class FeatureWindows:
    short: int = WINDOW_1M
    medium: int = WINDOW_5M
    long: int = WINDOW_1H


def risk_level(metadata: Column) -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit("merchant_risk_level")), F.lit(""))


def first_risk_marks(events: DataFrame) -> DataFrame:
    """Per merchant, the position of the first event that flagged it as high risk."""
    return (
        events.where(risk_level(F.col("metadata")) == "high")
        .select("merchant_id", F.unix_micros("event_time").alias("us"), F.col("event_seq").alias("seq"))
        .groupBy("merchant_id")
        .agg(F.min(F.struct("us", "seq")).alias("__risk"))
    )


def add_merchant_risk(events: DataFrame) -> DataFrame:
    """Adds ``__high_risk``: flagged by this event, or by any account's earlier event."""
    marked = lookup(events, first_risk_marks(events), ["merchant_id"], "event_seq")
    here = F.struct(F.unix_micros("event_time").alias("us"), F.col("event_seq").alias("seq"))
    flagged = (risk_level(F.col("metadata")) == "high") | F.coalesce(F.col("__risk") < here, F.lit(False))
    return marked.withColumn("__high_risk", flagged).drop("__risk")


def state_epochs(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """Adds ``__epoch``: how often the account's state had expired before the event.

    State is dropped after ``ttl_seconds`` without an event. A gap can only lie between the
    active days of an account, so the gaps are found on one row per (account, day) and the
    epochs are joined back on that pair.
    """
    if ttl_seconds <= 2 * 86_400:
        raise ValueError("state lifetime must be longer than two days")
    us = F.unix_micros("event_time")
    days = events.groupBy("account_id", F.floor(us / DAY_US).alias("__day")).agg(
        F.min(us).alias("__from"), F.max(us).alias("__to")
    )
    order = Window.partitionBy("account_id").orderBy("__day")
    expired = F.coalesce(
        (F.col("__from") - F.lag("__to").over(order) > ttl_seconds * MICROS).cast("int"), F.lit(0)
    )
    epochs = days.withColumn("__expired", expired).select(
        "account_id", "__day", F.sum("__expired").over(order).alias("__epoch")
    )
    return lookup(
        events.withColumn("__day", F.floor(us / DAY_US)), epochs, ["account_id", "__day"], "event_seq"
    ).drop("__day")


LAST = "struct<us:bigint,latitude:double,longitude:double,country:string>"


def _steps(windows: FeatureWindows, payload: bool) -> Column:
    """One arrival and three expiry rows for an event, as an array of structs."""
    us, amount, failed = F.col("__us"), F.col("__amount"), F.col("__failed")
    no_amount, zero = F.lit(0).cast(MONEY), F.lit(0)

    def step(at: Column, kind: int, n: tuple[int, int, int], spend: Column, fails: Column) -> Column:
        own = kind == ARRIVAL
        fields = {
            "us": at,
            "kind": F.lit(kind),
            "n_short": F.lit(n[0]),
            "n_medium": F.lit(n[1]),
            "n_long": F.lit(n[2]),
            "spend": spend,
            "fails": fails,
            "life_n": F.lit(1 if own else 0).cast("bigint"),
            "life_sum": amount if own else no_amount,
            "seen": us if own else F.lit(None).cast("bigint"),
            "last": F.when(F.lit(own), F.col("__last")),
            "device": F.when(F.lit(own), F.col("__device")),
            "merchant": F.when(F.lit(own), F.col("__merchant")),
        }
        if payload:
            fields["p"] = F.when(F.lit(own), F.col("__p"))
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    def leaves(seconds: int) -> Column:
        return us + (seconds * MICROS + 1)

    return F.array(
        step(us, ARRIVAL, (1, 1, 1), amount, failed),
        step(leaves(windows.short), EXPIRY, (-1, 0, 0), no_amount, zero),
        step(leaves(windows.medium), EXPIRY, (0, -1, 0), no_amount, -failed),
        step(leaves(windows.long), EXPIRY, (0, 0, -1), (-amount).cast(MONEY), zero),
    )


def _narrow(events: DataFrame) -> DataFrame:
    """What the running sums need of an event, without its payload."""
    key = F.col("account_id")
    if "__epoch" in events.columns:
        key = F.struct("account_id", "__epoch")
    last = F.struct(
        F.unix_micros("event_time").alias("us"),
        F.col("latitude").alias("latitude"),
        F.col("longitude").alias("longitude"),
        F.col("country").alias("country"),
    )
    return events.select(
        key.alias("__key"),
        F.unix_micros("event_time").alias("__us"),
        F.col("event_seq").alias("__seq"),
        F.col("amount").cast(MONEY).alias("__amount"),
        (F.col("prior_auth_failures") > 0).cast("int").alias("__failed"),
        last.cast(LAST).alias("__last"),
        F.col("device_id").alias("__device"),
        F.col("merchant_id").alias("__merchant"),
        F.struct("*").alias("__p"),
    )


def _layout(events: DataFrame, windows: FeatureWindows, chunk_rows: int) -> DataFrame:
    """Arrival, expiry and carry rows, dealt by their (key, chunk) to tasks of about as many events,
    however many there are: in memory they take far more than in the shuffle, whose bytes would
    otherwise decide."""
    narrow = _narrow(events)
    leaves = tuple(w * MICROS + 1 for w in (windows.short, windows.medium, windows.long))
    chunks = find_chunks(narrow, ["__key"], "__us", chunk_rows, offsets=(0, *leaves))
    entries = _narrow(add_merchant_risk(events)).select(
        "__key", "__seq", F.inline(_steps(windows, payload=True))
    )
    rows = (
        chunks.assign(entries, "us")
        .drop(HEAVY)
        .withColumns({"device_n": F.lit(1), "merchant_n": F.lit(1)})
    )
    tasks = max(1, math.ceil(chunks.rows / EVENTS_PER_TASK))
    if not chunks.any:
        # The path is one constant here, which the windows leave out of their keys.
        return rows.repartition(tasks, "__key")
    slim = narrow.select("__key", "__seq", F.inline(_steps(windows, payload=False)))
    for carry in _carry_rows(chunks.assign(slim, "us").where(HEAVY).drop(HEAVY)):
        rows = rows.unionByName(fill_missing(carry, rows, {"kind": F.lit(CARRY)}))
    return rows.repartition(tasks, "__key", CHUNK)


def _carry_rows(rows: DataFrame) -> list[DataFrame]:
    """For each chunk of a heavy account, what happened before it, as rows sorted first."""
    before = Window.partitionBy("__key").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = ["n_short", "n_medium", "n_long", "spend", "fails", "life_n", "life_sum"]
    arrived = F.col("kind") == ARRIVAL
    latest = F.max(F.when(arrived, F.struct(F.col("us"), F.col("__seq").alias("seq"), F.col("last"))))
    totals = rows.groupBy("__key", CHUNK).agg(
        *[F.sum(c).alias(c) for c in counts], F.min("seen").alias("seen"), latest.alias("latest")
    )
    account = totals.select(
        "__key",
        CHUNK,
        *[F.sum(c).over(before).alias(c) for c in counts],
        F.min("seen").over(before).alias("seen"),
        F.last("latest", ignorenulls=True).over(before)["last"].alias("last"),
    )

    def counter(column: str) -> DataFrame:
        per_chunk = rows.where(arrived).groupBy("__key", column, CHUNK).agg(F.count(F.lit(1)).alias("n"))
        earlier = (
            Window.partitionBy("__key", column).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = per_chunk.select("__key", column, CHUNK, F.sum("n").over(earlier).alias(f"{column}_n"))
        return carried.where(F.col(f"{column}_n").isNotNull())

    return [account, counter("device"), counter("merchant")]


def _with_history(layout: DataFrame) -> DataFrame:
    """Arrival rows with the account history before each of them."""
    order = ["us", "kind", "__seq"]
    prior = (
        Window.partitionBy("__key", CHUNK)
        .orderBy(F.col("us").asc_nulls_first(), "kind", "__seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def summed(column: str) -> Column:
        return F.coalesce(F.sum(column).over(prior), F.lit(0))

    account = layout.select(
        "__key",
        CHUNK,
        "__seq",
        "us",
        "kind",
        "device",
        "merchant",
        "device_n",
        "merchant_n",
        "p",
        summed("n_short").alias("h_short"),
        summed("n_medium").alias("h_medium"),
        summed("n_long").alias("h_long"),
        summed("spend").alias("h_spend"),
        summed("fails").alias("h_fails"),
        summed("life_n").alias("h_count"),
        summed("life_sum").alias("h_sum"),
        F.min("seen").over(prior).alias("h_first"),
        F.last("last", ignorenulls=True).over(prior).alias("h_last"),
    ).where(F.col("kind") != EXPIRY)

    def running(column: str) -> Column:
        window = (
            Window.partitionBy("__key", CHUNK, column)
            .orderBy(*[F.col(c).asc_nulls_first() for c in order])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(F.sum(f"{column}_n").over(window), F.lit(0))

    return (
        account.withColumn("h_device", running("device"))
        .withColumn("h_merchant", running("merchant"))
        .where(F.col("kind") == ARRIVAL)
    )


def _feature_columns() -> dict[str, Column]:
    p, last, us = F.col("p"), F.col("h_last"), F.col("us")
    amount = p["amount"].cast("double")
    average = F.when(
        F.col("h_count") > 0, F.col("h_sum").cast("double") / F.col("h_count").cast("double")
    ).otherwise(amount)
    located = last.isNotNull() & last["latitude"].isNotNull() & last["longitude"].isNotNull()
    distance = haversine_km(last["latitude"], last["longitude"], p["latitude"], p["longitude"])
    gap = F.greatest(F.lit(0.0), seconds_between(us, last["us"]))
    age = F.greatest(
        F.lit(0.0), seconds_between(us, F.coalesce(F.col("h_first"), us)) / F.lit(86_400.0)
    )
    abroad = (
        p["is_international"]
        & (F.coalesce(last["country"], F.lit("")) != "")
        & (last["country"] != p["country"])
    )
    hour = utc_hour(us)
    flags = {f"channel_{c}": (p["channel"] == c).cast("double") for c in CHANNELS}
    columns = {
        "amount": amount,
        "prior_auth_failures": p["prior_auth_failures"].cast("double"),
        "card_present": p["card_present"].cast("double"),
        "is_international": p["is_international"].cast("double"),
        "tx_count_1m": F.col("h_short").cast("double"),
        "tx_count_5m": F.col("h_medium").cast("double"),
        "tx_count_1h": F.col("h_long").cast("double"),
        "spend_sum_1h": F.col("h_spend").cast("double"),
        "spend_avg_30d_proxy": average,
        "amount_vs_recent_avg_ratio": amount / F.greatest(average, F.lit(1.0)),
        "device_new_for_account": (F.col("h_device") == 0).cast("double"),
        "merchant_new_for_account": (F.col("h_merchant") == 0).cast("double"),
        "geo_distance_from_last_tx_km": F.when(located, distance).otherwise(F.lit(0.0)),
        "time_since_last_tx_sec": F.when(located, gap).otherwise(F.lit(FIRST_EVENT_GAP_SECONDS)),
        "failed_auth_count_recent": F.col("h_fails").cast("double"),
        "international_mismatch": F.coalesce(abroad, F.lit(False)).cast("double"),
        "night_tx_flag": ((hour < 6) | (hour >= 23)).cast("double"),
        "high_risk_merchant_flag": p["__high_risk"].cast("double"),
        "account_age_days": age,
        "account_merchant_tx_count_30d": F.col("h_merchant").cast("double"),
        **flags,
    }
    return {name: columns[name] for name in FEATURES}


def add_features(
    events: DataFrame,
    windows: FeatureWindows = FeatureWindows(),
    state_ttl_seconds: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The events with a ``features`` struct of 25 doubles.

    Needs the contract columns used by the features and ``event_seq``, the arrival order that
    breaks ties in time. Account history is unlimited unless ``state_ttl_seconds`` is given:
    then it starts anew after that long without an event of the account.
    """
    prepared = events if state_ttl_seconds is None else state_epochs(events, state_ttl_seconds)
    history = _with_history(_layout(prepared, windows, chunk_rows))
    features = F.struct(*[expr.alias(name) for name, expr in _feature_columns().items()])
    return history.select(*[F.col("p")[c].alias(c) for c in events.columns], features.alias("features"))


def account_context(
    events: DataFrame, windows: FeatureWindows = FeatureWindows(), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """What is known of the account before each event: totals, last event, novelty, windows."""
    history = _with_history(_layout(events, windows, chunk_rows))
    p, last = F.col("p"), F.col("h_last")
    return history.select(
        p["event_id"].alias("event_id"),
        p["event_seq"].alias("event_seq"),
        p["account_id"].alias("account_id"),
        F.col("h_count").cast("bigint").alias("rolling_count"),
        F.col("h_sum").cast("double").alias("rolling_sum"),
        F.col("h_long").cast("bigint").alias("recent_count"),
        F.col("h_spend").cast("double").alias("recent_sum"),
        F.col("h_fails").cast("bigint").alias("recent_failed_auth_count"),
        (F.col("h_device") > 0).alias("known_device"),
        (F.col("h_merchant") > 0).alias("known_merchant"),
        F.col("h_merchant").cast("bigint").alias("account_merchant_count"),
        F.timestamp_micros(last["us"]).alias("last_time"),
        last["latitude"].alias("last_latitude"),
        last["longitude"].alias("last_longitude"),
        last["country"].alias("last_country"),
        F.timestamp_micros("h_first").alias("first_seen"),
        p["__high_risk"].alias("high_risk_merchant"),
    )


def trailing_counts_by_range(events: DataFrame, windows: FeatureWindows = FeatureWindows()) -> DataFrame:
    """The window counts in the plain RANGE form, for comparison with the expiry form.

    The frame also holds the event itself and its later peers at the same time, which are
    taken off again. An account is cut into slots as long as the longest window; each event is
    also put into the next slot, as context for the frames there. Each row re-reads its frame,
    so this suits accounts with few events per window.
    """
    slot_us = windows.long * MICROS + 1
    slot = F.floor(F.col("__us") / slot_us).cast("bigint")
    rows = events.select(F.struct("*").alias("__p"), "account_id", "event_seq", F.unix_micros("event_time").alias("__us"))
    copies = rows.select("*", slot.alias("__own"), F.explode(F.array(slot, slot + 1)).alias("__slot"))
    own = F.col("__slot") == F.col("__own")
    payload = F.when(own, F.col("__p")).alias("__p")
    placed = copies.select("account_id", "event_seq", "__us", "__slot", own.alias("__mine"), payload)
    peers = (
        Window.partitionBy("account_id", "__slot", "__us")
        .orderBy("event_seq")
        .rowsBetween(0, Window.unboundedFollowing)
    )
    later = F.count(F.lit(1)).over(peers)

    def trailing(seconds: int) -> Column:
        frame = (
            Window.partitionBy("account_id", "__slot").orderBy("__us").rangeBetween(-seconds * MICROS, 0)
        )
        return F.count(F.lit(1)).over(frame) - later

    return (
        placed.select(
            "__p",
            "__mine",
            trailing(windows.short).alias("n_short"),
            trailing(windows.medium).alias("n_medium"),
            trailing(windows.long).alias("n_long"),
        )
        .where("__mine")
        .select("__p.*", "n_short", "n_medium", "n_long")
    )
