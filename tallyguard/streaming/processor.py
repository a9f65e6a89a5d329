"""Keyed state for the streaming decisions.

Three small stateful steps: one per bucket of event ids (was the event delivered before?), one per
merchant and salt (has it been flagged as high risk before?) and one per account (history
features). Within a micro-batch the rows of a key are put in event-time order and handled as
arrays. With a waiting time events are held back until the clock has passed them by it, so those
that arrive out of order within it take their place, and the outputs equal those of the batch job.

Rows of kind ``OTHER`` (messages off the good route, repeated deliveries) pass all steps as they
are, so a stream has one branch and decodes a message once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import tallyguard.functions
import tallyguard.operators
import tallyguard.schemas
import tallyguard.streaming
from tallyguard.functions.scalars import haversine_km, seconds_between, utc_hour
from tallyguard.operators.features import MICROS, MONEY, FeatureWindows, risk_level
from tallyguard.operators.validate import GOOD
from tallyguard.schemas import CHANNELS, FEATURES, FIRST_EVENT_GAP_SECONDS, STATE_TTL_SECONDS

EVENT, FLAG, OTHER = 0, 1, 2
REPEAT, HEARTBEAT = "repeat", "heartbeat"

# What a row carries from the start: its kind, route, event and position, and the rest as text.
CARRIED = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("route", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("arrived", T.LongType()),
        T.StructField("us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("micros", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("risky", T.BooleanType()),
        T.StructField("repeat_of", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)

HISTORY = T.StructType(
    [
        *CARRIED.fields,
        T.StructField("n_short", T.LongType()),
        T.StructField("n_medium", T.LongType()),
        T.StructField("n_long", T.LongType()),
        T.StructField("spend", T.LongType()),
        T.StructField("fails", T.LongType()),
        T.StructField("life_n", T.LongType()),
        T.StructField("life_sum", T.StringType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("last_latitude", T.DoubleType()),
        T.StructField("last_longitude", T.DoubleType()),
        T.StructField("last_country", T.StringType()),
        T.StructField("device_before", T.LongType()),
        T.StructField("merchant_before", T.LongType()),
    ]
)

MERCHANT_SALTS = 16
# Waiting rows in one entry of the state.
PACKED_ROWS = 5_000
# Devices or merchants of an account whose counts lie in its one state value; each further one is asked for
# by itself.
SEEN_TOGETHER = 2_000
CLAIM_BUCKETS = 1024
CLAIM_SECONDS = 30 * 86_400
# Text of times in the payload: whole microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# The state handlers travel to the executors by value: those need no copy of this package.
for _part in (tallyguard.streaming, tallyguard.functions, tallyguard.operators, tallyguard.schemas):
    cloudpickle.register_pickle_by_value(_part)


def as_batch(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows a key received in this micro-batch (they may come in several chunks)."""
    found = list(chunks)
    return found[0].reset_index(drop=True) if len(found) == 1 else pd.concat(found, ignore_index=True)


def as_output(batch: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """The columns of the schema. A text column without any text is given as plain nulls, since one
    of missing numbers can't be sent back as text."""
    out = batch.reindex(columns=schema.fieldNames())
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    for name in texts:
        if out[name].dtype != object and not out[name].notna().any():
            out[name] = pd.Series([None] * len(out), index=out.index, dtype=object)
    return out


def in_time_order(batch: pd.DataFrame) -> pd.DataFrame:
    order = np.lexsort((batch["seq"].to_numpy(), batch["us"].to_numpy()))
    return batch.take(order).reset_index(drop=True)


def packed(batch: pd.DataFrame) -> list[tuple[bytes]]:
    """Carried rows as entries of a list state, many rows an entry: reading and writing one costs as
    much as that of a row."""
    schema, out = to_arrow_schema(CARRIED), []
    for start in range(0, len(batch), PACKED_ROWS):
        part = pa.Table.from_pandas(batch.iloc[start : start + PACKED_ROWS], schema=schema, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_table(part)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(entries: Iterator[tuple[bytes]]) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(rows).read_all() for (rows,) in entries]
    return pa.concat_tables(parts).to_pandas()


class EventClaims(StatefulProcessor):
    """Marks repeated deliveries of an event id within the horizon, by the arrival time.

    State: a map from id to arrival and sequence of the claimed delivery, one entry an id, for all
    ids of a bucket. An entry older than the horizon is void; a timer sweeps them out of the map.
    """

    def __init__(self, horizon_seconds: int) -> None:
        self.horizon_ms = horizon_seconds * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claims = handle.getMapState("claims", "event_id string", "arrived long, seq long")
        self.sweep = handle.getValueState("sweep", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = as_batch(rows).sort_values(["arrived", "seq"], kind="stable", ignore_index=True)
        seqs = batch["repeat_of"].to_numpy().copy()
        kinds = batch["kind"].to_numpy().copy()
        claimed: dict[str, tuple[int, int]] = {}
        # Asked once: a bucket without claims needs no look-up an event.
        older = self.claims.exists()
        for i, (kind, name, arrived, seq) in enumerate(
            zip(batch["kind"].tolist(), batch["event_id"].tolist(), batch["arrived"].tolist(), batch["seq"].tolist())
        ):
            if kind != EVENT:
                continue
            known = claimed.get(name)
            if known is None and older and self.claims.containsKey((name,)):
                known = tuple(self.claims.getValue((name,)))
            if known is not None and arrived - known[0] <= self.horizon_ms:
                seqs[i], kinds[i] = known[1], OTHER
                claimed[name] = known
                continue
            claimed[name] = (int(arrived), int(seq))
            self.claims.updateValue((name,), claimed[name])
        if claimed and not self.sweep.exists():
            self._sweep_at(min(a for a, _ in claimed.values()) + self.horizon_ms)
        repeat = (kinds == OTHER) & (batch["kind"].to_numpy() == EVENT)
        batch["repeat_of"] = seqs
        batch["route"] = np.where(repeat, REPEAT, batch["route"])
        batch["kind"] = kinds
        yield as_output(batch, CARRIED)

    def _sweep_at(self, at: int) -> None:
        # Sweeps are at least a sixteenth of the horizon apart.
        at += self.horizon_ms // 16
        self.sweep.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() - self.horizon_ms
        entries = [(name[0], claim[0]) for name, claim in self.claims.iterator()]
        left = [arrived for _, arrived in entries if arrived >= limit]
        for name, arrived in entries:
            if arrived < limit:
                self.claims.removeKey((name,))
        self.sweep.clear()
        if left:
            self._sweep_at(min(left) + self.horizon_ms)
        return iter([])


class MerchantRisk(StatefulProcessor):
    """Marks events at merchants that an earlier event, of any account, flagged.

    A merchant is spread over salts. Its events go to one salt each; those that flag it also send
    a row without payload to every salt, so each knows the earliest flag. With a waiting time
    events are held until the clock has passed them by it.
    """

    def __init__(self, wait_seconds: int | None) -> None:
        self.wait_ms = None if wait_seconds is None else wait_seconds * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flagged = handle.getValueState("flagged", "us long, seq long")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = as_batch(rows)
        if (batch["kind"] == OTHER).any():
            yield as_output(batch[batch["kind"] == OTHER], CARRIED)
        flags = batch[(batch["kind"] == FLAG) | (batch["kind"] == EVENT) & batch["risky"]]
        if len(flags):
            first = min(zip(flags["us"].tolist(), flags["seq"].tolist()))
            if not self.flagged.exists() or first < tuple(self.flagged.get()):
                self.flagged.update(first)
        events = batch.loc[batch["kind"] == EVENT, CARRIED.fieldNames()]
        if not len(events):
            return
        if self.wait_ms is None:
            yield self._marked(events)
            return
        due = self._due(events["us"])
        late = due < timerValues.getCurrentWatermarkInMs()
        if late.any():
            yield self._marked(events[late])
        held, due = events[~late], due[~late]
        if len(held):
            self.waiting.appendList(packed(held))
            self._wake_at(int(due.min()))

    def _due(self, us: pd.Series) -> pd.Series:
        """Milliseconds of the clock that must pass before an event is released."""
        return us // 1_000 + self.wait_ms + 1

    def _wake_at(self, at: int) -> None:
        if self.timer.exists():
            (set_for,) = self.timer.get()
            if set_for <= at:
                return
            self.handle.deleteTimer(set_for)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def _marked(self, events: pd.DataFrame) -> pd.DataFrame:
        events = in_time_order(events)
        if self.flagged.exists():
            us, seq = self.flagged.get()
            later = (events["us"] > us) | (events["us"] == us) & (events["seq"] > seq)
            events["risky"] = events["risky"].astype(bool) | later
        return as_output(events, CARRIED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        held = unpacked(self.waiting.get())
        due = self._due(held["us"])
        ready = due < timerValues.getCurrentWatermarkInMs()
        rest = held[~ready]
        if len(rest):
            self.waiting.put(packed(rest))
            self._wake_at(int(due[~ready].min()))
        else:
            self.waiting.clear()
        if ready.any():
            yield self._marked(held[ready])


@dataclass
class Life:
    """What is known of an account: totals, first and last event, how many devices and merchants, the time
    of its timer, how often the first devices and merchants came; and the events of the last hour (arrays
    of time, amount and failure), which are a value of their own."""

    n: int = 0
    total: int = 0
    first_us: int | None = None
    last_us: int | None = None
    latitude: float | None = None
    longitude: float | None = None
    country: str | None = None
    known_devices: int = 0
    known_merchants: int = 0
    wake: int | None = None
    devices: dict[str | None, int] = field(default_factory=dict)
    merchants: dict[str | None, int] = field(default_factory=dict)
    recent: tuple[bytes, bytes, bytes] = (b"", b"", b"")

    @staticmethod
    def of(row: tuple) -> Life:
        *plain, devices, merchants = row
        life = Life(*plain, _counts(devices), _counts(merchants))
        life.total = int(life.total)
        return life

    def row(self) -> tuple:
        seen = (json.dumps([list(x), list(x.values())]) for x in (self.devices, self.merchants))
        place = self.latitude, self.longitude, self.country
        known = self.known_devices, self.known_merchants
        return (self.n, str(self.total), self.first_us, self.last_us, *place, *known, self.wake, *seen)


LIFE = (
    "n long, total string, first_us long, last_us long, latitude double, longitude double, country string, "
    "known_devices long, known_merchants long, wake long, device_counts string, merchant_counts string"
)


def _counts(text: str) -> dict[str | None, int]:
    return dict(zip(*json.loads(text)))


class AccountHistory(StatefulProcessor):
    """History of an account before each of its events.

    State: two values, read and written once a micro-batch, as a call of the state costs more than many
    events; and an entry for each device and merchant, written when it is new. Counts of those beyond
    the first ``SEEN_TOGETHER`` are in their entries, so the values do not grow without end. It starts anew
    when the account was silent for longer than the lifetime; a timer removes it once the clock says
    so, also if the account never comes back. The window arrays also keep
    ``allowance`` seconds for late events.
    """

    def __init__(self, windows: FeatureWindows, lifetime: int | None, allowance: int, wait_seconds: int | None) -> None:
        self.windows = windows
        self.lifetime = lifetime
        self.allowance = allowance
        self.wait_ms = (wait_seconds or 0) * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", LIFE)
        self.recent = handle.getValueState("recent", "us binary, micros binary, failed binary")
        self.devices = handle.getMapState("devices", "device string", "n long")
        self.merchants = handle.getMapState("merchants", "merchant string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = as_batch(rows)
        other = batch["kind"].to_numpy() == OTHER
        if other.any():
            yield as_output(batch[other], HISTORY)
            batch = batch[~other]
            if not len(batch):
                return
        batch = in_time_order(batch)
        stored = self.profile.get()
        life = Life()
        if stored is not None:
            life = Life.of(stored)
            life.recent = self.recent.get()
        us, parts = batch["us"].to_numpy(), []
        for start, end in self._lives(us):
            if start > 0 or self._expired(us[0], life.last_us):
                life = self._renewed(life)
            parts.append(self._advance(life, batch.iloc[start:end]))
        if self.lifetime is not None and life.wake is None:
            self._expire_at(life)
        self.profile.update(life.row())
        self.recent.update(life.recent)
        yield from parts

    def _expire_at(self, life: Life) -> None:
        life.wake = life.last_us // 1_000 + self.lifetime * 1_000 + self.wait_ms + 1
        self.handle.registerTimer(life.wake)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """One timer an account: it moves on if there were events since it was set."""
        stored = self.profile.get()
        if stored is not None:
            life = Life.of(stored)
            if life.last_us // 1_000 + self.lifetime * 1_000 + self.wait_ms + 1 < timerValues.getCurrentWatermarkInMs():
                self._renewed(life)
            else:
                self._expire_at(life)
                self.profile.update(life.row())
        return iter([])

    def _expired(self, us: int, last: int | None) -> bool:
        return self.lifetime is not None and last is not None and us - last > self.lifetime * MICROS

    def _lives(self, us: np.ndarray) -> list[tuple[int, int]]:
        """Row ranges between gaps longer than the state lifetime."""
        if self.lifetime is None:
            return [(0, len(us))]
        cuts = (np.flatnonzero(np.diff(us) > self.lifetime * MICROS) + 1).tolist()
        return list(zip([0, *cuts], [*cuts, len(us)]))

    def _renewed(self, life: Life) -> Life:
        """A life that begins anew, with the timer of the one before."""
        for state in (self.profile, self.recent, self.devices, self.merchants):
            state.clear()
        return Life(wake=life.wake)

    def _windows(self, life: Life, batch: pd.DataFrame) -> dict[str, np.ndarray]:
        """Trailing counts and sums over the kept and the new events, as array lookups."""
        old = [np.frombuffer(part, dtype=np.int64) for part in life.recent]
        new = [batch[c].to_numpy(dtype=np.int64) for c in ("us", "micros", "failed")]
        is_new = np.concatenate([np.zeros(len(old[0]), bool), np.ones(len(new[0]), bool)])
        us, micros, failed = (np.concatenate(pair) for pair in zip(old, new))
        order = np.argsort(us, kind="stable")
        us, micros, failed, is_new = us[order], micros[order], failed[order], is_new[order]
        spent = np.concatenate([[0], np.cumsum(micros)])
        fails = np.concatenate([[0], np.cumsum(failed)])
        here = np.flatnonzero(is_new)

        def start(seconds: int) -> np.ndarray:
            return np.searchsorted(us, us[here] - seconds * MICROS, side="left")

        short, medium, long = (start(w) for w in (self.windows.short, self.windows.medium, self.windows.long))
        keep = us >= us[-1] - (self.windows.long + self.allowance) * MICROS
        life.recent = tuple(part[keep].tobytes() for part in (us, micros, failed))
        return {
            "n_short": here - short,
            "n_medium": here - medium,
            "n_long": here - long,
            "spend": spent[here] - spent[long],
            "fails": fails[here] - fails[medium],
        }

    def _seen(self, values: pd.Series, together: dict, known: int, state) -> tuple[np.ndarray, int]:
        """How often each value came before in this life of the account, and how many are known now."""
        names = [None if x is None or x != x else x for x in values.tolist()]
        added: dict[str | None, int] = {}
        before = np.empty(len(names), np.int64)
        for i, name in enumerate(names):
            before[i] = added.get(name, 0)
            added[name] = int(before[i]) + 1
        others = known > len(together)
        older: dict[str | None, int] = {}
        for name, n in added.items():
            if name in together:
                older[name] = together[name]
                together[name] += n
                continue
            if others and state.containsKey((name,)):
                older[name] = state.getValue((name,))[0]
            else:
                known += 1
                if len(together) < SEEN_TOGETHER:
                    together[name] = n
                else:
                    others = True
            state.updateValue((name,), (older.get(name, 0) + n,))
        # Missing values are counted within a micro-batch only.
        older.pop(None, None)
        if older:
            before += np.array([older.get(name, 0) for name in names], np.int64)
        return before, known

    def _advance(self, life: Life, batch: pd.DataFrame) -> pd.DataFrame:
        n = len(batch)
        out = {name: batch[name].to_numpy() for name in CARRIED.fieldNames()}
        us, last = out["us"], life.last_us
        out |= self._windows(life, batch)
        out["life_n"] = life.n + np.arange(n)
        sums = []
        for micros in out["micros"].tolist():
            sums.append(str(life.total))
            life.total += int(micros)
        out["life_sum"] = np.array(sums, dtype=object)
        life.first_us = int(us[0]) if life.first_us is None else min(int(us[0]), life.first_us)
        out["first_us"] = np.full(n, life.first_us)
        # The last event is the latest by its own time: one that comes late doesn't replace it.
        stored = np.zeros(n, bool)
        stored[0] = True
        if last is not None:
            stored[1:] = us[:-1] < last
        out["last_us"] = pd.arrays.IntegerArray(
            np.where(stored, 0 if last is None else last, np.roll(us, 1)).astype(np.int64), stored & (last is None)
        )
        for name in ("latitude", "longitude", "country"):
            values = np.roll(out[name].astype(object), 1)
            values[stored] = getattr(life, name)
            out[f"last_{name}"] = values
        out["device_before"], life.known_devices = self._seen(
            batch["device_id"], life.devices, life.known_devices, self.devices
        )
        out["merchant_before"], life.known_merchants = self._seen(
            batch["merchant_id"], life.merchants, life.known_merchants, self.merchants
        )
        if last is None or us[-1] >= last:
            life.last_us = int(us[-1])
            life.latitude, life.longitude, life.country = (
                _value(out[c][-1]) for c in ("latitude", "longitude", "country")
            )
        life.n += n
        return as_output(pd.DataFrame({name: out[name] for name in HISTORY.fieldNames()}, copy=False), HISTORY)


def _value(x: object) -> object:
    """A plain value of a cell, None where it is missing."""
    return None if pd.isna(x) else x if isinstance(x, str) else float(x)


def carried(event: Column, seq: Column, arrived: Column, payload: Column, route: Column | None = None) -> list[Column]:
    """The columns of ``CARRIED`` for an event struct. ``route`` other than good makes a row pass."""
    good = F.lit(True) if route is None else route == GOOD
    lane = F.concat(F.lit("other:"), F.pmod(F.xxhash64(seq), F.lit(CLAIM_BUCKETS)).cast("string"))
    amount = event["amount"].cast(MONEY)
    values = {
        "kind": F.when(good, F.lit(EVENT)).otherwise(F.lit(OTHER)),
        "route": F.lit(GOOD) if route is None else route,
        "event_id": event["event_id"],
        # Rows that pass have no account or merchant to meet at: they are spread.
        "account_id": F.when(good, event["account_id"]).otherwise(lane),
        "merchant_id": F.when(good, event["merchant_id"]).otherwise(lane),
        "device_id": event["device_id"],
        "country": event["country"],
        "latitude": event["latitude"],
        "longitude": event["longitude"],
        # Whole numbers have no nulls, so that no batch turns them into doubles.
        "arrived": F.coalesce(F.unix_millis(arrived), F.lit(0)),
        "us": F.coalesce(F.unix_micros(event["event_time"]), F.lit(0)),
        "seq": seq,
        "micros": F.when(good, (amount * 1_000_000).cast("bigint")).otherwise(0),
        "failed": F.when(good, (event["prior_auth_failures"] > 0).cast("bigint")).otherwise(0),
        "risky": F.coalesce(good & (risk_level(event["metadata"]) == "high"), F.lit(False)),
        "repeat_of": F.lit(-1),
        "payload": payload,
    }
    return [values[name].cast(CARRIED[name].dataType).alias(name) for name in CARRIED.fieldNames()]


def local_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose event id an earlier row of the same Arrow batch has, as rows that pass. So of an id
    that is delivered very often few rows reach its bucket."""
    for batch in batches:
        table = batch.to_pandas()
        events = table["kind"] == EVENT
        ordered = table[events].sort_values(["arrived", "seq"], kind="stable")
        first = ordered.groupby("event_id")["seq"].transform("first")
        again = ordered.index[ordered.duplicated("event_id")]
        if len(again):
            table.loc[again, "kind"] = OTHER
            table.loc[again, "route"] = REPEAT
            table.loc[again, "repeat_of"] = first[again]
            # They are spread like all rows that pass.
            spread = pd.util.hash_array(table.loc[again, "seq"].to_numpy()) % CLAIM_BUCKETS
            for name in ("account_id", "merchant_id"):
                table.loc[again, name] = [f"other:{lane}" for lane in spread]
            batch = pa.RecordBatch.from_pandas(table, schema=batch.schema, preserve_index=False)
        yield batch


def claimed_rows(rows: DataFrame, horizon_seconds: int = CLAIM_SECONDS, buckets: int = CLAIM_BUCKETS) -> DataFrame:
    """Carried rows with the repeated deliveries marked: route ``repeat``, and in ``repeat_of`` the
    sequence of an earlier delivery, else -1. The watermark has to follow the arrival."""
    marked = rows.mapInArrow(local_repeats, CARRIED)
    name = F.when(F.col("kind") == EVENT, F.col("event_id")).otherwise(F.col("merchant_id"))
    bucket = F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket")
    return (
        marked.select("*", bucket)
        .groupBy("bucket")
        .transformWithStateInPandas(EventClaims(horizon_seconds), CARRIED, "append", "EventTime")
    )


def with_history(
    rows: DataFrame,
    windows: FeatureWindows,
    state_ttl_seconds: int | None,
    late_seconds: int,
    wait_seconds: int | None,
    merchant_salts: int,
) -> DataFrame:
    """Carried rows with the history of their accounts."""
    # Rows that pass are spread by their lane; salts would only give each of them a key of its own.
    own = F.when(F.col("kind") == EVENT, F.pmod(F.xxhash64("seq"), F.lit(merchant_salts))).otherwise(0).cast("int")
    event = F.struct(own.alias("salt"), F.lit(False).alias("copy"))
    copies = F.array(*[F.struct(F.lit(i).alias("salt"), F.lit(True).alias("copy")) for i in range(merchant_salts)])
    flags = (F.col("kind") == EVENT) & F.col("risky")
    lanes = F.when(flags, F.concat(F.array(event), copies)).otherwise(F.array(event))
    dealt = rows.select("*", F.inline(lanes))
    dealt = dealt.withColumns(
        {
            "kind": F.when(F.col("copy"), F.lit(FLAG)).otherwise(F.col("kind")),
            "payload": F.when(~F.col("copy"), F.col("payload")),
        }
    ).drop("copy")
    marked = dealt.groupBy("merchant_id", "salt").transformWithStateInPandas(
        MerchantRisk(wait_seconds), CARRIED, "append", "EventTime"
    )
    return marked.groupBy("account_id").transformWithStateInPandas(
        AccountHistory(windows, state_ttl_seconds, late_seconds, wait_seconds), HISTORY, "append", "EventTime"
    )


def stream_features(
    events: DataFrame,
    windows: FeatureWindows = FeatureWindows(),
    state_ttl_seconds: int | None = STATE_TTL_SECONDS,
    late_seconds: int = 0,
    wait_seconds: int | None = None,
    clock: str = "event_time",
    clock_delay: str = "0 seconds",
    merchant_salts: int = MERCHANT_SALTS,
) -> DataFrame:
    """The streaming form of ``add_features``: same columns, same values on ordered input.

    With ``wait_seconds`` the values are the same on any input in which no event comes more than
    that much of the ``clock`` after one that happened later. Events are then held until the clock
    has passed them by it; rows without an event id are no events and only move the clock. Without
    it events are handled as they come: one that is late sees the state as it is then.

    The event itself travels through the stateful steps as JSON text next to the few columns
    they use, so only those are converted to arrays.
    """
    columns = events.columns
    schema = events.select(F.struct(*columns).alias("event")).schema["event"].dataType
    event = F.struct(*columns)
    timed = events.withWatermark(clock, clock_delay)
    route = F.when(F.col("event_id").isNull(), F.lit(HEARTBEAT)).otherwise(F.lit(GOOD))
    rows = timed.select(
        *carried(event, F.col("event_seq"), F.col(clock), F.to_json(event, TIMES), route)
    )
    history = with_history(rows, windows, state_ttl_seconds, late_seconds, wait_seconds, merchant_salts)
    found = history.where(F.col("kind") == EVENT).withColumn("event", F.from_json("payload", schema, TIMES))
    return found.select(*[F.col("event")[c].alias(c) for c in columns], history_features().alias("features"))


def history_features() -> Column:
    """The struct of features from the columns of ``HISTORY`` and ``event``."""
    e, last_us = F.col("event"), F.col("last_us")
    own = e["amount"].cast("double")
    average = F.when(
        F.col("life_n") > 0,
        (F.col("life_sum").cast("decimal(38,0)") / 1_000_000).cast("double") / F.col("life_n"),
    ).otherwise(own)
    located = last_us.isNotNull() & F.col("last_latitude").isNotNull() & F.col("last_longitude").isNotNull()
    distance = haversine_km(F.col("last_latitude"), F.col("last_longitude"), e["latitude"], e["longitude"])
    abroad = (
        e["is_international"]
        & (F.coalesce("last_country", F.lit("")) != "")
        & (F.col("last_country") != e["country"])
    )
    hour = utc_hour(F.col("us"))
    values = {
        "amount": own,
        "prior_auth_failures": e["prior_auth_failures"].cast("double"),
        "card_present": e["card_present"].cast("double"),
        "is_international": e["is_international"].cast("double"),
        "tx_count_1m": F.col("n_short").cast("double"),
        "tx_count_5m": F.col("n_medium").cast("double"),
        "tx_count_1h": F.col("n_long").cast("double"),
        "spend_sum_1h": F.col("spend") / 1_000_000.0,
        "spend_avg_30d_proxy": average,
        "amount_vs_recent_avg_ratio": own / F.greatest(average, F.lit(1.0)),
        "device_new_for_account": (F.col("device_before") == 0).cast("double"),
        "merchant_new_for_account": (F.col("merchant_before") == 0).cast("double"),
        "geo_distance_from_last_tx_km": F.when(located, distance).otherwise(0.0),
        "time_since_last_tx_sec": F.when(
            located, F.greatest(F.lit(0.0), seconds_between(F.col("us"), last_us))
        ).otherwise(FIRST_EVENT_GAP_SECONDS),
        "failed_auth_count_recent": F.col("fails").cast("double"),
        "international_mismatch": F.coalesce(abroad, F.lit(False)).cast("double"),
        "night_tx_flag": ((hour < 6) | (hour >= 23)).cast("double"),
        "high_risk_merchant_flag": F.col("risky").cast("double"),
        "account_age_days": F.greatest(F.lit(0.0), seconds_between(F.col("us"), F.col("first_us")) / 86_400.0),
        "account_merchant_tx_count_30d": F.col("merchant_before").cast("double"),
        **{f"channel_{c}": (e["channel"] == c).cast("double") for c in CHANNELS},
    }
    return F.struct(*[values[name].alias(name) for name in FEATURES])
