"""Rates, quantiles and alert states over time-stamped event tables.

Events are first counted per step (partial aggregation), so sliding windows only ever work on
rows per (label, step): their number depends on the time span, not on the number of events.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.skew import keyed_running, lookup

STEP_SECONDS = 60

# Windows of more steps than this are put together from two blocks.
WIDE_STEPS = 60

# Upper bounds of latency histogram buckets in seconds (the last bucket is open).
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# Alert rules (name, limit, seconds the condition must hold).
ALERTS = {
    "error_ratio": (0.02, 300),
    "dlq_rate": (0.01, 180),
    "worker_p95": (1.0, 300),
    "state_store_p95": (0.05, 300),
    "dataset_drift": (0.3, 600),
}


def sliding(
    events: DataFrame,
    us: Column,
    labels: list[str],
    window_seconds: int,
    partial: dict[str, Column],
    combine: dict[str, tuple[Callable, str]],
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Aggregates over [end - window, end) for each step end ``tick`` that has any event.

    ``partial`` aggregates the events of a step; ``combine`` names, for each result, the function
    (such as sum or max) and the partial column that it goes over.
    """
    steps = window_seconds // step_seconds
    per_step = events.groupBy(
        *labels, F.floor(us / (step_seconds * 1_000_000)).cast("bigint").alias("__step")
    ).agg(*[expr.alias(name) for name, expr in partial.items()])
    if steps > WIDE_STEPS:
        return _two_blocks(per_step, labels, steps, combine, step_seconds)
    spread = per_step.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("__ahead"))
    at = ((F.col("__step") + F.col("__ahead")) * step_seconds).alias("tick")
    return spread.groupBy(*labels, at).agg(*[fn(column).alias(name) for name, (fn, column) in combine.items()])


def _two_blocks(
    per_step: DataFrame, labels: list[str], steps: int, combine: dict[str, tuple[Callable, str]], step_seconds: int
) -> DataFrame:
    """The same for wide windows. Time is cut into blocks as long as the window, so a window is the
    end of one block and the beginning of the next; running aggregates from both sides of each
    block give the two parts, and a step is not copied into every window that holds it."""
    block = F.floor(F.col("__step") / steps).alias("__block")
    own = per_step.withColumns({"__block": block, "__at": F.pmod(F.col("__step"), F.lit(steps))}).drop("__step")
    grid = own.select(*labels, "__block").distinct().select(
        *labels, "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint"))).alias("__at")
    )
    keys = Window.partitionBy(*labels, "__block").orderBy("__at")
    before, after = keys.rowsBetween(Window.unboundedPreceding, -1), keys.rowsBetween(0, Window.unboundedFollowing)
    # The steps without events are rows of nulls, which the aggregates pass over.
    dense = own.unionByName(grid, allowMissingColumns=True)
    columns = list(dict.fromkeys(column for _, column in combine.values()))
    first = {c: fn for fn, c in combine.values()}
    cells = dense.groupBy(*labels, "__block", "__at").agg(*[first[c](c).alias(c) for c in columns])
    sides = cells.select(
        *labels,
        "__block",
        "__at",
        *[fn(c).over(before).alias(f"__before_{name}") for name, (fn, c) in combine.items()],
        *[fn(c).over(after).alias(f"__after_{name}") for name, (fn, c) in combine.items()],
    )

    def part(side: str, blocks_on: int) -> Column:
        tick = ((F.col("__block") + blocks_on) * steps + F.col("__at")) * step_seconds
        return F.struct(tick.alias("tick"), *[F.col(f"__{side}_{name}").alias(name) for name in combine])

    parts = sides.select(*labels, F.inline(F.array(part("before", 0), part("after", 1))))
    some = reduce(operator.or_, [F.col(name).isNotNull() for name in combine])
    return parts.where(some).groupBy(*labels, "tick").agg(*[fn(name).alias(name) for name, (fn, _) in combine.items()])


def rate(
    events: DataFrame,
    us: Column,
    labels: list[str] | None = None,
    window_seconds: int = 300,
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Events per second over the trailing window."""
    counts = increase(events, us, labels, window_seconds, step_seconds)
    return counts.select(*(labels or []), "tick", (F.col("increase") / float(window_seconds)).alias("rate"))


def increase(
    events: DataFrame,
    us: Column,
    labels: list[str] | None = None,
    window_seconds: int = 3600,
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Events in the trailing window."""
    return sliding(
        events,
        us,
        labels or [],
        window_seconds,
        {"n": F.count(F.lit(1))},
        {"increase": (F.sum, "n")},
        step_seconds,
    )


def error_ratio(errors: DataFrame, total: DataFrame) -> DataFrame:
    """Error rate over total rate, the total taken as at least 1 per second."""
    joined = total.select("tick", F.col("rate").alias("total_rate")).join(
        errors.select("tick", F.col("rate").alias("error_rate")), "tick", "left"
    )
    bad = F.coalesce("error_rate", F.lit(0.0))
    return joined.select("tick", (bad / F.greatest("total_rate", F.lit(1.0))).alias("value"))


def counter_increments(samples: DataFrame, us: Column, value: str, labels: list[str] | None = None) -> DataFrame:
    """What a counter grew by from one sample to the next (``added``), per label values.

    A counter that is lower than before began anew, at zero: all it shows is growth. The first
    sample has nothing to compare with and adds nothing.
    """
    order = Window.partitionBy(*(labels or [])).orderBy(us, value)
    before = F.lag(value).over(order)
    added = F.when(before.isNull(), 0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return samples.withColumn("added", added)


def counter_rate(
    samples: DataFrame,
    us: Column,
    value: str,
    labels: list[str] | None = None,
    window_seconds: int = 300,
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Growth per second of a sampled counter over the trailing window, resets taken out."""
    grown = counter_increments(samples, us, value, labels)
    rows = sliding(
        grown, us, labels or [], window_seconds, {"n": F.sum("added")}, {"increase": (F.sum, "n")}, step_seconds
    )
    return rows.select(*(labels or []), "tick", (F.col("increase") / float(window_seconds)).alias("rate"))


def bucket_of(value: Column) -> Column:
    """Number of the histogram bucket of a latency in seconds."""
    return sum((value > b).cast("int") for b in LATENCY_BOUNDS)


def bucket_counts(
    events: DataFrame, us: Column, value: Column, labels: list[str] | None = None, step_seconds: int = STEP_SECONDS
) -> DataFrame:
    """Histogram per step: (labels, ``at`` in microseconds, ``bucket``, ``n``). Those of several batches
    are put together by adding them up."""
    step = step_seconds * 1_000_000
    at = (F.floor(us / step) * step).cast("bigint").alias("at")
    return events.groupBy(*(labels or []), at, bucket_of(value).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_quantile(
    buckets: DataFrame,
    quantile: float = 0.95,
    labels: list[str] | None = None,
    window_seconds: int = 300,
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Quantile estimated from the counts of ``bucket_counts`` by linear interpolation, per trailing
    window."""
    labels = labels or []
    bounds = F.array(*[F.lit(b) for b in LATENCY_BOUNDS])
    counted = sliding(
        buckets, F.col("at"), [*labels, "bucket"], window_seconds, {"n": F.sum("n")}, {"n": (F.sum, "n")}, step_seconds
    )
    group = Window.partitionBy(*labels, "tick")
    ordered = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns(
        {"upto": F.sum("n").over(ordered), "rank": F.sum("n").over(group) * F.lit(quantile)}
    )
    holder = ranked.where(F.col("upto") >= F.col("rank")).groupBy(*labels, "tick").agg(
        F.min(F.struct("bucket", "n", "upto", "rank")).alias("b")
    )
    b = F.col("b")
    index = b["bucket"]
    low = F.when(index == 0, F.lit(0.0)).otherwise(F.get(bounds, index - 1))
    high = F.get(bounds, index)
    inside = (b["rank"] - (b["upto"] - b["n"])) / b["n"]
    estimate = F.when(index == len(LATENCY_BOUNDS), F.lit(LATENCY_BOUNDS[-1])).otherwise(
        low + (high - low) * inside
    )
    return holder.select(*labels, "tick", estimate.alias("value"))


def histogram_quantile(
    events: DataFrame,
    us: Column,
    value: Column,
    quantile: float = 0.95,
    labels: list[str] | None = None,
    window_seconds: int = 300,
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Quantile estimated from histogram buckets by linear interpolation, per trailing window."""
    counts = bucket_counts(events, us, value, labels, step_seconds)
    return bucket_quantile(counts, quantile, labels, window_seconds, step_seconds)


def exact_quantile(
    events: DataFrame, us: Column, value: Column, quantile: float = 0.95, step_seconds: int = 300
) -> DataFrame:
    """Exact quantile per tumbling step: the two rows around it (``low``, ``high``), how far it lies
    between them (``part``), and the interpolated ``value``.

    Values are counted per step and ranked with running counts, which split a step that holds
    very many distinct values over several tasks.
    """
    tick = ((F.floor(us / (step_seconds * 1_000_000)) + 1) * step_seconds).cast("bigint")
    counts = (
        events.groupBy(tick.alias("tick"), value.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("v_micros", F.floor(F.col("v") * 1_000_000).cast("bigint"))
    )
    ranked = keyed_running(counts, ["tick"], "v_micros", "v", {"before": F.col("n")})
    totals = counts.groupBy("tick").agg(F.sum("n").alias("rows"))
    sized = lookup(ranked, totals, ["tick"], "v")
    place = (F.col("rows") - 1) * F.lit(quantile)

    def at(position: Column) -> Column:
        holds = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(holds, F.col("v")))

    around = sized.groupBy("tick").agg(
        at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part")
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return around.select("tick", "low", "high", "part", value.alias("value"))


def max_over_time(
    samples: DataFrame, us: Column, value: str, window_seconds: int, labels: list[str] | None = None
) -> DataFrame:
    return sliding(
        samples, us, labels or [], window_seconds, {"m": F.max(value)}, {"value": (F.max, "m")}
    )


def latest_gauge(samples: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def alert_states(
    series: DataFrame, name: str, limit: float, hold_seconds: int, step_seconds: int = STEP_SECONDS
) -> DataFrame:
    """State of an alert at each evaluation step: inactive, pending or firing.

    The condition must hold at consecutive steps for ``hold_seconds``; a step without data
    counts as fine and ends the run. ``series`` has one row per step (``tick``, ``value``).
    """
    judged = series.select("tick", "value", (F.col("value") > limit).alias("over"))
    # An alert fires if it was over its limit at every step of the hold: only those steps count.
    steps = hold_seconds // step_seconds
    ahead = F.explode(F.sequence(F.lit(0), F.lit(steps * step_seconds), F.lit(step_seconds)))
    held = (
        judged.where("over")
        .select("tick", ahead.alias("ahead"))
        .groupBy((F.col("tick") + F.col("ahead")).alias("tick"))
        .agg(F.count(F.lit(1)).alias("steps_over"))
    )
    state = (
        F.when(~F.col("over"), "inactive")
        .when(F.col("steps_over") == steps + 1, "firing")
        .otherwise("pending")
    )
    return judged.join(held, "tick", "left").select(F.lit(name).alias("alert"), "tick", "value", state.alias("state"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Number of alerts and their sorted distinct statuses."""
    per_status = alerts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return per_status.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("alert_count"),
        F.array_sort(F.collect_set("status")).alias("statuses"),
    )


def stage_counters(decisions: DataFrame, dead_letters: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Processed events by stage and status."""
    done = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("events"))
    stages = done.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(stage).alias("stage"), status.alias("status"), F.col("events"))
                    for stage, status in (
                        ("validated", F.lit("ok")),
                        ("enriched", F.lit("ok")),
                        ("decisioned", F.col("decision")),
                    )
                ]
            )
        )
    )
    failed = dead_letters.groupBy(F.col("failed_stage").alias("stage")).agg(F.count(F.lit(1)).alias("events"))
    failed = failed.select("stage", F.lit("failed").alias("status"), "events")
    repeated = duplicates.agg(F.count(F.lit(1)).alias("events")).select(
        F.lit("dedupe").alias("stage"), F.lit("duplicate").alias("status"), "events"
    )
    merged = stages.unionByName(failed).unionByName(repeated)
    return merged.groupBy("stage", "status").agg(F.sum("events").alias("events")).where("events > 0")


def counters(events: DataFrame, *labels: str) -> DataFrame:
    """Events by label values."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("events"))
