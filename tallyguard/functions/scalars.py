"""Column functions used across the jobs. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
MICROS = 1_000_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def fixed_decimals(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, halves to even on the exact binary value."""
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def round_exact(value: Column, digits: int = 2) -> Column:
    """Rounding of a double as decimal text would show it (unlike ``round``, no decimal detour)."""
    return fixed_decimals(value, digits).cast("double")


def seconds_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / F.lit(float(MICROS))


def utc_hour(us: Column) -> Column:
    """Hour of day in UTC from epoch microseconds, whatever the session time zone is."""
    return F.pmod(F.floor(us / F.lit(3_600 * MICROS)), F.lit(24))


def hour_start(us: Column) -> Column:
    """Epoch second at which the hour of ``us`` starts."""
    return (F.floor(us / F.lit(3_600 * MICROS)) * 3_600).cast("bigint")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with microseconds."""
    micros = F.unix_micros(ts)
    wall = F.timestamp_add("MICROSECOND", micros, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    text = F.replace(wall.cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(text, F.lit("+00:00"))


def identity_hash(value: Column) -> Column:
    """Pseudonym of an identifier: the first 16 hex characters of its SHA-256."""
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def uuid_from(value: Column) -> Column:
    """A stable UUID-shaped identifier derived from text, so retries give the same id."""
    digest = F.sha2(value.cast("binary"), 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])


def score_text(score: Column) -> Column:
    return F.coalesce(fixed_decimals(score, 2), F.lit("n/a"))


def activity_message(decision: Column, transaction_id: Column, rule_id: Column, score: Column) -> Column:
    """``BLOCK • txn • rule • score 0.92``; the rule part is left out when there is none."""
    rule = F.when(rule_id != "", rule_id)
    return F.concat_ws(
        " • ", decision, transaction_id, rule, F.concat(F.lit("score "), score_text(score))
    )


def scored_text(score: Column, model_name: Column, model_version: Column) -> Column:
    return F.concat(
        F.lit("Scored "), fixed_decimals(score, 3), F.lit(" with "), model_name, F.lit(" "), model_version
    )


def scenario_label(scenario: Column) -> Column:
    """Readable scenario name without the word ``fraud``."""
    spaced = F.replace(F.replace(scenario, F.lit("_"), F.lit(" ")), F.lit("fraud"), F.lit(""))
    label = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    return F.when(F.coalesce(scenario, F.lit("")) == "", F.lit("unknown scenario")).otherwise(label)


def _half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def relative_age(ts: Column, as_of: Column) -> Column:
    """``updated 5s ago`` style text."""
    seconds = F.greatest(F.lit(0), _half_up((F.unix_millis(as_of) - F.unix_millis(ts)) / 1000))
    return (
        F.when(seconds < 5, F.lit("updated just now"))
        .when(seconds < 60, F.concat(F.lit("updated "), seconds.cast("string"), F.lit("s ago")))
        .otherwise(F.concat(F.lit("updated "), _half_up(seconds / 60).cast("string"), F.lit("m ago")))
    )


def time_until(ts: Column, as_of: Column) -> Column:
    """``expires in 30s`` style text."""
    seconds = F.greatest(F.lit(0), _half_up((F.unix_millis(ts) - F.unix_millis(as_of)) / 1000))
    return (
        F.when(seconds < 5, F.lit("expires in a few seconds"))
        .when(seconds < 60, F.concat(F.lit("expires in "), seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.lit("expires in "), _half_up(seconds / 60).cast("string"), F.lit("m")))
    )


def is_recent(ts: Column, as_of: Column, window_seconds: int) -> Column:
    return F.unix_millis(as_of) - F.unix_millis(ts) <= window_seconds * 1000


def is_notable(activity_type: Column, decision: Column, score: Column) -> Column:
    """Activities worth a notice: feedback, a BLOCK or REVIEW, or a score of 0.9 and more."""
    verdict = F.coalesce(F.upper(decision), F.lit(""))
    return (
        (activity_type == "feedback")
        | verdict.isin("BLOCK", "REVIEW")
        | (F.coalesce(score, F.lit(0.0)) >= 0.9)
    )
