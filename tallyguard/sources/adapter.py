"""Transaction-shaped rows derived from the ``events`` table, and raw messages made from them.

The raw activity table is too sparse for minute-scale rules, so time is compressed 60 times
and ten users share one account. Every column is a plain expression over the scan, so column
pruning reaches the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.scalars import iso_utc
from tallyguard.schemas import CONTRACT, RAW_TOPIC

EPOCH_START = 1_704_067_200
DAY_OFFSET = 64_800
COMPRESSION_US = 60_000_000

# City table (country, city, latitude, longitude), by city number.
CITIES = [
    ("IN", "Mumbai", 19.0760, 72.8777),
    ("IN", "Bengaluru", 12.9716, 77.5946),
    ("IN", "Delhi", 28.6139, 77.2090),
    ("IN", "Hyderabad", 17.3850, 78.4867),
    ("IN", "Chennai", 13.0827, 80.2707),
    ("SG", "Singapore", 1.3521, 103.8198),
    ("AE", "Dubai", 25.2048, 55.2708),
]

CHANNEL_OF = {
    "click": "ecommerce",
    "view": "pos",
    "purchase": "upi",
    "signup": "wallet",
    "error": "transfer",
}
METHOD_OF = {
    "ecommerce": "credit_card",
    "pos": "debit_card",
    "upi": "upi",
    "wallet": "wallet",
    "transfer": "bank_transfer",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Epoch microseconds of a timestamp column with or without zone (without: UTC)."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff(
            "MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(column)
        )
    return F.unix_micros(column)


def _choose(source: Column, mapping: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for key, value in mapping.items():
        chosen = F.when(source == key, F.lit(value)).otherwise(chosen)
    return chosen


def _city(index: Column, position: int, kind: str) -> Column:
    values = F.array(*[F.lit(city[position]).cast(kind) for city in CITIES])
    return F.get(values, index)


def transactions(events: DataFrame) -> DataFrame:
    """The 27 contract columns plus ``event_seq`` and an exact ``amount_exact``."""
    compressed = F.floor(
        (epoch_micros(events, "ts") - EPOCH_START * 1_000_000) / COMPRESSION_US
    ).cast("bigint")
    base = events.select(
        F.col("event_id").alias("event_seq"),
        (compressed + EPOCH_START + DAY_OFFSET).alias("t"),
        F.floor(F.col("user_id") / 10).cast("bigint").alias("acct"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("event_type").alias("kind"),
        F.col("value"),
        _choose(F.col("event_type"), CHANNEL_OF).alias("channel"),
    )
    seq, k, acct, kind = F.col("event_seq"), F.col("k"), F.col("acct"), F.col("kind")
    city = (
        F.when(k.between(90, 92), F.lit(5))
        .when(k.between(93, 94), F.lit(6))
        .otherwise((acct % 5).cast("int"))
    )
    base = base.withColumns(
        {"city_no": city, "amount_exact": (F.col("value") * 10).cast("decimal(14,2)")}
    )
    country = _city(F.col("city_no"), 0, "string")
    hex_seq = F.lower(F.lpad(F.hex(seq), 16, "0"))
    seq_text = seq.cast("string")
    device = F.when(k >= 97, F.concat(F.lit("dev_x"), seq_text)).otherwise(
        F.concat(F.lit("dev_"), (k % 11).cast("string"))
    )
    account = F.concat(F.lit("acct_"), acct.cast("string"))
    risky = ((k % 20) == 19) & (kind == "signup")
    currency = F.when(country == "IN", F.lit("INR")).otherwise(F.lit("USD"))
    columns = {
        "event_id": F.concat(
            F.lit("00000000-0000-0000-"), F.substring(hex_seq, 1, 4), F.lit("-"), F.substring(hex_seq, 5, 12)
        ),
        "event_time": F.timestamp_seconds("t"),
        "account_id": account,
        "customer_id": F.concat(F.lit("cust_"), acct.cast("string")),
        "transaction_id": F.concat(
            F.lit("txn_"), F.lpad(seq_text, F.greatest(F.lit(8), F.length(seq_text)), F.lit("0"))
        ),
        "payment_instrument_id": F.concat(F.lit("pi_"), acct.cast("string")),
        "merchant_id": F.concat(F.lit("m_"), (k % 20).cast("string")),
        "merchant_category": F.concat(F.lit("category_"), (k % 20 % 7).cast("string")),
        "amount": F.col("amount_exact").cast("double"),
        "currency": F.when(seq % 7 == 0, F.lower(currency)).otherwise(currency),
        "country": country,
        "city": _city(F.col("city_no"), 1, "string"),
        "latitude": _city(F.col("city_no"), 2, "double"),
        "longitude": _city(F.col("city_no"), 3, "double"),
        "channel": F.col("channel"),
        "device_id": device,
        "ip_address": F.concat(F.lit("203.0.113."), (acct % 256).cast("string")),
        "user_agent_hash": F.concat(F.lit("ua_"), device),
        "email_hash": F.concat(F.lit("em_"), account),
        "phone_hash": F.concat(F.lit("ph_"), account),
        "prior_auth_failures": F.when(kind == "error", 1 + k % 4).otherwise(0).cast("int"),
        "payment_method": _choose(F.col("channel"), METHOD_OF),
        "card_present": F.col("channel") == "pos",
        "is_international": country != "IN",
        "label": F.when(k % 13 == 0, F.lit(None))
        .when((k >= 90) | (F.col("value") >= 150), 1)
        .otherwise(0)
        .cast("int"),
        "simulation_scenario": F.when(k.between(90, 94), "impossible_travel")
        .when(k.between(95, 96), "account_takeover")
        .when(k.between(97, 99), "new_device_high_amount")
        .otherwise("normal_behavior"),
        "metadata": F.create_map(
            F.lit("merchant_risk_level"), F.when(risky, F.lit("high")).otherwise(F.lit("low"))
        ),
        "event_seq": seq,
        "amount_exact": F.col("amount_exact"),
    }
    return base.select(*[expr.alias(name) for name, expr in columns.items()])


def load_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(read_table(spark, sf_dir, "events"))


def raw_messages(tx: DataFrame) -> DataFrame:
    """JSON messages as a source topic would carry them, some of them broken on purpose.

    The first matching case of ``event_seq`` decides: no JSON (97), ``country`` missing (89),
    an unknown field (83), a wrong channel (79), zero amount (73), negative failures (71),
    amount as text (67, still valid).
    """
    seq = F.col("event_seq")

    def multiple(n: int, *earlier: int) -> Column:
        hit = seq % n == 0
        for other in earlier:
            hit = hit & (seq % other != 0)
        return hit

    fields = {name: F.col(name) for name in CONTRACT}
    fields["event_time"] = iso_utc(F.col("event_time"))
    fields["country"] = F.when(~multiple(89, 97), F.col("country"))
    fields["channel"] = F.when(multiple(79, 97, 89, 83), F.lit("carrier_pigeon")).otherwise(F.col("channel"))
    fields["amount"] = F.when(multiple(73, 97, 89, 83, 79), F.lit(0.0)).otherwise(F.col("amount"))
    fields["prior_auth_failures"] = F.when(
        multiple(71, 97, 89, 83, 79, 73), F.lit(-1)
    ).otherwise(F.col("prior_auth_failures"))
    fields["unexpected"] = F.when(multiple(83, 97, 89), F.lit("x"))
    body = F.to_json(F.struct(*[expr.alias(name) for name, expr in fields.items()]))
    body = F.when(
        multiple(67, 97, 89, 83, 79, 73, 71),
        F.regexp_replace(body, '"amount":([0-9.Ee+-]+)', '"amount":"$1"'),
    ).otherwise(body)
    return tx.select(
        F.col("account_id").alias("key"),
        F.when(seq % 97 == 0, F.lit("not json")).otherwise(body).alias("value"),
        F.lit(RAW_TOPIC).alias("topic"),
        F.col("event_time").alias("timestamp"),
        seq.alias("event_seq"),
    )


def repeated_messages(messages: DataFrame, tx_count_offset: int = 1_000_000_000_000) -> DataFrame:
    """The messages plus a second delivery, 30 seconds later, of every fiftieth."""
    again = messages.where(F.col("event_seq") % 50 == 0).withColumns(
        {
            "timestamp": F.col("timestamp") + F.expr("interval 30 seconds"),
            "event_seq": F.col("event_seq") + tx_count_offset,
        }
    )
    return messages.unionByName(again)
