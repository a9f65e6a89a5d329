"""Typed decoding of JSON messages against the closed event contract.

The text is parsed once, into a map of VARIANT, which tells the JSON type of each field. Each
field is then checked and converted by its own rules: text stays text, numbers may come as
numeric strings, flags as 0/1 or yes/no words, times as ISO text or epochs. Every violation is
listed; a message without any is an event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.scalars import uuid_from
from tallyguard.schemas import CHANNELS, CONTRACT, PAYMENT_METHODS, SCENARIOS, TRANSACTION

ENUMS = {
    "channel": CHANNELS,
    "payment_method": PAYMENT_METHODS,
    "simulation_scenario": SCENARIOS,
}
OPTIONAL = {"event_id", "event_time", "prior_auth_failures", "label", "metadata"}
NULLABLE = {"label"}

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
WHOLE_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"
UUID_TEXT = r"^(urn:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"
PLAIN_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ZONED_TEXT = r"(?i)(z|[+-]\d{2}(:?\d{2})?)$"
TRUE_WORDS = ["true", "t", "yes", "y", "on", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "off", "0"]
MILLIS_FROM = 2e10


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters and projections refer to instead of repeating.

    The optimizer copies projected expressions into the filters above them. For long chains
    of expressions that multiplies the work; a one-row generator keeps them evaluated once.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _kind(name: Column) -> Column:
    """text, number, flag, null, object or array, from the type name of a variant."""
    return (
        F.when(name == "STRING", "text")
        .when(name == "BOOLEAN", "flag")
        .when(name == "VOID", "null")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name.isNotNull(), "number")
    )


def _number(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "number", text.try_cast("double"))
        .when((kind == "text") & text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))
        .when(kind == "flag", (text == "true").cast("double"))
    )


def _whole(kind: Column, text: Column) -> Column:
    value = (
        F.when(kind == "number", text.try_cast("double"))
        .when((kind == "text") & text.rlike(WHOLE_TEXT), F.trim(text).try_cast("double"))
        .when(kind == "flag", (text == "true").cast("double"))
    )
    return F.when(value == F.floor(value), value.try_cast("int"))


def _flag(kind: Column, text: Column) -> Column:
    word = F.lower(text)
    number = F.when(kind == "number", text.try_cast("double"))
    yes = (kind.isin("flag", "text") & word.isin(TRUE_WORDS)) | F.coalesce(number == 1, F.lit(False))
    no = (kind.isin("flag", "text") & word.isin(FALSE_WORDS)) | F.coalesce(number == 0, F.lit(False))
    return F.when(yes, F.lit(True)).when(no, F.lit(False))


def _time(kind: Column, text: Column) -> Column:
    epoch = F.when(kind.isin("number", "text"), text.try_cast("double"))
    seconds = F.when(F.abs(epoch) > MILLIS_FROM, epoch / 1000).otherwise(epoch)
    from_epoch = F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint"))
    dated = F.when((kind == "text") & text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d"), F.trim(text))
    zoned = F.when(F.substring(dated, 11, 100).rlike(ZONED_TEXT), dated).otherwise(
        F.concat(dated, F.lit("Z"))
    )
    return F.coalesce(zoned.try_cast("timestamp"), from_epoch)


def _uuid(kind: Column, text: Column) -> Column:
    digits = F.lower(F.regexp_replace(F.regexp_replace(text, "^urn:uuid:", ""), "[-{}]", ""))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    shaped = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in parts])
    usual = (kind == "text") & text.rlike(PLAIN_UUID)
    return F.when(usual, text).when((kind == "text") & text.rlike(UUID_TEXT), shaped)


def _convert(name: str, variant: Column, kind: Column, text: Column) -> Column:
    type_name = TRANSACTION[name].dataType.simpleString()
    if name == "event_id":
        return _uuid(kind, text)
    if name in ENUMS:
        return F.when((kind == "text") & text.isin(ENUMS[name]), text)
    if type_name == "double":
        return _number(kind, text)
    if type_name == "int":
        return _whole(kind, text)
    if type_name == "boolean":
        return _flag(kind, text)
    if type_name == "timestamp":
        return _time(kind, text)
    if type_name.startswith("map"):
        return F.when(kind == "object", F.try_variant_get(variant, "$", "map<string,string>"))
    return F.when(kind == "text", text)


WANTED = {
    "double": "a number",
    "int": "a whole number",
    "boolean": "true or false",
    "timestamp": "a time",
    "map<string,string>": "an object",
    "string": "text",
}


def decode_events(messages: DataFrame, value: str = "value", arrival: str | None = "timestamp") -> DataFrame:
    """Adds ``event`` (contract struct) and ``errors`` (array of text, empty when valid).

    A missing event id becomes a hash of the message, so a retry decodes to the same event; a
    missing event time becomes the arrival time.
    """
    received = F.col(arrival) if arrival else F.current_timestamp()
    # One parse gives every field with its type; an object that can't be read as such is null.
    parsed = computed_once(messages, {"__m": F.from_json(value, "map<string,variant>")})
    parsed = computed_once(
        parsed,
        {
            "__keys": F.map_keys("__m"),
            **{f"__v_{name}": F.try_element_at("__m", F.lit(name)) for name in CONTRACT},
        },
    )
    described = {f"__k_{name}": F.schema_of_variant(f"__v_{name}") for name in CONTRACT}
    texts = {f"__t_{name}": F.try_variant_get(F.col(f"__v_{name}"), "$", "string") for name in CONTRACT}
    parsed = computed_once(parsed, {**described, **texts})
    checked = [name for name in CONTRACT if not _plain_text(name)]
    parsed = computed_once(
        parsed,
        {
            f"__c_{name}": _convert(
                name, F.col(f"__v_{name}"), _kind(F.col(f"__k_{name}")), F.col(f"__t_{name}")
            )
            for name in checked
        },
    )
    converted = {
        name: F.col(f"__c_{name}")
        if name in checked
        else F.when(F.col(f"__k_{name}") == "STRING", F.col(f"__t_{name}"))
        for name in CONTRACT
    }
    unknown = F.array_sort(F.array_except(F.col("__keys"), F.array(*[F.lit(n) for n in CONTRACT])))
    problems = [_problem(name, F.col(f"__k_{name}"), converted[name]) for name in CONTRACT]
    problems.append(
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))
    )
    defaults = {
        "event_id": uuid_from(F.col(value)),
        "event_time": received,
        "prior_auth_failures": F.lit(0),
        "metadata": F.create_map().cast("map<string,string>"),
    }
    fields = [
        (F.coalesce(expr, defaults[n]) if n in defaults else expr).alias(n) for n, expr in converted.items()
    ]
    not_object = F.array(F.lit("message: must be a JSON object"))
    errors = F.when(F.col("__keys").isNull(), not_object).otherwise(F.array_compact(F.array(*problems)))
    outcome = {"event": F.struct(*fields), "errors": errors}
    return computed_once(parsed, outcome).select(*messages.columns, *outcome)


def _plain_text(name: str) -> bool:
    return (
        TRANSACTION[name].dataType.typeName() == "string" and name not in ENUMS and name != "event_id"
    )


def _problem(name: str, kind: Column, converted: Column) -> Column:
    """Text of the violation of one field, or NULL. ``kind`` is NULL where the field is missing."""
    wanted = WANTED[TRANSACTION[name].dataType.simpleString()]
    if name in ENUMS:
        wanted = "one of " + ", ".join(ENUMS[name])
    elif name == "event_id":
        wanted = "a UUID"
    wrong = F.lit(f"{name}: must be {wanted}")
    if name in NULLABLE:
        return F.when(converted.isNull() & (kind != "VOID"), wrong)
    if name in OPTIONAL:
        return F.when(converted.isNull() & kind.isNotNull(), wrong)
    missing = F.lit(f"{name}: field required")
    return F.when(converted.isNull(), F.when(kind.isNull(), missing).otherwise(wrong))


def coerce_training_rows(rows: DataFrame) -> DataFrame:
    """Contract columns of table or CSV rows, with ``metadata`` text read as a map.

    The text may be JSON or use single quotes; columns outside the contract are dropped.
    """
    columns = []
    for field in TRANSACTION.fields:
        if field.name not in rows.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name == "metadata" and rows.schema["metadata"].dataType.typeName() == "string":
            columns.append(F.from_json("metadata", "map<string,string>").alias("metadata"))
        else:
            columns.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    if "event_seq" in rows.columns:
        columns.append(F.col("event_seq"))
    return rows.select(*columns)
