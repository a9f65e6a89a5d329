"""Helpers that keep one heavy key from becoming one heavy task.

* ``find_chunks``: keys with many rows are cut into time chunks. Everything that runs per key
  then runs per (key, chunk), and what a chunk needs to know about the chunks before it
  arrives as small pre-aggregated carry rows.
* ``keyed_running``: running sums per key in time order built on those chunks.
* ``value_prefix``: running sums over a value order without a single-task sort.
* ``lookup``: left join to a unique-key table; broadcast only after its size was counted,
  else a shuffled join in which heavy keys are salted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000
CHUNK_SHARE = 50_000
HOT_ROWS = 2_000_000
HOT_SHARE = 10_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32

MAX_LEVELS = 8

CHUNK = "__chunk"
HEAVY = "__heavy"


@dataclass(frozen=True)
class Chunks:
    """How heavy keys are cut: even time slots per key, crowded slots again into even slots.

    ``levels`` hold (keys, chunk path so far, start, width). Each is bounded by construction: a
    heavy key holds more than 1/50,000 of all rows and a crowded slot twice as much, so a level
    has fewer than 50,000 rows per row offset. They are safe to broadcast. ``rows`` is the number
    of all rows.
    """

    keys: list[str]
    levels: tuple[DataFrame, ...] = ()
    rows: int = 0

    @property
    def any(self) -> bool:
        return bool(self.levels)

    def assign(self, df: DataFrame, us: str) -> DataFrame:
        """Adds ``__chunk``, a path of slot numbers that sorts in time order, and ``__heavy``."""
        placed = df.withColumn(CHUNK, F.array().cast("array<bigint>"))
        for level in self.levels:
            slot = F.floor((F.col(us) - F.col("__from")) / F.col("__width")).cast("bigint")
            deeper = F.when(F.col("__from").isNull(), F.col(CHUNK)).otherwise(F.concat(CHUNK, F.array(slot)))
            placed = (
                placed.join(F.broadcast(level), [*self.keys, CHUNK], "left")
                .withColumn(CHUNK, deeper)
                .drop("__from", "__width")
            )
        return placed.withColumn(HEAVY, F.size(CHUNK) > 0)


def find_chunks(
    df: DataFrame, keys: list[str], us: str, chunk_rows: int = CHUNK_ROWS, offsets: tuple[int, ...] = (0,)
) -> Chunks:
    """Looks for heavy keys and decides how to cut them.

    One aggregate over the key and time columns finds them. Only if there are any, further
    ones over their rows find slots that are still crowded, until none is. Rows of one key at
    one instant stay together. ``offsets`` are the distances, in microseconds, at which a row
    has entries of its own (its expiries), which crowd slots too.
    """
    load = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(us).alias("__from"), F.max(us).alias("__to")
    )
    sizes = load.agg(F.sum("__rows").alias("rows"), F.max("__rows").alias("most")).first()
    rows = sizes["rows"] or 0
    if (sizes["most"] or 0) <= chunk_rows:
        return Chunks(keys, rows=rows)
    target = max(chunk_rows, rows // CHUNK_SHARE)
    path = F.array().cast("array<bigint>").alias(CHUNK)
    first = load.where(F.col("__rows") > target).select(
        *keys, path, "__rows", "__from", (F.col("__to") + max(offsets)).alias("__to")
    )
    chunks = Chunks(keys, rows=rows)
    entries = None
    for _ in range(MAX_LEVELS):
        width = F.ceil((F.col("__to") - F.col("__from") + 1) * target / F.col("__rows"))
        level = _as_literal(
            first.select(*keys, CHUNK, "__from", F.greatest(F.lit(1), width).cast("bigint").alias("__width"))
        )
        if level is None:
            break
        chunks = Chunks(keys, (*chunks.levels, level), rows)
        if entries is None:
            spread = F.explode(F.array(*[F.col(us) + o for o in offsets])).alias("__us")
            entries = df.select(*keys, spread).join(F.broadcast(level.select(*keys)), keys, "left_semi")
        crowd = chunks.assign(entries, "__us").groupBy(*keys, CHUNK).agg(
            F.count(F.lit(1)).alias("__rows"), F.min("__us").alias("__from"), F.max("__us").alias("__to")
        )
        first = crowd.where((F.col("__rows") > 2 * target) & (F.col("__to") > F.col("__from")))
    return chunks


def _as_literal(df: DataFrame) -> DataFrame | None:
    """A bounded table as local rows, so that all branches of a plan see the same one."""
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows else None


def keyed_running(
    df: DataFrame,
    keys: list[str],
    us: str,
    seq: str,
    measures: dict[str, Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds, per measure, its sum over the earlier rows of the same key (0 on the first row)."""
    chunks = find_chunks(df, keys, us, chunk_rows)
    rows = chunks.assign(df, us).withColumns({f"__{m}": e for m, e in measures.items()})
    payload = [c for c in df.columns if c not in keys]
    packed = rows.select(
        *keys,
        CHUNK,
        F.lit(1).alias("__kind"),
        F.col(us).alias("__us"),
        F.col(seq).alias("__seq"),
        *[f"__{m}" for m in measures],
        F.struct(*payload).alias("__p"),
    )
    if chunks.any:
        totals = rows.where(HEAVY).groupBy(*keys, CHUNK).agg(*[F.sum(f"__{m}").alias(f"__{m}") for m in measures])
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = {f"__{m}": F.coalesce(F.sum(f"__{m}").over(before), F.lit(0)) for m in measures}
        carry = totals.select(*keys, CHUNK, *[e.alias(n) for n, e in carried.items()])
        packed = packed.unionByName(fill_missing(carry, packed, {"__kind": F.lit(0)}))
    prior = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy("__kind", "__us", "__seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        packed.select(
            *keys,
            "__kind",
            "__p",
            *[F.coalesce(F.sum(f"__{m}").over(prior), F.lit(0)).alias(m) for m in measures],
        )
        .where("__kind = 1")
        .select(*keys, "__p.*", *measures)
    )


def fill_missing(df: DataFrame, like: DataFrame, given: dict[str, Column]) -> DataFrame:
    """``df`` in the shape of ``like``: given values, own columns, NULL for the rest."""
    columns = []
    for field in like.schema.fields:
        value = given.get(field.name)
        if value is None:
            value = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def value_cuts(df: DataFrame, group: str, value: str, cuts: int = 128) -> dict[str, list[float]]:
    """Approximate quantile cut points per group, as literals.

    At most ``groups x cuts`` numbers reach the driver. Fixed literals make every branch of a
    plan, and every retry of a task, agree on the bucket of a value.
    """
    share = [i / cuts for i in range(1, cuts)]
    rows = df.groupBy(group).agg(F.percentile_approx(value, share, 2_000).alias("cuts")).collect()
    return {row[group]: sorted(set(row["cuts"] or [])) for row in rows}


def value_prefix(
    df: DataFrame, group: str, value: str, measures: list[str], cuts: int = 128
) -> DataFrame:
    """Adds ``<measure>_before``: sums over smaller values within the group, exactly.

    ``df`` has one row per (group, value), already aggregated, and few groups (columns of a
    report, or a constant). Values are cut into buckets of similar size, so no task sorts a
    whole group; the sums of whole buckets are a table of at most groups x cuts rows.
    """
    points = value_cuts(df, group, value, cuts)
    if not points:
        return df.withColumns({f"{m}_before": F.col(m) * 0 for m in measures})
    table = F.create_map(
        *[
            item
            for name, values in points.items()
            for item in (F.lit(name), F.array(*[F.lit(float(v)) for v in values]))
        ]
    )
    cut_list = F.element_at(table, F.col(group))
    bucketed = df.withColumn(
        "__bucket", F.size(F.filter(cut_list, lambda c: c < F.col(value).cast("double")))
    )
    totals = bucketed.groupBy(group, "__bucket").agg(*[F.sum(m).alias(f"__{m}") for m in measures])
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group, "__bucket", *[F.coalesce(F.sum(f"__{m}").over(earlier), F.lit(0)).alias(f"__{m}") for m in measures]
    )
    prior = (
        Window.partitionBy(group, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = bucketed.join(F.broadcast(offsets), [group, "__bucket"])
    return joined.select(
        *df.columns,
        *[
            (F.col(f"__{m}") + F.coalesce(F.sum(m).over(prior), F.lit(0))).alias(f"{m}_before")
            for m in measures
        ],
    )


def fits_broadcast(table: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to be sent to every executor; bytes are those of its rows as
    JSON text, which is at least about what they take in memory."""
    row = F.octet_length(F.to_json(F.struct(*table.columns)))
    measured = table.limit(most_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("bytes")).first()
    return measured["rows"] <= most_rows and (measured["bytes"] or 0) <= most_bytes


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: list[str],
    salt_from: str,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join to a table with unique keys. ``how`` is left, left_semi, left_anti or inner.

    The table is measured first (at most ``broadcast_rows + 1`` rows are looked at). Only below
    the limits of rows and bytes is it broadcast. Beyond them both sides are shuffled; keys that
    hold very many rows of ``df`` are then spread over 32 salts, and only their table rows are
    copied.
    """
    if fits_broadcast(table, broadcast_rows):
        return df.join(F.broadcast(table), on, how)
    hot = hot_keys(df, on, hot_rows)
    if hot is None:
        return df.join(table, on, how)
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt_from), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = df.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with very many rows, at most 10,000 of them, or None."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    found = counts.where(F.col("__rows") > hot_rows)
    if found.isEmpty():
        return None
    least = max(hot_rows, df.count() // HOT_SHARE)
    return _as_literal(found.where(F.col("__rows") > least).select(*on, F.lit(True).alias("__hot")))
