"""Exact top-k search by distributed histogram selection.

All rows are scored against a block of queries. Histograms of the scores, summed over the whole
table, say in which bin the k-th best score of each query lies; that bin becomes the range of the
next histogram. Where more rows than can be ranked share one score, the same refinement goes on
over their ids. At the end only rows at or above the found border are kept and ranked.

Nothing but histogram counts and the final candidates is shuffled, and a task sends no bins
below the one that holds its own k-th row, as the border can't lie there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.workers import map_arrow
from tallyguard.session import work_dir

QUERY_BLOCK = 2_048
BINS = 512
ROWS_AT_ONCE = 4_096
SCALE = 1_024
_EXACT = 1 << 53
_LONG = np.iinfo(np.int64)


@dataclass
class Range:
    """Where the border of a query lies: scores ``low`` to ``high``, then, among rows of one
    score, negated ids ``low`` to ``high``; ``above`` rows are known to be better."""

    low: int
    high: int
    above: int = 0
    tied: int | None = None


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) of finite numbers, as exact numbers in 64-bit floats, or as Python integers
    where those would lose digits."""
    scaled = np.floor(np.asarray(values, dtype=np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= _EXACT:
        return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)
    return scaled


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products (rows, queries) as 64-bit integers; beyond them the nearest one."""
    if not rows.size or not queries.size:
        return np.zeros((len(rows), len(queries)), dtype=np.int64)
    bound = int(np.abs(rows).max()) * int(np.abs(queries).max()) * rows.shape[1]
    if bound < _EXACT:
        return (rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in rows], dtype=object) @ np.array(
        [[int(x) for x in q] for q in queries], dtype=object
    ).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def usable(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of a batch by number of components, without rows that have no id,
    no vector, or a component that is null or not finite."""
    ids = batch.column(0).to_pylist()
    groups: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for name, vector in zip(ids, batch.column(1), strict=True):
        if name is None or not vector.is_valid or vector.values.null_count:
            continue
        values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(values * SCALE).all():
            kept = groups.setdefault(len(values), ([], []))
            kept[0].append(name)
            kept[1].append(values)
    return {
        size: (np.array(names, dtype=np.int64), integers(np.array(vectors).reshape(len(names), size)))
        for size, (names, vectors) in groups.items()
    }


@dataclass
class Queries:
    """A block of queries: numbers, ids and integer vectors, by number of components."""

    groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def only(self, numbers: set[int]) -> Queries:
        out = {}
        for size, (own, ids, vectors) in self.groups.items():
            kept = np.array([n in numbers for n in own.tolist()], dtype=bool)
            if kept.any():
                out[size] = (own[kept], ids[kept], vectors[kept])
        return Queries(out)

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For pieces of a batch: query numbers, row ids, scores (rows, queries), and which of
        them are candidates: all rows but the query's own."""
        for size, (ids, vectors) in usable(batch).items():
            if size not in self.groups:
                continue
            numbers, own, queries = self.groups[size]
            for at in range(0, len(ids), ROWS_AT_ONCE):
                here = slice(at, at + ROWS_AT_ONCE)
                yield numbers, ids[here], scores(vectors[here], queries), ids[here, None] != own[None, :]


def _extent(shared):
    """Per task and query: number of candidates, least and greatest score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            for numbers, _, score, candidate in shared.value.scored(batch):
                counts = candidate.sum(axis=0)
                least = np.where(candidate, score, _LONG.max).min(axis=0)
                most = np.where(candidate, score, _LONG.min).max(axis=0)
                for n, c, low, high in zip(numbers.tolist(), counts.tolist(), least.tolist(), most.tolist(), strict=True):
                    if c:
                        old = seen.get(n, [0, low, high])
                        seen[n] = [old[0] + c, min(old[1], low), max(old[2], high)]
        columns = list(zip(*((n, *v) for n, v in seen.items()), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query", "n", "low", "high"]
        )

    return run


def _width(r: Range) -> int:
    return (r.high - r.low) // BINS + 1


def _histogram(shared, ranges: dict[int, Range], k: int):
    """Per task and query: counts of the bins from the top down to the task's k-th row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for numbers, ids, score, candidate in shared.value.scored(batch):
                for column, n in enumerate(numbers.tolist()):
                    r = ranges[n]
                    inside = candidate[:, column]
                    if r.tied is None:
                        values = score[:, column]
                    else:
                        inside = inside & (score[:, column] == r.tied)
                        values = -ids
                    values = values[inside & (values >= r.low) & (values <= r.high)]
                    if len(values):
                        bins = (values.astype(np.uint64) - np.uint64(r.low % 2**64)) // np.uint64(_width(r))
                        found = np.bincount(bins.astype(np.int64), minlength=BINS)
                        counts[n] = counts.get(n, 0) + found
        rows = []
        for n, found in counts.items():
            above = 0
            for b in np.flatnonzero(found)[::-1].tolist():
                rows.append((n, b, int(found[b])))
                above += int(found[b])
                if above >= k:
                    break
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "bin", "n"])

    return run


def _best(shared, ranges: dict[int, Range]):
    """All candidates at or above the border of their query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for numbers, ids, score, candidate in shared.value.scored(batch):
                for column, n in enumerate(numbers.tolist()):
                    r, own = ranges[n], score[:, column]
                    if r.tied is None:
                        kept = candidate[:, column] & (own >= r.low)
                    else:
                        kept = candidate[:, column] & ((own > r.tied) | (own == r.tied) & (-ids >= r.low))
                    rows += [(n, i, s) for i, s in zip(ids[kept].tolist(), own[kept].tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame, size: int) -> Iterator[Queries]:
    """The queries in blocks, numbered within a block; the driver holds one block at a time."""
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64()))])
    rows: list[tuple] = []

    def block() -> Queries:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )
        groups, first = {}, 0
        for width, (ids, vectors) in usable(batch).items():
            groups[width] = (np.arange(first, first + len(ids)), ids, vectors)
            first += len(ids)
        return Queries(groups)

    for row in queries.toLocalIterator():
        rows.append((row[0], row[1]))
        if len(rows) == size:
            yield block()
            rows = []
    if rows:
        yield block()


def _borders(vectors: DataFrame, queries: Queries, k: int, ids: tuple[int, int]) -> dict[int, Range]:
    """The range that holds the border of every query that has candidates; ``ids`` are the least
    and the greatest id of the table."""
    context = vectors.sparkSession.sparkContext
    enough = 4 * k + 64
    found = (
        map_arrow(vectors, _extent(context.broadcast(queries)), "query long, n long, low long, high long")
        .groupBy("query")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    ranges = {r["query"]: Range(r["low"], r["high"]) for r in found}
    unsettled = {r["query"] for r in found if r["n"] > enough}
    while unsettled:
        shared = context.broadcast(queries.only(unsettled))
        bins = map_arrow(
            vectors, _histogram(shared, {n: ranges[n] for n in unsettled}, k), "query long, bin long, n long"
        )
        need = vectors.sparkSession.createDataFrame(
            [(n, k - ranges[n].above) for n in unsettled], "query long, need long"
        )
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        borders = (
            bins.groupBy("query", "bin")
            .agg(F.sum("n").alias("n"))
            .withColumn("upto", F.sum("n").over(down))
            .join(F.broadcast(need), "query")
            .where("upto >= need AND upto - n < need")
            .collect()
        )
        for r in borders:
            old = ranges[r["query"]]
            low = old.low + r["bin"] * _width(old)
            new = Range(low, min(old.high, low + _width(old) - 1), old.above + r["upto"] - r["n"], old.tied)
            settled = new.above + r["n"] <= enough
            if not settled and new.low == new.high:
                if new.tied is not None:
                    settled = True
                else:
                    new = Range(-ids[1], -ids[0], new.above, new.low)
            ranges[r["query"]] = new
            if settled:
                unsettled.discard(r["query"])
    return ranges


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Per query its k best rows: query_id, rank from 1, vec_id and score, the inner product of
    floor(1024 x) of both vectors. Fewer candidates give fewer rows; ties go to the smaller id.

    ``queries`` has the same columns as ``vectors``; all rows but those with the query's own id
    are candidates. Rows without an id, with a null vector, or with a component that is null or
    not finite take no part; a vector of another length is no candidate. Rows that share an id
    are ranked each; equal query rows are answered once. Scores beyond 64 bits become the
    nearest 64-bit number. An empty table gives no rows.

    Queries are answered in blocks, each against the whole table and written when it is done.
    """
    spark = vectors.sparkSession
    columns = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")]
    rows = vectors.select(*columns)
    target = work_dir(spark, "top-k")
    result = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], result).write.parquet(target)
    ids = tuple(rows.agg(F.min("vec_id"), F.max("vec_id")).first())
    for own in _blocks(queries.select(*columns).distinct(), block):
        ranges = _borders(rows, own, k, ids)
        if not ranges:
            continue
        shared = spark.sparkContext.broadcast(own.only(set(ranges)))
        best = map_arrow(rows, _best(shared, ranges), "query long, vec_id long, score long")
        names = spark.createDataFrame(
            [(int(n), int(i)) for numbers, ids, _ in own.groups.values() for n, i in zip(numbers, ids, strict=True)],
            "query long, query_id long",
        )
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score").write.mode(
            "append"
        ).parquet(target)
    return spark.read.schema(result).parquet(target)
