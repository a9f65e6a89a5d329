"""Near-duplicates by SimHash, found with pivot distance tables.

Equal fingerprints are one class. A fingerprint has eight segments of eight bits, and each
segment has eight reference patterns (Walsh patterns, whose distances determine the segment).
Fingerprints within r bits agree on all distances of at least 8 - r segments, so a table for
each choice of 8 - r segments, keyed by those distances, brings every such pair together; a
bucket of a table can't hold more than 2^(8 r) fingerprints. In a bucket, pairs are discarded
by the largest difference of their distances to references of full width, and the survivors
are verified. A bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.joins import join_counted
from tallyguard.llm.workers import map_arrow
from tallyguard.session import written

DISTANCE = 2
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
PAIR_BLOCK = 1 << 20

SEGMENTS = 8
WALSH = [sum(((k & j).bit_count() & 1) << j for j in range(8)) for k in range(8)]
# Full-width references: the Walsh patterns of 64 bits, every fourth of them.
REFERENCES = np.array(
    [sum(((k & j).bit_count() & 1) << j for j in range(64)) for k in range(0, 64, 4)], dtype=np.uint64
)
# The distances of each segment value to the eight references, as one number for each value.
_DISTANCES = np.array([[(v ^ w).bit_count() for w in WALSH] for v in range(256)], dtype=np.uint64)
SEGMENT_ROW = (_DISTANCES << (np.arange(8, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the shingles of a text in UTF-8: a bit is set if it is in over half of their
    hashes. Fewer words than a shingle are one shingle; no words give zero."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    ends = ends[size - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(starts))


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Document id and fingerprint (as a signed number) of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    return map_arrow(rows, _fingerprints(size, seed), "doc_id long, print long")


def pivot_rows(prints: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each table, the key of every fingerprint: the pivot distances of its segments."""
    rows = SEGMENT_ROW[prints.view(np.uint8).reshape(-1, SEGMENTS)]
    for table, kept in enumerate(combinations(range(SEGMENTS), SEGMENTS - distance)):
        key = np.full(len(prints), np.uint64(table + 1))
        for segment in kept:
            key = (key ^ rows[:, segment]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield table, key


def _tables(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for _, key in pivot_rows(prints.view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(prints)], names=["bucket", "print"]
                )

    return run


def links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct fingerprints within the distance."""
    prints = prints.view(np.uint64)
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    table = np.bitwise_count(prints[:, None] ^ REFERENCES).astype(np.int8)
    step = max(1, PAIR_BLOCK // len(prints))
    out = []
    for at in range(0, len(prints) - 1, step):
        here = slice(at, min(at + step, len(prints) - 1))
        a, b = np.nonzero(np.abs(table[here, None, 0] - table[None, at + 1 :, 0]) <= distance)
        a, b = a + at, b + at + 1
        a, b = a[a < b], b[a < b]
        for pivot in range(1, len(REFERENCES)):
            near = np.abs(table[a, pivot] - table[b, pivot]) <= distance
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                out.append((i, j))
    return out


def _bucket_links(distance: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def within(buckets: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        pairs: list[tuple[int, int]] = []
        borders = np.flatnonzero(np.diff(buckets)) + 1
        starts = np.concatenate([[0], borders])
        ends = np.concatenate([borders, [len(buckets)]])
        for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            group = prints[start:end]
            pairs += [(int(group[i]), int(group[j])) for i, j in links(group, distance)]
        low = [min(p) for p in pairs]
        high = [max(p) for p in pairs]
        return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = prints = np.zeros(0, dtype=np.int64)
        for batch in batches:
            buckets = np.concatenate([buckets, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(buckets):
                continue
            last = int(np.searchsorted(buckets, buckets[-1]))
            yield within(buckets[:last], prints[:last])
            buckets, prints = buckets[last:], prints[last:]
        yield within(buckets, prints)

    return run


def linked_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v), u > v, that join the distinct fingerprints in ``print`` as all pairs within
    the distance would."""
    if not 0 < distance < SEGMENTS:
        raise ValueError("the distance must be 1 to 7 bits")
    dealt = map_arrow(prints, _tables(distance), "bucket long, print long").repartition("bucket")
    found = map_arrow(dealt.sortWithinPartitions("bucket"), _bucket_links(distance), "u long, v long")
    return found.distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Node and root (the smallest node) of every connected component of the links (u, v).

    Alternates the large-star and small-star steps until nothing changes. Every round is written
    to the shared folder, so its lineage ends there.
    """
    edges = written(edges, "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    size: int = SHINGLE,
) -> DataFrame:
    """One row per document: id, fingerprint as 16 hex digits, and the smallest id that links of
    at most ``distance`` differing bits reach, itself included.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with the same
    id keep a row each. Rows without an id are linked, but never name a component, unless all of
    it are such rows: then it is null. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = written(least, "classes")
    roots = stars(linked_fingerprints(classes.select("print"), distance))
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = members.join(classes, members["node"] == classes["print"]).select("print", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("print", "component_id")
    components = written(
        classes.join(of_linked, "print", "left").select(
            "print", "copies", F.coalesce("component_id", "least").alias("component_id")
        ),
        "components",
    )
    return join_counted(prints, components, "print", "copies").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
