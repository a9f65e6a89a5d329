"""Centroid clustering over vectors in the order of a space-filling curve.

Vectors are projected to a few directions, ordered along a Hilbert curve there and cut into
blocks. A block is a zone map: its vectors, the least and greatest value of every component, and
the sum of its vectors. In each round the distances from a block's box to the centroids leave a
few candidates, often one; only those are compared with the vectors, in whole-number arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.workers import map_arrow
from tallyguard.session import written

SCALE = 256
COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2

CURVE_DIMENSIONS = 8
CURVE_BITS = 7
BLOCK_ROWS = 512
# Whole components beyond this could give a distance that a signed 64-bit number can't hold.
LIMIT = 1 << 27
# Below this every sum of squares is exact in a double.
EXACT_IN_DOUBLE = 1 << 20

_BLOCKS = "vec_ids binary, known binary, vectors binary, least array<int>, greatest array<int>, sums array<long>"
_ROWS = "vec_id long, cluster int, distance long"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of whole-number points (one a row, ``bits`` bits a coordinate) on a Hilbert curve.

    The Gray-code form of the curve: high bits first, every coordinate whose bit is set inverts
    the lower bits of the first, any other swaps them with the first's.
    """
    axes = cells.astype(np.uint64).T.copy()
    n = len(axes)
    if n * bits > 64:
        raise ValueError("the position must fit in 64 bits")
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        low = level - np.uint64(1)
        for i in range(n):
            is_set = (axes[i] & level) != 0
            moved = np.where(is_set, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(is_set, axes[0] ^ low, axes[0] ^ moved)
            axes[i] ^= moved
        level >>= np.uint64(1)
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        turn ^= np.where((axes[n - 1] & level) != 0, level - np.uint64(1), np.uint64(0))
        level >>= np.uint64(1)
    axes ^= turn
    position = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            position = (position << np.uint64(1)) | ((axis >> np.uint64(bit)) & np.uint64(1))
    return position


def box_candidates(least: np.ndarray, greatest: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some point of the box, ties included.

    A centroid goes if its least distance to the box is above another's greatest one. One more
    bound is taken against the centroid with the smallest greatest distance: the difference of
    two squared distances is linear, so its least value over the box is exact.
    """
    least, greatest, centroids = (x.astype(np.int64) for x in (least, greatest, centroids))
    outside = np.maximum(np.maximum(least - centroids, centroids - greatest), 0)
    nearest = (outside * outside).sum(axis=1)
    across = np.maximum(np.abs(centroids - least), np.abs(centroids - greatest))
    farthest = (across * across).sum(axis=1)
    best = int(farthest.argmin())
    left = np.flatnonzero(nearest <= farthest[best])
    slope = 2 * (centroids[best] - centroids[left])
    lowest = np.where(slope >= 0, slope * least, slope * greatest).sum(axis=1)
    norms = (centroids * centroids).sum(axis=1)
    return left[lowest + norms[left] - norms[best] <= 0]


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the place of the nearest of the centroids (the first of equals) and the
    squared distance, exactly."""
    span = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if span <= EXACT_IN_DOUBLE:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        distances = (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (v @ c.T)
    else:
        v = vectors.astype(np.int64)
        distances = np.empty((len(v), len(centroids)), dtype=np.int64)
        for j, centroid in enumerate(centroids.astype(np.int64)):
            away = v - centroid
            distances[:, j] = (away * away).sum(axis=1)
    nearest = distances.argmin(axis=1)
    return nearest, distances[np.arange(len(vectors)), nearest].astype(np.int64)


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of whole components; all lists have the same length and no null."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(flat * scale).reshape(len(column), -1)
    if values.size and np.abs(values).max() > LIMIT:
        raise OverflowError(f"a component times {scale} is beyond {LIMIT}; its distances pass 64 bits")
    return values.astype(np.int32)


def _placed(scale: int, middle: np.ndarray, directions: np.ndarray, step: np.ndarray):
    """Adds each vector's position on the curve; the vector becomes its whole components."""
    top = (1 << CURVE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _whole(batch.column(1), scale)
            along = (vectors - middle) @ directions.T
            cells = np.clip(np.floor(along / step) + (top + 1) // 2, 0, top)
            position = hilbert_index(cells, CURVE_BITS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(position), pa.array([v.tobytes() for v in vectors], pa.binary())],
                names=["vec_id", "position", "vector"],
            )

    return run


def _blocks(components: int, block_rows: int):
    """Cuts ordered rows into blocks with their zone maps."""
    schema = pa.schema(
        [("vec_ids", pa.binary()), ("known", pa.binary()), ("vectors", pa.binary())]
        + [("least", pa.list_(pa.int32())), ("greatest", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))]
    )

    def block(ids: list[int | None], raw: list[bytes]) -> pa.RecordBatch:
        vectors = np.frombuffer(b"".join(raw), "<i4").reshape(-1, components)
        return pa.RecordBatch.from_pylist(
            [
                {
                    "vec_ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
                    "known": np.array([i is not None for i in ids], np.uint8).tobytes(),
                    "vectors": vectors.tobytes(),
                    "least": vectors.min(axis=0).tolist(),
                    "greatest": vectors.max(axis=0).tolist(),
                    "sums": vectors.sum(axis=0, dtype=np.int64).tolist(),
                }
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        raw: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            raw += batch.column(1).to_pylist()
            while len(ids) >= block_rows:
                yield block(ids[:block_rows], raw[:block_rows])
                ids, raw = ids[block_rows:], raw[block_rows:]
        if ids:
            yield block(ids, raw)

    return run


def _zones(batch: pa.RecordBatch, centroids: np.ndarray):
    """For each block: row number, candidates and the vectors."""
    components = centroids.shape[1]
    least, greatest = (
        batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, components)
        for name in ("least", "greatest")
    )
    raw = batch.column(batch.schema.get_field_index("vectors"))
    for row in range(batch.num_rows):
        vectors = np.frombuffer(raw[row].as_buffer(), "<i4").reshape(-1, components)
        yield row, box_candidates(least[row], greatest[row], centroids), vectors


def _partial_sums(centroids: np.ndarray):
    """Sum and number of the vectors of every cluster, one row for each cluster of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centroids.shape, dtype=np.int64)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            whole = batch.column(batch.schema.get_field_index("sums"))
            for row, left, vectors in _zones(batch, centroids):
                if len(left) == 1:
                    sums[left[0]] += whole[row].values.to_numpy()
                    counts[left[0]] += len(vectors)
                    continue
                nearest, _ = nearest_centroids(vectors, centroids[left])
                for place, cluster in enumerate(left):
                    mine = vectors[nearest == place]
                    sums[cluster] += mine.sum(axis=0, dtype=np.int64)
                    counts[cluster] += len(mine)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array(counts[used]),
                pa.array([sums[i].tolist() for i in used], pa.list_(pa.int64())),
            ],
            names=["cluster", "n", "sums"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = (batch.column(batch.schema.get_field_index(name)) for name in ("vec_ids", "known"))
            for row, left, vectors in _zones(batch, centroids):
                nearest, distances = nearest_centroids(vectors, centroids[left])
                names = np.frombuffer(ids[row].as_buffer(), "<i8")
                missing = np.frombuffer(known[row].as_buffer(), np.uint8) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, mask=missing),
                        pa.array(left[nearest].astype(np.int32)),
                        pa.array(distances),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int) -> DataFrame:
    """Id and vector of the rows with the right number of components, none null or not finite."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where((F.size("vector") == components) & finite)


def starting_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``, as whole components. Rows with equal
    ids follow by their vectors, rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "vector").limit(k)
    rows = first.collect()
    if not rows:
        return np.empty((0, 0))
    return np.floor(np.array([r["vector"] for r in rows], dtype=np.float64) * scale)


def zone_blocks(
    kept: DataFrame, start: np.ndarray, scale: int, components: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The written table of blocks along the curve. Its directions are the main axes of the
    starting centroids, so it costs no pass; they only decide how tight the boxes are.

    Equal vectors have one position; the id and a salt follow it in the order, so however many
    equal rows there are, they are spread over the ranges.
    """
    middle = start.mean(axis=0)
    _, _, axes = np.linalg.svd(start - middle, full_matrices=False)
    directions = np.zeros((CURVE_DIMENSIONS, components))
    directions[: min(CURVE_DIMENSIONS, len(axes))] = axes[:CURVE_DIMENSIONS]
    spread = np.abs((start - middle) @ directions.T).max(axis=0)
    step = np.maximum(spread, 1.0) * 2.5 / (1 << CURVE_BITS)
    placed = map_arrow(
        kept, _placed(scale, middle, directions, step), "vec_id long, position long, vector binary"
    ).withColumn("salt", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("position", "vec_id", "salt").sortWithinPartitions("position", "vec_id")
    return written(map_arrow(ordered.select("vec_id", "vector"), _blocks(components, block_rows), _BLOCKS), "zone-blocks")


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every cluster; a centroid without vectors stays.

    What reaches the driver is a number for each component of each centroid.
    """
    partial = map_arrow(
        blocks.select("vectors", "least", "greatest", "sums"),
        _partial_sums(centroids),
        "cluster int, n long, sums array<long>",
    )
    long_form = partial.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    totals = long_form.groupBy("cluster", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n")
    )
    out = centroids.copy()
    for row in totals.collect():
        out[row["cluster"], row["place"]] = int(row["part"]) // row["n"]
    return out


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
    components: int = COMPONENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per kept vector: id, cluster, squared distance to its centroid, the sums of the
    distances of its cluster and of all, and the SHA-256 of its centroid's components.

    Vectors that are null, have another number of components, or hold null or a number that isn't
    finite are left out. Components become ``floor(scale * x)``; beyond 2^27 in size they raise an
    error, as a distance could pass 64 bits. Rows with the same id or vector keep a row each. Rows
    without an id take part, and are starting centroids only where all others are. With fewer than
    k vectors each is a centroid; an empty table gives no rows. Other columns are not read.
    """
    kept = kept_vectors(vectors, id_col, vector_col, components)
    centroids = starting_centroids(kept, k, seed, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame(
            [], _ROWS + ", cluster_inertia long, inertia long, centroid_sha256 string"
        )
    blocks = zone_blocks(kept, centroids, scale, components, block_rows)
    centroids = centroids.astype(np.int64)
    for _ in range(rounds):
        moved = next_centroids(blocks, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    assigned = written(
        map_arrow(
            blocks.select("vec_ids", "known", "vectors", "least", "greatest"),
            _assigned(centroids),
            _ROWS,
        ),
        "clusters",
    )
    digests = [
        (i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(centroids.tolist())
    ]
    by_cluster = [(r["cluster"], int(r["d"])) for r in _inertia(assigned).collect()]
    total = sum(d for _, d in by_cluster)
    named = dict(digests)
    summary = vectors.sparkSession.createDataFrame(
        [(i, d, total, named[i]) for i, d in by_cluster],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # At most k rows.
    return assigned.join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _inertia(assigned: DataFrame) -> DataFrame:
    """Sum of the distances of every cluster; one row for each centroid at most."""
    return assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same clustering by comparing every vector with every centroid."""
    steps = []
    for step in range(rounds + 1):
        steps.append(
            f"""d{step} AS MATERIALIZED (
  SELECT v.vec_id, c.cluster, sum((v.q - c.q) * (v.q - c.q))::BIGINT AS distance
  FROM parts v JOIN c{step} c USING (place) GROUP BY v.vec_id, c.cluster),
a{step} AS MATERIALIZED (
  SELECT vec_id, cluster, distance FROM d{step}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
        )
        if step < rounds:
            steps.append(
                f"""m{step} AS (
  SELECT a.cluster, p.place, floor(sum(p.q)::DOUBLE / count(*))::BIGINT AS q
  FROM a{step} a JOIN parts p USING (vec_id) GROUP BY a.cluster, p.place),
c{step + 1} AS MATERIALIZED (
  SELECT c.cluster, c.place, coalesce(m.q, c.q) AS q FROM c{step} c LEFT JOIN m{step} m USING (cluster, place))"""
            )
    chain = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
parts AS MATERIALIZED (
  SELECT vec_id, place, floor({SCALE} * embedding[place]::DOUBLE)::BIGINT AS q
  FROM kept, range(1, {COMPONENTS + 1}) AS places(place)),
start AS (
  SELECT vec_id, (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INTEGER AS cluster FROM kept),
c0 AS MATERIALIZED (
  SELECT s.cluster, p.place, p.q FROM start s JOIN parts p USING (vec_id) WHERE s.cluster < {k}),
{chain},
digests AS (
  SELECT cluster, sha256(string_agg(q::VARCHAR, ',' ORDER BY place)) AS centroid_sha256
  FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN digests USING (cluster)
"""
