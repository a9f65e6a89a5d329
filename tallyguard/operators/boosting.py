"""Gradient-boosted trees with second-order splits over binned columns.

Every column is cut into bins once, and rows are kept in blocks. For each level of a tree one pass
adds up the gradients and hessians of the rows by (node, column, bin); the sums, whose number does
not depend on the rows, give the driver the split with the largest gain under an L2 penalty. Rows
never leave their partition: the first pass of a tree adds the tree before it to the margins and
keeps the blocks so, the other passes apply no tree but the one that grows.

Many trees are grown by tasks that run at the same time and need no job for each pass (``together``), the
same trees by the same sums; passes remain for few trees, and where a cluster gives no such tasks.

Gradients and hessians are whole multiples of 2^-24, so the sums are exact and the model does
not depend on how the rows are partitioned, or on tasks that run again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyguard.operators
from tallyguard.session import work_dir

# Workers need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(tallyguard.operators)

UNIT = 1 << 24
LEAST_GAIN = 1e-6
ROWS_PER_TASK = 50_000
# Beyond that a task has more rows, as every task of a pass sends sums of its own.
TASKS_PER_CORE = 2
SUM_TASKS = 4
ROWS_PER_BLOCK = 25_000
# Trees after which the margins are written to the shared folder, where their lineage ends.
TREES_PER_STORE = 20
QUANTILE_ACCURACY = 10_000
# Rows that are looked up in the tables of leaves at once: what they need stays in a core's cache.
ROWS_PER_LOOK = 512
# From so many trees on they are grown by tasks that run at the same time, each with so many rows.
TREES_TOGETHER = 20
ROWS_TOGETHER = 200_000

TREE_ROWS = (
    "tree int, node int, feature string, threshold double, gain double, gradient double, hessian double, value double"
)


@dataclass(frozen=True)
class BoostingSettings:
    """Names follow their meaning: ``l2`` is added to the hessian of every leaf, a child needs
    ``least_hessian``, a tree sees ``row_share`` of the rows and ``column_share`` of the columns."""

    rounds: int = 100
    depth: int = 5
    learning_rate: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0
    least_hessian: float = 1.0
    l2: float = 1.0
    bins: int = 256
    seed: int = 0


@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2i+1 and 2i+2. A row goes left if its value
    is below the threshold, that is if its bin is below ``cut``. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        whole = np.full(n, -1, dtype=np.int32)
        return Tree(whole, np.zeros(n, np.int32), *(np.zeros(n) for _ in range(5)))

    def nodes(self, columns: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node at which every row (a column of ``columns``) ends. ``limits`` are the cuts for
        binned columns and the thresholds for values."""
        n = columns.shape[1]
        flat, rows = columns.reshape(-1), np.arange(n)
        at = np.zeros(n, dtype=np.int64)
        for _ in range(len(self.feature).bit_length() - 1):
            feature = self.feature[at]
            inner = feature >= 0
            right = flat[np.where(inner, feature, 0) * n + rows] >= limits[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class Ensemble:
    """Fitted trees over named columns; missing values count as 0."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def probability(self, columns: np.ndarray, tables: LeafTables | None = None) -> np.ndarray:
        if tables is None and self.trees:
            tables = LeafTables(self.trees)
        margin = tables.margins(columns) if tables else np.zeros(columns.shape[1])
        return 1.0 / (1.0 + np.exp(-margin))

    def column(self, *values: Column) -> Column:
        """Probability of class 1 as a column expression; the rows pass Python in Arrow batches."""
        return _predictor(self)(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per node that is in use."""
        rows = []
        for number, tree in enumerate(self.trees):
            used = [0]
            for node in used:
                name = None
                if tree.feature[node] >= 0:
                    name = self.features[tree.feature[node]]
                    used += [2 * node + 1, 2 * node + 2]
                inner = name is not None
                rows.append(
                    (
                        number,
                        node,
                        name,
                        float(tree.threshold[node]) if inner else None,
                        float(tree.gain[node]) if inner else None,
                        float(tree.gradient[node]),
                        float(tree.hessian[node]),
                        None if inner else float(tree.value[node]),
                    )
                )
        return spark.createDataFrame(rows, TREE_ROWS)

    @staticmethod
    def load(rows: DataFrame, features: list[str]) -> Ensemble:
        """The ensemble whose ``frame`` was stored; its size is that of a model."""
        names = {name: i for i, name in enumerate(features)}
        stored = rows.orderBy("tree", "node").collect()
        trees: dict[int, list] = {}
        for row in stored:
            trees.setdefault(row["tree"], []).append(row)
        out = []
        for number in sorted(trees):
            depth = (max(r["node"] for r in trees[number]) + 1).bit_length() - 1
            tree = Tree.empty(depth)
            for r in trees[number]:
                node = r["node"]
                tree.gradient[node], tree.hessian[node] = r["gradient"], r["hessian"]
                if r["feature"] is None:
                    tree.value[node] = r["value"]
                else:
                    tree.feature[node] = names[r["feature"]]
                    tree.threshold[node], tree.gain[node] = r["threshold"], r["gain"]
            out.append(tree)
        return Ensemble(features, out)


class LeafTables:
    """The leaves of all trees at once.

    A tree's leaves are the bits of a number, from left to right. Where a row goes right at a node it can't
    reach the leaves below its left child. So a table for each column, by the place of its value among
    the thresholds of all trees, says which leaves of each tree remain; the first one that all columns
    leave is the row's leaf.
    """

    def __init__(self, trees: list[Tree]) -> None:
        depth = max(len(t.feature).bit_length() - 1 for t in trees)
        # Deeper trees are walked one by one.
        self.trees = trees if depth > 6 else []
        if self.trees:
            return
        self.kind, n = (np.uint32 if depth < 6 else np.uint64), len(trees)
        kind = self.kind
        limits: dict[int, set[float]] = {}
        for tree in trees:
            for node in np.flatnonzero(tree.feature >= 0):
                limits.setdefault(int(tree.feature[node]), set()).add(float(tree.threshold[node]))
        self.limits = {column: np.array(sorted(found)) for column, found in limits.items()}
        self.tables = {column: np.full((len(found) + 1, n), ~kind(0), kind) for column, found in self.limits.items()}
        self.values = np.zeros((n, 1 << depth))
        for number, tree in enumerate(trees):
            reached = [(0, 0, 1 << depth)]
            for node, start, size in reached:
                column = int(tree.feature[node])
                if column < 0:
                    self.values[number, start : start + size] = tree.value[node]
                    continue
                half = size // 2
                place = np.searchsorted(self.limits[column], tree.threshold[node])
                self.tables[column][place + 1 :, number] &= ~kind(((1 << half) - 1) << start)
                reached += [(2 * node + 1, start, half), (2 * node + 2, start + half, half)]
        self.first = np.arange(n) * (1 << depth)

    def margins(self, columns: np.ndarray) -> np.ndarray:
        if self.trees:
            margin = np.zeros(columns.shape[1])
            for tree in self.trees:
                margin += tree.value[tree.nodes(columns, tree.threshold)]
            return margin
        places = {c: np.searchsorted(found, columns[c], side="right") for c, found in self.limits.items()}
        for column, place in places.items():
            place[np.isnan(columns[column])] = 0
        out = np.zeros(columns.shape[1])
        for start in range(0, len(out), ROWS_PER_LOOK):
            n = len(out[start : start + ROWS_PER_LOOK])
            left = np.full((n, len(self.values)), ~self.kind(0))
            found = np.empty_like(left)
            for column, table in self.tables.items():
                left &= np.take(table, places[column][start : start + n], axis=0, out=found, mode="clip")
            first = np.bitwise_count(~left & (left - self.kind(1)))
            # Added up tree by tree.
            out[start : start + n] = np.cumsum(self.values.reshape(-1)[self.first + first], axis=1)[:, -1]
        return out


def _predictor(ensemble: Ensemble):
    tables: list[LeafTables] = []

    @F.arrow_udf("double")
    def predict(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return pa.array([], pa.float64())
        values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
        if ensemble.trees and not tables:
            tables.append(LeafTables(ensemble.trees))
        return pa.array(ensemble.probability(np.nan_to_num(values, nan=0.0), *tables))

    return predict


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` rising cuts for each column, its approximate quantiles: one pass."""
    shares = ", ".join(f"{i / bins!r}D" for i in range(bins + 1))
    found = rows.agg(
        *[F.expr(f"percentile_approx(`{name}`, array({shares}), {QUANTILE_ACCURACY})").alias(f"q{i}") for i, name in enumerate(features)]
    ).first()
    # The least value has nothing below it.
    return [np.unique(np.array(values or [], dtype=np.float64))[1:] for values in found]


def _binned(cuts: list[np.ndarray], positive_weight: float):
    """Rows in blocks: bins by column (one byte each, or two), weight, label and a number for each row."""
    kind = bin_type(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(start, ROWS_PER_BLOCK)
                n = part.num_rows
                bins = np.empty((len(cuts), n), dtype=kind)
                for i, limits in enumerate(cuts):
                    values = part.column(i).to_numpy(zero_copy_only=False)
                    bins[i] = np.searchsorted(limits, values, side="right")
                label = part.column(len(cuts)).to_numpy(zero_copy_only=False).astype(np.float64)
                weight = np.where(label == 1.0, positive_weight, 1.0)
                draw = part.column(len(cuts) + 1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (bins, label, weight, draw, np.zeros(n))], names=NAMES
                )

    return run


NAMES = ["bins", "label", "weight", "draw", "margin"]
BINNED = ", ".join(f"{name} binary" for name in NAMES)


def bin_type(cuts: list[np.ndarray]) -> str:
    return "<u1" if max(len(c) for c in cuts) < 256 else "<u2"


def opened(row, kind: str) -> tuple[np.ndarray, ...]:
    """A block as arrays: bins with a row for each column, label, weight, draw, margin."""
    label, weight, margin = (np.frombuffer(row[i], np.float64) for i in (1, 2, 4))
    return np.frombuffer(row[0], kind).reshape(-1, len(label)), label, weight, np.frombuffer(row[3], np.int64), margin


def _after(block: tuple[np.ndarray, ...], tree: Tree) -> tuple[np.ndarray, ...]:
    """The block with a tree added to its margins."""
    bins, *others, margin = block
    return bins, *others, margin + tree.value[tree.nodes(bins, tree.cut)]


def drawn(draw: np.ndarray, number: int, seed: int, share: float) -> np.ndarray:
    """Whether a tree sees the rows, by a hash of the row's number, the tree and the seed."""
    if share >= 1.0:
        return np.ones(len(draw), dtype=bool)
    salt = ((number + 1) * 0x9E3779B97F4A7C15 ^ seed) & 0xFFFFFFFFFFFFFFFF
    mixed = draw.view(np.uint64) ^ np.uint64(salt)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the weighted logistic loss, in whole units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    gradient = np.rint(weight * (p - label) * UNIT).astype(np.int64)
    hessian = np.rint(weight * p * (1.0 - p) * UNIT).astype(np.int64)
    return gradient, hessian


def _level_sums(growing: Tree, level: int, used: np.ndarray, width: int, number: int, settings: BoostingSettings):
    """Sums of the blocks of one partition by column of ``used``: gradients and hessians by (node of
    the level, bin)."""
    first = (1 << level) - 1
    size = (1 << level) * width

    def run(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((len(used), 2, size), np.int64)
        for bins, label, weight, draw, margin in blocks:
            node = growing.nodes(bins, growing.cut)
            here = np.flatnonzero((node >= first) & drawn(draw, number, settings.seed, settings.row_share))
            units = gradients(margin[here], label[here], weight[here])
            slot = (node[here] - first) * width
            for place, column in enumerate(used):
                cells = slot + bins[column][here]
                for kind in (0, 1):
                    # Whole numbers this small add up exactly in doubles.
                    total[place, kind] += np.bincount(cells, units[kind], size).astype(np.int64)
        yield from enumerate(total)

    return run


def best_splits(g: np.ndarray, h: np.ndarray, l2: float, least_hessian: float):
    """For each node of (node, column, bin) sums: gain, column and cut of the best split, and the
    node's own sums. A cut c sends bins below c to the left; ties go to the first column and cut."""
    left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1] / UNIT, np.cumsum(h, axis=2)[:, :, :-1] / UNIT
    whole_g, whole_h = g[:, :1, :].sum(axis=2) / UNIT, h[:, :1, :].sum(axis=2) / UNIT
    right_g, right_h = whole_g[:, :, None] - left_g, whole_h[:, :, None] - left_h

    def strength(a, b):
        return a * a / (b + l2)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (strength(left_g, left_h) + strength(right_g, right_h) - strength(whole_g, whole_h)[:, :, None])
    gain[(left_h < least_hessian) | (right_h < least_hessian) | np.isnan(gain)] = -np.inf
    flat = gain.reshape(len(g), -1)
    if not flat.shape[1]:
        nothing = np.zeros(len(g), dtype=np.int64)
        return np.full(len(g), -np.inf), nothing, nothing, whole_g[:, 0], whole_h[:, 0]
    best = flat.argmax(axis=1)
    column, cut = np.unravel_index(best, gain.shape[1:])
    return flat[np.arange(len(g)), best], column, cut + 1, whole_g[:, 0], whole_h[:, 0]


def used_columns(number: int, columns: int, settings: BoostingSettings) -> np.ndarray:
    """The columns that a tree sees."""
    rng = np.random.default_rng([settings.seed, number])
    return np.sort(rng.permutation(columns)[: max(1, math.ceil(settings.column_share * columns))])


def found_splits(g: np.ndarray, h: np.ndarray, first: int, settings: BoostingSettings) -> tuple[np.ndarray, ...]:
    """``best_splits`` with the sums left of the split; ``first`` is added to the columns' numbers."""
    gain, column, cut, own_g, own_h = best_splits(g, h, settings.l2, settings.least_hessian)
    left = np.arange(g.shape[2]) < cut[:, None]
    nodes = np.arange(len(g))
    left_g, left_h = (np.where(left, x[nodes, column], 0).sum(axis=1) / UNIT for x in (g, h))
    return gain, column + first, cut, own_g, own_h, left_g, left_h


def put_node(
    tree: Tree, node: int, split: list, used: np.ndarray, cuts: list[np.ndarray], settings: BoostingSettings
) -> bool:
    """Writes a node by its best split (a row of ``found_splits``); whether it has children."""
    gain, column, cut, own_g, own_h, left_g, left_h = split
    tree.gradient[node], tree.hessian[node] = own_g, own_h
    if gain <= LEAST_GAIN:
        tree.value[node] = -own_g / (own_h + settings.l2) * settings.learning_rate
        return False
    name = used[column]
    tree.feature[node], tree.cut[node], tree.gain[node] = name, cut, gain
    tree.threshold[node] = cuts[name][cut - 1]
    for child, (cg, ch) in ((2 * node + 1, (left_g, left_h)), (2 * node + 2, (own_g - left_g, own_h - left_h))):
        tree.gradient[child], tree.hessian[child] = cg, ch
        tree.value[child] = -cg / (ch + settings.l2) * settings.learning_rate
    return True


def grow_tree(blocks: RDD, number: int, cuts: list[np.ndarray], settings: BoostingSettings) -> Tree:
    """One more tree: a pass over the rows for each level but the last, whose leaves follow from
    the splits above them."""
    width = max(len(c) for c in cuts) + 1
    used = used_columns(number, len(cuts), settings)
    tree = Tree.empty(settings.depth)
    tasks = blocks.getNumPartitions()
    for level in range(settings.depth):
        first = (1 << level) - 1
        sums = blocks.mapPartitions(_level_sums(tree, level, used, width, number, settings))
        if tasks > 1:
            # Added up in tasks: what the driver gets does not grow with their number.
            sums = sums.reduceByKey(np.add, min(tasks, SUM_TASKS))
        total = np.zeros((2, len(used), width << level), np.int64)
        for place, found in sums.collect():
            total[:, place] = found
        g, h = total.reshape(2, len(used), 1 << level, width).swapaxes(1, 2)
        splits = found_splits(g, h, 0, settings)
        grown = False
        for i in range(1 << level):
            node = first + i
            if node and tree.feature[(node - 1) // 2] < 0:
                continue
            grown |= put_node(tree, node, [x[i] for x in splits], used, cuts, settings)
        if not grown:
            break
    return tree


def fit_ensemble(
    rows: DataFrame,
    features: list[str],
    label: str = "label",
    keys: list[str] | None = None,
    positive_weight: float = 1.0,
    settings: BoostingSettings = BoostingSettings(),
    cuts: list[np.ndarray] | None = None,
) -> Ensemble:
    """Boosted trees for a 0/1 label.

    ``keys`` are columns that tell rows apart; with a row share below 1 a hash of them, and of the
    features, decides which trees see a row. Missing values and labels count as 0. Rows are
    binned once, written and cached; every pass reads only the bins. Without rows there is no
    tree to grow: the ensemble is empty and gives one half.
    """
    names = [f"c{i}" for i in range(len(features))]
    value = [F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    draw = F.xxhash64(*[F.col(k) for k in keys or []], *value)
    clean = rows.select(
        *[v.alias(n) for v, n in zip(value, names)],
        F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"),
        draw.alias("draw"),
    )
    if cuts is None:
        cuts = quantile_cuts(clean, names, settings.bins)
    count = clean.count()
    ensemble = Ensemble(list(features))
    if not count:
        return ensemble
    spark = rows.sparkSession
    together = _tasks_together(spark, count, settings)
    tasks = together or min(math.ceil(count / ROWS_PER_TASK), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    kind = bin_type(cuts)
    path = work_dir(spark, "boosting")
    clean.repartition(tasks).mapInArrow(_binned(cuts, positive_weight), BINNED).write.parquet(path)
    if together:
        from tallyguard.operators.together import fit_together

        ensemble.trees = fit_together(spark, path, cuts, settings, together)
        return ensemble
    blocks = _blocks(spark, path, tasks, kind)
    held = [blocks]
    try:
        for number in range(settings.rounds):
            if number:
                blocks = _kept(blocks, ensemble.trees[-1])
                held.append(blocks)
                if number % TREES_PER_STORE == 0:
                    path = work_dir(spark, "boosting")
                    spark.createDataFrame(blocks.map(lambda block: [bytearray(x.tobytes()) for x in block]), BINNED).write.parquet(path)
                    for older in held:
                        older.unpersist()
                    blocks = _blocks(spark, path, tasks, kind)
                    held = [blocks]
            ensemble.trees.append(grow_tree(blocks, number, cuts, settings))
            # The first pass of a tree has made its blocks from those of the tree before.
            while len(held) > 1:
                held.pop(0).unpersist()
    finally:
        for older in held:
            older.unpersist()
    return ensemble


def _tasks_together(spark: SparkSession, count: int, settings: BoostingSettings) -> int:
    """In how many tasks that run at the same time the trees grow; 0 if by passes."""
    from tallyguard.operators.together import filesystem, tasks_at_once

    if settings.rounds < TREES_TOGETHER:
        return 0
    wanted = math.ceil(count / ROWS_TOGETHER)
    if wanted == 1:
        return 1
    try:
        filesystem(work_dir(spark, "sums"))
    except (pa.ArrowInvalid, OSError):
        return 0
    return min(wanted, tasks_at_once(spark))


def _blocks(spark: SparkSession, path: str, tasks: int, kind: str) -> RDD:
    """Blocks written to the shared folder, dealt evenly and cached for the passes."""
    stored = spark.read.parquet(path).repartition(tasks).rdd.map(lambda row: opened(row, kind))
    return stored.persist(StorageLevel.MEMORY_AND_DISK)


def _kept(blocks: RDD, tree: Tree) -> RDD:
    """The blocks after one more tree, cached by the next pass."""
    return blocks.map(lambda block: _after(block, tree)).persist(StorageLevel.MEMORY_AND_DISK)
