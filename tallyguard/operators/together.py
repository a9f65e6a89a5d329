"""Trees grown by tasks that run at the same time and keep their rows between levels.

A job grows many trees. Each task holds its rows as arrays; for every level it sums up gradients and
hessians by (column, node, bin), leaves the sums in the shared folder, and adds up those of all tasks for
its share of the columns. Only the best split of each share passes the driver. Of two children the
one with fewer rows is summed up, the other one is the rest of its parent. Columns of few bins share one
code, and a count by that code gives the sums of all of them.

All sums are whole numbers, so the trees are those that passes over the rows would grow.
"""

from __future__ import annotations

import pickle
import tempfile
import time
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

from tallyguard.operators.boosting import (
    BINNED,
    NAMES,
    BoostingSettings,
    Tree,
    bin_type,
    drawn,
    found_splits,
    gradients,
    opened,
    put_node,
    used_columns,
)
from tallyguard.session import work_dir

# Values that the codes of columns which share one may take.
SHARED_CODES = 1_024
# Rows that are handled at once, and bytes of rows that a task keeps in memory; further ones lie in a
# temporary file.
ROWS_AT_ONCE = 65_536
HELD_BYTES = 400_000_000
# Seconds between looks for the files of other tasks, and after which a task gives up.
LEAST_WAIT, LONGEST_PAUSE, MOST_WAIT = 0.001, 0.2, 7_200
# Trees after which the margins are written to the shared folder.
TREES_PER_JOB = 55


class Codes:
    """Columns of bins as fewer columns of codes: a code is the sum of ``bin * step`` of its columns."""

    def __init__(self, bins: list[int]) -> None:
        self.bins = bins
        self.sizes: list[int] = []
        self.place = [(0, 1)] * len(bins)
        for column in sorted(range(len(bins)), key=lambda c: (-bins[c], c)):
            for code, size in enumerate(self.sizes):
                if size * bins[column] <= SHARED_CODES:
                    self.place[column] = (code, size)
                    self.sizes[code] = size * bins[column]
                    break
            else:
                self.place[column] = (len(self.sizes), 1)
                self.sizes.append(bins[column])

    def of(self, bins: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(bins.shape[1], np.int64) for _ in self.sizes]
        for column, (code, step) in enumerate(self.place):
            out[code] += bins[column].astype(np.int64) * step
        return [codes.astype(np.uint8 if size <= 256 else np.uint16 if size <= 65_536 else np.int64) for codes, size in zip(out, self.sizes)]

    def bin(self, codes: np.ndarray, column: int) -> np.ndarray:
        """The bins of a column for codes of its group."""
        step = self.place[column][1]
        return codes.astype(np.int64) // step % self.bins[column]

    def sums(self, totals: np.ndarray, code: int, column: int) -> np.ndarray:
        """Sums by (kind, node, bin of a column) from those by (kind, node, code)."""
        step, n = self.place[column][1], self.bins[column]
        return totals.reshape(*totals.shape[:2], self.sizes[code] // (step * n), n, step).sum(axis=(2, 4))


class Rows:
    """Some rows of a task: codes, label, weight, number and margin, and what the tree that grows needs."""

    def __init__(self, codes: list[np.ndarray], label, weight, draw, margin, held) -> None:
        n = len(label)
        self.codes = [held(c) for c in codes]
        # Weights are few: each is kept once, and a row has its place.
        self.weights, place = np.unique(weight, return_inverse=True)
        small = np.uint8 if len(self.weights) <= 256 else np.int64
        self.label, self.place, self.draw, self.margin = (held(x) for x in (label, place.astype(small), draw, margin))
        self.node = held(np.zeros(n, np.uint16))
        self.seen = held(np.zeros(n, bool))
        self.units = held(np.zeros((2, n)))

    def weight(self) -> np.ndarray:
        return self.weights[self.place]


class Held:
    """Arrays in memory up to a number of bytes, then in a temporary file that no name leads to."""

    def __init__(self, limit: int) -> None:
        self.left, self.file = limit, None

    def __call__(self, array: np.ndarray) -> np.ndarray:
        self.left -= array.nbytes
        if self.left >= 0 or not array.nbytes:
            return np.array(array)
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        start = self.file.seek(0, 2)
        self.file.truncate(start + array.nbytes)
        out = np.memmap(self.file, array.dtype, "r+", start, array.shape)
        out[:] = array
        return out


class Alone:
    """Exchange of a task that has all rows."""

    task, tasks = 0, 1

    def messages(self, own: object) -> list:
        return [own]

    def summed(self, sums: np.ndarray) -> tuple[int, np.ndarray]:
        return 0, sums


class Exchange:
    """Exchange between the tasks of a stage by files of a shared folder.

    Spark's own barrier takes a second, so it is used once, to agree on a name. A task gives its next file
    only when it has read those before, so one exchange back a task drops its own.
    """

    def __init__(self, context: BarrierTaskContext, folder: str) -> None:
        self.task, self.tasks = context.partitionId(), len(context.getTaskInfos())
        # A stage that begins anew reads nothing of the one before.
        self.run = context.allGather(uuid.uuid4().hex)[0]
        self.files, self.folder = filesystem(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.number = 0

    def _name(self, number: int, task: int) -> str:
        return f"{self.folder}/{self.run}-{number}-{task}"

    def _give(self, content: object) -> None:
        """Writes a file, by a rename, and waits until all tasks have theirs."""
        self.number += 1
        own = self._name(self.number, self.task)
        with self.files.open_output_stream(f"{own}.part") as out:
            out.write(content)
        self.files.move(f"{own}.part", own)
        missing = [self._name(self.number, task) for task in range(self.tasks)]
        wait, until = LEAST_WAIT, time.monotonic() + MOST_WAIT
        while missing := [x.path for x in self.files.get_file_info(missing) if x.type == fs.FileType.NotFound]:
            if time.monotonic() > until:
                raise TimeoutError(f"{missing[0]} did not come")
            time.sleep(wait)
            wait = min(wait * 1.2, LONGEST_PAUSE)
        if self.number > 1:
            self.files.delete_file(self._name(self.number - 1, self.task))

    def messages(self, own: object) -> list:
        self._give(pickle.dumps(own))
        found = []
        for task in range(self.tasks):
            with self.files.open_input_file(self._name(self.number, task)) as file:
                found.append(pickle.loads(file.read()))
        return found

    def summed(self, sums: np.ndarray) -> tuple[int, np.ndarray]:
        """The first of the columns that this task adds up, and their sums over all tasks."""
        self._give(np.ascontiguousarray(sums).data)
        first, end = (len(sums) * (self.task + i) // self.tasks for i in (0, 1))
        total = np.zeros((end - first, *sums.shape[1:]), np.int64)
        if total.nbytes:
            for task in range(self.tasks):
                with self.files.open_input_file(self._name(self.number, task)) as file:
                    file.seek(first * (sums.nbytes // len(sums)))
                    total += np.frombuffer(file.read(total.nbytes), np.int64).reshape(total.shape)
        return first, total

    def close(self) -> None:
        self.messages(None)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if urlsplit(folder).scheme:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def tasks_at_once(spark: SparkSession) -> int:
    """How many tasks the cluster runs at the same time; 0 where it can't promise that."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    inner = context._jsc.sc()
    return max(1, inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()))


def grower(cuts: list[np.ndarray], settings: BoostingSettings, first: int, end: int, folder: str, tasks: int, last: bool):
    """What a task does: the trees ``first`` to ``end`` from its blocks. Task 0 gives the trees; unless they
    are the last ones, every task gives its blocks with their new margins."""
    kind = bin_type(cuts)

    def run(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        codes = Codes([len(c) + 1 for c in cuts])
        held, rows = Held(HELD_BYTES), []
        for bins, label, weight, draw, margin in gathered(blocks):
            if ((label == 0) | (label == 1)).all():
                label = label.astype(bool)
            rows.append(Rows(codes.of(bins), label, weight, draw, margin, held))
        exchange = Exchange(BarrierTaskContext.get(), folder) if tasks > 1 else Alone()
        trees = []
        for number in range(first, end):
            trees.append(grow_together(rows, codes, number, cuts, settings, exchange))
        if tasks > 1:
            exchange.close()
        if exchange.task == 0:
            yield (bytearray(pickle.dumps([list(vars(tree).values()) for tree in trees])), *([None] * 5))
        if last:
            return
        for part in rows:
            bins = np.stack([codes.bin(part.codes[codes.place[c][0]], c) for c in range(len(cuts))]).astype(kind)
            values = bins, part.label.astype(np.float64), part.weight(), part.draw, part.margin
            yield (None, *(bytearray(x.tobytes()) for x in values))

    return run


def gathered(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks put together to about as many rows as are handled at once."""
    held: list[tuple[np.ndarray, ...]] = []
    for block in blocks:
        if held and sum(len(b[1]) for b in held) + len(block[1]) > ROWS_AT_ONCE:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))
            held = []
        held.append(block)
    if held:
        yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))


def grow_together(
    rows: list[Rows], codes: Codes, number: int, cuts: list[np.ndarray], settings: BoostingSettings, exchange
) -> Tree:
    """One more tree, and its values added to the margins of the rows."""
    width = max(codes.bins)
    used = used_columns(number, len(cuts), settings)
    for part in rows:
        part.node[:] = 0
        part.seen[:] = drawn(np.asarray(part.draw), number, settings.seed, settings.row_share)
        part.units[:] = gradients(part.margin, part.label, part.weight())
    tree = Tree.empty(settings.depth)
    # Nodes of the level, those of them whose rows are summed up, and the sums of the level before by node.
    nodes, summed, older = [0], [0], {}
    for level in range(settings.depth):
        start, own = exchange.summed(level_sums(rows, codes, used, summed, width, len(tree.feature)))
        best = None
        if own.size:
            by_node = dict(zip(summed, own.transpose(2, 1, 0, 3)))
            for node in nodes:
                if node not in by_node:
                    by_node[node] = older[(node - 1) // 2] - by_node[node + 1 if node % 2 else node - 1]
            older = by_node
            # By (kind, node, column, bin).
            g, h = np.stack([by_node[n] for n in nodes], axis=1)
            best = found_splits(g, h, start, settings)
        splits = merged([x for x in exchange.messages(best) if x is not None])
        grown = [n for i, n in enumerate(nodes) if put_node(tree, n, [x[i] for x in splits], used, cuts, settings)]
        if not grown:
            break
        last = level + 1 == settings.depth
        counts = move(rows, codes, tree, grown, last)
        if last:
            break
        counts = sum(exchange.messages(counts))
        nodes = [child for n in grown for child in (2 * n + 1, 2 * n + 2)]
        summed = [left if counts[left] <= counts[left + 1] else left + 1 for left in nodes[::2]]
    for part in rows:
        part.margin += tree.value[part.node]
    return tree


def level_sums(rows: list[Rows], codes: Codes, used: np.ndarray, summed: list[int], width: int, size: int) -> np.ndarray:
    """Sums of the rows at some nodes by (column of ``used``, kind, node, bin)."""
    rank = np.full(size, -1, np.int64)
    rank[summed] = np.arange(len(summed))
    wanted = sorted({codes.place[c][0] for c in used})
    totals = {code: np.zeros((2, len(summed) * codes.sizes[code]), np.int64) for code in wanted}
    for part in rows:
        if summed == [0] and part.seen.all():
            at, here = np.zeros(len(part.node), np.int64), slice(None)
        else:
            at = rank[part.node]
            here = np.flatnonzero((at >= 0) & part.seen)
            at = at[here]
        units = [part.units[kind][here] for kind in (0, 1)]
        for code in wanted:
            cells = at * codes.sizes[code] if len(summed) > 1 else np.zeros(len(at), np.int64)
            cells += part.codes[code][here]
            for kind in (0, 1):
                # Whole numbers this small add up exactly in doubles.
                totals[code][kind] += np.bincount(cells, units[kind], totals[code].shape[1]).astype(np.int64)
    out = np.zeros((len(used), 2, len(summed), width), np.int64)
    for place, column in enumerate(used):
        code = codes.place[column][0]
        found = totals[code].reshape(2, len(summed), codes.sizes[code])
        out[place, :, :, : codes.bins[column]] = codes.sums(found, code, column)
    return out


def merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The best of the splits that the tasks found for each node; of equal ones that of the first column."""
    best = found[0]
    for other in found[1:]:
        better = (other[0] > best[0]) | ((other[0] == best[0]) & (other[1] < best[1]))
        best = tuple(np.where(better, y, x) for x, y in zip(best, other))
    return best


def move(rows: list[Rows], codes: Codes, tree: Tree, grown: list[int], last: bool) -> np.ndarray:
    """Rows at the new inner nodes go to a child; how many of those that the tree sees are at each node."""
    size = len(tree.feature)
    widest = max(codes.sizes)
    inner = np.full(size, -1, np.int64)
    inner[grown] = np.arange(len(grown))
    group = np.array([codes.place[tree.feature[n]][0] for n in grown])
    right = np.zeros((len(grown), widest), np.uint8)
    for i, node in enumerate(grown):
        column = tree.feature[node]
        values = np.arange(codes.sizes[group[i]])
        right[i, : len(values)] = codes.bin(values, column) >= tree.cut[node]
    flat = right.reshape(-1)
    counts = np.zeros(size, np.int64)
    everywhere = len(grown) == 1 << int(np.log2(grown[0] + 1))
    for part in rows:
        at = inner[part.node]
        if not everywhere:
            here = np.flatnonzero(at >= 0)
            at = at[here]
        side = np.zeros(len(at), np.uint8)
        groups = sorted(set(group.tolist()))
        for code in groups:
            values = part.codes[code] if everywhere else part.codes[code][here]
            if len(groups) == 1:
                side = flat[at * widest + values]
            else:
                own = np.flatnonzero((group == code)[at])
                side[own] = flat[at[own] * widest + values[own]]
        if everywhere:
            part.node[:] = 2 * part.node + 1 + side
        else:
            part.node[here] = 2 * part.node[here] + 1 + side
        if not last:
            counts += np.bincount(part.node[part.seen] if not part.seen.all() else part.node, minlength=size)
    return counts


def fit_together(
    spark: SparkSession, path: str, cuts: list[np.ndarray], settings: BoostingSettings, tasks: int
) -> list[Tree]:
    """The trees over the blocks of a folder. After some trees the blocks are written with their margins, so a
    stage that begins anew loses no more than those."""
    trees: list[Tree] = []
    kind = bin_type(cuts)
    for first in range(0, settings.rounds, TREES_PER_JOB):
        end = min(first + TREES_PER_JOB, settings.rounds)
        rows = spark.read.parquet(path).where("bins IS NOT NULL").select(*NAMES).repartition(tasks).rdd
        blocks = rows.map(lambda row: opened(row, kind))
        task = grower(cuts, settings, first, end, work_dir(spark, "sums"), tasks, end == settings.rounds)
        out = (blocks.barrier() if tasks > 1 else blocks).mapPartitions(task)
        path = work_dir(spark, "boosting")
        spark.createDataFrame(out, f"trees binary, {BINNED}").write.parquet(path)
        (found,) = spark.read.parquet(path).where("trees IS NOT NULL").select("trees").collect()
        trees += [Tree(*values) for values in pickle.loads(found["trees"])]
    return trees
