"""Hierarchical packing of token ids into windows of several lengths.

A document is cut into windows of the greatest length and a rest, which goes to the shortest
tier that holds it. In each tier the longest rests are placed first, each into the fullest
window that has room. Gaps of the longer windows are then filled from the shorter tiers, and
the last gap of a window is closed by cutting a rest. What is left of the shortest tier at the
end of an input split is laid out in sequences whose lengths are powers of two.

Each input split is packed by itself with bounded memory and without a shuffle. The sequences
of a tier are dealt to step groups of equal token counts and about equal attention cost.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.tokens import encoder
from tallyguard.llm.workers import map_arrow

TIERS = (256, 512, 1024, 2048)
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


@dataclass
class Rest:
    """A part of a document that is not yet in a sequence."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Rest, Rest]:
        return (
            Rest(self.doc_id, self.start, self.ids[: 4 * length], self.doc_tokens),
            Rest(self.doc_id, self.start + length, self.ids[4 * length :], self.doc_tokens),
        )


class Shelf:
    """Rests of one tier by length: takes the longest that fits."""

    def __init__(self):
        self.lengths: list[int] = []
        self.rests: dict[int, list[Rest]] = {}
        self.tokens = 0

    def __len__(self) -> int:
        return sum(map(len, self.rests.values()))

    def add(self, rest: Rest) -> None:
        if rest.length not in self.rests:
            insort(self.lengths, rest.length)
            self.rests[rest.length] = []
        self.rests[rest.length].append(rest)
        self.tokens += rest.length

    def take(self, most: int) -> Rest | None:
        """The longest rest of at most that length."""
        at = bisect_left(self.lengths, most + 1) - 1
        return self._pop(at) if at >= 0 else None

    def _pop(self, at: int) -> Rest:
        length = self.lengths[at]
        rest = self.rests[length].pop()
        if not self.rests[length]:
            del self.rests[length]
            del self.lengths[at]
        self.tokens -= length
        return rest


@dataclass
class Packer:
    """Packs the rests it is given; finished sequences go to ``done`` as (tier, pieces)."""

    tiers: tuple[int, ...]
    pool: int
    shelves: dict[int, Shelf] = field(default_factory=dict)
    done: list[tuple[int, list[Rest]]] = field(default_factory=list)
    held: int = 0

    def __post_init__(self):
        self.shelves = {tier: Shelf() for tier in self.tiers}

    def add_document(self, doc_id: int | None, ids: bytes) -> None:
        total, window = len(ids) // 4, self.tiers[-1]
        rest = Rest(doc_id, 0, ids, total)
        while rest.length >= window:
            piece, rest = rest.cut(window)
            self.done.append((window, [piece]))
        if rest.length:
            self._shelve(rest)
            self.held += 1
            if self.held >= self.pool:
                self.pack(last=False)

    def _shelve(self, rest: Rest) -> None:
        self.shelves[self.tiers[bisect_left(self.tiers, rest.length)]].add(rest)

    def pack(self, last: bool) -> None:
        """Packs all tiers from the longest; unfilled windows of the shortest tier wait for more
        documents unless these were the last."""
        for tier in reversed(self.tiers):
            for window in self._best_fit(tier):
                self._fill(tier, window, last)
        self.held = sum(map(len, self.shelves.values()))

    def _best_fit(self, tier: int) -> list[list[Rest]]:
        shelf = self.shelves[tier]
        windows: list[list[Rest]] = []
        rooms: list[tuple[int, int]] = []
        while (rest := shelf.take(tier)) is not None:
            at = bisect_left(rooms, (rest.length, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
                windows[k].append(rest)
            else:
                room, k = tier, len(windows)
                windows.append([rest])
            if room > rest.length:
                insort(rooms, (room - rest.length, k))
        return windows

    def _fill(self, tier: int, window: list[Rest], last: bool) -> None:
        room = tier - sum(r.length for r in window)
        below = [t for t in reversed(self.tiers) if t < tier]
        for shorter in below:
            while room and (rest := self.shelves[shorter].take(room)) is not None:
                window.append(rest)
                room -= rest.length
        if room:
            source = next((t for t in reversed(below) if self.shelves[t].tokens), None)
            if source is not None:
                piece, rest = self.shelves[source].take(source).cut(room)
                window.append(piece)
                self._shelve(rest)
                room = 0
        if not room:
            self.done.append((tier, window))
        elif last or tier > self.tiers[0]:
            self._powers(window)
        else:
            for rest in window:
                self._shelve(rest)

    def _powers(self, window: list[Rest]) -> None:
        """An unfilled window as full sequences of falling powers of two."""
        left = sum(r.length for r in window)
        rests = window[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out: list[Rest] = []
            while size:
                rest = rests.pop()
                if rest.length > size:
                    rest, more = rest.cut(size)
                    rests.append(more)
                out.append(rest)
                size -= rest.length
            self.done.append((sum(r.length for r in out), out))


class StepGroups:
    """Deals full sequences of a tier to steps of ``tokens`` tokens; the costliest go first, each
    to the step with the least attention cost that has room."""

    def __init__(self, tokens: int, rounds: int = 8):
        self.tokens, self.rounds = tokens, rounds
        self.waiting: dict[int, list] = {}
        self.number = 0

    def add(self, tier: int, sequence, cost: int) -> Iterator[tuple[int, object]]:
        waiting = self.waiting.setdefault(tier, [])
        waiting.append((cost, sequence))
        if len(waiting) >= self.rounds * max(1, self.tokens // tier):
            yield from self._deal(tier)

    def _deal(self, tier: int) -> Iterator[tuple[int, object]]:
        waiting = self.waiting.pop(tier)
        each = max(1, self.tokens // tier)
        steps = -(-len(waiting) // each)
        loads = [(0, self.number + k, 0) for k in range(steps)]
        self.number += steps
        for cost, sequence in sorted(waiting, key=lambda x: -x[0]):
            load, step, used = heapq.heappop(loads)
            yield step, sequence
            if used + 1 < each:
                heapq.heappush(loads, (load + cost, step, used + 1))

    def rest(self) -> Iterator[tuple[int, object]]:
        for tier in sorted(self.waiting):
            yield from self._deal(tier)


_SCHEMA = pa.schema(
    [
        (name, pa.int32() if kind == "int" else pa.int64())
        for name, kind in (x.strip().split() for x in PIECES.split(","))
    ]
)


def _pack(tokenizer: str, end_id: int, tiers: tuple[int, ...], pool: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        encode_text = encoder(tokenizer).encode
        end = struct.pack("<I", end_id)
        packer, groups = Packer(tiers, pool), StepGroups(step_tokens)
        sequences = 0

        def described() -> Iterator[tuple[int, list]]:
            nonlocal sequences
            for tier, pieces in packer.done:
                rows, offset = [], 0
                for p in pieces:
                    rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, base + sequences, offset, tier))
                    offset += p.length
                sequences += 1
                yield from groups.add(tier, rows, sum(p.length**2 for p in pieces))
            packer.done.clear()

        def batch_of(dealt) -> pa.RecordBatch:
            rows = [(*row, base + step) for step, sequence in dealt for row in sequence]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
            )

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add_document(name, encode_text(text.as_py()) + end)
            yield batch_of(described())
        packer.pack(last=True)
        yield batch_of(described())
        yield batch_of(groups.rest())

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    pool: int = 4096,
    step_tokens: int = 65_536,
) -> DataFrame:
    """One row per piece: document, start in it, length, CRC-32 of the ids (unsigned 32-bit,
    little-endian), tokens of the document with its end id, sequence, offset there, tier (the
    length of the sequence) and step group.

    Null texts are empty: the document is its end id. Rows with the same id are packed each by
    itself, in the order in which Spark reads them; rows without an id keep a null id. Memory is
    bounded by ``pool`` waiting rests and one document. All sequences are full: their lengths are
    the tiers, or powers of two for the last few of an input split. An empty table gives no rows.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_arrow(rows, _pack(tokenizer, end_id, tuple(tiers), pool, step_tokens), PIECES)
