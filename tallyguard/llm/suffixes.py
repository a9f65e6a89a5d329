"""Benchmark decontamination with suffix arrays over shards of the training text.

Every batch of documents is a shard. Its words become numbers of the benchmark's vocabulary (0
for any other word, so no match runs over it), its suffixes are sorted, and each suffix of each
benchmark item is found by binary search. The ranges found give all places of a match; matches
at neighbouring suffixes of an item along the same diagonal make up the longest one.

The benchmark goes to the workers in blocks of bounded size; the documents pass block after
block without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.workers import map_arrow

WINDOW = 13
BLOCK_BYTES = 16_000_000

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, longest_match long, longest_start long, longest_item string"
)

_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and all characters from U+0080 on."""
    return text.translate(_TO_WORDS).split() if text else []


@dataclass
class Query:
    """A run of words to find: its words as numbers, and where the items have it."""

    words: tuple[int, ...]
    places: list[tuple[int, int]]


class Index:
    """The suffixes of a block of benchmark items, ready to be searched for."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW):
        self.window = window
        self.names: list[str] = []
        self.vocabulary: dict[bytes, int] = {}
        queries: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            item = len(self.names)
            self.names.append(name)
            for at in range(max(1, len(numbers) - window + 1)):
                queries[tuple(numbers[at : at + window])].append((item, at))
        self.queries = [Query(words, places) for words, places in sorted(queries.items())]
        self.shortest = min((len(q.words) for q in self.queries), default=window)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = 63 // self.bits
        self.levels = -(-window // self.per_key)
        self.bounds = [[self._bounds(q.words, level) for level in range(self.levels)] for q in self.queries]
        self.first_low = np.array([b[0][0] for b in self.bounds], dtype=np.int64)
        self.first_high = np.array([b[0][1] for b in self.bounds], dtype=np.int64)

    def _bounds(self, words: tuple[int, ...], level: int) -> tuple[int, int]:
        """The least and greatest key that a suffix beginning with the words has at a level."""
        low = high = 0
        for i in range(level * self.per_key, (level + 1) * self.per_key):
            known = i < len(words)
            low = low << self.bits | (words[i] if known else 0)
            high = high << self.bits | (words[i] if known else (1 << self.bits) - 1)
        return low, high

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))


class SuffixArray:
    """Sorted suffixes of a shard: all those long enough to hold a query."""

    def __init__(self, words: np.ndarray, index: Index):
        stops = np.append(np.flatnonzero(words == 0), len(words))
        places = np.flatnonzero(words)
        run = stops[np.searchsorted(stops, places)] - places
        places = places[run >= index.shortest]
        padded = np.concatenate([words, np.zeros(index.levels * index.per_key, dtype=np.int64)])
        keys = []
        for level in range(index.levels):
            key = np.zeros(len(places), dtype=np.int64)
            for i in range(level * index.per_key, (level + 1) * index.per_key):
                key = key << index.bits | padded[places + i]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        self.places = places[order]
        self.keys = [key[order] for key in keys]

    def find(self, index: Index) -> Iterator[tuple[Query, np.ndarray]]:
        """Each query that occurs, with all its places."""
        lows = np.searchsorted(self.keys[0], index.first_low, "left")
        highs = np.searchsorted(self.keys[0], index.first_high, "right")
        for q in np.flatnonzero(lows < highs):
            low, high = int(lows[q]), int(highs[q])
            for key, (least, most) in zip(self.keys[1:], index.bounds[q][1:], strict=True):
                part = key[low:high]
                low, high = low + int(np.searchsorted(part, least, "left")), low + int(np.searchsorted(part, most, "right"))
                if low >= high:
                    break
            if low < high:
                yield index.queries[q], self.places[low:high]


@dataclass
class Found:
    """What a shard holds of the benchmark: a mark for each word, items of each document, and the
    longest match of each document as (words, first word in the document, item)."""

    marks: np.ndarray
    items: list[set[str]]
    longest: list[tuple[int, int, str]]


def search(documents: list[np.ndarray], index: Index) -> Found:
    """All matches of the index in a shard; ``documents`` hold the numbers of their words."""
    n = len(documents)
    starts = np.cumsum([0] + [len(d) + 1 for d in documents])[:-1] if n else np.zeros(0, dtype=np.int64)
    zero = np.zeros(1, dtype=np.int64)
    words = np.concatenate([x for d in documents for x in (d, zero)]) if n else zero
    change = np.zeros(len(words) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    longest: list[tuple[int, int, str]] = [(0, 0, "")] * n
    diagonals: dict[tuple[int, int], list[int]] = defaultdict(list)
    lengths: dict[int, int] = {}
    for query, places in SuffixArray(words, index).find(index) if index.queries else ():
        np.add.at(change, places, 1)
        np.add.at(change, places + len(query.words), -1)
        for item, at in query.places:
            lengths[item] = min(index.window, len(query.words))
            for place in places.tolist():
                diagonals[item, place - at].append(place)
    for (item, _), places in diagonals.items():
        places.sort()
        name, first = index.names[item], places[0]
        for here, after in zip(places, [*places[1:], -1], strict=True):
            if after == here + 1:
                continue
            doc = int(np.searchsorted(starts, first, "right")) - 1
            items[doc].add(name)
            match = (here - first + lengths[item], first - int(starts[doc]), name)
            if (match[0], -match[1]) > (longest[doc][0], -longest[doc][1]):
                longest[doc] = match
            first = after
    return Found(np.cumsum(change[:-1]) > 0, items, longest)


_PASSED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.binary()),
        ("marks", pa.binary()),
        ("items", pa.list_(pa.string())),
        ("longest_match", pa.int64()),
        ("longest_start", pa.int64()),
        ("longest_item", pa.string()),
    ]
)
_PASSED_DDL = (
    "doc_id long, text binary, marks binary, items array<string>, longest_match long, longest_start long, longest_item string"
)
_DONE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("items", pa.list_(pa.string())),
        ("longest_match", pa.int64()),
        ("longest_start", pa.int64()),
        ("longest_item", pa.string()),
    ]
)


def _search(shared, last: bool, share_num: int, share_den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(1)
            documents = [index.numbers(words_of(t.as_py())) for t in texts]
            found = search(documents, index)
            rows, at = [], 0
            for i, (name, numbers) in enumerate(zip(batch.column(0).to_pylist(), documents, strict=True)):
                marks = found.marks[at : at + len(numbers)]
                at += len(numbers) + 1
                items, longest = found.items[i], found.longest[i]
                if (before := batch.column(2)[i].as_py()) is not None:
                    marks = marks | np.unpackbits(np.frombuffer(before, np.uint8), count=len(numbers)).astype(bool)
                    items = items | set(batch.column(3)[i].as_py())
                    old = (batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py())
                    longest = max(longest, old, key=lambda m: (m[0], -m[1]))
                items = sorted(items)
                if not last:
                    rows.append((name, texts[i].as_py(), np.packbits(marks).tobytes(), items, *longest))
                    continue
                hit = int(marks.sum())
                rows.append(
                    (
                        name,
                        len(numbers),
                        hit,
                        len(items),
                        hashlib.sha256(",".join(items).encode()).hexdigest(),
                        hit > 0 and share_den * hit >= share_num * len(numbers),
                        items,
                        *longest,
                    )
                )
            schema = _DONE if last else _PASSED
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    block: list[tuple[str, bytes | None]] = []
    size = 0
    for row in benchmark.toLocalIterator():
        block.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += len(row[1] or b"") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def benchmark_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    contaminated_from: tuple[int, int] = (1, 20),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: words, words hit by an occurrence of a window of an item, the items found,
    their SHA-256, whether the words hit are at least the given share, and the longest verbatim
    match of whole windows with its first word (0-based) and its item; ties go to the earlier place.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Null or empty
    texts have no words and are never contaminated; items without words, or without an id, match
    nothing. Equal items are all named. Rows with the same document id are judged each by itself.
    An empty benchmark contaminates nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_col).cast("string"), F.col(item_text_col).cast("string").cast("binary")
    ).where(F.col(item_col).isNotNull())
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
        F.lit(None).cast("binary").alias("marks"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("long").alias("longest_match"),
        F.lit(None).cast("long").alias("longest_start"),
        F.lit(None).cast("string").alias("longest_item"),
    )
    blocks = _blocks(items, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(Index(block, window))
        rows = map_arrow(
            rows, _search(shared, after is None, *contaminated_from), RESULT if after is None else _PASSED_DDL
        )
        block = after
    return rows
