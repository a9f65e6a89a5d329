"""Repeated passages, cut out of the text so that the earliest ranked occurrence stays.

A text is read as normalised words (lower case, parted by white space). Its units are runs of 25
words that its content chooses (the least hash of every 25 neighbours), so a passage has the same
units wherever it stands: in a line, across line ends, with or without punctuation. Lines can't do
that. Unit digests are grouped over the whole table; a unit that is not the first of its digest is
an anchor. Anchors that follow one another at one distance from their first occurrences are a
stretch of equal words; it is extended word by word on both sides in the two texts.

A stretch of 50 words is a repeat. Where the words around an anchor have their earliest occurrence
elsewhere than the anchor itself, stretches can be shorter than the repeat they lie in; so windows
of 50 words around the ends of the stretches are hashed and grouped too. Together they find every
window of 50 words that occurs earlier, and nothing else is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.joins import HOT_SHARE, join_counted
from tallyguard.llm.workers import map_arrow
from tallyguard.session import written

LEAST_WORDS = 50

_OTHER_SPACE = "\t\r\n\f\v"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_CHUNK_BYTES = 1 << 20

_ANCHORS = "doc_id long, place long, rank long, pos int, digest long, distance int, deep boolean"
_FOUND = (
    "doc_id long, place long, rank long, side string, pos int, start long, end long, words array<long>, edges array<int>, "
    "first_hash long, second_hash long, run long, o_place long, o_pos int, copies long"
)
_FOUND_NAMES = [field.split(" ")[0] for field in _FOUND.split(", ")]
_LONG, _INT = pa.int64(), pa.int32()
_KINDS = [pa.string(), _INT, _LONG, _LONG, pa.list_(_LONG), pa.list_(_INT), _LONG, _LONG, _LONG, _LONG, _INT, _LONG]


class Words:
    """Words of some texts: hash of every word, and where it starts and ends (code points)."""

    def __init__(self, texts: list[str]):
        flat = pa.array(texts, pa.large_string())
        for space in _OTHER_SPACE:
            flat = pc.replace_substring(flat, space, " ")
        split = pc.split_pattern(flat, " ")
        counts = pc.list_value_length(split).to_numpy()
        encoded = pc.dictionary_encode(pc.list_flatten(split))
        # No word holds a space, so all are lower-cased in one text.
        names = " ".join(encoded.dictionary.to_numpy(zero_copy_only=False)).lower().split(" ")
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        sizes = pc.utf8_length(encoded.dictionary).to_numpy()
        ids = encoded.indices.to_numpy()
        lengths = sizes[ids]
        ends = np.cumsum(lengths + 1) - 1
        of_text = np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        base = np.zeros(len(texts), dtype=np.int64)
        base[counts > 0] = (ends - lengths)[first[counts > 0]]
        ends -= base[of_text]
        real = lengths > 0
        self.hashes, self.ends = hashes[ids[real]], ends[real]
        self.starts = self.ends - lengths[real]
        self.borders = np.searchsorted(of_text[real], np.arange(len(texts) + 1))

    def of(self, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.borders[text], self.borders[text + 1])
        return self.hashes[part], self.starts[part], self.ends[part]


def run_hashes(hashes: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` words, put together from runs of 1, 2, 4, ... words."""
    n = max(0, len(hashes) - size + 1)
    out, done, width = None, 0, 1
    part = hashes
    while True:
        if size & width:
            block = part[done : done + n]
            out = block if out is None else _followed(out, block, width, kind)
            done += width
        if done == size:
            return (out ^ (out >> np.uint64(29))) * _MIX[1 - kind]
        part = _followed(part[: max(0, len(part) - width)], part[width:], width, kind)
        width *= 2


def _followed(first: np.ndarray, second: np.ndarray, width: int, kind: int) -> np.ndarray:
    """Hashes of runs and the runs of ``width`` words after them."""
    out = (first ^ (first >> np.uint64(31))) * (_MIX[kind] + np.uint64(2 * width)) + second
    return out ^ (out >> np.uint64(27))


def last_minima(values: np.ndarray, size: int) -> np.ndarray:
    """For every run of ``size`` values the place of its least one, the last of equal ones."""
    least, place, width = values, np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        left, right = least[: max(0, len(least) - step)], least[step:]
        later = right <= left
        least = np.where(later, right, left)
        place = np.where(later, place[step:], place[: len(left)])
        width += step
    return place


def anchors_of(words: Words, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and digest of the units of all texts. Every run of ``least_words`` - 1 words
    of a text holds one, and neighbours are at most their size apart."""
    size = least_words // 2
    units = run_hashes(words.hashes, size)
    reach = 2 * size - 1
    n = max(0, len(words.hashes) - reach + 1)
    of_text = np.repeat(np.arange(len(words.borders) - 1), np.diff(words.borders))
    # Runs that don't cross from one text to the next.
    starts = np.flatnonzero(of_text[:n] == of_text[reach - 1 : reach - 1 + n])
    chosen = np.zeros(len(units), dtype=bool)
    chosen[last_minima(units, size)[starts]] = True
    found = np.flatnonzero(chosen)
    text = of_text[found]
    return text, found - words.borders[text], units[found]


def nearest_before(
    text: np.ndarray, position: np.ndarray, digest: np.ndarray, least_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """For units in the order of texts and positions: how far the last unit with the same digest lies
    before in the same text (0: none), and whether a unit lies deep in a stretch at one distance, so
    that all windows around it lie there too."""
    size = least_words // 2
    order = np.lexsort((position, digest, text))
    distance = np.zeros(len(text), dtype=np.int64)
    same = (np.diff(text[order]) == 0) & (digest[order][1:] == digest[order][:-1])
    distance[order[1:][same]] = np.diff(position[order])[same]
    joined = (np.diff(text) == 0) & (np.diff(distance) == 0) & (distance[1:] > 0) & (np.diff(position) <= size)
    run = np.concatenate([[0], np.cumsum(~joined)]) if len(text) else np.zeros(0, dtype=np.int64)
    first = np.searchsorted(run, run)
    last = np.searchsorted(run, run, "right") - 1
    inside = (position - position[first] >= least_words) & (position[last] - position >= least_words)
    return distance, inside & (distance > 0)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Parts of the batches, of about a megabyte of text at least a row, with their words."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), Words(texts[at : i + 1])
                at, size = i + 1, 0


def _find_anchors(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches, 3):
            text, position, digest = anchors_of(words, least_words)
            distance, deep = nearest_before(text, position, digest, least_words)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i).take(row) for i in range(3)),
                    pa.array(position.astype(np.int32)),
                    pa.array(digest.view(np.int64)),
                    pa.array(distance.astype(np.int32)),
                    pa.array(deep),
                ],
                names=["doc_id", "place", "rank", "pos", "digest", "distance", "deep"],
            )

    return run


def _lists(values: np.ndarray, first: np.ndarray, step: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """For every row ``counts`` values from ``first`` on, to the right or (step -1) to the left."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    at = np.repeat(first, counts) + np.repeat(step, counts) * nth
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[at]))


def beside(words: Words, text: np.ndarray, at: np.ndarray, left: np.ndarray, size: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Up to ``size`` words on one side of borders in the texts, the nearest first, and the text
    offsets that a passage up to the border has with 0, 1, ... of them."""
    border = words.borders[text] + at
    counts = np.minimum(size, np.where(left, at, words.borders[text + 1] - border))
    step = np.where(left, -1, 1)
    near = _lists(words.hashes.view(np.int64), border - left, step, counts)
    # Starts of the words from the border to the left, or ends from the word before it to the right.
    limits = np.concatenate([words.starts, words.ends]).astype(np.int32)
    return near, _lists(limits, np.where(left, border, len(words.starts) + border - 1), step, counts + 1)


def in_ranges(words: Words, text: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Places, among the words of all texts, of the windows of ``size`` words that begin at the words
    ``low`` to ``high`` of the texts; each once, and none crosses the end of its text."""
    first, end = words.borders[text], words.borders[text + 1]
    low, high = first + np.maximum(low, 0), np.minimum(first + high, end - size)
    some = low <= high
    cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(cover, low[some], 1)
    np.add.at(cover, high[some] + 1, -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def _look_up(least_words: int):
    """Answers what is asked of each text: words beside a border, or windows of a range."""
    lead = least_words - least_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches, 3):
            asked = part.column(4)
            text = pc.list_parent_indices(asked).to_numpy().astype(np.int64)
            side, low, high, *others = pc.list_flatten(asked).flatten()
            low, high = (c.to_numpy().astype(np.int64) for c in (low, high))
            window, left = (pc.equal(side, name).to_numpy(zero_copy_only=False) for name in ("window", "left"))
            origin = pc.starts_with(side, "o_").to_numpy(zero_copy_only=False)
            left |= pc.equal(side, "o_left").to_numpy(zero_copy_only=False)

            def batch(of: np.ndarray, *columns):
                row = pa.array(of)
                # What the other kind of row has.
                filled = [pa.nulls(len(of), kind) if c is None else pa.array(c) for c, kind in zip(columns, _KINDS, strict=True)]
                return pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(3)), *filled], names=_FOUND_NAMES)

            at = in_ranges(words, text[window], low[window], high[window], least_words)
            if len(at):
                of = np.searchsorted(words.borders, at, "right") - 1
                hashes = [run_hashes(words.hashes, least_words, kind)[at].view(np.int64) for kind in (0, 1)]
                yield batch(
                    of, pa.repeat("window", len(at)), (at - words.borders[of]).astype(np.int32),
                    words.starts[at], words.ends[at + least_words - 1], None, None, *hashes, None, None, None, None,
                )
            for ends in (np.flatnonzero(~window & ~origin), np.flatnonzero(origin)):
                if len(ends):
                    near, edges = beside(words, text[ends], low[ends], left[ends], lead)
                    take = pa.array(ends)
                    yield batch(
                        text[ends], side.take(take), low[ends].astype(np.int32), None, None, near,
                        None if origin[ends[0]] else edges, None, None, *(c.take(take) for c in others),
                    )

    return run


def _equal_words(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise((differs - 1).cast("int"))


def _first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a written table that have an earlier one with the same keys, and that one in ``first``.

    The rows are shuffled once. Keys of which a thousandth of all rows may have the first stay out of
    the shuffle: their earliest rows are found by an aggregate and broadcast. A sketch of fixed
    size tells which; what it says decides only the way, not the rows.
    """
    order = F.struct("rank", "doc_id", "place", "pos")
    often = F.expr(f"approx_top_k({keys[0]}, {HOT_SHARE}, {10 * HOT_SHARE})").alias("often")
    counted = rows.agg(often, F.count("*").alias("total"))
    hot = counted.select("total", F.inline("often")).where(F.col("count") * HOT_SHARE >= F.col("total"))
    hot = [row["item"] for row in hot.select("item").collect()]
    rest, found = rows, None
    if hot:
        # As many rows as the frequent keys, or windows that share one of their hashes.
        earliest = rows.where(F.col(keys[0]).isin(hot)).groupBy(*keys).agg(F.min(order).alias("first"))
        marked = rows.join(F.broadcast(earliest), keys, "left")
        found = marked.where(order > F.col("first"))
        rest = marked.where(F.col("first").isNull()).drop("first")
    later = rest.withColumn("first", F.min(order).over(Window.partitionBy(*keys))).where(order > F.col("first"))
    return later if found is None else later.unionByName(found)


def _stretches(anchors: DataFrame, size: int) -> DataFrame:
    """Runs of anchors at one distance from an origin: place, first and last word (end exclusive), and
    place and distance of the origin. An anchor has two origins: the first occurrence of all, and
    the last one before it in its own text. Text that repeats itself is one stretch of the second
    kind, and the anchors deep inside it need no other origin."""
    shallow = anchors.where(~F.col("deep")).drop("deep")
    delta = F.col("pos") - F.col("first.pos")
    not_own = (F.col("first.place") != F.col("place")) | (delta != F.col("distance"))
    later = _first_of(shallow, ["digest"]).where(not_own).select(
        "doc_id", "place", "rank", "pos", F.col("first.place").alias("o_place"), delta.alias("delta"),
        F.col("first.doc_id").alias("kept_doc_id"),
    )
    own = anchors.where("distance > 0").select(
        "doc_id", "place", "rank", "pos", F.col("place").alias("o_place"), F.col("distance").alias("delta"),
        F.col("doc_id").alias("kept_doc_id"),
    )
    later = later.union(own)
    in_doc = Window.partitionBy("place").orderBy("o_place", "delta", "pos")
    before = F.lag(F.struct("o_place", "delta", "pos")).over(in_doc)
    joins = (before["o_place"] == F.col("o_place")) & (before["delta"] == F.col("delta")) & (F.col("pos") - before["pos"] <= size)
    cut = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    numbered = later.withColumn("cut", cut).withColumn("run", F.sum("cut").over(in_doc))
    return numbered.groupBy("place", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("rank").alias("rank"),
        F.min("pos").alias("low"),
        (F.max("pos") + size).alias("high"),
        F.first("o_place").alias("o_place"),
        F.first("delta").alias("delta"),
        F.first("kept_doc_id").alias("kept_doc_id"),
    )


def _looked_up(runs: DataFrame, docs: DataFrame, least_words: int, size: int) -> DataFrame:
    """What the texts say about the ends of the stretches: the words beside them, in the document and
    in its origin, and the windows around them, without those inside a long stretch. The texts
    are joined once."""
    low, high, lead = F.col("low"), F.col("high"), least_words - size
    o_low, o_high = low - F.col("delta"), high - F.col("delta")
    around = F.when(high - low < least_words, F.array(_want("window", low - lead, high - size))).otherwise(
        F.array(_want("window", low - lead, low - 1), _want("window", high - least_words + 1, high - size))
    )
    run = {"run": F.col("run"), "o_place": F.col("o_place")}
    ends = F.array(_want("left", low, low, **run, o_pos=o_low), _want("right", high, high, **run, o_pos=o_high))
    mine = runs.select("place", F.inline(F.concat(ends, around)))
    # A border of an origin is told once, with the number of stretches that wait for it.
    borders = F.array(
        *[F.struct(F.lit(f"o_{side}").alias("side"), at.cast("int").alias("low")) for side, at in (("left", o_low), ("right", o_high))]
    )
    theirs = runs.select(F.col("o_place").alias("place"), F.inline(borders)).groupBy("place", "side", "low").agg(F.count("*").alias("copies"))
    theirs = theirs.select("place", F.inline(F.array(_want(F.col("side"), F.col("low"), F.col("low"), copies=F.col("copies")))))
    asked = mine.union(theirs)
    # A document has a few wants for each of its units, so its list is no longer than its text.
    per_doc = asked.groupBy("place").agg(F.collect_list(F.struct(*asked.columns[1:])).alias("asked"))
    told = docs.join(per_doc, "place").select("doc_id", "place", "rank", "text", "asked")
    return written(map_arrow(told, _look_up(least_words), _FOUND), "looked-up", "zstd")


_OTHERS = {"run": "long", "o_place": "long", "o_pos": "int", "copies": "long"}


def _want(side: str | Column, low: Column, high: Column, **others: Column) -> Column:
    side = F.lit(side) if isinstance(side, str) else side
    more = [others.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _OTHERS.items()]
    return F.struct(side.alias("side"), low.cast("int").alias("low"), high.cast("int").alias("high"), *more)


def _extended(found: DataFrame) -> DataFrame:
    """The stretches with the equal words beside them, and their offsets in the text."""
    left = F.col("side") == "left"
    own = found.where(F.col("side").isin("left", "right")).select(
        "place", "run", "side", "pos", "doc_id", F.col("words").alias("own_words"), "edges",
        F.struct(F.col("o_place").alias("place"), "side", F.col("o_pos").alias("pos")).alias("o_key"),
    )
    origin = found.where(F.col("side").startswith("o_")).select(
        F.struct("place", F.substring("side", 3, 5).alias("side"), "pos").alias("o_key"),
        F.col("doc_id").alias("kept_doc_id"), F.col("words").alias("o_words"), "copies",
    )
    both = join_counted(own, origin, "o_key", "copies").drop("o_key", "copies")
    more, edge = F.col("more"), F.get("edges", "more").cast("long")
    grown = both.withColumn("more", _equal_words(F.col("own_words"), F.col("o_words"))).select(
        "place", "run", "doc_id", "kept_doc_id",
        F.when(left, F.col("pos") - more).alias("low"),
        F.when(~left, F.col("pos") + more).alias("high"),
        F.when(left, edge).alias("start"),
        F.when(~left, edge).alias("end"),
    )
    return grown.groupBy("place", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("kept_doc_id").alias("kept_doc_id"),
        *[F.max(c).alias(c) for c in ("low", "high", "start", "end")],
    )


def _earlier_windows(found: DataFrame, least_words: int) -> DataFrame:
    """Windows around the ends of the stretches that occur earlier."""
    windows = found.where("side = 'window'").select(
        "doc_id", "place", "rank", "pos", "start", "end", "first_hash", "second_hash"
    )
    later = _first_of(windows, ["first_hash", "second_hash"])
    return later.select(
        "place", "doc_id", F.col("first.doc_id").alias("kept_doc_id"), F.col("pos").alias("low"),
        (F.col("pos") + least_words).alias("high"), "start", "end",
    )


def repeats(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_col: str | None = None,
    place_col: str | None = None,
) -> DataFrame:
    """One row per removed span: document, start and end in its text (code points, end exclusive),
    words, and a document that has an earlier occurrence of a part of it, the earliest where a whole
    stretch has one origin; ``place`` numbers the document's row. A word is in a span if a window of ``least_words`` words around it occurs
    earlier, in another document or in its own, also where the two overlap.

    Occurrences are ranked by the integer ``rank_col`` (the document id, unless given), then by id,
    then by ``place_col`` (a number of each row, no two alike; unless given, the order in which
    Spark reads the rows), then by place in the text; nulls come first. Null and empty texts, and
    those of fewer words, have no spans and are nobody's origin. Copies of whole rows are repeats
    like any other. An empty table gives no rows. Other columns are not read.
    """
    if least_words < 4:
        raise ValueError("a repeat has at least four words")
    size = least_words // 2
    place = F.col(place_col) if place_col else F.monotonically_increasing_id()
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        place.cast("long").alias("place"),
        F.col(rank_col or id_col).cast("long").alias("rank"),
        F.col(text_col).cast("string").alias("text"),
    )
    rows = written(rows, "texts", "zstd")
    anchors = written(map_arrow(rows, _find_anchors(least_words), _ANCHORS), "units", "zstd")
    runs = written(_stretches(anchors, size), "stretches")
    found = _looked_up(runs, rows, least_words, size)
    grown = written(_extended(found).where(F.col("high") - F.col("low") >= least_words), "grown")
    windows = _earlier_windows(found, least_words)
    grown = grown.select(windows.columns).withColumn("by_window", F.lit(False))
    spans = grown.union(windows.withColumn("by_window", F.lit(True)))

    in_doc = Window.partitionBy("place").orderBy("low", "high")
    reach = F.max("high").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(reach >= F.col("low"), F.lit(False)), 0).otherwise(1)
    merged = spans.withColumn("begins", begins).withColumn("span", F.sum("begins").over(in_doc))
    return merged.groupBy("place", "span").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("high") - F.min("low")).cast("long").alias("words"),
        F.min_by("kept_doc_id", F.struct("by_window", "low", "high", "kept_doc_id")).alias("kept_doc_id"),
    ).select("doc_id", "start", "end", "words", "kept_doc_id", "place")


_PLACE, _SPANS = "__place", "__removed"


def _cut(spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            spans_at = batch.schema.get_field_index(spans_name)
            texts = []
            for text, spans in zip(batch.column(column), batch.column(spans_at).to_pylist(), strict=True):
                text = text.as_py()
                if spans:
                    parts, at = [], 0
                    for start, end in sorted((s["start"], s["end"]) for s in spans):
                        whole_line = (start == 0 or text[start - 1] == "\n") and text[end : end + 1] == "\n"
                        parts.append(text[at:start])
                        at = end + whole_line
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield batch.set_column(column, batch.schema.field(column), pa.array(texts, pa.string()))

    return run


def _free_name(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def without_repeats(docs: DataFrame, **options: object) -> DataFrame:
    """The rows with the spans cut out of the string column ``text``, and with them the line end
    where whole lines go; all other columns stay. The rows are numbered and written first."""
    place, removed = _free_name(_PLACE, docs.columns), _free_name(_SPANS, docs.columns)
    numbered = written(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    found = repeats(numbered, place_col=place, **options)
    spans = found.groupBy(F.col("place").alias(place)).agg(F.collect_list(F.struct("start", "end")).alias(removed))
    joined = numbered.join(spans, place, "left")
    return map_arrow(joined, _cut(removed), joined.schema).drop(place, removed)


def oracle(table: str = "documents", least_words: int = LEAST_WORDS) -> str:
    """The spans from all windows of all texts, for tables whose document ids are all different."""
    return f"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\f\\r\\v]+|[ \\t\\n\\f\\r\\v]+') AS parts FROM {table}),
pieces AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM tokens),
placed AS (
  SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM pieces),
words AS (
  SELECT doc_id, lower(part) AS word, "end" - length(part) AS "start", "end",
    row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
  FROM placed WHERE part SIMILAR TO '[^ \\t\\n\\f\\r\\v]+'),
lists AS (
  SELECT doc_id, list(word ORDER BY pos) AS w, list("start" ORDER BY pos) AS s, list("end" ORDER BY pos) AS e
  FROM words GROUP BY doc_id HAVING count(*) >= {least_words}),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + {least_words}], ' ')) AS digest,
    s[pos + 1] AS "start", e[pos + {least_words}] AS "end"
  FROM lists, LATERAL (SELECT unnest(range(0, len(w) - {least_words} + 1)) AS pos)),
later AS (
  SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, pos) > 1),
marked AS (
  SELECT *, CASE WHEN pos <= lag(pos) OVER w + {least_words} THEN 0 ELSE 1 END AS begins
  FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
spans AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked)
SELECT doc_id, min("start")::BIGINT AS "start", max("end")::BIGINT AS "end", (max(pos) - min(pos) + {least_words})::BIGINT AS words
FROM spans GROUP BY doc_id, span
"""
