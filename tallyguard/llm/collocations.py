"""Frequent phrases and collocations by Toivonen's method.

A bounded sample proposes frequent phrases at a lowered threshold. One pass over all documents
counts exactly what was proposed and its negative border: the phrases that were not proposed
although all their parts were. A border phrase that turns out frequent may have frequent
extensions that nobody counted; passes for those follow until no border phrase is new.

A phrase is counted if its two longest parts are known, which Bloom filters of a fixed size
answer. A filter may say yes wrongly: then a phrase is counted for nothing, and dropped by its
count. It never says no wrongly, so no frequent phrase is lost, however large the tables are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.llm.joins import join_counted
from tallyguard.llm.workers import map_arrow
from tallyguard.session import written

MOST_WORDS = 3
LEAST_COUNT = 10
PER_LANG = 2000
COVERED = 50
MILLION = 1_000_000
NO_LANG = "und"

# What ends a piece, and what parts words in it.
PIECE_END = "[.,;:!?\n-\r]"
_OTHER_ENDS = ".,;:!?\v\f\r"
WORD_GAP = "[ \t]"

SAMPLE_BYTES = 24 << 20
SAMPLE_SEED = 11
# Of the count expected in the sample, so that few frequent phrases are missed.
SAMPLE_SLACK = 0.5
FILTER_BITS = 25
PART_BYTES = 1 << 19
SALTS = 32
COUNTS = "words int, lang string, phrase string, n long"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def joined_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of what comes first and the last word; order counts."""
    return _mixed(first * _TURN + second)


def word_hashes(words: list[bytes] | list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def phrase_hash(lang: str, phrase: str) -> int:
    """The hash that ``count`` gives to a phrase of a language."""
    words = phrase.encode().split(b" ")
    seed = word_hashes([lang.encode()])
    hashes = [_mixed(word_hashes([w]) ^ seed) for w in words]
    out = hashes[0]
    for h in hashes[1:]:
        out = joined_hashes(out, h)
    return int(out[0])


class Filter:
    """A Bloom filter of phrases with a given number of words; its table has 2^bits bits."""

    def __init__(self, words: np.ndarray):
        self._words = words
        self._bits = len(words).bit_length() + 5

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        mask = np.uint64((1 << bits) - 1)
        return [(hashes >> np.uint64(shift)) & mask for shift in (0, 19, 38)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for place in self.places(hashes, self._bits):
            word = self._words[(place >> np.uint64(6)).astype(np.int64)]
            found &= (word >> (place & np.uint64(63))) & np.uint64(1) != 0
        return found


def _set_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [phrase_hash(a, b) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            place = np.concatenate(Filter.places(np.array(hashes, dtype=np.uint64), bits))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((place >> np.uint64(6)).astype(np.int32)),
                    pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64)),
                ],
                names=["word", "bits"],
            )

    return run


def build_filter(phrases: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of the phrases in (lang, phrase). At most 2^(bits - 6) numbers come to the driver."""
    set_bits = map_arrow(phrases.select("lang", "phrase"), _set_bits(bits), "word int, bits long")
    rows = set_bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words)


# Counting


_GAPS = re.compile(WORD_GAP + "+")
_ENDS = re.compile(PIECE_END)


def parts_of(text: str, most_words: int, size: int = PART_BYTES) -> Iterator[tuple[str, int]]:
    """Parts of a long text and the number of words at each part's end that only complete phrases
    begun before them; those words begin the next part. A part ends at the end of a piece
    where there is one, else at a gap between words."""
    at = 0
    while len(text) - at > size:
        ends = [m.start() for m in _ENDS.finditer(text, at + size // 2, at + size)]
        if ends:
            yield text[at : ends[-1]], 0
            at = ends[-1] + 1
            continue
        gap = _GAPS.search(text, at + size)
        end = _ENDS.search(text, at + size, gap.start() if gap else len(text))
        if end:
            yield text[at : end.start()], 0
            at = end.end()
            continue
        if gap is None:
            break
        look = gap.end()
        words = 0
        while words < most_words - 1 and look < len(text) and not _ENDS.match(text, look):
            after = re.compile("[ \t.,;:!?\n-\r]").search(text, look)
            stop = after.start() if after else len(text)
            words += 1
            look = stop
            gaps = _GAPS.match(text, look)
            look = gaps.end() if gaps else look
        yield text[at:look], words
        at = gap.end()
    yield text[at:], 0


def _chunks(batches: Iterator[pa.RecordBatch], most_words: int):
    """Lists of (language, text, words at the end that begin nothing) of bounded size."""
    held: list[tuple[str, str, int]] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            lang = lang.as_py()
            for part, rest in parts_of(text, most_words) if len(text) > PART_BYTES else ((text, 0),):
                held.append((lang, part, rest))
                size += len(part)
                if size >= PART_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _tokens(chunk: list[tuple[str, str, int]]):
    """Word numbers of a chunk in one row, -1 where a piece ends, their languages and whether a
    phrase may begin there; the words; the languages."""
    langs = sorted({lang for lang, _, _ in chunk})
    number = {lang: i for i, lang in enumerate(langs)}
    texts = pa.array([text for _, text, _ in chunk], pa.large_string())
    texts = pc.ascii_lower(texts)
    for end in _OTHER_ENDS:
        texts = pc.replace_substring(texts, end, "\n")
    texts = pc.replace_substring(texts, "\n", " \n ")
    texts = pc.replace_substring(texts, "\t", " ")
    large = pa.large_string()
    texts = pc.binary_join_element_wise(texts, pa.scalar(" \n", large), pa.scalar("", large))
    split = pc.split_pattern(texts, " ")
    lengths = pc.list_value_length(split).to_numpy()
    of_text = np.repeat(np.arange(len(chunk)), lengths)
    encoded = pc.dictionary_encode(pc.list_flatten(split))
    words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = encoded.indices.to_numpy().astype(np.int64)
    empty = words.index("") if "" in words else -1
    border = words.index("\n")
    keep = ids != empty
    ids, of_text = ids[keep], of_text[keep]
    ids[ids == border] = -1
    begins = ids >= 0
    rests = [(i, rest) for i, (_, _, rest) in enumerate(chunk) if rest]
    for i, rest in rests:
        last = int(np.searchsorted(of_text, i, "right")) - 1
        begins[last - rest : last] = False
    of_lang = np.array([number[lang] for lang, _, _ in chunk], dtype=np.int64)[of_text]
    return ids, of_lang, begins, words, langs


def _alike(at: np.ndarray, length: int, ids: np.ndarray, of_lang: np.ndarray, n_words: int):
    """One of the places of every phrase that begins at the places, and how many begin with it."""
    columns = [of_lang[at], *(ids[at + i] for i in range(length))]
    bits = n_words.bit_length()
    if int(columns[0].max()).bit_length() + length * bits > 62:
        code = columns[0]
        for column in columns[1:]:
            code = np.unique(code, return_inverse=True)[1] * n_words + column
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        return [c[first] for c in columns], counts
    # Sorted numbers that hold all parts of a phrase need no places beside them.
    code = columns[0]
    for column in columns[1:]:
        code = (code << bits) | column
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    counts = np.diff(np.append(first, len(code)))
    code, parts = code[first], []
    for _ in range(length):
        parts.append(code & ((1 << bits) - 1))
        code = code >> bits
    return [code, *reversed(parts)], counts


def _held_at(where: np.ndarray, hashes: np.ndarray, held: Filter) -> np.ndarray:
    """Whether the filter holds the phrases at the marked places."""
    out = np.zeros(len(where), dtype=bool)
    at = np.flatnonzero(where)
    out[at] = held.holds(hashes[at])
    return out


def _count_chunk(chunk, most_words: int, known: list[Filter] | None, before: list[Filter] | None):
    """(words, languages, phrases, counts) of the phrases of a chunk that are to be counted."""
    ids, of_lang, begins, words, langs = _tokens(chunk)
    names = pa.array(words, pa.large_string())
    lang_names = pa.array(langs, pa.string())
    seeds = word_hashes(langs)
    hashes = _mixed(word_hashes(words)[np.maximum(ids, 0)] ^ seeds[of_lang])
    # For the present length: places where a phrase begins that may be counted, its hash, and whether
    # it was counted with the filters ``before``.
    phrase = ids >= 0
    phrase_hashes = hashes
    old = np.full(len(ids), before is not None)
    if before is None:
        occurrences = np.bincount(of_lang[begins], minlength=len(langs))
        yield (
            pa.array(np.zeros(len(langs), dtype=np.int32)),
            lang_names,
            pa.nulls(len(langs), pa.string()),
            pa.array(occurrences.astype(np.int64)),
        )
    for length in range(1, most_words + 1):
        new = np.flatnonzero(phrase & begins[: len(phrase)] & ~old)
        if len(new):
            (lang, *parts), counts = _alike(new, length, ids, of_lang, len(words))
            texts = [names.take(pa.array(part)) for part in parts]
            text = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string()))
            yield (
                pa.array(np.full(len(counts), length, dtype=np.int32)),
                lang_names.take(pa.array(lang)),
                text.cast(pa.string()),
                pa.array(counts.astype(np.int64)),
            )
        if length == most_words:
            return
        # A longer phrase is this one and the next word; its other longest part begins one later.
        good = phrase if known is None else _held_at(phrase, phrase_hashes, known[length - 1])
        if before is not None:
            was = _held_at(old & good, phrase_hashes, before[length - 1])
            old = was[:-1] & was[1:]
        else:
            old = old[1:]
        phrase = good[:-1] & good[1:]
        phrase_hashes = joined_hashes(phrase_hashes[:-1], hashes[length:])


def _counts(most_words: int, known: list[Filter] | None, before: list[Filter] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most_words):
            for columns in _count_chunk(chunk, most_words, known, before):
                yield pa.RecordBatch.from_arrays(list(columns), names=["words", "lang", "phrase", "n"])

    return run


def count_phrases(
    texts: DataFrame,
    most_words: int,
    known: list[Filter] | None = None,
    before: list[Filter] | None = None,
) -> DataFrame:
    """Exact counts of the phrases of (lang, text) whose two longest parts ``known`` holds, by the
    filter of their length; without filters, of all. Left out is what the same rule with the
    filters ``before`` had counted. Phrases are counted in each part of the input first, so a
    frequent one is a few rows in the shuffle. Without ``before`` there is a row of no words and no
    phrase for every language, with its word occurrences."""
    rows = map_arrow(texts, _counts(most_words, known, before), COUNTS)
    return rows.groupBy("words", "lang", "phrase").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.lit(None) if lang_col is None else F.col(lang_col)
    return docs.select(
        F.coalesce(lang.cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text")
    )


def _filters(phrases: DataFrame, most_words: int, bits: int) -> list[Filter]:
    return [build_filter(phrases.where(F.col("words") == length), bits) for length in range(1, most_words)]


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    most_words: int = MOST_WORDS,
    least_count: int = LEAST_COUNT,
    sample_bytes: int = SAMPLE_BYTES,
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """All phrases (words, lang, phrase, n) that occur ``least_count`` times or more, and the number
    of word occurrences of every language (lang, total), both exact and written.

    The sample is a share of the rows that holds about ``sample_bytes`` bytes. It decides only
    how much the first pass counts; the passes end when no phrase that was counted is both
    frequent and unknown to the filters they used, so at most ``most_words`` are needed.
    """
    texts = _texts(docs, text_col, lang_col)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = min(1.0, sample_bytes / max(size, 1))
    lowered = max(2, int(SAMPLE_SLACK * least_count * share))
    sample = texts if share == 1.0 else texts.sample(False, share, SAMPLE_SEED)
    proposed = written(
        count_phrases(sample, most_words - 1).where((F.col("words") > 0) & (F.col("n") >= lowered)), "proposed"
    )
    known = _filters(proposed, most_words, filter_bits)
    enough = (F.col("words") == 0) | (F.col("n") >= least_count)
    counted = written(count_phrases(texts, most_words, known).where(enough), "counted")
    totals = counted.where("words = 0").select("lang", F.col("n").alias("total"))
    frequent = counted.where("words > 0")
    news = frequent.where(F.col("words") < most_words).join(proposed, ["words", "lang", "phrase"], "left_anti")
    while not news.isEmpty():
        # The border failed: phrases frequent in all that the sample didn't propose.
        names = ["words", "lang", "phrase"]
        wider = _filters(proposed.select(names).union(frequent.select(names)), most_words, filter_bits)
        more = written(count_phrases(texts, most_words, wider, known).where(F.col("n") >= least_count), "counted")
        frequent = frequent.unionByName(more)
        news = more.where(F.col("words") < most_words)
        known = wider
    return frequent, totals


# Collocations


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)) in whole numbers; exact for counts of up to 14 digits."""
    a, left, right = (c.cast("decimal(14,0)") for c in (a, left, right))
    product = (a * a).cast("decimal(28,0)") * F.lit(MILLION).cast("decimal(7,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (left * right).cast("decimal(28,0)"))


def _with_count(rows: DataFrame, part: str, singles: DataFrame, name: str) -> DataFrame:
    """The rows with the count of the phrase in ``part``, whose text begins with its language."""
    copies = rows.groupBy(part).agg(F.count("*").alias("copies"))
    table = written(copies.join(singles.select(F.col("key").alias(part), F.col("n").alias(name)), part), "parts")
    return join_counted(rows, table, part, "copies").drop("copies")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    most_words: int = MOST_WORDS,
    least_count: int = LEAST_COUNT,
    per_lang: int = PER_LANG,
    covered: int = COVERED,
    sample_bytes: int = SAMPLE_BYTES,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The first ``per_lang`` phrases of every language by score: rank, phrase, its count ``a``,
    the counts ``l`` and ``r`` of its two parts at the cut with the lowest score (the first of
    equal ones), the language's words ``n``, and the score.

    A-Z are lower-cased; phrases don't cross ``. , ; : ! ?`` or line ends. Phrases inside a longer
    candidate that has at least ``covered`` percent of their count are left out. Null texts are
    empty, rows without a language are of ``und``; rows that repeat count each time; ties go to
    the smaller phrase in byte order. A language with no candidate, and an empty table, give no
    rows. Other columns are not read.
    """
    frequent, totals = frequent_phrases(
        docs, text_col, lang_col, most_words, least_count, sample_bytes, filter_bits
    )
    # No language or word holds a space or line end inside a key: the length of the language's
    # name goes first, so two languages never share a key.
    lang_key = F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.lit("\n"))
    keyed = written(frequent.withColumn("key", F.concat(lang_key, "phrase")), "frequent")
    candidates = keyed.where("words > 1")
    pieces = F.split("phrase", " ")
    cuts = candidates.select(
        "words", "lang", "phrase", F.col("n").alias("a"), lang_key.alias("lang_key"), pieces.alias("pieces"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    )
    cuts = cuts.select(
        "words", "lang", "phrase", "a", "k",
        F.concat("lang_key", F.array_join(F.slice("pieces", F.lit(1), F.col("k")), " ")).alias("head"),
        F.concat("lang_key", F.array_join(F.slice("pieces", F.col("k") + 1, F.col("words") - F.col("k")), " ")).alias("tail"),
    )
    singles = keyed.where(F.col("words") < most_words)
    both = _with_count(_with_count(cuts, "head", singles, "l").drop("head"), "tail", singles, "r").drop("tail")
    scored = both.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("words", "lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    lowest = written(lowest.select("words", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")

    inside = candidates.where("words > 2").select(
        "words", "lang", F.col("n").alias("longer"), F.split("phrase", " ").alias("pieces")
    )
    for_each = F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1),
            lambda start: F.array_join(F.slice(F.col("pieces"), start, size), " "),
        ),
    )
    inside = inside.select("lang", "longer", F.explode(F.flatten(for_each)).alias("phrase"))
    cover = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    dropped = F.coalesce(
        F.lit(100).cast("decimal(3,0)") * F.col("longer") >= F.lit(covered).cast("decimal(3,0)") * F.col("a"), F.lit(False)
    )
    left = lowest.join(cover, ["lang", "phrase"], "left").where(~dropped)

    # A language is ranked in parts by a hash of the phrase; their first rows are few.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    in_part = Window.partitionBy("lang", "salt").orderBy(*order)
    first = salted.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= per_lang).drop("rank")
    in_lang = Window.partitionBy("lang").orderBy(*order)
    ranked = first.withColumn("rank", F.row_number().over(in_lang).cast("long")).where(F.col("rank") <= per_lang)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


def oracle() -> str:
    """The same collocations from counts of all phrases."""
    return f"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents),
words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
phrases AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM words, range(1, {MOST_WORDS + 1}) AS s(size), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i))
  GROUP BY lang, size, phrase),
frequent AS MATERIALIZED (SELECT * FROM phrases WHERE f >= {LEAST_COUNT}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT lang, size, phrase, f AS a, k,
    array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM frequent, range(1, {MOST_WORDS}) AS cut(k) WHERE size > 1 AND k < size),
scored AS (
  SELECT c.*, h.f AS l, t.f AS r,
    (({MILLION}::HUGEINT * a::HUGEINT * a::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN phrases h ON h.lang = c.lang AND h.phrase = c.head AND h.size = k
  JOIN phrases t ON t.lang = c.lang AND t.phrase = c.tail AND t.size = c.size - k
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS part
  FROM frequent, range(1, 3) AS s(i) WHERE size = 3),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM longer g WHERE s.size = 2 AND g.lang = s.lang AND g.part = s.phrase AND 100 * g.f >= {COVERED} * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {PER_LANG}
"""
