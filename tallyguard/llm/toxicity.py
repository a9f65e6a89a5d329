"""Toxicity scores from a fuzzy lexicon and the context of its hits.

A lexicon of words and word beginnings is learned from labelled documents: terms that are much
more frequent in toxic ones. Its trie is intersected with a Levenshtein automaton, so that
misspelled terms are found as well. Every hit has the weight of its term; hits in quotations or
after reporting words count little. A document's features are the heaviest window of words and
totals over the whole text, and a logistic classifier turns them into a probability.

The labelled rows that are fitted are a sample of bounded size. Lexicon and classifier are fitted
on two different parts of it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.workers import map_arrow

TRAINING_ROWS = 10_000
LEXICON_SIZE = 2_000
FOLDS = 5
WINDOW = 60
QUOTED = 0.2
FUZZY = 0.5
FUZZY_LENGTH = 5
STEMS = range(4, 9)
QUOTE_REACH = 60
REPORT_REACH = 3
REMEMBERED = 500_000

# Opening and closing quotation marks, and words that report speech.
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORTING = frozenset(
    "said says called quote quoted quotes word term wrote dit disait appelé mot sagte sagt nannte wort dijo dice llamó palabra".split()
)

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def word_of(token: str) -> str:
    """The lower-cased token without marks at its edges."""
    return token if token.isalpha() else _EDGES.sub("", token)


@dataclass
class Node:
    children: dict[str, int] = field(default_factory=dict)
    weight: float = 0.0
    term: str = ""
    stem: float = 0.0
    stem_term: str = ""


class FuzzyTrie:
    """The trie of a lexicon, walked by a Levenshtein automaton of one edit.

    A state is a set of (node, edits); states and their transitions are made when a word first
    needs them. Words of ``FUZZY_LENGTH`` letters or more match with one edit, all terms match
    exactly, and stems match the beginning of a longer word exactly.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], common: frozenset[str] = frozenset()):
        self.nodes = [Node()]
        self.common = common
        for term, weight in words.items():
            node = self._node(term)
            node.weight, node.term = weight, term
        for term, weight in stems.items():
            node = self._node(term)
            node.stem, node.stem_term = weight, term
        self.letters = frozenset(c for node in self.nodes for c in node.children)
        self.states: list[frozenset[tuple[int, int]]] = []
        self.numbers: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _node(self, term: str) -> Node:
        at = 0
        for c in term:
            if c not in self.nodes[at].children:
                self.nodes[at].children[c] = len(self.nodes)
                self.nodes.append(Node())
            at = self.nodes[at].children[c]
        return self.nodes[at]

    def _state(self, items: set[tuple[int, int]]) -> int:
        skipped = {(child, 1) for node, edits in items if edits == 0 for child in self.nodes[node].children.values()}
        best: dict[int, int] = {}
        for node, edits in items | skipped:
            best[node] = min(edits, best.get(node, 1))
        key = frozenset(best.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            for c, child in self.nodes[node].children.items():
                if c == letter:
                    items.add((child, edits))
                elif edits == 0:
                    items.add((child, 1))
            if edits == 0:
                items.add((node, 1))
        return self._state(items) if items else -1

    def match(self, word: str) -> tuple[str, float] | None:
        """The term of most weight that the word stands for, and its weight."""
        state, best = self.start, ("", 0.0)
        for at, c in enumerate(word):
            letter = c if c in self.letters else "\0"
            moves = self.moves[state]
            if letter not in moves:
                moves[letter] = self._move(state, letter)
            state = moves[letter]
            if state < 0:
                break
            if STEMS[0] <= at + 1 < len(word):
                for node, edits in self.states[state]:
                    if edits == 0 and self.nodes[node].stem > best[1]:
                        best = (self.nodes[node].stem_term, self.nodes[node].stem)
        if state >= 0 and word:
            for node, edits in self.states[state]:
                found = self.nodes[node]
                if edits and (len(found.term) < FUZZY_LENGTH or word in self.common):
                    continue
                weight = found.weight * (FUZZY if edits else 1)
                if weight > best[1]:
                    best = (found.term, weight)
        return best if best[1] > 0 else None


class _Hits(dict):
    """Remembers the hit of every token; starts anew when it is full."""

    def __init__(self, trie: FuzzyTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> float:
        found = self.trie.match(word_of(token))
        if len(self) >= REMEMBERED:
            self.clear()
        weight = self[token] = found[1] if found else 0.0
        return weight


def quoted_places(tokens: list[str]) -> list[tuple[int, int]]:
    """Ranges of tokens in quotation marks that close within ``QUOTE_REACH`` tokens."""
    out, opened = [], -1
    for i, token in enumerate(tokens):
        bare = token.rstrip(".,;:!?")
        if opened < 0 and token[0] in OPENING:
            opened = i
        if opened >= 0 and len(bare) > (i == opened) and bare[-1] in CLOSING:
            out.append((opened, i))
            opened = -1
        elif opened >= 0 and i - opened >= QUOTE_REACH:
            opened = -1
    return out


FEATURES = 6


def features(text: str | None, hits: _Hits) -> list[float]:
    """Heaviest window, logarithm of the total, weight per word, quoted weight, different hits
    and length of a text."""
    tokens = text.lower().split() if text else []
    found = [(i, w) for i, w in enumerate(map(hits.__getitem__, tokens)) if w > 0]
    if not found:
        return [0.0] * (FEATURES - 1) + [math.log1p(len(tokens))]
    quotes = quoted_places(tokens)
    plain, quoted = [], 0.0
    for i, weight in found:
        before = {word_of(t) for t in tokens[max(0, i - REPORT_REACH) : i]}
        if before & REPORTING or any(a <= i <= b for a, b in quotes):
            quoted += weight
            weight *= QUOTED
        plain.append((i, weight))
    heaviest = total = 0.0
    window, at = 0.0, 0
    for i, weight in plain:
        window += weight
        total += weight
        while plain[at][0] <= i - WINDOW:
            window -= plain[at][1]
            at += 1
        heaviest = max(heaviest, window)
    different = len({tokens[i] for i, _ in found})
    return [
        min(heaviest, 30.0),
        math.log1p(total),
        100 * total / (len(tokens) + 20),
        math.log1p(quoted),
        math.log1p(different),
        math.log1p(len(tokens)),
    ]


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    common: frozenset[str]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def hits(self) -> _Hits:
        return _Hits(FuzzyTrie(self.words, self.stems, self.common))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(rows)), (rows - self.center) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch: terms, whether they are stems, and their documents by label."""
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = {word_of(t) for t in (text.as_py() or "").lower().split()}
            stems = {w[:n] for w in words for n in STEMS if len(w) > n}
            for terms, stem in ((words, False), (stems, True)):
                for term in terms:
                    if 2 < len(term) <= 40:
                        counts[term, stem][toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.bool_()),
                pa.array([counts[k][0] for k in keys], pa.int64()),
                pa.array([counts[k][1] for k in keys], pa.int64()),
            ],
            names=["term", "stem", "clean", "toxic"],
        )


_TERMS = "term string, stem boolean, clean long, toxic long"


def learn_lexicon(rows: DataFrame, clean: int, toxic: int) -> tuple[dict, dict, frozenset[str]]:
    """Words and stems with their log-odds, at most ``LEXICON_SIZE`` of each, and the clean words
    that are one edit from a term. ``rows`` hold doc_id, text and toxic."""
    least = max(3, toxic // 200)
    counted = (
        map_arrow(rows, _terms, _TERMS)
        .groupBy("term", "stem")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    terms = counted.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds >= 1.2")
    best = [
        terms.where(F.col("stem") == stem).orderBy(F.desc("odds"), F.desc("toxic"), "term").limit(LEXICON_SIZE).collect()
        for stem in (False, True)
    ]
    words = {r["term"]: r["odds"] for r in best[0] if r["odds"] >= 2}
    stems = {r["term"]: r["odds"] for r in best[1]}
    trie = FuzzyTrie(words, {})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t for t in batch.column(0).to_pylist() if t not in words and trie.match(t)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["term"])

    ordinary = map_arrow(counted.where(~F.col("stem") & (F.col("clean") > 0)).select("term"), near, "term string")
    common = frozenset(r["term"] for r in ordinary.collect()) if words else frozenset()
    return words, stems, common


def fit_classifier(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a logistic regression; without both labels only the prior."""
    center = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES)
    scale = np.maximum(rows.std(axis=0), 1e-6) if len(rows) else np.ones(FEATURES)
    weights = np.zeros(FEATURES + 1)
    weights[0] = math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else -3.0
    if not 0 < labels.sum() < len(labels):
        return center, scale, weights
    x = np.c_[np.ones(len(rows)), (rows - center) / scale]
    ridge = np.diag([1e-6] + [0.3] * FEATURES)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ weights)
        weights = weights - step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
    return center, scale, weights


def _feature_rows(words: dict, stems: dict, common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(FuzzyTrie(words, stems, common))
        for batch in batches:
            rows = [features(t.as_py(), hits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(2)], names=["x", "toxic"]
            )

    return run


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: CRC-32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    training_rows: int = TRAINING_ROWS,
) -> ToxicityModel:
    """Learns from labelled rows that aren't held out; beyond ``training_rows`` from a sample of
    about that size, drawn by a hash of the id.

    Rows without id or label teach nothing; an id with several labels is toxic if one says so.
    Without labels the score is a small constant; with one label only, the prior.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    total = known.count()
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000))
    sample = known.where(part < int(1_000_000 * min(1.0, training_rows / max(total, 1))))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", "toxic")
    )
    first = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(100)) < 60
    sizes = {r["toxic"]: r["count"] for r in rows.where(first).groupBy("toxic").count().collect()}
    words, stems, common = learn_lexicon(rows.where(first), sizes.get(0, 0), sizes.get(1, 0))
    fitted = map_arrow(
        rows.where(~first), _feature_rows(words, stems, common), "x array<double>, toxic int"
    ).collect()
    x = np.array([r["x"] for r in fitted], dtype=float).reshape(len(fitted), FEATURES)
    y = np.array([r["toxic"] for r in fitted], dtype=float)
    return ToxicityModel(words, stems, common, *fit_classifier(x, y))


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in batches:
            rows = np.array([features(t.as_py(), hits) for t in batch.column(1)]).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.probability(rows))], names=["doc_id", "score"]
            )

    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, whether its labels are held out, probability of being toxic, and the prediction at one
    half, for every row. Null texts are empty and get a score too; a null id counts as learned
    from, as it never has a label."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = map_arrow(rows, _score(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _keep(model: ToxicityModel, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rows = np.array([features(t.as_py(), hits) for t in texts]).reshape(batch.num_rows, FEATURES)
            yield batch.filter(pa.array(model.probability(rows) < limit))

    return run


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows whose string column ``text`` scores below the limit, with all their columns."""
    return map_arrow(docs, _keep(model, limit), docs.schema)
