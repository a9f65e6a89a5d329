"""Personal data by weak supervision.

Strict patterns find the base spans, which always stay. Looser patterns give further candidates.
Four labelers vote on every candidate (yes, no, or no opinion): its form, a gazetteer of known
beginnings and endings, cue words around it, and its grouping. The votes are counted over the
whole table, expectation-maximisation estimates how reliable each labeler is for each kind, and
a logistic span classifier is trained on the resulting probabilities. Candidates that it accepts
are added.

Candidates carry a code of their kind, votes and length, so what comes to the driver is one
count for each code, at most ``4 * 2 * 3**4 * 4``.
"""

from __future__ import annotations

import hashlib

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.workers import map_arrow
from tallyguard.session import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns, with possessive repeats where those match alike.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser patterns for candidates.
_SPELLED_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT|@) ?[\])] ?[A-Za-z0-9-]{1,63}+"
    r"(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}+){1,8}+"
)
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\) ?|0?[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
_WORTH_A_LOOK = re.compile(r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]")

# The gazetteer and the cue words.
ENDINGS = frozenset("com org net edu gov info biz io de fr es uk eu us ca au ch at it nl be pt mx ar br in jp".split())
CARD_STARTS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6011|65|35|3[068]")
CALLING_CODES = re.compile(r"\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
CUES = {
    EMAIL: frozenset("email e-mail mail contact write correo courriel kontakt address mailto".split()),
    IP: frozenset("ip host server address addr client login peer node dirección adresse".split()),
    CARD: frozenset("card visa mastercard amex credit debit payment karte tarjeta carte paid".split()),
    PHONE: frozenset("tel phone call fax mobile cell telefon teléfono téléphone ruf sms whatsapp".split()),
}
COUNTER_CUES = frozenset("version order invoice item isbn token hash id serial build page chapter license licence".split())
CUE_REACH = 60

_WORD = re.compile(r"[\w-]+")
LABELERS = 4


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ outwards in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    spans = [(s, EMAIL, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            spans.append((m.start(), PHONE, m.end()))
    return sorted(spans)


def _loose_spans(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _SPELLED_EMAIL.finditer(text):
        yield m.start(), EMAIL, m.end()
    for m in _IP.finditer(text):
        yield m.start(), IP, m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 64 and 12 <= len(_digits(m.group())) <= 19:
            yield m.start(), CARD, m.end()
    for m in _LOCAL_PHONE.finditer(text):
        yield m.start(), PHONE, m.end()


def _form(kind: int, span: str, base: bool) -> int:
    """The pattern labeler: the strict pattern, or the check digit or range that fails."""
    return 1 if base else -1 if kind in (CARD, IP) else 0


def _gazetteer(kind: int, span: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")] "))[-1].lower() in ENDINGS else -1
    if kind == IP:
        first = span.split(".")[0]
        return 1 if len(first) <= 3 and 0 < int(first) < 224 else -1
    digits = _digits(span)
    if kind == CARD:
        return 1 if CARD_STARTS.match(digits) else -1
    if span.startswith("+"):
        return 1 if CALLING_CODES.match(span) else -1
    return 1 if digits.startswith("0") or len(digits) == 10 else 0


def _context(kind: int, text: str, start: int, end: int) -> int:
    around = text[max(0, start - CUE_REACH) : start] + " " + text[end : end + CUE_REACH // 2]
    words = set(_WORD.findall(around.lower()))
    return 1 if words & CUES[kind] else -1 if words & COUNTER_CUES else 0


def _grouping(kind: int, span: str) -> int:
    """The shape labeler: usual lengths and separators."""
    parts = [len(p) for p in re.split(r"[^0-9A-Za-z]+", span) if p]
    if kind == CARD:
        total = sum(parts)
        if len(parts) == 1:
            return 1 if total in (15, 16) else 0
        return 1 if parts in ([4] * 4, [4, 6, 5]) else -1
    if kind == IP:
        return 1 if max(parts) <= 3 else -1
    if kind == PHONE:
        return 1 if 3 <= len(parts) <= 5 and parts[-1] in (3, 4) else 0
    return 1 if len(parts) >= 3 else 0


def code_of(kind: int, base: bool, votes: tuple[int, ...], length: int) -> int:
    code = kind * 2 + base
    for vote in votes:
        code = code * 3 + vote + 1
    return code * 4 + min(3, length // 8)


def parts_of(code: int) -> tuple[int, bool, tuple[int, ...], int]:
    code, size = divmod(code, 4)
    votes = []
    for _ in range(LABELERS):
        code, vote = divmod(code, 3)
        votes.append(vote - 1)
    return code // 2, bool(code % 2), tuple(votes[::-1]), size


def candidates(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of the base spans and of the further candidates that touch none
    of them, sorted."""
    if not text or _WORTH_A_LOOK.search(text) is None:
        return []
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    found = [(s, k, e, True) for s, k, e in base]
    at = 0
    for start, kind, end in sorted(set(_loose_spans(text))):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if not any(s < end and start < e for s, e in taken[at : at + 8]):
            found.append((start, kind, end, False))
    out = []
    for start, kind, end, strict in found:
        span = text[start:end]
        votes = (_form(kind, span, strict), _gazetteer(kind, span), _context(kind, text, start, end), _grouping(kind, span))
        out.append((start, kind, end, code_of(kind, strict, votes, end - start)))
    return sorted(out)


_SPANS = pa.schema(
    [("doc_id", pa.int64())] + [(name, pa.list_(pa.int32())) for name in ("starts", "kinds", "ends", "codes")]
)
_SPANS_DDL = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, codes array<int>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [candidates(t.as_py()) for t in batch.column(1)]
        columns = [
            pa.array([[span[i] for span in spans] for spans in found], pa.list_(pa.int32())) for i in range(4)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_SPANS)


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers by kind, and the probability of every code that was met."""

    reliability: dict[int, tuple[float, np.ndarray]]
    probability: dict[int, float]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over votes in {-1, 0, 1}: the share of true spans, for each
    labeler its vote distribution given false and true (labelers, 2, 3), and each row's
    probability. It starts from the labelers being right in 80 of 100 cases."""
    start = np.array([[0.4, 0.4, 0.2], [0.2, 0.4, 0.4]])
    tables, share = np.repeat(start[None], votes.shape[1], axis=0), 0.5
    column = votes + 1
    posterior = np.full(len(votes), 0.5)
    for _ in range(rounds):
        logs = np.log(np.array([1 - share, share]))[None, :] + sum(
            np.log(tables[i][:, column[:, i]].T) for i in range(votes.shape[1])
        )
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        for i in range(votes.shape[1]):
            for c in range(2):
                seen = np.bincount(column[:, i], weights=weight[c], minlength=3) + 20 * start[c]
                tables[i, c] = seen / seen.sum()
    return share, tables, posterior


def _features(codes: list[int]) -> np.ndarray:
    rows = []
    for code in codes:
        kind, _, votes, size = parts_of(code)
        row = [1.0] + [float(kind == k) for k in range(4)] + [float(size == k) for k in range(4)]
        for k in range(4):
            row += [float(v) * (kind == k) for v in votes]
        rows.append(row)
    return np.array(rows).reshape(len(codes), 25)


def train(counted: dict[int, int]) -> SpanModel:
    """Estimates the labelers' reliability on the counts of the codes and fits the classifier."""
    codes = sorted(counted)
    if not codes:
        return SpanModel({}, {})
    counts = np.array([counted[c] for c in codes], dtype=float)
    kinds = np.array([parts_of(c)[0] for c in codes])
    votes = np.array([parts_of(c)[2] for c in codes])
    target, reliability = np.zeros(len(codes)), {}
    for kind in sorted(set(kinds.tolist())):
        own = kinds == kind
        share, tables, posterior = estimate(votes[own], counts[own])
        reliability[kind] = (share, tables)
        target[own] = posterior
    features, weights = _features(codes), np.zeros(25)
    scale = counts / counts.sum() * len(codes)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (scale * (p - target)) + 0.01 * weights
        curve = (features * (scale * p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(25)
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
    return SpanModel(reliability, dict(zip(codes, p.tolist(), strict=True)))


def _chosen(spans: list[tuple[int, int, int, int]], model: SpanModel, least: float) -> list[tuple[int, int, int, bool]]:
    """Base spans and the accepted candidates; of overlapping candidates the likelier stays."""
    base = [(s, k, e, True) for s, k, e, code in spans if parts_of(code)[1]]
    more = [(-model.probability.get(code, 0.0), s, k, e) for s, k, e, code in spans if not parts_of(code)[1]]
    kept: list[tuple[int, int, int, bool]] = []
    for p, start, kind, end in sorted(more):
        if -p >= least and all(e <= start or end <= s for s, _, e, _ in kept):
            kept.append((start, kind, end, False))
    return sorted(base + kept)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


_RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{kind}", pa.int64()) for kind in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)
_RESULT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _classify(model: SpanModel, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for name, *spans in zip(*columns, strict=True):
                chosen = _chosen(list(zip(*spans, strict=True)), model, least)
                base = [s for s in chosen if s[3]]
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((name, *counts, digest, _joined(chosen), len(chosen) - len(base)))
            filled = list(zip(*rows, strict=True)) or [[]] * len(_RESULT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(filled, _RESULT, strict=True)], schema=_RESULT
            )

    return run


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates of every row, written to the shared folder: they are read twice."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(map_arrow(rows, _find, _SPANS_DDL), "spans")


def train_on(found: DataFrame) -> SpanModel:
    """The model of a table of candidates; one count for each code comes to the driver."""
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    return train({r["code"]: r["count"] for r in counts})


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """Per row: numbers of base spans by kind, SHA-256 of the base spans, all spans as
    kind:start:end (code points, end exclusive) by start and kind, and how many were added.

    Null texts are empty and have no spans. Rows with the same id are judged each by itself. An
    added span touches no base span; of two that overlap the likelier one stays, on a tie the
    earlier one. Without candidates nothing is trained. An empty table gives no rows.
    """
    found = find_candidates(docs, id_col, text_col)
    return map_arrow(found, _classify(train_on(found), least), _RESULT_DDL)


def _mask(model: SpanModel, least: float):
    def masked(text: str | None) -> str | None:
        spans = _chosen(candidates(text), model, least)
        if not spans:
            return text
        out, at = [], 0
        for start, kind, end, _ in spans:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = pa.array([masked(t.as_py()) for t in batch.column(place)], pa.string())
            yield batch.set_column(place, batch.schema.field(place), texts)

    return run


def mask_personal_data(docs: DataFrame, model: SpanModel, least: float = 0.5) -> DataFrame:
    """The rows with every span in the string column ``text`` replaced by its kind in brackets;
    of spans that overlap, the first names the gap. All other columns stay as they are."""
    return map_arrow(docs, _mask(model, least), docs.schema)
