"""Plain versions of the operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import xxhash

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, lang string, place long, rank int, bucket string, print string, score double"

SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "Two words"),
    (6, SENTENCE),
    (7, SENTENCE),
    (7, SENTENCE),
    (8, SENTENCE.upper() + " upsilon."),
    (None, SENTENCE),
    (None, None),
    (9, "x" * 30_000),
    (10, " ".join(f"word{i % 977}" for i in range(60_000))),
    (11, "日本語 のテキスト 😀 é İ ß \x00 end\r\n"),
    (12, ("Mail a.b@c.example.com or 10.0.0.1, card 4111 1111 1111 1111 now, tel +1 (212) 555-0100.\n") * 3),
    (-5, "<|endoftext|> isn't special's"),
]


def awkward(spark, rows=AWKWARD):
    """The documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 0, 1, "b", "p", 0.5) for i, t in rows], SCHEMA)


def crc(ids) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))


def overlap(docs, items):
    """(words, hit words, items, digest, contaminated) of every document."""
    windows = defaultdict(set)
    for name, text in items:
        own = words(text)
        size = min(13, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows[tuple(own[i : i + size])].add(str(name))
    sizes = {len(w) for w in windows}
    out = []
    for _, text in docs:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                names = windows.get(tuple(own[i : i + size]), ())
                if names:
                    hit.update(range(i, i + size))
                    found.update(names)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return out


def simhash(text: str | None) -> int:
    own = re.findall("[^\x20\x09-\x0d]+", lowered(text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], distance: int = 2) -> list[int]:
    """For every fingerprint the first place in its component."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)
