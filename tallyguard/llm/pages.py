"""Main text of web pages with a recurrent block labeller.

A page is read into its leaf blocks in order. Each block becomes a vector: a hashed bag of the
tags and attribute words on its path, a hashed bag of its words, and a few ratios. A
bidirectional LSTM reads the whole sequence, so the label of a block depends on the entire page.
The blocks labelled as article text are joined.

The labeller is trained here on generated pages, whose blocks are known by construction: many
layouts with menus, headers, footers, sidebars, notices, adverts, forms and reader comments
around the article.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.workers import map_arrow

# Fixed values of HTML: elements without an end tag, elements whose content isn't shown, elements
# that begin a new block, and elements that a new block of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript svg canvas iframe object title head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul button label".split()
)
ENDS = {
    "p": frozenset("p"),
    "li": frozenset(["li", "p"]),
    "dd": frozenset(["dd", "dt", "p"]),
    "dt": frozenset(["dd", "dt", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("article aside div section main ul ol table form nav footer header blockquote body td th".split())
# What may stand in a head; anything else ends it, as its end tag and the body's tag may be left out.
IN_HEAD = frozenset("base head link meta noscript object script style template title".split())
_ATTRIBUTES = frozenset(["class", "id", "role", "itemprop", "aria-label", "style"])
_PARTS = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


class _Reader(HTMLParser):
    """Collects the leaf blocks of a page; unclosed and misplaced tags are tolerated."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = self.unseen = 0
        self.ended = False

    def read(self, html: str) -> list[Block]:
        self.feed(html)
        self.ended = True
        self.close()
        self.flush()
        return self.blocks

    def parse_comment(self, i, report=1):
        """A comment that nothing ends runs to the end of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ended else end

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(tuple(described for tag, described in self.open if tag in BLOCKS), text, self.linked))
        self.parts, self.linked = [], 0

    def _close(self, place: int) -> None:
        for tag, _ in self.open[place:]:
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
        del self.open[place:]

    def _end(self, tag: str) -> None:
        """Closes the outermost open element of a kind, and what is in it."""
        for place, (opened, _) in enumerate(self.open):
            if opened == tag:
                self._close(place)
                return

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            innermost = self.open[-1][0]
            if tag not in IN_HEAD and innermost == "head" or tag == "body":
                self._end("head")
            elif tag in BLOCKS:
                # An element of the page's text can't stand in a drawing: its end tag is missing.
                self._end("svg")
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            ends = ENDS.get(tag, frozenset(["p"]))
            for place in range(len(self.open) - 1, -1, -1):
                opened = self.open[place][0]
                if opened in ends:
                    self._close(place)
                    break
                if opened in SCOPES and opened not in ends:
                    break
        if tag in VOID:
            return
        words = [tag]
        for name, value in attrs if tag in BLOCKS else ():
            if name == "hidden":
                words.append("hidden:hidden")
            elif name in _ATTRIBUTES and value:
                words += [f"{name}:{part}" for part in _PARTS.findall(value.lower())]
        self.open.append((tag, " ".join(words)))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in BLOCKS:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                self._close(place)
                return

    def handle_data(self, data):
        if self.unseen and self.open[-1][0] == "head" and data.strip():
            self._end("head")
        if self.unseen == 0:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks with visible text, in page order."""
    if not html:
        return []
    return _Reader().read(html)


PATH_SIZE, WORD_SIZE, RATIOS = 128, 16, 6
INPUT = PATH_SIZE + WORD_SIZE + RATIOS
HIDDEN = 12
_DIGIT = re.compile(r"[0-9]")


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Tags and attribute words of the path, the innermost ones counting most."""
    out = np.zeros(PATH_SIZE, dtype=np.float32)
    for depth, described in enumerate(reversed(path)):
        for word in described.split():
            out[zlib.crc32(word.encode()) % PATH_SIZE] += 1.0 if depth == 0 else 0.6
    return np.minimum(out, 2.0)


def block_vector(block: Block) -> np.ndarray:
    out = np.zeros(INPUT, dtype=np.float32)
    out[:PATH_SIZE] = _path_vector(block.path)
    text = block.text
    words = [PATH_SIZE + zlib.crc32(word) % WORD_SIZE for word in text.lower().encode().split()]
    out[: PATH_SIZE + WORD_SIZE] += np.bincount(words, minlength=PATH_SIZE + WORD_SIZE) / max(1, len(words))
    out[-6:] = (
        min(len(text), 1000) / 250,
        min(1.0, block.linked / max(1, len(text))),
        float(text[-1] in ".!?…\"”»"),
        float(len(text) < 40),
        min(len(block.path), 20) / 10,
        len(_DIGIT.findall(text)) / max(1, len(text)),
    )
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Labeller:
        random = np.random.default_rng(seed)
        weights = {}
        for side in "fb":
            weights[f"x{side}"] = random.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
            weights[f"h{side}"] = random.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            weights[f"b{side}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            weights[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1
        weights["o"] = random.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        weights["ob"] = np.zeros(1, dtype=np.float32)
        return cls(weights)

    def _side(self, x: np.ndarray, side: str, keep: bool):
        """States of one direction for (pages, blocks, inputs); steps are kept for training."""
        pages, length = x.shape[:2]
        inputs = x @ self.w["x" + side] + self.w["b" + side]
        h = np.zeros((pages, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.zeros((pages, length, HIDDEN), dtype=np.float32)
        steps = []
        order = range(length) if side == "f" else range(length - 1, -1, -1)
        for t in order:
            z = inputs[:, t] + h @ self.w["h" + side]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                steps.append((t, *before, i, f, o, g, tc))
        return out, steps

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Per page the probability of every block being article text. Pages of a like length go
        through together; zero blocks that fill up a page follow its end and are read last by the
        forward side, first by the backward side, for which each page is aligned to the end."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = order[at : at + max(1, min(128, 20_000 // max(1, len(pages[order[min(at + 127, len(order) - 1)]]))))]
            at += len(group)
            length = max(len(pages[i]) for i in group)
            if not length:
                continue
            front = np.zeros((len(group), length, INPUT), dtype=np.float32)
            back = np.zeros_like(front)
            for k, i in enumerate(group):
                front[k, : len(pages[i])] = pages[i]
                back[k, length - len(pages[i]) :] = pages[i]
            f, _ = self._side(front, "f", keep=False)
            b, _ = self._side(back, "b", keep=False)
            for k, i in enumerate(group):
                n = len(pages[i])
                states = np.concatenate([f[k, :n], b[k, length - n :]], axis=1)
                out[i] = 1 / (1 + np.exp(-(states @ self.w["o"] + self.w["ob"])))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss and its gradients for one page."""
        x = x[None]
        sides = {side: self._side(x, side, keep=True) for side in "fb"}
        states = np.concatenate([sides["f"][0][0], sides["b"][0][0]], axis=1)
        p = 1 / (1 + np.exp(-(states @ self.w["o"] + self.w["ob"])))
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        delta = ((p - y) / len(y)).astype(np.float32)
        grads = {"o": states.T @ delta, "ob": np.array([delta.sum()], dtype=np.float32)}
        d_states = delta[:, None] * self.w["o"]
        for k, side in enumerate("fb"):
            own = d_states[:, k * HIDDEN : (k + 1) * HIDDEN]
            dh = np.zeros((1, HIDDEN), dtype=np.float32)
            dc = np.zeros_like(dh)
            dz_all = np.zeros((x.shape[1], 4 * HIDDEN), dtype=np.float32)
            grad_h = np.zeros_like(self.w["h" + side])
            for t, h, c, i, f, o, g, tc in reversed(sides[side][1]):
                dh = dh + own[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate(
                    [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1
                )
                dz_all[t] = dz[0]
                grad_h += h.T @ dz
                dh = dz @ self.w["h" + side].T
                dc = dc * f
            grads["x" + side] = x[0].T @ dz_all
            grads["h" + side] = grad_h
            grads["b" + side] = dz_all.sum(axis=0)
        return loss, grads


class _Templates:
    """Generates pages whose blocks are known."""

    # Names that sites give to their parts.
    NAMES = {
        "menu": "menu nav navigation navbar topnav breadcrumb breadcrumbs mainmenu links toc",
        "header": "header masthead banner top logo branding sitehead",
        "footer": "footer colophon bottom copyright legal sitefoot imprint",
        "sidebar": "sidebar aside related widget rail secondary recommended trending more",
        "notice": "notice cookie consent alert gdpr popup modal banner message warning",
        "ad": "ad ads advert advertisement sponsor sponsored promo promotion partner",
        "form": "form search subscribe newsletter login signup contact",
        "comments": "comments comment reply replies discussion responses disqus thread reader",
        "article": "article content post entry main story body text page single",
    }
    PHRASES = {
        "menu": "home|about|contact|news|archive|products|blog|help|next|previous|inicio|accueil|startseite|kontakt",
        "header": "welcome to our site|daily news|the journal|your source|menu",
        "footer": "© all rights reserved|privacy policy|terms of use|imprint · contact|powered by|copyright 2020",
        "sidebar": "related articles|read more|popular posts|you may also like|follow us|tags",
        "notice": "we use cookies to improve your experience|accept all|this site uses cookies|subscribe to continue",
        "ad": "advertisement|sponsored content|buy now and save|limited offer|click here|free shipping today",
        "form": "enter your email|search|subscribe|sign up|password|submit|your name",
        "comments": "reply|great article thank you|i do not agree with this|posted by|comments|report|like",
    }
    SYLLABLES = "an be con de en er es fi ga ha in ka la lo ma men ne on or pa que ra re se sch ta te ti tion un ver wo".split()

    def __init__(self, seed: int):
        self.random = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.random.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        count = int(self.random.integers(low, high + 1))
        return " ".join("".join(self.pick(self.SYLLABLES) for _ in range(int(self.random.integers(1, 4)))) for _ in range(count))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.pick([".", ".", ".", "!", "?", ""])

    def attributes(self, part: str) -> str:
        if self.random.random() < 0.2:
            return ""
        name = self.pick(self.NAMES[part].split())
        return f' {self.pick(["class", "class", "id"])}="{self.pick(["", "site-", "c-", "block "])}{name}{self.pick(["", "-wrap", " clearfix", "-1"])}"'

    def outside(self, part: str) -> list[tuple[str, int]]:
        """A part around the article, as (markup or text, label) pieces; a label of -1 is markup."""
        tag = {
            "menu": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"],
            "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "section", "dialog"],
            "ad": ["div", "div", "aside", "ins"], "form": ["form"], "comments": ["section", "div", "ul", "ol"],
        }[part]
        tag, attributes = self.pick(tag), self.attributes(part)
        if tag in ("div", "section", "ul", "ol", "ins") and not attributes and part in ("comments", "sidebar", "notice", "ad"):
            attributes = f' class="{self.pick(self.NAMES[part].split())}"'
        out: list[tuple[str, int]] = [(f"<{tag}{attributes}>", -1)]
        if part == "menu":
            listed = self.random.random() < 0.7
            if listed and tag != "ul":
                out.append(("<ul>", -1))
            for _ in range(int(self.random.integers(2, 9))):
                phrase = self.pick(self.PHRASES["menu"].split("|")) if self.random.random() < 0.5 else self.words(1, 2)
                out += [("<li>" if listed else "<div>", -1), ('<a href="/x">', -1), (phrase, 0), ("</a>", -1), ("</li>" if listed else "</div>", -1)]
            if listed and tag != "ul":
                out.append(("</ul>", -1))
        else:
            inner = self.pick(["p", "div", "li", "span", "label" if part == "form" else "p"])
            pieces = int(self.random.integers(1, 6 if part in ("comments", "sidebar", "footer") else 3))
            for _ in range(pieces):
                long = part in ("comments", "ad", "footer", "sidebar", "notice") and self.random.random() < 0.6
                text = self.sentence(4, 40) if long else self.pick(self.PHRASES[part].split("|"))
                if part == "footer" and self.random.random() < 0.5:
                    text = "&copy; " + text
                if inner == "span":
                    out += [("<div><span>", -1), (text, 0), ("</span></div>", -1)]
                else:
                    linked = self.random.random() < 0.3
                    out += [(f"<{inner}>" + '<a href="#">' * linked, -1), (text, 0), ("</a>" * linked + f"</{inner}>", -1)]
        out.append((f"</{tag}>", -1))
        return out

    def article(self) -> list[tuple[str, int]]:
        tag = self.pick(["article", "article", "article", "main", "div", "section"])
        attributes = self.attributes("article") if tag in ("article", "main") else f' class="{self.pick(self.NAMES["article"].split())}"'
        if tag == "article" and self.random.random() < 0.5:
            attributes = ""
        out: list[tuple[str, int]] = [(f"<{tag}{attributes}>", -1)]
        if self.random.random() < 0.85:
            head = self.pick(["h1", "h1", "h2"])
            out += [(f"<{head}>", -1), (self.sentence(1, 12), 1), (f"</{head}>", -1)]
        for _ in range(int(self.random.integers(1, 14))):
            kind = self.random.random()
            if kind < 0.1:
                out += [("<h2>", -1), (self.words(1, 6), 1), ("</h2>", -1)]
            elif kind < 0.16:
                out += [("<ul>", -1)]
                for _ in range(int(self.random.integers(2, 5))):
                    out += [("<li>", -1), (self.sentence(1, 14), 1), ("</li>", -1)]
                out += [("</ul>", -1)]
            elif kind < 0.2:
                out += [("<blockquote>", -1), (self.sentence(4, 30), 1), ("</blockquote>", -1)]
            else:
                if kind > 0.95 and len(out) > 4:
                    out += self.outside(self.pick(["ad", "notice", "form", "sidebar"]))
                short = self.random.random() < 0.25
                text = self.sentence(1, 4) if short else " ".join(self.sentence(3, 20) for _ in range(int(self.random.integers(1, 5))))
                if self.random.random() < 0.12:
                    text = text.replace(" ", self.pick([" | ", "!! ", "*** ", ", ", " 7 "])) + self.pick(["", " |", ","])
                if self.random.random() < 0.06:
                    text = text.upper()
                bold = self.random.random() < 0.1
                out += [("<p>" + "<b>" * bold, -1), (text, 1), (self.pick(["</p>", "</p>", "<br>", ""]), -1)]
        out.append((f"</{tag}>", -1))
        return out

    def page(self) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = [("<html><head><title>x</title></head><body>", -1)]
        chance = self.random.random
        before = [p for p, often in (("header", 0.4), ("notice", 0.3), ("menu", 0.85), ("form", 0.2), ("ad", 0.5), ("sidebar", 0.2)) if chance() < often]
        after = [p for p, often in (("ad", 0.2), ("comments", 0.4), ("sidebar", 0.3), ("form", 0.2), ("notice", 0.1), ("menu", 0.1), ("footer", 0.9)) if chance() < often]
        wrapped = chance() < 0.4
        if wrapped:
            out.append((self.pick(['<div class="wrapper">', '<div id="page">', "<div>", '<div class="container">']), -1))
        for part in before:
            out += self.outside(part)
        if chance() < 0.97:
            article = self.article()
            if "comments" in after and chance() < 0.3:
                after.remove("comments")
                article = article[:-1] + self.outside("comments") + article[-1:]
            out += article
        for part in after:
            out += self.outside(part)
        return out + [("</div>" * wrapped + "</body></html>", -1)]


def training_page(templates: _Templates) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a generated page's blocks. Texts carry their label through the
    reader as a private-use character, which is taken off before the vectors are made."""
    html = "".join(piece if label < 0 else chr(0xE000 + label) + piece for piece, label in templates.page())
    vectors, labels = [], []
    for block in leaf_blocks(html):
        marks = [c for c in block.text if "" <= c <= ""]
        text = "".join(c for c in block.text if not "" <= c <= "")
        if text:
            vectors.append(block_vector(Block(block.path, text, min(block.linked, len(text)))))
            labels.append(float(marks[:1] == [""]))
    return np.array(vectors, dtype=np.float32).reshape(-1, INPUT), np.array(labels)


@lru_cache(maxsize=2)
def train(pages: int = 2400, seed: int = 7, rate: float = 0.01, batch: int = 8) -> Labeller:
    """Trains the labeller on generated pages by Adam; the same arguments give the same model."""
    templates, labeller = _Templates(seed), Labeller.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in labeller.w.items()}
    second = {k: np.zeros_like(v) for k, v in labeller.w.items()}
    steps = pages // batch
    for step in range(1, steps + 1):
        total = {k: np.zeros_like(v) for k, v in labeller.w.items()}
        for _ in range(batch):
            x, y = training_page(templates)
            if len(x):
                for k, g in labeller.gradients(x, y)[1].items():
                    total[k] += g / batch
        norm = float(np.sqrt(sum((g**2).sum() for g in total.values())))
        now = rate * (1 - 0.9 * step / steps)
        for k, g in total.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            labeller.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return labeller


def main_text(blocks: list[Block], probabilities: np.ndarray) -> str:
    return "\n\n".join(b.text for b, p in zip(blocks, probabilities, strict=True) if p >= 0.5)


PAGES_AT_ONCE = 256

_RESULT = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("text", pa.string()),
        ("n_chars", pa.int64()),
        ("n_blocks", pa.int64()),
        ("n_kept", pa.int64()),
    ]
)
_RESULT_DDL = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def _extract(labeller: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                pages = [leaf_blocks(html.as_py()) for html in batch.column(2)]
                vectors = [
                    np.array([block_vector(b) for b in blocks], dtype=np.float32).reshape(-1, INPUT) for blocks in pages
                ]
                kept = labeller.probabilities(vectors)
                texts = [main_text(blocks, p) for blocks, p in zip(pages, kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([len(b) for b in pages], pa.int64()),
                        pa.array([int((p >= 0.5).sum()) for p in kept], pa.int64()),
                    ],
                    schema=_RESULT,
                )

    return run


def extract(
    pages: DataFrame,
    labeller: Labeller | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per page: id, url, main text, its code points, and the numbers of blocks and of kept ones.

    Null and empty pages have an empty text. Character references are decoded, white space in a
    block is one space, blocks are joined by an empty line. Rows with the same id are read each
    by itself. An empty table gives no rows. Without a labeller the standard one is trained.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return map_arrow(rows, _extract(labeller or train()), _RESULT_DDL)
